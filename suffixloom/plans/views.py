"""Views of the driver's tables as the inputs of the operators, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counts, trie
from ..sources import lexicon, lexicon_vectors

LEAST = 10  # least frequency of a word of the tries
DECODED = 20  # least frequency of a word that is decoded
MORPH_ABOVE = 25  # decoders keep morphs above this count


class Views:
    """The inputs over one directory of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def lexicon(self, least: int = 1) -> DataFrame:
        return lexicon(self.table("documents"), least)

    def words(self) -> DataFrame:
        return self.lexicon(LEAST)

    def frequent(self) -> DataFrame:
        return self.lexicon(DECODED)

    def trie_words(self) -> DataFrame:
        return trie.by_prefix(self.words())

    def nodes(self) -> DataFrame:
        return trie.trie_nodes(self.trie_words())

    def bounds(self) -> DataFrame:
        return trie.boundaries(self.nodes())

    def segments(self) -> DataFrame:
        return trie.segment(self.trie_words(), self.bounds())

    def counts(self) -> DataFrame:
        return trie.morph_counts(self.segments())

    def decode_probs(self) -> DataFrame:
        return counts.unigram_probs(self.counts().where(F.col("n") > MORPH_ABOVE))

    def vectors(self) -> DataFrame:
        return lexicon_vectors(self.lexicon(), self.table("embeddings"))


_CTES = {
    "tok": (r"SELECT unnest(string_split(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g'), ' ')) AS word FROM documents", ()),
    "lex": ("SELECT word, count(*) AS freq FROM tok WHERE length(word) >= 2 GROUP BY word", ("tok",)),
    "w": (f"SELECT word, freq FROM lex WHERE freq >= {LEAST}", ("lex",)),
    "wf": (f"SELECT word, freq FROM lex WHERE freq >= {DECODED}", ("lex",)),
    "tw": ("SELECT substring(word, 1, 3) AS trie_id, word FROM w", ("w",)),
    "pk": ("SELECT trie_id, word, unnest(range(1, length(word) + 1)) AS k FROM tw", ("tw",)),
    "tn": ("SELECT trie_id, substring(word, 1, k) AS prefix, CAST(count(DISTINCT CASE WHEN k = length(word) THEN '$' ELSE substring(word, k + 1, 1) END) AS INT) AS n_children, bool_or(k = length(word)) AS is_word FROM pk GROUP BY 1, 2", ("pk",)),
    "bd": ("SELECT trie_id, prefix FROM tn WHERE n_children >= 3 AND length(prefix) >= 2", ("tn",)),
    "ct": ("SELECT p.trie_id, p.word, list_sort(list(p.k)) AS cuts FROM pk p JOIN bd b ON p.trie_id = b.trie_id AND substring(p.word, 1, p.k) = b.prefix WHERE p.k < length(p.word) GROUP BY 1, 2", ("pk", "bd")),
    "en": ("SELECT tw.trie_id, tw.word, list_concat(coalesce(cuts, []), [length(tw.word)]) AS ends FROM tw LEFT JOIN ct ON tw.trie_id = ct.trie_id AND tw.word = ct.word", ("tw", "ct")),
    "seg": ("SELECT trie_id, word, [substring(word, CASE WHEN i = 1 THEN 1 ELSE ends[i - 1] + 1 END, ends[i] - CASE WHEN i = 1 THEN 0 ELSE ends[i - 1] END) for i in range(1, len(ends) + 1)] AS morphs FROM en", ("en",)),
    "sf": ("SELECT seg.word, freq, morphs FROM seg JOIN w ON seg.word = w.word", ("seg", "w")),
    "mt": ("SELECT trie_id, word, i AS pos, morphs[i] AS morph FROM (SELECT trie_id, word, morphs, unnest(range(1, len(morphs) + 1)) AS i FROM seg)", ("seg",)),
    "mc": ("SELECT morph, count(*) AS n FROM mt GROUP BY morph", ("mt",)),
    "pr": ("SELECT morph, n, n / CAST(sum(n) OVER () AS DOUBLE) AS p FROM mc", ("mc",)),
    "pd": (f"SELECT morph, n, n / CAST(sum(n) OVER () AS DOUBLE) AS p FROM mc WHERE n > {MORPH_ABOVE}", ("mc",)),
    "mk": ("SELECT word, CASE WHEN len(morphs) = 1 THEN list_concat(morphs, ['$']) ELSE morphs END AS m FROM seg", ("seg",)),
    "bg": ("SELECT first, second, count(*) AS n FROM (SELECT m[i] AS first, m[i + 1] AS second FROM (SELECT m, unnest(range(1, len(m))) AS i FROM mk)) GROUP BY 1, 2", ("mk",)),
    "st": ("SELECT word, freq, list_concat(['STR'], morphs[2:], ['END']) AS m, morphs[1] AS stem FROM sf", ("sf",)),
    "tr": ("SELECT first, second, CAST(sum(freq) AS BIGINT) AS n FROM (SELECT m[i] AS first, m[i + 1] AS second, freq FROM (SELECT m, freq, unnest(range(1, len(m))) AS i FROM st)) GROUP BY 1, 2", ("st",)),
    "tm": ("SELECT morph, CAST(sum(freq) AS BIGINT) AS n FROM (SELECT unnest(m) AS morph, freq FROM st) GROUP BY 1", ("st",)),
    "vc": ("SELECT word, r.vec_id, embedding AS vec FROM (SELECT word, row_number() OVER (ORDER BY freq DESC, word) - 1 AS vec_id FROM lex) r JOIN embeddings e ON r.vec_id = e.vec_id", ("lex",)),
    "cp": ("SELECT trie_id, word, i, len(morphs) AS n, array_to_string(morphs[1:i], '') AS prefix FROM (SELECT trie_id, word, morphs, unnest(range(1, len(morphs) + 1)) AS i FROM seg)", ("seg",)),
    "pp": ("SELECT DISTINCT substring(word, 1, k) AS prefix FROM (SELECT word, unnest(range(2, length(word) + 1)) AS k FROM w)", ("w",)),
    "pl": ("SELECT prefix, substring(prefix, 1, k) AS \"left\" FROM (SELECT prefix, unnest(range(1, length(prefix))) AS k FROM pp)", ("pp",)),
    "tile": (
        "SELECT wf.word, length(morph) AS b, [morph] AS morphs, [length(morph)] AS ends, log10(p) AS score FROM wf JOIN pd ON starts_with(wf.word, morph) "
        "UNION ALL SELECT tile.word, b + length(pd.morph), list_append(morphs, pd.morph), list_append(ends, b + length(pd.morph)), score + log10(p) FROM tile JOIN pd ON substring(tile.word, b + 1, length(pd.morph)) = pd.morph WHERE b < length(tile.word)",
        ("wf", "pd"),
    ),
    "tl": ("SELECT word, morphs, ends, score FROM tile WHERE b = length(word)", ("tile",)),
    "bs": ("SELECT word, idx, substring(word, 1, length(word) - idx) AS stem, CASE WHEN idx = 0 THEN '$' ELSE substring(word, length(word) - idx + 1, idx) END AS suffix FROM (SELECT word, CAST(unnest(range(0, CASE WHEN length(word) >= 6 THEN 5 WHEN length(word) > 1 THEN length(word) - 1 ELSE length(word) END)) AS INT) AS idx FROM w)", ("w",)),
}


def with_views(query: str, *names: str) -> str:
    """The query with the named views and what they need before it."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in _CTES[name][1]:
            need(n)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_CTES[n][0]})" for n in order) + "\n" + query
