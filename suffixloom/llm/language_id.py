"""Operator 7: language of texts by a linear-chain conditional random field over their words.

Affix, n-gram and lexicon features and learned transitions label every word by forward-backward, so a text that
switches languages is read piece by piece; a document's language is the label of largest mean probability.  The field is
fitted on the driver to a bounded sample of labelled rows, ``SAMPLE`` for each language with at most ``SAMPLE_CHARS``
characters each, chosen by a hash of the text, and sent to the workers: ``BUCKETS`` weights for each language, whatever
the corpus's size.  Whole texts are labelled, in spans of words that each see some words of their neighbours.  Nothing is
shuffled but label counts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if no row is labelled.
Rows without identifier are never trained on.  Rows repeat as in the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read_table

SAMPLE = 150
SAMPLE_CHARS = 20_000


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS):
    """A model from a sample of the labelled rows."""
    from ._crf import train, words_of

    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND text RLIKE '\\\\p{L}' AND length(text) <= %d" % sample_chars)
    counts = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return train([])
    share = 1 << 30
    cut = F.lit(0)
    for lang, n in sorted(counts.items()):
        cut = F.when(F.col("lang") == lang, min(share, -(-share * sample // n))).otherwise(cut)
    # the hash takes equal texts together; about `sample` rows of a language pass
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(share)) < cut).limit(8 * sample * len(counts))
    texts = sorted({(r.text, r.lang) for r in chosen.collect()})
    return train([(words_of(t), lang) for t, lang in texts])


def identify(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, n_words, n_switches."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(it):
        import pandas as pd

        for pdf in it:
            made = _read(sent, pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **{c: [m[k] for m in made] for k, c in enumerate(("lang_pred", "score", "n_words", "n_switches"))}})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, lang_pred string, score double, n_words long, n_switches long")


def _read(sent, texts: list[str | None]) -> list[tuple[str, float, int, int]]:
    from ._arrow_text import batches
    from ._crf import words_of
    from ._worker import claim

    claim("language", _readers.clear)
    reader = _reader(sent)
    texts = [t or "" for t in texts]
    out = []
    for a, b in batches(texts, 1 << 19):
        words = [words_of(t) for t in texts[a:b]]
        # what the pattern takes for a word may still have no letter
        out += reader.read([w if any(c.isalpha() for x in w for c in x) else [] for w in words])
    return out


_readers: dict[int, object] = {}


def _reader(sent):
    """One reader for each model and worker process."""
    from ._crf import Reader

    key = id(sent.value)
    if key not in _readers:
        _readers.clear()
        _readers[key] = Reader(sent.value)
    return _readers[key]


def keep_identified(docs: DataFrame, model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of the input whose language is known with at least this score, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts):
        import pandas as pd

        return pd.Series([lang != "und" and score >= least for lang, score, _, _ in _read(sent, texts.tolist())], dtype=bool)

    return docs.where(known(F.col(text_col)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where("doc_id IS NOT NULL").where(~held_out()))
    found = identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
