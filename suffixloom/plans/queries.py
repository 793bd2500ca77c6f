"""The registered queries over the driver's tables, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ortho, scores
from ..operators import counts, decode, sampler, splits, trie, vectors
from ..sources import raw_tokens
from ..sources.sinks import bigram_lines, count_lines, dump_lines, result_lines, trie_lines
from .views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def add(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def r9(x):
    return F.round(x, 9)


def seg(column: str = "morphs"):
    return F.array_join(column, "+").alias("seg")


# Sources and tries


@query("SELECT word, freq FROM lex", "lex")
def lexicon_freq(v: Views) -> DataFrame:
    return v.lexicon()


@query("SELECT word, freq FROM lex WHERE freq >= 20 AND length(word) > 1", "lex")
def word_list_threshold(v: Views) -> DataFrame:
    return v.lexicon(20).where("length(word) > 1")


@query(r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \n\r]+')) AS word FROM documents) WHERE length(word) >= 2 AND NOT regexp_matches(word, '^[0-9]') GROUP BY word")
def raw_token_freq(v: Views) -> DataFrame:
    return counts.token_frequency(raw_tokens(v.table("documents")))


@query("SELECT trie_id, prefix, n_children, is_word FROM tn", "tn")
def trie_branching(v: Views) -> DataFrame:
    return v.nodes()


@query("SELECT trie_id, prefix FROM bd", "bd")
def trie_boundaries(v: Views) -> DataFrame:
    return v.bounds()


@query("SELECT prefix, CAST(count(DISTINCT CASE WHEN k = length(word) THEN '$' ELSE substring(word, k + 1, 1) END) AS INT) AS n_children FROM (SELECT word, substring(word, 1, k) AS prefix, k FROM pk) GROUP BY prefix", "pk")
def single_trie(v: Views) -> DataFrame:
    return trie.trie_nodes(trie.single(v.words())).select("prefix", "n_children")


@query("SELECT trie_id, word, array_to_string(morphs, '+') AS seg FROM seg", "seg")
def boundary_segment(v: Views) -> DataFrame:
    return v.segments().select("trie_id", "word", seg())


@query("SELECT morph, n FROM mc", "mc")
def morpheme_freq(v: Views) -> DataFrame:
    return v.counts()


@query("SELECT morphs[-1] AS morph, count(*) AS n FROM seg GROUP BY 1", "seg")
def last_morph_freq(v: Views) -> DataFrame:
    return trie.last_morph_counts(v.segments())


@query("SELECT trie_id, array_to_string(list_sort(list(morph)), ' ') AS tokens FROM mt GROUP BY trie_id", "mt")
def trie_tokens(v: Views) -> DataFrame:
    return trie.trie_tokens(v.segments()).select("trie_id", F.array_join("tokens", " ").alias("tokens"))


_CUM = "cum AS (SELECT trie_id, word, i, array_to_string(morphs[1:i], '') AS prefix, len(morphs) AS n FROM (SELECT trie_id, word, morphs, unnest(range(1, len(morphs) + 1)) AS i FROM seg))"


@query(None)
def cumulative_prefixes(v: Views) -> DataFrame:
    rows = v.segments().select("word", F.posexplode(trie.prefixes_of()).alias("pos", "prefix"))
    return rows.select("word", (F.col("pos") + 1).cast("bigint").alias("i"), "prefix")


SQL["cumulative_prefixes"] = with_views("SELECT word, i, array_to_string(morphs[1:i], '') AS prefix FROM (SELECT word, morphs, unnest(range(1, len(morphs) + 1)) AS i FROM seg)", "seg")


@query(f"SELECT DISTINCT a.trie_id, a.prefix, b.prefix AS neighbour FROM (SELECT * FROM (WITH {_CUM} SELECT * FROM cum)) a JOIN (SELECT * FROM (WITH {_CUM} SELECT * FROM cum)) b ON a.trie_id = b.trie_id AND a.word = b.word AND b.i = a.i + 1 SEMI JOIN bd ON a.trie_id = bd.trie_id AND a.prefix = bd.prefix", "seg", "bd")
def boundary_neighbours(v: Views) -> DataFrame:
    return trie.neighbours(v.segments(), v.bounds())


@query("SELECT morph, CAST(sum(d) AS BIGINT) AS n FROM (SELECT morph, n AS d FROM mc UNION ALL SELECT morph, -1 FROM mt WHERE length(trie_id) = 3 UNION ALL SELECT word, 1 FROM tw WHERE length(trie_id) = 3) GROUP BY morph HAVING sum(d) <> 0", "mc", "mt", "tw")
def delta_counts(v: Views) -> DataFrame:
    old = v.segments().where("length(trie_id) = 3")
    new = old.select("trie_id", "word", F.array("word").alias("morphs"))
    return trie.changed_counts(v.counts(), old, new)


@query("SELECT word FROM w WHERE starts_with(word, 'th')", "w")
def prefix_search(v: Views) -> DataFrame:
    return trie.keys_with_prefix(v.words(), "th").select("word")


@query("SELECT word FROM w WHERE regexp_full_match(word, 't..n')", "w")
def wildcard_match(v: Views) -> DataFrame:
    return trie.keys_that_match(v.words(), "t..n").select("word")


@query("SELECT q.word AS query, coalesce(arg_max(k.word, length(k.word)), '') AS found FROM lex q LEFT JOIN (SELECT q2.word, substring(q2.word, 1, kk) AS pre, kk FROM (SELECT word, unnest(range(1, length(word) + 1)) AS kk FROM lex) q2) x ON q.word = x.word LEFT JOIN w k ON x.pre = k.word GROUP BY 1", "lex", "w")
def longest_prefix(v: Views) -> DataFrame:
    queries = v.lexicon().select(F.col("word").alias("query"))
    return trie.longest_prefix(queries, v.words(), "")


@query("SELECT word, freq FROM w ANTI JOIN wf USING (word)", "w", "wf")
def anti_filter(v: Views) -> DataFrame:
    return trie.without_keys(v.words(), v.frequent())


@query("SELECT word, freq FROM lex SEMI JOIN (SELECT DISTINCT stem FROM st) s ON lex.word = s.stem", "lex", "st")
def semi_filter(v: Views) -> DataFrame:
    stems = v.segments().select(F.element_at("morphs", 1).alias("word"))
    return v.lexicon().join(stems, "word", "left_semi")


@query("SELECT t.word, coalesce(freq, 1) AS freq FROM (SELECT DISTINCT morph AS word FROM mc) t LEFT JOIN wf USING (word)", "mc", "wf")
def freq_left_join(v: Views) -> DataFrame:
    return v.counts().select(F.col("morph").alias("word")).join(v.frequent(), "word", "left").select("word", F.coalesce("freq", F.lit(1)).alias("freq"))


@query("SELECT k.word AS child, arg_max(p.word, (length(p.word), p.word)) AS parent FROM wf k LEFT JOIN wf p ON contains(k.word, p.word) AND k.word <> p.word GROUP BY 1", "wf")
def containment_tree(v: Views) -> DataFrame:
    return trie.containment_parents(v.frequent())


# Splits


@query("SELECT word, idx, stem, suffix FROM bs", "bs")
def binary_splits(v: Views) -> DataFrame:
    return splits.binary_splits(v.words())


@query(
    "SELECT word, 2 AS m, substring(word, 1, i) || '-' || substring(word, i + 1) AS seg FROM (SELECT word, unnest(range(1, length(word))) AS i FROM wf) "
    "UNION ALL SELECT word, 3, substring(word, 1, i) || '-' || substring(word, i + 1, j - i) || '-' || substring(word, j + 1) FROM (SELECT word, i, unnest(range(i + 1, length(word))) AS j FROM (SELECT word, unnest(range(1, length(word))) AS i FROM wf)) "
    "UNION ALL SELECT word, 4, substring(word, 1, i) || '-' || substring(word, i + 1, j - i) || '-' || substring(word, j + 1, k - j) || '-' || substring(word, k + 1) FROM (SELECT word, i, j, unnest(range(j + 1, length(word))) AS k FROM (SELECT word, i, unnest(range(i + 1, length(word))) AS j FROM (SELECT word, unnest(range(1, length(word))) AS i FROM wf)))",
    "wf",
)
def multi_cut_splits(v: Views) -> DataFrame:
    return splits.multi_cut_splits(v.frequent()).select("word", "m", F.array_join("morphs", "-").alias("seg"))


@query('SELECT prefix, "left" FROM pl', "pl")
def prefix_pairs(v: Views) -> DataFrame:
    return splits.prefix_pairs(v.words())


@query("SELECT word, array_to_string(morphs, '+') AS seg FROM tl", "tl")
def tilings(v: Views) -> DataFrame:
    words, morphs = v.frequent().select("word"), v.decode_probs().select("morph")
    return splits.tilings(words, morphs).select("word", seg())


_U = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) / 4503599627370496.0"


@query(
    "SELECT word, substring(word, 1, length(word) - k) AS stem, CASE WHEN k = 0 THEN '$' ELSE substring(word, length(word) - k + 1, k) END AS suffix FROM "
    f"(SELECT word, CAST(floor({_U.format(chr(39).join(['word || ', '|biased|42', '']))} * CASE WHEN length(word) > 4 THEN 5 ELSE length(word) END) AS INT) AS k FROM w)",
    "w",
)
def biased_splits(v: Views) -> DataFrame:
    return splits.biased_binary_split(v.words())


@query(None)
def random_splits(v: Views) -> DataFrame:
    return splits.random_split(v.words()).select("word", seg())


# Scores


@query("SELECT trie_id, prefix, round(pow(4, n_children) * exp(-4) / factorial(n_children), 9) AS p FROM tn", "tn")
def poisson_prior(v: Views) -> DataFrame:
    return v.nodes().select("trie_id", "prefix", r9(scores.poisson(F.col("n_children"), 4.0)).alias("p"))


@query("SELECT p.prefix AS word, round(log10(coalesce(freq, 1e-7) / (SELECT sum(freq) FROM lex)), 9) AS score FROM pp p LEFT JOIN lex ON p.prefix = lex.word", "pp", "lex")
def presence_prior(v: Views) -> DataFrame:
    lex = v.lexicon()
    total = lex.agg(F.sum("freq").alias("total"))
    rows = splits.prefix_pairs(v.words()).select(F.col("prefix").alias("word")).distinct().join(lex, "word", "left").crossJoin(F.broadcast(total))
    return rows.select("word", r9(F.log10(F.coalesce(F.col("freq").cast("double"), F.lit(1e-7)) / F.col("total"))).alias("score"))


@query("SELECT word, round(log10(pow(0.037, length(word) // len(morphs))), 9) AS score FROM seg", "seg")
def length_prior(v: Views) -> DataFrame:
    return v.segments().select("word", r9(scores.length_prior(F.length("word"), F.size("morphs"))).alias("score"))


@query("SELECT morph, round(ln(pow(1 / 29.0, length(morph) + 1)), 9) AS score FROM mc", "mc")
def affix_prior(v: Views) -> DataFrame:
    return v.counts().select("morph", r9(scores.affix_prior(F.length("morph"))).alias("score"))


@query("SELECT word, translate(word, 'öçüığş', 'OCUIGS') AS tr, replace(replace(replace(replace(word, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') AS ger FROM w", "w")
def ortho_maps(v: Views) -> DataFrame:
    return v.words().select("word", ortho.turkish_ascii(F.col("word")).alias("tr"), ortho.german_map(F.col("word")).alias("ger"))


@query("SELECT CASE WHEN morph = 'ken' THEN morph ELSE translate(morph, 'aeıitdcçkğ', 'HHHHDDCCGG') END AS class, CAST(sum(n) AS BIGINT) AS n FROM mc GROUP BY 1", "mc")
def allomorph_class(v: Views) -> DataFrame:
    return v.counts().groupBy(ortho.allomorph_class(F.col("morph")).alias("class")).agg(F.sum("n").alias("n"))


# Counts and probabilities


@query("SELECT morph, n, round(p, 9) AS p FROM pr", "pr")
def unigram_prob(v: Views) -> DataFrame:
    return counts.unigram_probs(v.counts()).select("morph", "n", r9("p").alias("p"))


@query("SELECT CASE WHEN pos = 1 THEN 'stem' ELSE 'suffix' END AS kind, morph, CAST(sum(freq) AS BIGINT) AS n FROM mt JOIN w ON mt.word = w.word GROUP BY 1, 2", "mt", "w")
def init_counts_uni(v: Views) -> DataFrame:
    return counts.init_unigrams(v.segments().join(v.words(), "word"), True, F.col("freq"))


@query("SELECT first, second, n FROM bg", "bg")
def init_counts_bi(v: Views) -> DataFrame:
    return counts.init_bigrams(v.segments())


@query("SELECT bg.first, bg.second, bg.n, round(bg.n / CAST(mc.n AS DOUBLE), 9) AS p FROM bg JOIN mc ON bg.first = mc.morph", "bg", "mc")
def bigram_prob(v: Views) -> DataFrame:
    return counts.bigram_probs(counts.init_bigrams(v.segments()), v.counts()).select("first", "second", "n", r9("p").alias("p"))


def _weighted(v: Views) -> DataFrame:
    return v.segments().join(v.words(), "word")


@query("SELECT first, second, n FROM tr", "tr")
def transition_counts(v: Views) -> DataFrame:
    return counts.transition_counts(_weighted(v), F.col("freq"))


@query("SELECT a.morph AS first, round(1.0 / (a.n + (SELECT count(*) FROM tm)), 9) AS p0 FROM tm a", "tm")
def transition_unseen(v: Views) -> DataFrame:
    return counts.laplace_unseen(counts.transition_morphs(_weighted(v), F.col("freq"))).select("first", r9("p0").alias("p0"))


@query("SELECT tr.first, tr.second, round((tr.n + 1) / CAST(tm.n + (SELECT count(*) FROM tm) AS DOUBLE), 9) AS p FROM tr JOIN tm ON tr.first = tm.morph", "tr", "tm")
def transition_laplace(v: Views) -> DataFrame:
    rows = _weighted(v)
    return counts.laplace_transitions(counts.transition_counts(rows, F.col("freq")), counts.transition_morphs(rows, F.col("freq"))).select("first", "second", r9("p").alias("p"))


@query("SELECT stem AS morph, CAST(sum(freq) AS BIGINT) AS n, round(sum(freq) / CAST(sum(sum(freq)) OVER () AS DOUBLE), 9) AS p FROM st GROUP BY stem", "st")
def stem_prob(v: Views) -> DataFrame:
    return counts.stem_probs(_weighted(v), F.col("freq")).select("morph", "n", r9("p").alias("p"))


@query("SELECT coalesce(t.prefix, lex.word) AS word, CAST(round(coalesce(freq, 0) + CAST(0.1 AS DOUBLE), 9) AS DOUBLE) AS mass FROM (SELECT DISTINCT prefix FROM tn) t FULL JOIN lex ON t.prefix = lex.word", "tn", "lex")
def smoothed_corpus(v: Views) -> DataFrame:
    return counts.smoothed_corpus(v.nodes(), v.lexicon(), 0.1).select("word", r9("mass").alias("mass"))


@query("SELECT token, CAST(sum(d) AS BIGINT) AS diff FROM (SELECT word AS token, -1 AS d FROM tw UNION ALL SELECT morph, 1 FROM mt) GROUP BY 1 HAVING sum(d) <> 0", "tw", "mt")
def multiset_diff(v: Views) -> DataFrame:
    s = v.segments()
    return counts.multiset_diff(s.select(F.col("word").alias("token")), s.select(F.explode("morphs").alias("token")))


# Decoders


@query(
    "SELECT wf.word, coalesce(array_to_string(morphs, '+'), wf.word) AS seg, round(score, 9) AS score FROM wf LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, ends) AS r FROM tl) WHERE r = 1) f ON wf.word = f.word",
    "tl",
)
def decode_unigram(v: Views) -> DataFrame:
    return decode.decode_unigram(v.frequent(), v.decode_probs()).select("word", seg(), r9("score").alias("score"))


_BI = (
    "SELECT word, array_to_string(morphs, '+') AS seg, round(score, 9) AS score FROM (SELECT word, morphs, score, row_number() OVER (PARTITION BY word ORDER BY score DESC, ends) AS r FROM ("
    "SELECT x.word, x.morphs, x.ends, log10(any_value(s.p)) + sum(log10(coalesce(bg.n / CAST(c.n AS DOUBLE), 0.01) / c.n)) AS score, count(*) AS k FROM "
    "(SELECT *, CASE WHEN len(morphs) = 1 THEN list_concat(morphs, ['$']) ELSE morphs END AS m, unnest(range(1, greatest(len(morphs), 2))) AS i FROM tl) x "
    "JOIN pd s ON s.morph = x.morphs[1] JOIN pd c ON c.morph = x.m[i] LEFT JOIN bg ON bg.first = x.m[i] AND bg.second = x.m[i + 1] "
    "GROUP BY x.word, x.morphs, x.ends HAVING count(*) = greatest(len(x.morphs), 2) - 1)) WHERE r = 1"
)


@query(_BI, "tl", "bg", "pd")
def decode_bigram(v: Views) -> DataFrame:
    probs = v.decode_probs()
    tiled = splits.tilings(v.frequent().select("word"), probs.select("morph"))
    bigrams = counts.bigram_probs(counts.init_bigrams(v.segments()), probs.select("morph", "n"))
    return decode.decode_bigram(tiled, probs, bigrams).select("word", seg(), r9("score").alias("score"))


@query(
    "SELECT wf.word, CASE WHEN g.ok THEN array_to_string(g.morphs, '+') ELSE coalesce(array_to_string(f.morphs, '+'), wf.word) END AS seg FROM wf "
    "LEFT JOIN (SELECT word, morphs, true AS ok FROM seg WHERE len(list_filter(morphs, lambda m: m NOT IN (SELECT morph FROM pd))) = 0) g ON wf.word = g.word "
    "LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, ends) AS r FROM tl) WHERE r = 1) f ON wf.word = f.word".replace(
        "SELECT word, morphs, true AS ok FROM seg WHERE len(list_filter(morphs, lambda m: m NOT IN (SELECT morph FROM pd))) = 0",
        "SELECT mt.word, any_value(seg.morphs) AS morphs, true AS ok FROM mt JOIN seg ON mt.word = seg.word LEFT JOIN pd ON pd.morph = mt.morph GROUP BY mt.word HAVING count(*) = count(pd.morph)",
    ),
    "tl", "seg", "mt",
)
def decode_model_path(v: Views) -> DataFrame:
    return decode.decode_model(v.frequent(), v.segments(), v.decode_probs()).select("word", seg())


def _transitions(v: Views):
    rows = _weighted(v)
    morphs = counts.transition_morphs(rows, F.col("freq"))
    trans = counts.laplace_transitions(counts.transition_counts(rows, F.col("freq")), morphs)
    stems = counts.stem_probs(rows, F.col("freq"))
    affixes = morphs.where(~F.col("morph").isin("STR", "END"))
    tiled = decode.stem_tilings(v.frequent().select("word"), stems, affixes)
    return tiled, stems, trans, counts.laplace_unseen(morphs)


_RS = """
, stems AS (SELECT stem, sum(freq) / CAST(sum(sum(freq)) OVER () AS DOUBLE) AS p FROM st GROUP BY stem),
v AS (SELECT count(*) AS v FROM tm),
af AS (SELECT morph FROM tm WHERE morph NOT IN ('STR', 'END')),
rt AS (
  SELECT wf.word, length(stem) AS b, [stem] AS morphs, [length(stem)] AS ends, ln(p) AS score, 'STR' AS prev
  FROM wf JOIN stems ON starts_with(wf.word, stem) AND length(stem) >= 2 AND stem <> wf.word
  UNION ALL
  SELECT rt.word, b + length(af.morph), list_append(morphs, af.morph), list_append(ends, b + length(af.morph)),
         score + ln((coalesce(tr.n, 0) + 1) / CAST(a.n + v.v AS DOUBLE)), af.morph
  FROM rt JOIN af ON substring(rt.word, b + 1, length(af.morph)) = af.morph JOIN tm a ON a.morph = rt.prev CROSS JOIN v
  LEFT JOIN tr ON tr.first = rt.prev AND tr.second = af.morph WHERE b < length(rt.word)
),
done AS (
  SELECT rt.word, morphs, ends, score + ln((coalesce(tr.n, 0) + 1) / CAST(a.n + v.v AS DOUBLE)) AS score
  FROM rt JOIN tm a ON a.morph = rt.prev CROSS JOIN v LEFT JOIN tr ON tr.first = rt.prev AND tr.second = 'END' WHERE b = length(word)
)
"""


def _resegment_sql(score: str) -> str:
    head = with_views("", "st", "tm", "tr", "wf").rstrip()
    return head + _RS + f"SELECT word, array_to_string(morphs, '+') AS seg, round(score, 9) AS score FROM (SELECT word, morphs, {score} AS score, row_number() OVER (PARTITION BY word ORDER BY {score} DESC, ends) AS r FROM done) WHERE r = 1"


@query(None)
def resegment_map(v: Views) -> DataFrame:
    return decode.resegment(decode.transition_score(*_transitions(v))).select("word", seg(), r9("score").alias("score"))


SQL["resegment_map"] = _resegment_sql("score")


@query(None)
def resegment_len_prior(v: Views) -> DataFrame:
    scored = decode.transition_score(*_transitions(v))
    prior = F.expr("aggregate(slice(morphs, 2, size(morphs) - 1), 0D, (s, m) -> s + ln(pow(1 / 29D, length(m) + 1)))")
    return decode.resegment(decode.add_prior(scored, prior)).select("word", seg(), r9("score").alias("score"))


SQL["resegment_len_prior"] = _resegment_sql("score + list_sum([ln(pow(1 / 29.0, length(m) + 1)) for m in morphs[2:]])")


def _chained(v: Views, prior) -> DataFrame:
    tiled, *model = _transitions(v)
    scored = decode.transition_score(tiled, *model)
    return decode.resegment(prior(scored, decode.chain_cosines(tiled, v.vectors()))).select("word", seg(), r9("score").alias("score"))


@query(None)
def resegment_binomial_np(v: Views) -> DataFrame:
    return _chained(v, decode.binomial_np)


@query(None)
def resegment_binomial_c(v: Views) -> DataFrame:
    return _chained(v, decode.binomial_c)


@query(None)
def resegment_semantic(v: Views) -> DataFrame:
    return _chained(v, decode.semantic_prior)


# Vectors

_COS = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({1} AS DOUBLE[]), CAST({1} AS DOUBLE[]))))"


@query(f'SELECT "left", prefix, CASE WHEN c IS NULL OR c < 0 OR c > 1 THEN -1.0 ELSE round(c, 9) END AS cosine FROM (SELECT pl."left", pl.prefix, {_COS.format("a.vec", "b.vec")} AS c FROM pl LEFT JOIN vc a ON pl."left" = a.word LEFT JOIN vc b ON pl.prefix = b.word)', "pl", "vc")
def cosine_table(v: Views) -> DataFrame:
    return vectors.cosine_table(v.words(), v.vectors()).select("left", "prefix", r9("cosine").alias("cosine"))


@query(f"SELECT word, neighbour, round(c, 6) AS cosine, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY round(c, 12) DESC, neighbour) AS rank FROM (SELECT a.word, b.word AS neighbour, {_COS.format('a.vec', 'b.vec')} AS c FROM (SELECT * FROM vc WHERE vec_id % 20 = 0) a JOIN vc b ON a.word <> b.word)) WHERE rank <= 5", "vc")
def knn_topk(v: Views) -> DataFrame:
    vs = v.vectors()
    return vectors.nearest(vs.where("vec_id % 20 = 0").select("word"), vs, 5).select("word", "neighbour", F.round("cosine", 6).alias("cosine"), "rank")


@query(None)
def nested_segment(v: Views) -> DataFrame:
    return vectors.nested_segment(v.lexicon(), v.vectors(), 0.05).select("word", "freq", "found", seg())


@query(None)
def multisplit_top10(v: Views) -> DataFrame:
    return vectors.top_splits(vectors.multi_splits(v.vectors().select("word"), v.vectors()))


# Samplers


def _posterior_sql(grams: str, model: str, separated: bool) -> str:
    """The same distribution as SQL over the binary splits."""
    a, g, d = "0.01", "0.037", "1"
    stems = "(SELECT m[1] AS morph, count(*) AS n FROM mk GROUP BY 1)" if separated else "(SELECT morph, count(*) AS n FROM (SELECT unnest(m) AS morph FROM mk) GROUP BY 1)"
    suffixes = "(SELECT morph, count(*) AS n FROM (SELECT unnest(m[2:]) AS morph FROM mk) GROUP BY 1)" if separated else stems
    own_s = "(SELECT word, m[1] AS morph, 1 AS k FROM mk)" if separated else "(SELECT word, morph, count(*) AS k FROM (SELECT word, unnest(m) AS morph FROM mk) GROUP BY 1, 2)"
    own_f = "(SELECT word, morph, count(*) AS k FROM (SELECT word, unnest(m[2:]) AS morph FROM mk) GROUP BY 1, 2)" if separated else own_s
    own_b = "(SELECT word, m[i] AS first, m[i + 1] AS second, count(*) AS k FROM (SELECT word, m, unnest(range(1, len(m))) AS i FROM mk) GROUP BY 1, 2, 3)"
    d_s, d_f = ("1", "len(mk.m) - 1") if separated else ("len(mk.m)", "len(mk.m)")
    one = "0" if separated else "1"
    ls, lf = "CASE WHEN stem = '$' THEN 0 ELSE length(stem) END", "CASE WHEN suffix = '$' THEN 0 ELSE length(suffix) END"
    nf = f"(nf + CASE WHEN stem = suffix THEN {one} ELSE 0 END)"
    n_f = f"(N_f + {one})"
    tf = "T_f" if separated else "(T_f + CASE WHEN ns = 0 THEN 1 ELSE 0 END)"
    bs, bf = f"pow({g}, {ls} + 1)", f"pow({g}, {lf} + 1)"

    def uni(n, total, types, base, bare=False):
        if model == "ml":
            return f"CASE WHEN {n} > 0 THEN {n} / {total} ELSE 0.01 / {total} END"
        if model == "dp":
            return f"CASE WHEN {n} > 0 THEN {n} / ({total} + {a}) ELSE {a} * {base} / ({total} + {a}) END"
        return f"CASE WHEN {n} > 0 THEN ({n} - {d}) / ({total if bare else f'({total} + {a})'}) ELSE ({a} + {d} * {types}) * {base} / ({total} + {a}) END"

    stem = uni("ns", "N_s", "T_s", bs, separated and grams == "uni")
    if grams == "uni":
        second = uni(nf, n_f, tf, bf)
    else:
        if model == "ml":
            seen, back = "nsf / ns", uni(nf, n_f, tf, bf)
        elif model == "dp":
            seen, back = f"nsf / ns + {a}", f"{a} * ({uni(nf, n_f, tf, bf)})"
        else:
            seen = f"(nsf - {d}) / ns + {a}"
            back = f"({a} + {d} * B) * (CASE WHEN {nf} > 0 THEN {nf} - {d} ELSE ({a} + {d} * {tf}) * {bf} END) / ({n_f} + {a})"
        second = f"CASE WHEN ns > 0 AND nsf > 0 THEN {seen} ELSE {back} END"
    return with_views(
        f"""SELECT word, idx, stem, suffix, round(weight / nullif(sum(weight) OVER (PARTITION BY word), 0), 9) AS prob FROM (
SELECT word, idx, stem, suffix, CASE WHEN x <= 0 OR y <= 0 THEN 0 ELSE pow(10, log10(x) + log10(y)) END AS weight FROM (
SELECT *, CAST({stem} AS DOUBLE) AS x, CAST({second} AS DOUBLE) AS y FROM (
SELECT bs.word, bs.idx, bs.stem, bs.suffix, CAST(coalesce(s.n, 0) - coalesce(os.k, 0) AS DOUBLE) AS ns, CAST(coalesce(f.n, 0) - coalesce(of.k, 0) AS DOUBLE) AS nf, CAST(coalesce(bg.n, 0) - coalesce(ob.k, 0) AS DOUBLE) AS nsf,
  (SELECT CAST(sum(n) AS DOUBLE) FROM {stems}) - {d_s} AS N_s, (SELECT CAST(count(*) AS DOUBLE) FROM {stems}) AS T_s,
  (SELECT CAST(sum(n) AS DOUBLE) FROM {suffixes}) - ({d_f}) AS N_f, (SELECT CAST(count(*) AS DOUBLE) FROM {suffixes}) AS T_f,
  (SELECT CAST(count(DISTINCT first) AS DOUBLE) FROM bg) AS B
FROM bs JOIN mk ON mk.word = bs.word LEFT JOIN {stems} s ON s.morph = bs.stem LEFT JOIN {suffixes} f ON f.morph = bs.suffix LEFT JOIN bg ON bg.first = bs.stem AND bg.second = bs.suffix
LEFT JOIN {own_s} os ON os.word = bs.word AND os.morph = bs.stem LEFT JOIN {own_f} of ON of.word = bs.word AND of.morph = bs.suffix
LEFT JOIN {own_b} ob ON ob.word = bs.word AND ob.first = bs.stem AND ob.second = bs.suffix)))""",
        "bs", "mk", "bg",
    )


def _add_posterior(grams: str, model: str, separated: bool) -> None:
    name = f"posterior_{grams}_{'sep' if separated else 'unified'}_{model}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = Views(spark, sf_dir)
        segments = v.segments()
        out = sampler.posterior(segments, sampler.count_tables(segments, separated), grams, model, separated)
        return out.select("word", "idx", "stem", "suffix", r9("prob").alias("prob"))

    QUERIES[name] = run
    SQL[name] = _posterior_sql(grams, model, separated)


for _g in ("uni", "bi"):
    for _s in (False, True):
        for _m in ("ml", "dp", "py"):
            _add_posterior(_g, _m, _s)


@query(None)
def gibbs_sweep_1(v: Views) -> DataFrame:
    return sampler.gibbs_sweep(v.segments(), "bi", "dp", True).select("word", seg())


@query(
    "SELECT word, CAST(pos - 1 AS INT) AS pos, morph, round(log10(CASE WHEN n > 0 THEN n / (total + 0.01) ELSE 0.01 * pow(0.037, length(morph) + 1) / (total + 0.01) END), 9) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY morph ORDER BY word, pos) - 1 AS DOUBLE) AS n, CAST(row_number() OVER (ORDER BY word, pos) - 1 AS DOUBLE) AS total FROM mt)",
    "mt",
)
def joint_score(v: Views) -> DataFrame:
    return sampler.sequential_dp(v.segments(), 0.01, 0.037).select("word", "pos", "morph", r9("score").alias("score"))


# Sinks


@query("SELECT morph || ':' || n AS value FROM mc", "mc")
def sink_counts(v: Views) -> DataFrame:
    return count_lines(v.counts())


@query("SELECT first || '>' || second || ':' || n AS value FROM bg", "bg")
def sink_bigrams(v: Views) -> DataFrame:
    return bigram_lines(counts.init_bigrams(v.segments()))


@query("SELECT morph || ' : ' || n AS value FROM mc", "mc")
def sink_dump(v: Views) -> DataFrame:
    return dump_lines(v.counts(), "n")


@query("SELECT translate(word, 'öçüığş', 'OCUIGS') || chr(9) || translate(array_to_string(morphs, ' '), 'öçüığş', 'OCUIGS') AS value FROM seg", "seg")
def sink_results(v: Views) -> DataFrame:
    return result_lines(v.segments())


@query("SELECT trie_id, array_to_string(list_sort(list(CASE WHEN len(morphs) > 1 THEN array_to_string(morphs[:-2], '') || ' ' || morphs[-1] ELSE word END)), '_') AS value FROM seg GROUP BY trie_id", "seg")
def sink_tries(v: Views) -> DataFrame:
    return trie_lines(v.segments())
