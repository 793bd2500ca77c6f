"""Registered queries of priors, samplers, decoders and graphs beyond those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ortho, scores
from ..functions.scores import hash_uniform
from ..operators import counts, decode, priors, sampler, splits, trie, vectors
from ..params import DEFAULT
from .queries import _COS, SQL, _transitions, _weighted, query, r9, seg
from .views import Views, with_views

_P4 = "pow(4, coalesce(n_children, 0)) * exp(-4) / factorial(coalesce(n_children, 0))"
_STORED = "CASE WHEN c IS NULL OR c < 0 OR c > 1 THEN -1.0 ELSE c END"
_CUT = f"CASE WHEN c IS NULL OR c < 0 OR c > 1 OR c < 0.25 THEN 0.001 WHEN c > 0.25 THEN 1.0 ELSE c END"
#: log10 of the Poisson probability as the plans compute it: by the logarithm of the factorial.
_LP = f"log10({_P4})"

# Scores


@query(f'SELECT "left", prefix, CASE WHEN c IS NULL OR c < 0 OR c > 1 THEN 0.1 ELSE round(c, 9) END AS similarity FROM (SELECT pl."left", pl.prefix, {_COS.format("a.vec", "b.vec")} AS c FROM pl LEFT JOIN vc a ON pl."left" = a.word LEFT JOIN vc b ON pl.prefix = b.word)', "pl", "vc")
def live_similarity(v: Views) -> DataFrame:
    rows = priors.live_similarity(splits.prefix_pairs(v.words()), v.vectors(), "left", "prefix", DEFAULT.sim_unfound)
    return rows.select("left", "prefix", r9("similarity").alias("similarity"))


@query(f'SELECT "left", prefix, CASE WHEN c IS NULL OR c < 0 OR c > 1 THEN 0.1 ELSE round(c, 9) END AS looked_up, round({_CUT}, 9) AS cut FROM (SELECT pl."left", pl.prefix, {_COS.format("a.vec", "b.vec")} AS c FROM pl LEFT JOIN vc a ON pl."left" = a.word LEFT JOIN vc b ON pl.prefix = b.word)', "pl", "vc")
def looked_up_similarity(v: Views) -> DataFrame:
    rows = vectors.cosine_table(v.words(), v.vectors())
    c = F.col("cosine")
    return rows.select("left", "prefix", r9(scores.similarity(c, 0.1)).alias("looked_up"), r9(scores.cut_similarity(c, 0.1, 0.001)).alias("cut"))


_STEPS = f"""
, steps AS (
  SELECT a.trie_id, a.word, a.n, a.prefix AS x, b.prefix AS y, {_COS.format("va.vec", "vb.vec")} AS c
  FROM cp a LEFT JOIN cp b ON a.word = b.word AND a.trie_id = b.trie_id AND b.i = a.i + 1
  LEFT JOIN vc va ON va.word = a.prefix LEFT JOIN vc vb ON vb.word = b.prefix
  WHERE a.i < a.n OR a.n = 1
)
"""


def _with_steps(query_: str, *names: str) -> str:
    return with_views("", "cp", "vc", *names).rstrip() + _STEPS + query_


@query(None)
def prior_bundle(v: Views) -> DataFrame:
    rows = priors.prior_bundle(v.segments(), v.nodes(), v.lexicon(), v.vectors())
    return rows.select("trie_id", "word", *(r9(c).alias(c) for c in ("poisson", "similarity", "presence", "length")))


SQL["prior_bundle"] = _with_steps(
    f"SELECT s.trie_id, s.word, round(sum({_LP}), 9) AS poisson, round(sum(CASE WHEN y IS NULL THEN 0.0 ELSE log10({_CUT}) END), 9) AS similarity, "
    "round(sum(log10(coalesce(freq, 1e-7) / (SELECT sum(freq) FROM lex))), 9) AS presence, round(log10(pow(0.037, length(s.word) // any_value(s.n))), 9) AS length "
    "FROM steps s LEFT JOIN tn ON tn.trie_id = s.trie_id AND tn.prefix = s.x LEFT JOIN lex ON lex.word = s.x GROUP BY s.trie_id, s.word",
    "tn", "lex",
)


@query(None)
def step_similarity(v: Views) -> DataFrame:
    return priors.step_similarity(v.segments(), v.vectors(), DEFAULT.sim_unfound).select("word", r9("score").alias("score"))


SQL["step_similarity"] = _with_steps("SELECT word, round(sum(CASE WHEN c = 0 THEN CAST('-inf' AS DOUBLE) ELSE log10(CASE WHEN c IS NULL OR c < 0 OR c > 1 THEN 0.1 ELSE c END) END), 9) AS score FROM steps WHERE y IS NOT NULL GROUP BY word")


_NB = f"""
, nb AS (SELECT DISTINCT a.trie_id, a.prefix, b.prefix AS neighbour FROM cp a JOIN cp b ON a.trie_id = b.trie_id AND a.word = b.word AND b.i = a.i + 1 SEMI JOIN bd ON a.trie_id = bd.trie_id AND a.prefix = bd.prefix),
nc AS (SELECT nb.trie_id, nb.prefix, nb.neighbour, {_COS.format("va.vec", "vb.vec")} AS c FROM nb LEFT JOIN vc va ON va.word = nb.prefix LEFT JOIN vc vb ON vb.word = nb.neighbour),
ns AS (SELECT trie_id, prefix, log10(avg(CASE WHEN c IS NULL OR c < 0 OR c > 1 THEN 1e-12 ELSE c END)) AS score FROM nc GROUP BY 1, 2)
"""


def _with_neighbours(query_: str, *names: str) -> str:
    return with_views("", "cp", "bd", "vc", "tn", *names).rstrip() + _NB + query_


@query(None)
def trie_sums(v: Views) -> DataFrame:
    scores_ = priors.neighbour_scores(trie.neighbours(v.segments(), v.bounds()), v.vectors())
    rows = priors.trie_sums(v.bounds(), v.nodes(), scores_, DEFAULT.poisson_lambda)
    return rows.select("trie_id", r9("poisson").alias("poisson"), r9("similarity").alias("similarity"))


SQL["trie_sums"] = _with_neighbours(f"SELECT bd.trie_id, round(sum({_LP}), 9) AS poisson, round(sum(coalesce(score, 0.0)), 9) AS similarity FROM bd JOIN tn ON bd.trie_id = tn.trie_id AND bd.prefix = tn.prefix LEFT JOIN ns ON bd.trie_id = ns.trie_id AND bd.prefix = ns.prefix GROUP BY 1")


@query(None)
def similarity_report(v: Views) -> DataFrame:
    rows = vectors.pair_cosines(trie.neighbours(v.segments(), v.bounds()), v.vectors(), "prefix", "neighbour")
    return rows.select("trie_id", "prefix", "neighbour", r9("cosine").alias("cosine"))


SQL["similarity_report"] = _with_neighbours("SELECT trie_id, prefix, neighbour, round(c, 9) AS cosine FROM nc")

# Tries and graphs


@query("SELECT trie_id, word, CAST(row_number() OVER (PARTITION BY trie_id ORDER BY word) - 1 AS INT) AS seq FROM tw", "tw")
def trie_get(v: Views) -> DataFrame:
    return trie.insertion_numbers(v.trie_words())


@query("SELECT trie_id AS key, arg_max(word, (freq, word)) AS value FROM (SELECT trie_id, tw.word, freq FROM tw JOIN w ON tw.word = w.word) GROUP BY 1", "tw", "w")
def keyed_put(v: Views) -> DataFrame:
    from ..sources import last_by_order

    rows = v.words().select(F.substring("word", 1, 3).alias("key"), "word", F.struct("freq", "word").alias("turn"))
    return last_by_order(rows, "key", "word", "turn").withColumnRenamed("word", "value")


@query("SELECT trie_id, prefix, n_children FROM tn", "tn")
def branch_factors(v: Views) -> DataFrame:
    return v.nodes().select("trie_id", "prefix", "n_children")


@query("SELECT trie_id, word FROM tw", "tw")
def trie_word_dump(v: Views) -> DataFrame:
    return v.nodes().where("is_word").select("trie_id", F.col("prefix").alias("word"))


@query("SELECT a.word, b.word AS first_word, CAST(count(k) AS INT) AS n FROM (SELECT trie_id, word, unnest(range(1, length(word) + 1)) AS k FROM tw) a JOIN (SELECT trie_id, min(word) AS word FROM tw GROUP BY 1) b ON a.trie_id = b.trie_id WHERE substring(a.word, 1, k) = substring(b.word, 1, k) AND k <= length(b.word) GROUP BY 1, 2", "tw")
def common_prefixes(v: Views) -> DataFrame:
    firsts = v.trie_words().groupBy("trie_id").agg(F.min("word").alias("first_word"))
    return v.trie_words().join(firsts, "trie_id").select("word", "first_word", trie.common_prefix(F.col("word"), F.col("first_word")).alias("n"))


_PARENT = "ct2 AS (SELECT k.word AS child, arg_max(p.word, (length(p.word), p.word)) AS parent FROM wf k LEFT JOIN wf p ON contains(k.word, p.word) AND k.word <> p.word GROUP BY 1)"


@query(None)
def tree_paths(v: Views) -> DataFrame:
    return trie.path_lines(trie.containment_parents(v.frequent()))


SQL["tree_paths"] = with_views("", "wf").rstrip() + f", {_PARENT}, up AS (SELECT child AS path, child AS at FROM ct2 WHERE child NOT IN (SELECT parent FROM ct2 WHERE parent IS NOT NULL) UNION ALL SELECT c.parent || '-->' || up.path, c.parent FROM up JOIN ct2 c ON c.child = up.at WHERE c.parent IS NOT NULL) SELECT path AS value FROM up JOIN ct2 c ON c.child = up.at WHERE c.parent IS NULL"


@query(None)
def tree_cosines(v: Views) -> DataFrame:
    rows = vectors.pair_cosines(trie.containment_parents(v.frequent()), v.vectors(), "child", "parent")
    return rows.select("child", "parent", r9(F.coalesce("cosine", F.lit(-0.5))).alias("cosine"))


SQL["tree_cosines"] = with_views("", "wf", "vc").rstrip() + f", {_PARENT} SELECT child, parent, round(coalesce({_COS.format('a.vec', 'b.vec')}, -0.5), 9) AS cosine FROM ct2 LEFT JOIN vc a ON a.word = child LEFT JOIN vc b ON b.word = parent"


def _knn(v: Views) -> DataFrame:
    vs = v.vectors()
    return vectors.nearest(vs.where("vec_id % 20 = 0").select("word"), vs, 5)


_KNN = f"knn AS (SELECT word, neighbour, c AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY round(c, 12) DESC, neighbour) AS rank FROM (SELECT a.word, b.word AS neighbour, {_COS.format('a.vec', 'b.vec')} AS c FROM (SELECT * FROM vc WHERE vec_id % 20 = 0) a JOIN vc b ON a.word <> b.word)) WHERE rank <= 5)"


@query(None)
def knn_tries(v: Views) -> DataFrame:
    return trie.trie_nodes(trie.knn_tries(_knn(v)))


SQL["knn_tries"] = with_views("", "vc").rstrip() + f", {_KNN}, kt AS (SELECT DISTINCT word AS trie_id, word FROM knn UNION SELECT word, neighbour FROM knn), kk AS (SELECT trie_id, word, unnest(range(1, length(word) + 1)) AS k FROM kt) SELECT trie_id, substring(word, 1, k) AS prefix, CAST(count(DISTINCT CASE WHEN k = length(word) THEN '$' ELSE substring(word, k + 1, 1) END) AS INT) AS n_children, bool_or(k = length(word)) AS is_word FROM kk GROUP BY 1, 2"


@query(None)
def knn_lines(v: Views) -> DataFrame:
    return _knn(v).select(F.concat_ws(" ", "word", "neighbour", F.col("rank").cast("string")).alias("value"))


SQL["knn_lines"] = with_views("", "vc").rstrip() + f", {_KNN.replace('c AS cosine', 'rank')} SELECT word || ' ' || neighbour || ' ' || rank AS value FROM knn"


@query(None)
def similar_closure(v: Views) -> DataFrame:
    near = _knn(v)
    return trie.closure(near.select("word").distinct(), near, least=0.3)


SQL["similar_closure"] = with_views("", "vc").rstrip() + f", {_KNN}, cl AS (SELECT DISTINCT word AS trie_id, word FROM knn UNION SELECT cl.trie_id, knn.neighbour FROM cl JOIN knn ON knn.word = cl.word WHERE knn.cosine > 0.3) SELECT trie_id, word FROM cl"


@query(None)
def stem_closure(v: Views) -> DataFrame:
    near = _knn(v)
    words = near.select("word").distinct()
    return trie.closure(words, near, words.select("word", F.substring("word", 1, 1).alias("stem")))


SQL["stem_closure"] = with_views("", "vc").rstrip() + f", {_KNN}, cl AS (SELECT DISTINCT word AS trie_id, word FROM knn UNION SELECT cl.trie_id, knn.neighbour FROM cl JOIN knn ON knn.word = cl.word WHERE starts_with(knn.neighbour, substring(cl.trie_id, 1, 1))) SELECT trie_id, word FROM cl"

# Splits


@query(
    "SELECT seg.word, morphs[1] || '-' || substring(seg.word, length(morphs[1]) + 1, i) || '-' || substring(seg.word, length(morphs[1]) + i + 1) AS seg FROM (SELECT word, morphs, unnest(range(1, length(word) - length(morphs[1]))) AS i FROM seg WHERE len(morphs) > 1) seg",
    "seg",
)
def fixed_stem_splits(v: Views) -> DataFrame:
    stems = v.segments().where("size(morphs) > 1").select("word", F.element_at("morphs", 1).alias("stem"))
    rows = splits.multi_cut_splits(stems.select("word"), (3,)).join(stems, "word").where(F.element_at("morphs", 1) == F.col("stem"))
    return rows.select("word", F.array_join("morphs", "-").alias("seg"))


_UNI = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) / 4503599627370496.0"


@query(None)
def random_tilings(v: Views) -> DataFrame:
    return splits.random_tiling(v.words()).select("word", seg())


_U_TILE = _UNI.format("word || '|' || p || '|tile|42'")
SQL["random_tilings"] = with_views("", "w").rstrip() + (
    f", rt AS (SELECT word, 0 AS p, CAST([] AS INT[]) AS ends FROM w UNION ALL SELECT word, p + step, list_append(ends, p + step) FROM (SELECT word, p, ends, CAST(floor({_U_TILE} * (length(word) - p - 1)) AS INT) + 1 AS step FROM rt WHERE length(word) - p > 1)) "
    "SELECT word, array_to_string([substring(word, CASE WHEN i = 1 THEN 1 ELSE es[i - 1] + 1 END, es[i] - CASE WHEN i = 1 THEN 0 ELSE es[i - 1] END) for i in range(1, len(es) + 1)], '+') AS seg FROM (SELECT word, list_append(ends, length(word)) AS es FROM rt WHERE length(word) - p <= 1)"
)

# Decoders


@query(
    "SELECT f.word, coalesce(array_to_string(t.morphs, '+'), f.word) AS seg FROM wf f LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, ends) AS r FROM tl WHERE len(morphs) > 1) WHERE r = 1) t ON f.word = t.word",
    "tl",
)
def decode_no_whole(v: Views) -> DataFrame:
    return decode.decode_unigram(v.frequent(), v.decode_probs(), whole=False).select("word", seg())


@query(None)
def decode_sweep(v: Views) -> DataFrame:
    return decode.threshold_sweep(v.frequent(), v.counts()).select("threshold", "word", seg(), r9("score").alias("score"))


@query(None)
def decode_gold(v: Views) -> DataFrame:
    gold = v.lexicon().select("word")
    return decode.decode_model(gold, v.segments(), v.decode_probs()).select("word", seg())


@query(None)
def chained_splits(v: Views) -> DataFrame:
    tiled = _transitions(v)[0]
    return decode.chain_filter(tiled, decode.chain_cosines(tiled, v.vectors())).select("word", seg())


@query(None)
def resegment_stem_prior(v: Views) -> DataFrame:
    scored = decode.transition_score(*_transitions(v))
    prior = F.expr("aggregate(morphs, 0D, (s, m) -> s + ln(pow(1 / 29D, length(m) + 1)))")
    return decode.resegment(decode.add_prior(scored, prior)).select("word", seg(), r9("score").alias("score"))


from .queries import _resegment_sql  # noqa: E402

SQL["resegment_stem_prior"] = _resegment_sql("score + list_sum([ln(pow(1 / 29.0, length(m) + 1)) for m in morphs])")

_CLASS = "CASE WHEN {0} IN ('ken', 'STR', 'END') THEN {0} ELSE translate({0}, 'aeıitdcçkğ', 'HHHHDDCCGG') END"


def _class_transitions(v: Views) -> tuple[DataFrame, DataFrame]:
    rows = counts.allomorph_segments(_weighted(v))
    morphs = counts.transition_morphs(rows, F.col("freq"))
    return morphs, counts.laplace_transitions(counts.transition_counts(rows, F.col("freq")), morphs)


@query(
    f"SELECT t.first, t.second, round((t.n + 1) / CAST(m.n + (SELECT count(*) FROM (SELECT DISTINCT {_CLASS.format('morph')} FROM tm)) AS DOUBLE), 9) AS p FROM "
    f"(SELECT {_CLASS.format('first')} AS first, {_CLASS.format('second')} AS second, CAST(sum(n) AS BIGINT) AS n FROM tr GROUP BY 1, 2) t JOIN "
    f"(SELECT {_CLASS.format('morph')} AS morph, CAST(sum(n) AS BIGINT) AS n FROM tm GROUP BY 1) m ON t.first = m.morph",
    "tr", "tm",
)
def allomorph_transitions(v: Views) -> DataFrame:
    return _class_transitions(v)[1].select("first", "second", r9("p").alias("p"))


def resegment_allomorph(v: Views) -> DataFrame:
    tiled, stems, _, _ = _transitions(v)
    morphs, trans = _class_transitions(v)
    scored = decode.transition_score(tiled, stems, trans, counts.laplace_unseen(morphs), key=ortho.allomorph_class)
    return decode.resegment(scored).select("word", seg(), r9("score").alias("score"))


query(None)(resegment_allomorph)

# Samplers


def _p2(v: Views) -> tuple[DataFrame, DataFrame]:
    """Binary splits and left parts of words with their log10 weight: growing DP likelihood, Poisson, similarity, presence."""
    segments = v.segments()
    own = sampler.own_tokens(segments)
    cands = splits.binary_splits(v.words()).select("word", "idx", "stem", "suffix").withColumn("trie_id", F.substring("word", 1, 3))
    scored = sampler.p2_likelihood(cands, segments, own)
    shape = F.when(F.col("suffix") == "$", F.array("stem")).otherwise(F.array("stem", "suffix"))
    bundle = priors.prior_bundle(cands.select("trie_id", "word", "idx", shape.alias("morphs")), v.nodes(), v.lexicon(), v.vectors(), key=("idx",))
    rows = scored.join(bundle.select("word", "idx", "poisson", "similarity", "presence"), ["word", "idx"])
    return rows.withColumn("score", F.col("lik") + F.col("poisson") + F.col("similarity") + F.col("presence")), segments


@query(None)
def posterior_p2(v: Views) -> DataFrame:
    rows, _ = _p2(v)
    out = sampler.normalised(rows.withColumn("left", F.col("word")), F.col("score"))
    return out.select("word", "idx", "stem", "suffix", r9("prob").alias("prob"))


SQL["posterior_p2"] = with_views(
    f"""SELECT word, idx, stem, suffix, round(weight / sum(weight) OVER (PARTITION BY word), 9) AS prob FROM (
SELECT word, idx, stem, suffix, pow(10, log10(ps) + CASE WHEN suffix = '$' THEN 0 ELSE log10(pf) END + log10(po) + CASE WHEN suffix = '$' THEN 0.0 ELSE log10({_CUT}) END + pr) AS weight FROM (
SELECT *, CASE WHEN ns > 0 THEN ns / (N + 0.01) ELSE 0.01 * pow(0.037, length(stem) + 1) / (N + 0.01) END AS ps,
  CASE WHEN nf > 0 THEN nf / (N + 1 + 0.01) ELSE 0.01 * pow(0.037, length(suffix) + 1) / (N + 1 + 0.01) END AS pf FROM (
SELECT bs.word, idx, stem, suffix, CAST(coalesce(s.n, 0) - coalesce(os.k, 0) AS DOUBLE) AS ns,
  CAST(coalesce(f.n, 0) - coalesce(of.k, 0) + CASE WHEN stem = suffix THEN 1 ELSE 0 END AS DOUBLE) AS nf,
  CAST((SELECT sum(n) FROM mc) - len(seg.morphs) AS DOUBLE) AS N, {_P4} AS po,
  {_COS.format("va.vec", "vb.vec")} AS c, log10(coalesce(lx.freq, 1e-7) / (SELECT sum(freq) FROM lex)) AS pr
FROM bs JOIN seg ON seg.word = bs.word LEFT JOIN mc s ON s.morph = stem LEFT JOIN mc f ON f.morph = suffix
LEFT JOIN (SELECT word, morph, count(*) AS k FROM mt GROUP BY 1, 2) os ON os.word = bs.word AND os.morph = stem
LEFT JOIN (SELECT word, morph, count(*) AS k FROM mt GROUP BY 1, 2) of ON of.word = bs.word AND of.morph = suffix
LEFT JOIN tn ON tn.trie_id = substring(bs.word, 1, 3) AND tn.prefix = stem
LEFT JOIN lex lx ON lx.word = stem LEFT JOIN vc va ON va.word = stem LEFT JOIN vc vb ON vb.word = bs.word)))""",
    "bs", "seg", "mc", "mt", "tn", "lex", "vc",
)


@query(None)
def forward_gibbs(v: Views) -> DataFrame:
    """One draw a word, each split weighed by all recursive splits of its left part."""
    rows, segments = _p2(v)
    lefts = v.words().select("word", F.explode(F.expr("if(length(word) > 2, sequence(3, length(word)), cast(array() as array<int>))")).alias("p"))
    parts = lefts.select(F.expr("substring(word, 1, p)").alias("part")).distinct()
    cuts = splits.binary_splits(parts.select(F.col("part").alias("word"))).where("idx > 0").select(F.col("word").alias("part"), F.col("idx").alias("i"), "stem", "suffix")
    inner = lefts.withColumn("part", F.expr("substring(word, 1, p)")).join(cuts, "part").select("word", "p", "i", "stem", "suffix").withColumn("trie_id", F.substring("word", 1, 3))
    lik = sampler.p2_likelihood(inner, segments, sampler.own_tokens(segments))
    keyed = inner.select("trie_id", "word", "p", "i", F.array("stem", "suffix").alias("morphs"))
    bundle = priors.prior_bundle(keyed, v.nodes(), v.lexicon(), v.vectors(), key=("p", "i"))
    scored = lik.join(bundle.select("word", "p", "i", "poisson", "similarity", "presence"), ["word", "p", "i"])
    scored = scored.select("word", "p", "i", F.pow(F.lit(10.0), F.col("lik") + F.col("poisson") + F.col("similarity") + F.col("presence")).alias("s"))
    z = sampler.forward_weights(segments, scored)
    rows = rows.join(z, "word").withColumn("score", F.col("score") + scores.log10(F.expr("element_at(z, length(stem))"))).withColumn("left", F.col("word"))
    drawn = sampler.draw(sampler.normalised(rows, F.col("score")).where("prob IS NOT NULL"), 1, 0, DEFAULT.seed)
    return drawn.select("word", "stem", "suffix")


def _joint(v: Views, rows: DataFrame, nodes, lexicon, vecs, probs) -> DataFrame:
    """(word, morphs, score) of segmentations: unigram likelihood, Poisson, similarity and presence."""
    keyed = rows.withColumn("trie_id", F.substring("word", 1, 3))
    bundle = priors.prior_bundle(keyed, nodes, lexicon, vecs)
    parts = rows.select("word", F.explode("morphs").alias("morph")).join(probs.select("morph", "p"), "morph", "left")
    lik = parts.groupBy("word").agg(F.sum(F.log10(F.coalesce("p", F.lit(DEFAULT.laplace)))).alias("lik"))
    out = rows.join(bundle, "word").join(lik, "word")
    return out.select("word", "morphs", (F.col("lik") + F.col("poisson") + F.col("similarity") + F.col("presence")).alias("score"))


@query(None)
def metropolis_step(v: Views) -> DataFrame:
    probs = counts.unigram_probs(v.counts())
    tables = (v.nodes(), v.lexicon(), v.vectors(), probs)
    old = _joint(v, v.segments().select("word", "morphs"), *tables)
    new = _joint(v, splits.random_split(v.words()), *tables)
    return sampler.metropolis(old, new, 1, 42).select("word", seg(), "accepted")


@query(None)
def metropolis_binary(v: Views) -> DataFrame:
    """One binary step from whole words; the old state's similarity is the published constant 1e-6."""
    rows = splits.biased_binary_split(v.words()).where("suffix != '$'").withColumn("trie_id", F.substring("word", 1, 3))
    whole = rows.select("trie_id", "word", F.array("word").alias("morphs"))
    split = rows.select("trie_id", "word", F.array("stem", "suffix").alias("morphs"))
    probs = counts.unigram_probs(v.counts())
    lik = lambda r: r.select("word", F.explode("morphs").alias("morph")).join(probs.select("morph", "p"), "morph", "left").groupBy("word").agg(F.sum(F.log10(F.coalesce("p", F.lit(DEFAULT.laplace)))).alias("lik"))
    bundle = lambda r: priors.prior_bundle(r, v.nodes(), v.lexicon(), v.vectors()).select("word", "poisson", "similarity")
    old = whole.join(lik(whole), "word").join(bundle(whole), "word").select("word", "morphs", (F.col("lik") + F.col("poisson") - 6.0).alias("score"))
    new = split.join(lik(split), "word").join(bundle(split), "word").select("word", "morphs", (F.col("lik") + F.col("poisson") + F.col("similarity")).alias("score"))
    return sampler.metropolis(old, new, 1, 42).select("word", seg(), "accepted")


def _block(v: Views) -> DataFrame:
    toggled = v.bounds().groupBy("trie_id").agg(F.min("prefix").alias("prefix"))
    near = priors.neighbour_scores(trie.neighbours(v.segments(), v.bounds()), v.vectors())
    return sampler.block_step(v.segments(), v.bounds(), toggled, v.nodes(), near)


@query(None)
def block_step(v: Views) -> DataFrame:
    return _block(v).select("trie_id", "prefix", *(r9(c).alias(c) for c in ("d_dp", "d_poisson", "d_similarity")), "accepted")


@query(None)
def block_bounds(v: Views) -> DataFrame:
    return sampler.after_block_step(v.bounds(), _block(v))


@query(None)
def block_presence(v: Views) -> DataFrame:
    first = v.bounds().groupBy("trie_id").agg(F.min("prefix").alias("prefix"))
    kept = v.bounds().join(first, ["trie_id", "prefix"], "left_anti")
    token = lambda s: s.select("trie_id", F.explode("morphs").alias("token"))
    old, new = token(trie.segment(v.trie_words(), kept)), token(v.segments())
    added = new.join(old.distinct(), ["trie_id", "token"], "left_anti").distinct()
    removed = old.join(new.distinct(), ["trie_id", "token"], "left_anti").distinct()
    mass = counts.smoothed_corpus(v.nodes(), v.lexicon(), DEFAULT.block_laplace)
    out = priors.tail_presence(added, removed, first.withColumnRenamed("prefix", "candidate"), mass)
    return out.select("trie_id", "candidate", "n_tails", r9("new").alias("new"), r9("old").alias("old"))


@query("SELECT morph, CAST(sum(d) AS BIGINT) AS n FROM (SELECT morph, n AS d FROM mc UNION ALL SELECT morph, -1 FROM mt JOIN wf USING (word) UNION ALL SELECT word, 1 FROM wf) GROUP BY 1", "mc", "mt", "wf")
def removed_and_inserted(v: Views) -> DataFrame:
    gone = v.segments().join(v.frequent(), "word", "left_semi").select(F.explode("morphs").alias("morph"))
    return sampler.changed(v.counts(), gone, v.frequent().select(F.col("word").alias("morph")))


@query(None)
def gibbs_two_sweeps(v: Views) -> DataFrame:
    return sampler.gibbs(v.segments(), "uni", "dp", False, 2).select("word", seg())
