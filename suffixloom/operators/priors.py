"""Priors of a segmentation, as columns over tables: Poisson, similarity, presence, length; sums over tries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import cosine, cut_similarity, length_prior, log10, poisson, stored_cosine
from ..params import DEFAULT, Params


def live_similarity(pairs: DataFrame, vectors: DataFrame, a: str, b: str, unfound: float) -> DataFrame:
    """The pairs with ``similarity``: their cosine, or ``unfound`` where a vector is missing or it lies outside [0, 1]."""
    va, vb = vectors.select(F.col("word").alias(a), F.col("vec").alias("va")), vectors.select(F.col("word").alias(b), F.col("vec").alias("vb"))
    c = stored_cosine(cosine(F.col("va"), F.col("vb")))
    return pairs.join(va, a, "left").join(vb, b, "left").withColumn("similarity", F.when(c == -1, F.lit(unfound)).otherwise(c)).drop("va", "vb")


def _steps(segments: DataFrame) -> DataFrame:
    """(trie_id, word, x, y): a cumulative prefix and the next one; y is null for a word that is whole."""
    cum = F.expr("transform(sequence(1, size(morphs)), i -> array_join(slice(morphs, 1, i), ''))")
    rows = segments.select("trie_id", "word", cum.alias("cum"))
    return rows.select("trie_id", "word", F.explode(F.expr("transform(sequence(1, greatest(size(cum) - 1, 1)), i -> struct(cum[i - 1] as x, get(cum, i) as y))")).alias("s")).select("trie_id", "word", "s.x", "s.y")


def presence(freq: Column, total: Column, laplace: float) -> Column:
    return F.log10(F.coalesce(freq.cast("double"), F.lit(laplace)) / total)


def prior_bundle(segments: DataFrame, nodes: DataFrame, lexicon: DataFrame, vectors: DataFrame, p: Params = DEFAULT, key: tuple[str, ...] = ()) -> DataFrame:
    """(trie_id, word, poisson, similarity, presence, length) of segmentations (trie_id, word, morphs), all log10.

    Poisson and presence are summed over the cumulative prefixes but the whole word, or over the word if it is whole;
    the similarity over neighbouring prefixes, cut at ``sim_cut``; a whole word has that of ``sim_unsegmented``.
    ``key`` names more columns that tell segmentations of a word apart.
    """
    cum = F.expr("transform(sequence(1, size(morphs)), i -> array_join(slice(morphs, 1, i), ''))")
    pairs = F.expr("transform(sequence(1, greatest(size(cum) - 1, 1)), i -> struct(cum[i - 1] as x, get(cum, i) as y))")
    names = ["trie_id", "word", *key]
    length = length_prior(F.length("word"), F.size("morphs"))
    rows = segments.select(*names, length.alias("length"), cum.alias("cum")).select(*names, "length", F.explode(pairs).alias("s")).select(*names, "length", "s.x", "s.y")
    rows = rows.join(nodes.select("trie_id", F.col("prefix").alias("x"), "n_children"), ["trie_id", "x"], "left")
    rows = rows.join(lexicon.select(F.col("word").alias("x"), "freq"), "x", "left").crossJoin(F.broadcast(lexicon.agg(F.sum("freq").alias("total"))))
    va, vb = vectors.select(F.col("word").alias("x"), F.col("vec").alias("va")), vectors.select(F.col("word").alias("y"), F.col("vec").alias("vb"))
    rows = rows.join(va, "x", "left").join(vb, "y", "left")
    near = cut_similarity(stored_cosine(cosine(F.col("va"), F.col("vb"))), p.sim_unfound, p.low_sim, p.sim_cut)
    sim = F.when(F.col("y").isNull(), log10(F.lit(p.sim_unsegmented))).otherwise(log10(near))
    return rows.groupBy(*names).agg(
        F.sum(log10(poisson(F.coalesce("n_children", F.lit(0)), p.poisson_lambda))).alias("poisson"), F.sum(sim).alias("similarity"),
        F.sum(presence(F.col("freq"), F.col("total"), p.laplace)).alias("presence"), F.max("length").alias("length"),
    )


def step_similarity(segments: DataFrame, vectors: DataFrame, unfound: float) -> DataFrame:
    """(word, score): the sum of log10 of the cosines of neighbouring cumulative prefixes of segmented words."""
    rows = live_similarity(_steps(segments).where("y IS NOT NULL"), vectors, "x", "y", unfound)
    return rows.groupBy("word").agg(F.sum(log10(F.col("similarity"))).alias("score"))


def neighbour_scores(neighbours: DataFrame, vectors: DataFrame, invalid: float = 1e-12) -> DataFrame:
    """(trie_id, prefix, score): log10 of a boundary's mean cosine with its neighbours; ``invalid`` stands outside [0, 1]."""
    rows = live_similarity(neighbours, vectors, "prefix", "neighbour", invalid)
    return rows.groupBy("trie_id", "prefix").agg(log10(F.avg("similarity")).alias("score"))


def trie_sums(bounds: DataFrame, nodes: DataFrame, scores: DataFrame, lam: float) -> DataFrame:
    """(trie_id, poisson, similarity): sums over a trie's boundaries.  A boundary that no word passes adds no similarity."""
    rows = bounds.join(nodes.select("trie_id", "prefix", "n_children"), ["trie_id", "prefix"]).join(scores, ["trie_id", "prefix"], "left")
    return rows.groupBy("trie_id").agg(F.sum(log10(poisson(F.col("n_children"), lam))).alias("poisson"), F.sum(F.coalesce("score", F.lit(0.0))).alias("similarity"))


def tail_presence(added: DataFrame, removed: DataFrame, candidates: DataFrame, mass: DataFrame, unseen: float = -5.23357304130864) -> DataFrame:
    """(trie_id, candidate, n_tails, new, old): presence of a candidate whose tokens replace longer ones.

    ``added`` and ``removed`` (trie_id, token) are the tokens that a step brings and takes.  A tail is an added token that
    a removed one ends in, after the candidate.  The words that were take ``unseen`` each, as published.
    """
    tails = added.join(candidates, "trie_id").withColumn("whole", F.concat("candidate", "token"))
    tails = tails.join(removed.select("trie_id", F.col("token").alias("whole")).distinct(), ["trie_id", "whole"]).groupBy("trie_id", "candidate").agg(F.count_distinct("token").alias("n_tails"))
    total = mass.agg(F.sum("mass").alias("total"))
    rows = candidates.join(tails, ["trie_id", "candidate"], "left").join(mass.select(F.col("word").alias("candidate"), "mass"), "candidate", "left").crossJoin(F.broadcast(total))
    n = F.coalesce("n_tails", F.lit(0)).cast("bigint")
    return rows.select("trie_id", "candidate", n.alias("n_tails"), (n * F.coalesce(log10(F.col("mass") / F.col("total")), F.lit(0.0))).alias("new"), (n * F.lit(unseen)).alias("old"))


def feature_name(poisson: bool, similarity: bool, presence: bool, length: bool) -> str:
    """The name of a combination of priors, as files are named after it."""
    used = [n for n, on in (("poisson", poisson), ("sim", similarity), ("presence", presence), ("length", length)) if on]
    return "_".join(used) or "none"
