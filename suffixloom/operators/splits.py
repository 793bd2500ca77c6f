"""Enumeration of splits: binary, multi-cut and over affix sets; best tilings by a fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import hash_uniform


#: The morphs of a word from its end positions.
CUT = "transform(sequence(1, size(ends)), i -> substring(word, if(i = 1, 0, ends[i - 2]) + 1, ends[i - 1] - if(i = 1, 0, ends[i - 2])))"


def binary_splits(words: DataFrame, min_stem: int = 2) -> DataFrame:
    """(word, idx, stem, suffix): the word whole, then suffixes of 1, 2, ... letters; four at most."""
    n = F.length("word")
    k = F.when(n >= min_stem + 4, 5).when(n > min_stem - 1, n - min_stem + 1).otherwise(n)
    rows = words.select("word", F.explode(F.sequence(F.lit(0), k - 1)).alias("idx"))
    return rows.select("word", "idx", F.expr("substring(word, 1, length(word) - idx)").alias("stem"), F.expr("if(idx = 0, '$', substring(word, length(word) - idx + 1, idx))").alias("suffix"))


def multi_cut_splits(words: DataFrame, parts: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """(word, m, morphs): all splits into exactly m morphs."""
    out = None
    for m in parts:
        rows = words.where(F.length("word") >= m).select("word", F.array(F.lit(0)).alias("cuts"))
        for j in range(1, m):
            rows = rows.select("word", "cuts", F.explode(F.sequence(F.element_at("cuts", -1) + 1, F.length("word") - (m - j))).alias("k"))
            rows = rows.select("word", F.concat("cuts", F.array("k")).alias("cuts"))
        ends = F.concat(F.slice("cuts", 2, m), F.array(F.length("word")))
        morphs = F.transform(F.zip_with("cuts", ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: F.substring(F.col("word"), p["a"] + 1, p["b"] - p["a"]))
        rows = rows.select("word", F.lit(m).alias("m"), morphs.alias("morphs"))
        out = rows if out is None else out.unionByName(rows)
    return out


def prefix_pairs(words: DataFrame, min_length: int = 2) -> DataFrame:
    """(prefix, left): every distinct prefix of the words and every proper prefix of it."""
    rows = words.where(F.length("word") >= min_length).select(F.explode(F.expr(f"transform(sequence({min_length}, length(word)), k -> substring(word, 1, k))")).alias("prefix")).distinct()
    return rows.select("prefix", F.explode(F.expr("transform(sequence(1, length(prefix) - 1), k -> substring(prefix, 1, k))")).alias("left"))


def pieces(words: DataFrame, morphs: DataFrame) -> DataFrame:
    """(word, a, b, morph, ...): substrings [a, b) of the words that are morphs: an equi-join, before any enumeration."""
    rows = words.select("word", F.explode(F.expr("sequence(0, length(word) - 1)")).alias("a"))
    rows = rows.select("word", "a", F.explode(F.expr("sequence(a + 1, length(word))")).alias("b"))
    return rows.withColumn("morph", F.expr("substring(word, a + 1, b - a)")).join(morphs, "morph")


def tilings(words: DataFrame, morphs: DataFrame) -> DataFrame:
    """(word, morphs, ends): all ways to tile a word with morphs of the set, by a fold over its positions."""
    rows = pieces(words, morphs.select("morph").distinct()).groupBy("word").agg(F.collect_list(F.struct("a", "b")).alias("ps"))
    step = "flatten(transform(filter(ps, p -> p.b = k), p -> transform(acc[p.a], e -> concat(e, array(p.b)))))"
    start = "array(array(cast(array() as array<int>)))"
    rows = rows.select("word", F.explode(F.expr(f"element_at(aggregate(sequence(1, length(word)), {start}, (acc, k) -> concat(acc, array({step}))), -1)")).alias("ends"))
    return rows.select("word", F.expr(CUT).alias("morphs"), "ends")


def best_tiling(scored: DataFrame) -> DataFrame:
    """(word, morphs, score) of the best tiling, from scored pieces (word, a, b, w): Viterbi as a fold over positions.

    Scores add up from left to right.  Of equal scores the one whose end positions come first wins.  A worse start can
    draw level by rounding later on, so a position keeps besides its best start those that come before all better ones
    and are so close that rounding may level them; the rest can't win any more.  A word's pieces are at most the square
    of its length, so the array of a word is small however large the lexicon is.
    """
    rows = scored.groupBy("word").agg(F.collect_list(F.struct("a", "b", "w")).alias("ps")).withColumn("n", F.length("word"))
    # n additions of numbers up to n |w|, each off by 2**-53 of the sum at most, twice over
    rows = rows.withColumn("slack", F.expr(f"array_max(transform(ps, p -> abs(p.w))) * n * n * {2.0**-50}D"))
    none = "cast(array() as array<struct<score:double,neg:array<int>>>)"
    start = "array(array(struct(0D as score, cast(array() as array<int>) as neg)))"
    cand = "flatten(transform(filter(ps, p -> p.b = k), p -> transform(acc[p.a], e -> struct(e.score + p.w as score, concat(e.neg, array(-p.b)) as neg))))"
    ahead = "size(f) = 0 or (c.score >= f[0].score - slack and c.neg > element_at(f, -1).neg)"
    front = f"aggregate(sort_array({cand}, false), {none}, (f, c) -> if({ahead}, concat(f, array(c)), f))"
    fold = f"aggregate(sequence(1, n), {start}, (acc, k) -> concat(acc, array({front})))"
    rows = rows.withColumn("best", F.get(F.expr(f"element_at({fold}, -1)"), F.lit(0))).where("best IS NOT NULL")
    rows = rows.select("word", "best.score", F.expr("transform(best.neg, x -> -x)").alias("ends"))
    return rows.select("word", F.expr(CUT).alias("morphs"), "score", "ends")


def random_split(words: DataFrame, seed: int = 42) -> DataFrame:
    """(word, morphs): a uniform number of cuts, then so many distinct places, all drawn by hashes of the word."""
    n = F.length("word")
    rows = words.select("word", F.floor(hash_uniform(F.col("word"), F.lit("cuts"), F.lit(str(seed))) * n).cast("int").alias("c"))
    places = rows.where("length(word) > 1").select("word", "c", F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
    places = places.withColumn("u", hash_uniform(F.col("word"), F.col("k").cast("string"), F.lit(str(seed))))
    cuts = places.groupBy("word", "c").agg(F.sort_array(F.collect_list(F.struct("u", "k"))).alias("ks"))
    cuts = cuts.select("word", F.expr("array_sort(transform(slice(ks, 1, c), x -> x.k))").alias("cuts"))
    rows = words.select("word").join(cuts, "word", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<int>")))
    morphs = "transform(sequence(0, size(cuts)), i -> substring(word, if(i = 0, 0, cuts[i - 1]) + 1, if(i = size(cuts), length(word), cuts[i]) - if(i = 0, 0, cuts[i - 1])))"
    return rows.select("word", F.expr(morphs).alias("morphs"))


def random_tiling(words: DataFrame, seed: int = 42) -> DataFrame:
    """(word, morphs): pieces of uniform length, drawn until one letter is left, which is the last morph."""
    n = F.length("word")
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.floor(hash_uniform(F.col("word"), p.cast("string"), F.lit("tile"), F.lit(str(seed))) * (n - p - 1)).cast("int") + p + 1)
    rows = words.select("word", at.alias("to"))
    fold = "aggregate(sequence(1, length(word)), struct(0 as p, cast(array() as array<int>) as ends), (s, i) -> if(length(word) - s.p > 1, struct(to[s.p] as p, concat(s.ends, array(to[s.p])) as ends), s)).ends"
    rows = rows.select("word", F.concat(F.expr(fold), F.array(n)).alias("ends"))
    return rows.select("word", F.expr(CUT).alias("morphs"))


def biased_binary_split(words: DataFrame, seed: int = 42) -> DataFrame:
    """(word, stem, suffix): a suffix of 0 to 4 letters, or up to the word's length less one if that is shorter."""
    u = hash_uniform(F.col("word"), F.lit("biased"), F.lit(str(seed)))
    k = F.floor(u * F.when(F.length("word") > 4, 5).otherwise(F.length("word"))).cast("int")
    return words.select("word", k.alias("k")).select("word", F.expr("substring(word, 1, length(word) - k)").alias("stem"), F.expr("if(k = 0, '$', right(word, k))").alias("suffix"))
