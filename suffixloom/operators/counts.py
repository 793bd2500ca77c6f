"""Count tables and probabilities: unigram, bigram, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def init_unigrams(segments: DataFrame, separated: bool = False, weight: Column | None = None) -> DataFrame:
    """(kind, morph, n): one table ``all``, or ``stem`` and ``suffix``; each morph weighs 1 or the word's frequency."""
    w = (F.lit(1) if weight is None else weight).cast("bigint")
    rows = segments.select(w.alias("w"), F.posexplode("morphs").alias("pos", "morph"))
    kind = F.when(F.col("pos") == 0, "stem").otherwise("suffix") if separated else F.lit("all")
    return rows.groupBy(kind.alias("kind"), "morph").agg(F.sum("w").alias("n"))


def init_bigrams(segments: DataFrame, weight: Column | None = None, mark: bool = True) -> DataFrame:
    """(first, second, n); an unsegmented word is followed by ``$``."""
    w = (F.lit(1) if weight is None else weight).cast("bigint")
    m = F.when((F.size("morphs") == 1) & F.lit(mark), F.concat("morphs", F.array(F.lit("$")))).otherwise(F.col("morphs"))
    return _pairs(segments.select(w.alias("w"), m.alias("m")))


def _pairs(rows: DataFrame) -> DataFrame:
    pairs = F.expr("transform(sequence(1, size(m) - 1), i -> struct(m[i - 1] as first, m[i] as second))")
    rows = rows.where("size(m) > 1").select("w", F.explode(pairs).alias("p"))
    return rows.groupBy("p.first", "p.second").agg(F.sum("w").alias("n"))


def unigram_probs(counts: DataFrame) -> DataFrame:
    """(morph, n, p).  The total is one row, joined by broadcast."""
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("morph", "n", (F.col("n") / F.col("total")).alias("p"))


def bigram_probs(bigrams: DataFrame, unigrams: DataFrame) -> DataFrame:
    """n(a, b) / n(a), for contexts that have a count."""
    of = unigrams.where("n > 0").select(F.col("morph").alias("first"), F.col("n").alias("of"))
    return bigrams.where("n > 0").join(of, "first").select("first", "second", "n", (F.col("n") / F.col("of")).alias("p"))


def with_sentinels(segments: DataFrame) -> DataFrame:
    """STR, the suffixes, END."""
    suffixes = F.slice("morphs", 2, F.greatest(F.size("morphs") - 1, F.lit(0)))
    return segments.withColumn("m", F.concat(F.array(F.lit("STR")), suffixes, F.array(F.lit("END"))))


def allomorph_segments(segments: DataFrame) -> DataFrame:
    """The segmentations with their suffixes replaced by allomorph classes; the stem stays."""
    from ..functions.ortho import allomorph_class

    suffixes = F.transform(F.slice("morphs", 2, F.greatest(F.size("morphs") - 1, F.lit(0))), allomorph_class)
    return segments.withColumn("morphs", F.concat(F.slice("morphs", 1, 1), suffixes))


def transition_counts(segments: DataFrame, weight: Column | None = None) -> DataFrame:
    w = (F.lit(1) if weight is None else weight).cast("bigint")
    return _pairs(with_sentinels(segments).select(w.alias("w"), "m"))


def transition_morphs(segments: DataFrame, weight: Column | None = None) -> DataFrame:
    """(morph, n) of sentinels and suffixes."""
    w = (F.lit(1) if weight is None else weight).cast("bigint")
    rows = with_sentinels(segments).select(w.alias("w"), F.explode("m").alias("morph"))
    return rows.groupBy("morph").agg(F.sum("w").alias("n"))


def stem_probs(segments: DataFrame, weight: Column | None = None) -> DataFrame:
    w = (F.lit(1) if weight is None else weight).cast("bigint")
    return unigram_probs(segments.select(F.element_at("morphs", 1).alias("morph"), w.alias("w")).groupBy("morph").agg(F.sum("w").alias("n")))


def laplace_transitions(pairs: DataFrame, morphs: DataFrame) -> DataFrame:
    """(first, second, p) of seen pairs: (n(a, b) + 1) / (n(a) + V).  Unseen ones are ``laplace_unseen``."""
    size = morphs.agg(F.count("*").alias("v"))
    of = morphs.select(F.col("morph").alias("first"), F.col("n").alias("of"))
    return pairs.join(of, "first").crossJoin(F.broadcast(size)).select("first", "second", ((F.col("n") + 1) / (F.col("of") + F.col("v"))).alias("p"))


def laplace_unseen(morphs: DataFrame) -> DataFrame:
    """(first, p0): the probability of any transition that wasn't seen."""
    size = morphs.agg(F.count("*").alias("v"))
    return morphs.crossJoin(F.broadcast(size)).select(F.col("morph").alias("first"), (F.lit(1.0) / (F.col("n") + F.col("v"))).alias("p0"))


def smoothed_corpus(prefixes: DataFrame, lexicon: DataFrame, laplace: float) -> DataFrame:
    """(word, mass): trie prefixes at ``laplace``, corpus words at their frequency more."""
    rows = prefixes.select(F.col("prefix").alias("word")).distinct().join(lexicon, "word", "full")
    return rows.select("word", (F.coalesce("freq", F.lit(0)) + F.lit(laplace)).alias("mass"))


def multiset_diff(old: DataFrame, new: DataFrame, column: str = "token") -> DataFrame:
    signed = old.select(column, F.lit(-1).cast("bigint").alias("d")).unionByName(new.select(column, F.lit(1).cast("bigint").alias("d")))
    return signed.groupBy(column).agg(F.sum("d").alias("diff")).where("diff != 0")


def token_frequency(tokens: DataFrame) -> DataFrame:
    """Counts of raw tokens of two characters or more that don't begin with a digit."""
    return tokens.where((F.length("word") >= 2) & ~F.col("word").rlike("^[0-9]")).groupBy("word").agg(F.count("*").alias("n"))
