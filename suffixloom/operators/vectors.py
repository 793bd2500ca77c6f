"""Vector operators: similarities, nearest neighbours, cosine table, nested segmentation, multi-splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scores import cosine, stored_cosine
from ..sources.tables import Tables
from .splits import multi_cut_splits, prefix_pairs


def pair_cosines(pairs: DataFrame, vectors: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    va = vectors.select(F.col("word").alias(a), F.col("vec").alias("va"))
    vb = vectors.select(F.col("word").alias(b), F.col("vec").alias("vb"))
    return pairs.join(va, a, "left").join(vb, b, "left").withColumn("cosine", cosine(F.col("va"), F.col("vb"))).drop("va", "vb")


def cosine_table(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """(left, prefix, cosine) of every prefix and its own prefixes; -1 for words without vector and outside [0, 1]."""
    rows = pair_cosines(prefix_pairs(words), vectors, "left", "prefix")
    return rows.select("left", "prefix", stored_cosine(F.col("cosine")).alias("cosine"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block: int = 256) -> DataFrame:
    """(word, neighbour, cosine, rank): exact nearest neighbours of a stated query set, read in blocks.

    A block of queries is broadcast as one small matrix; every vector is compared with it where it lies, and each batch
    hands on its best k of a query only.  Vectors and result are tables, so neither is made again by what reads them.
    """
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("neighbour", T.StringType()), T.StructField("cosine", T.DoubleType())])
    spark, store = vectors.sparkSession, Tables(vectors.sparkSession, "nearest")
    vectors = store.table(vectors.select("word", "vec"))
    asked = store.table(queries.select("word").join(vectors, "word"))
    n = -(-asked.count() // block)
    out = spark.createDataFrame([], schema)
    for i in range(n):
        rows = asked.where(F.pmod(F.xxhash64("word"), F.lit(n)) == i).collect()  # one block
        if not rows:
            continue
        sent = spark.sparkContext.broadcast(([r.word for r in rows], [list(r.vec) for r in rows]))

        def run(it, sent=sent):
            import numpy as np
            import pandas as pd

            names, q = sent.value[0], np.array(sent.value[1], dtype=np.float64)
            q_norm = np.sqrt((q * q).sum(axis=1))
            for pdf in it:
                if not len(pdf):
                    continue
                v = np.array(pdf["vec"].tolist(), dtype=np.float64)
                c = (q @ v.T) / np.maximum(q_norm[:, None] * np.sqrt((v * v).sum(axis=1))[None], 1e-300)
                words = pdf["word"].to_numpy(dtype=object)
                c = np.round(c, 12)
                last = np.partition(c, -(k + 1), axis=1)[:, -(k + 1)] if len(words) > k + 1 else np.full(len(names), -np.inf)
                got = []
                for j, name in enumerate(names):
                    some = np.flatnonzero(c[j] >= last[j])  # with the word itself, and all that are level with the last
                    order = sorted((-float(c[j, at]), words[at]) for at in some if words[at] != name)[:k]
                    got += [(name, w, -x) for x, w in order]
                yield pd.DataFrame(got, columns=["word", "neighbour", "cosine"])

        out = out.unionByName(vectors.mapInPandas(run, schema))
    rank = F.row_number().over(W.partitionBy("word").orderBy(F.desc("cosine"), "neighbour"))
    return store.table(out.withColumn("rank", rank).where(F.col("rank") <= k))


def analogy(vectors: DataFrame, positive: list[str], negative: list[str], k: int) -> DataFrame:
    """Nearest words to the sum of some vectors less others."""
    named = vectors.where(F.col("word").isin(positive + negative)).withColumn("s", F.when(F.col("word").isin(positive), 1.0).otherwise(-1.0))
    parts = named.select(F.posexplode("vec").alias("i", "x"), "s").groupBy("i").agg(F.sum(F.col("x").cast("double") * F.col("s")).alias("x"))
    target = parts.agg(F.expr("transform(array_sort(collect_list(struct(i, x))), p -> p.x)").alias("target"))  # one row
    rows = vectors.where(~F.col("word").isin(positive + negative)).crossJoin(F.broadcast(target))
    return rows.select("word", cosine(F.col("vec"), F.col("target")).alias("cosine")).orderBy(F.desc("cosine"), "word").limit(k)


def _cosine_map(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """(word, cs): the cosines of all pairs of prefixes (i, j) of a word that both have vectors."""
    spans = words.select("word", F.explode(F.expr("sequence(1, length(word) - 1)")).alias("i")).where("length(word) > 1")
    spans = spans.select("word", "i", F.explode(F.expr("sequence(i + 1, length(word))")).alias("j"))
    spans = spans.withColumn("x", F.expr("substring(word, 1, i)")).withColumn("y", F.expr("substring(word, 1, j)"))
    known = vectors.select(F.col("word").alias("y"), F.col("vec").alias("vy"))
    rows = spans.join(known, "y").join(vectors.select(F.col("word").alias("x"), F.col("vec").alias("vx")), "x")
    rows = rows.withColumn("c", cosine(F.col("vx"), F.col("vy")))
    return rows.groupBy("word").agg(F.collect_list(F.struct("i", "j", "c")).alias("cs"))


def nested_segment(words: DataFrame, vectors: DataFrame, threshold: float = 0.25, upper: float = 0.99) -> DataFrame:
    """(word, freq, found, morphs): strips suffixes greedily while the shorter prefix is similar to the last stem.

    A word without vector is not found and has no morphs; one of less than three letters is its own stem.  The stem
    loses one letter after another; whenever the rest has a cosine above ``threshold`` and below ``upper`` with the
    current stem, what was stripped becomes a suffix and the rest the stem.
    """
    known = vectors.select("word").withColumn("found", F.lit(True))
    rows = words.join(known, "word", "left").withColumn("found", F.coalesce("found", F.lit(False))).join(_cosine_map(words, vectors), "word", "left")
    rows = rows.withColumn("cs", F.coalesce("cs", F.array().cast("array<struct<i:int,j:int,c:double>>")))
    ok = f"exists(cs, p -> p.i = length(word) - k and p.j = acc.stem and p.c > {threshold}D and p.c < {upper}D)"
    fold = (
        "aggregate(if(length(word) < 3, cast(array() as array<int>), sequence(1, length(word) - 2)), "
        "struct(length(word) as stem, cast(array() as array<int>) as cuts), "
        f"(acc, k) -> if({ok}, struct(length(word) - k as stem, concat(array(length(word) - k), acc.cuts) as cuts), acc)).cuts"
    )
    rows = rows.withColumn("ends", F.concat(F.expr(fold), F.array(F.length("word"))))
    morphs = F.expr("transform(sequence(1, size(ends)), i -> substring(word, if(i = 1, 0, ends[i - 2]) + 1, ends[i - 1] - if(i = 1, 0, ends[i - 2])))")
    return rows.select("word", "freq", "found", F.when(F.col("found"), morphs).alias("morphs"))


#: The thresholds that are tried one after another, as doubles come out.  Fixed values.
LADDER = (0.3, 0.25, 0.2, 0.15000000000000002, 0.10000000000000002, 0.05000000000000002, 1.3877787807814457e-17, -0.04999999999999999)


def multi_splits(words: DataFrame, vectors: DataFrame, parts: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """(word, m, seg, score, threshold): splits whose consecutive prefixes all have vectors and cosines below 1.

    For each word and m the largest threshold of the ladder that any split passes decides which splits stay; the score
    is the sum of cosines over m.
    """
    splits = multi_cut_splits(words, parts).withColumn("seg", F.array_join("morphs", "-"))
    cum = F.expr("transform(sequence(1, size(morphs)), i -> array_join(slice(morphs, 1, i), ''))")
    pairs = splits.withColumn("cum", cum).select("word", "m", "seg", F.explode(F.expr("transform(sequence(1, m - 1), i -> struct(i as i, cum[i - 1] as x, cum[i] as y))")).alias("p"))
    vx, vy = vectors.select(F.col("word").alias("x"), F.col("vec").alias("vx")), vectors.select(F.col("word").alias("y"), F.col("vec").alias("vy"))
    rows = pairs.select("word", "m", "seg", "p.i", "p.x", "p.y").join(vx, "x").join(vy, "y").withColumn("c", cosine(F.col("vx"), F.col("vy"))).where("c < 1")
    got = rows.groupBy("word", "m", "seg").agg(F.min("c").alias("least"), F.sort_array(F.collect_list(F.struct("i", "c"))).alias("cs")).where("size(cs) = m - 1")
    got = got.withColumn("score", F.expr("aggregate(cs, 0D, (s, x) -> s + x.c)") / F.col("m"))
    pick = F.lit(None).cast("double")
    for t in reversed(LADDER):
        pick = F.when(F.col("least") > t, F.lit(t)).otherwise(pick)
    got = got.withColumn("t", pick).where("t IS NOT NULL")
    got = got.withColumn("threshold", F.max("t").over(W.partitionBy("word", "m"))).where("least > threshold")
    return got.select("word", "m", "seg", "score", "threshold")


def top_splits(splits: DataFrame, k: int = 10) -> DataFrame:
    """(word, splits): the best k over all m, padded with the last."""
    rank = F.row_number().over(W.partitionBy("word").orderBy(F.desc("score"), "seg"))
    rows = splits.withColumn("rank", rank).where(F.col("rank") <= k)
    rows = rows.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("rank", "seg"))).alias("xs"))
    segs = F.transform("xs", lambda x: x["seg"])
    return rows.select("word", F.array_join(F.concat(segs, F.array_repeat(F.element_at(segs, -1), F.lit(k) - F.size(segs))), "+").alias("splits"))
