"""Tries as tables: (trie_id, prefix, n_children, is_word); boundaries, segmentation, look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import Tables

END = "$"


def by_prefix(words: DataFrame, n: int = 3) -> DataFrame:
    """(trie_id, word): words that share their first letters make a trie."""
    return words.select(F.substring("word", 1, n).alias("trie_id"), "word")


def single(words: DataFrame) -> DataFrame:
    return words.select(F.lit("singleTrie").alias("trie_id"), "word")


def trie_nodes(trie_words: DataFrame) -> DataFrame:
    """Children of a prefix are the distinct next characters; the end of a word counts as one."""
    at = F.explode(F.sequence(F.lit(1), F.length("word")))
    rows = trie_words.select("trie_id", "word", at.alias("k"))
    rows = rows.select("trie_id", F.expr("substring(word, 1, k)").alias("prefix"), F.expr(f"if(k = length(word), '{END}', substring(word, k + 1, 1))").alias("c"))
    return rows.groupBy("trie_id", "prefix").agg(F.count_distinct("c").cast("int").alias("n_children"), F.max(F.col("c") == END).alias("is_word"))


def boundaries(nodes: DataFrame, least: int = 3, min_length: int = 2) -> DataFrame:
    return nodes.where((F.col("n_children") >= least) & (F.length("prefix") >= min_length)).select("trie_id", "prefix")


def segment(trie_words: DataFrame, bounds: DataFrame) -> DataFrame:
    """(trie_id, word, morphs): words are cut after every boundary that is a proper prefix.

    The prefix join is an equi-join on exploded prefixes; boundaries are not broadcast, as they grow with the lexicon.
    """
    cut = trie_words.where("length(word) > 1").select("trie_id", "word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k"))
    cut = cut.withColumn("prefix", F.expr("substring(word, 1, k)")).join(bounds, ["trie_id", "prefix"])
    cuts = cut.groupBy("trie_id", "word").agg(F.sort_array(F.collect_set("k")).alias("cuts"))
    rows = trie_words.join(cuts, ["trie_id", "word"], "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<int>")))
    ends = F.concat("cuts", F.array(F.length("word")))
    starts = F.concat(F.array(F.lit(0)), "cuts")
    morphs = F.transform(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: F.substring(F.col("word"), p["a"] + 1, p["b"] - p["a"]))
    return rows.select("trie_id", "word", morphs.alias("morphs"))


def morph_counts(segments: DataFrame) -> DataFrame:
    return segments.select(F.explode("morphs").alias("morph")).groupBy("morph").agg(F.count("*").alias("n"))


def last_morph_counts(segments: DataFrame) -> DataFrame:
    return segments.select(F.element_at("morphs", -1).alias("morph")).groupBy("morph").agg(F.count("*").alias("n"))


def trie_tokens(segments: DataFrame) -> DataFrame:
    return segments.groupBy("trie_id").agg(F.sort_array(F.flatten(F.collect_list("morphs"))).alias("tokens"))


def changed_counts(counts: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts after one trie's segmentation ``old`` was replaced by ``new``."""
    signed = counts.select("morph", "n").unionByName(morph_counts(old).withColumn("n", -F.col("n"))).unionByName(morph_counts(new))
    return signed.groupBy("morph").agg(F.sum("n").alias("n")).where("n != 0")


def replace_trie(segments: DataFrame, new: DataFrame) -> DataFrame:
    return segments.join(new.select("trie_id").distinct(), "trie_id", "left_anti").unionByName(new)


def prefixes_of(morphs: str = "morphs"):
    """Cumulative prefixes of a segmentation."""
    return F.expr(f"transform(sequence(1, size({morphs})), i -> array_join(slice({morphs}, 1, i), ''))")


def neighbours(segments: DataFrame, bounds: DataFrame) -> DataFrame:
    """(trie_id, prefix, neighbour): a boundary and itself with the next morph, in words that are cut there."""
    rows = segments.withColumn("cum", prefixes_of()).where("size(cum) > 1")
    rows = rows.select("trie_id", F.explode(F.expr("transform(sequence(1, size(cum) - 1), i -> struct(cum[i - 1] as prefix, cum[i] as neighbour))")).alias("x"))
    return rows.select("trie_id", "x.prefix", "x.neighbour").join(bounds, ["trie_id", "prefix"], "left_semi").distinct()


def keys_with_prefix(keys: DataFrame, prefix: str) -> DataFrame:
    return keys.where(F.col("word").startswith(prefix))


def keys_that_match(keys: DataFrame, pattern: str) -> DataFrame:
    """``.`` stands for any character; other characters stand for themselves."""
    import re

    return keys.where(F.col("word").rlike("^" + "".join("." if c == "." else re.escape(c) for c in pattern) + "$"))


def longest_prefix(queries: DataFrame, keys: DataFrame, missing: str | None = None) -> DataFrame:
    """(query, found): the longest key that begins the query."""
    rows = queries.select("query", F.explode(F.sequence(F.lit(1), F.greatest(F.length("query"), F.lit(1)))).alias("k"))
    hits = rows.withColumn("word", F.expr("substring(query, 1, k)")).join(keys.select("word"), "word").groupBy("query").agg(F.max("k").alias("k"))
    found = F.expr("substring(query, 1, k)")
    out = queries.join(hits, "query", "left").select("query", found.alias("found"))
    return out if missing is None else out.fillna(missing, "found")


def without_keys(keys: DataFrame, gone: DataFrame) -> DataFrame:
    return keys.join(gone, "word", "left_anti")


def closure(seeds: DataFrame, edges: DataFrame, stems: DataFrame | None = None, least: float | None = None) -> DataFrame:
    """(trie_id, word): what is reached from a seed over the neighbours ``edges`` (word, neighbour, cosine).

    With ``stems`` (word, stem) only words that begin with the seed's stem are reached, with ``least`` only over
    neighbours of a larger cosine.  It goes on until nothing new is reached.
    """
    store = Tables(seeds.sparkSession, "closure")
    found = store.table(seeds.select(F.col("word").alias("trie_id"), "word").distinct())
    frontier, step = found, store.table(edges if least is None else edges.where(F.col("cosine") > least))
    while not frontier.isEmpty():
        new = frontier.join(step, "word").select("trie_id", F.col("neighbour").alias("word"))
        if stems is not None:
            new = new.join(stems.select(F.col("word").alias("trie_id"), "stem"), "trie_id").where(F.col("word").startswith(F.col("stem"))).select("trie_id", "word")
        frontier = store.table(new.distinct().join(found, ["trie_id", "word"], "left_anti"))
        found = store.table(found.unionByName(frontier))
    return found


def common_prefix(a, b):
    """The number of letters that two strings begin with in common."""
    return F.aggregate(F.sequence(F.lit(1), F.least(F.length(a), F.length(b))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring(a, 1, i) == F.substring(b, 1, i)), i).otherwise(n))


def insertion_numbers(trie_words: DataFrame) -> DataFrame:
    """(trie_id, word, seq): words are put into their trie in their order; a look-up returns the number."""
    return trie_words.withColumn("seq", F.row_number().over(W.partitionBy("trie_id").orderBy("word")) - 1)


def knn_tries(neighbours: DataFrame) -> DataFrame:
    """(trie_id, word): a trie for each word, of itself and its nearest neighbours (word, neighbour)."""
    own = neighbours.select(F.col("word").alias("trie_id"), "word").distinct()
    return own.unionByName(neighbours.select(F.col("word").alias("trie_id"), F.col("neighbour").alias("word"))).distinct()


def path_lines(edges: DataFrame) -> DataFrame:
    """``root-->...-->leaf`` lines of the trees in (child, parent); a root's parent is null."""
    leaves = edges.select(F.col("child").alias("at")).join(edges.select(F.col("parent").alias("at")), "at", "left_anti")
    rows = leaves.select(F.col("at").alias("path"), "at")
    done = None
    up = edges.select(F.col("child").alias("at"), "parent")
    store = Tables(edges.sparkSession, "paths")
    while True:
        rows = store.table(rows.join(up, "at", "left"))
        ended = rows.where("parent IS NULL").select("path")
        done = ended if done is None else done.unionByName(ended)
        rows = rows.where("parent IS NOT NULL").select(F.concat("parent", F.lit("-->"), "path").alias("path"), F.col("parent").alias("at"))
        if rows.isEmpty():
            return done.select(F.col("path").alias("value"))


def containment_parents(keys: DataFrame) -> DataFrame:
    """(child, parent): the longest other key that a key contains, found by an equi-join on exploded substrings."""
    subs = keys.select("word", F.explode(F.expr("flatten(transform(sequence(1, length(word)), i -> transform(sequence(1, length(word) - i + 1), n -> substring(word, i, n))))")).alias("part"))
    hits = subs.where("part != word").distinct().join(keys.select(F.col("word").alias("part")), "part")
    best = hits.groupBy("word").agg(F.max(F.struct(F.length("part").alias("l"), F.col("part").alias("p"))).alias("m"))
    return keys.join(best, "word", "left").select(F.col("word").alias("child"), F.col("m.p").alias("parent"))
