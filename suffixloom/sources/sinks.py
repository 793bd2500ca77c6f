"""Sinks: text tables in the formats of the tools downstream, and models as Parquet directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ortho import german_map, turkish_ascii


def line_pair(a: Column, b: Column, sep: str) -> Column:
    return F.concat_ws(sep, a, b.cast("string"))


def count_lines(counts: DataFrame) -> DataFrame:
    """``m:n`` lines."""
    return counts.select(line_pair(F.col("morph"), F.col("n"), ":").alias("value"))


def bigram_lines(bigrams: DataFrame) -> DataFrame:
    """``a>b:n`` lines."""
    return bigrams.select(F.concat(F.col("first"), F.lit(">"), F.col("second"), F.lit(":"), F.col("n").cast("string")).alias("value"))


def transition_lines(probs: DataFrame) -> DataFrame:
    """``a->b:p`` lines."""
    return probs.select(F.concat(F.col("first"), F.lit("->"), F.col("second"), F.lit(":"), F.col("p").cast("string")).alias("value"))


def dump_lines(rows: DataFrame, value: str) -> DataFrame:
    """``m : x`` lines."""
    return rows.select(F.concat(F.col("morph"), F.lit(" : "), F.col(value).cast("string")).alias("value"))


def result_lines(decoded: DataFrame, language: str = "tr") -> DataFrame:
    """``word<tab>segmentation`` in the evaluator's letters."""
    seg = F.array_join("morphs", " ")
    if language == "tr":
        return decoded.select(F.concat_ws("\t", turkish_ascii(F.col("word")), turkish_ascii(seg)).alias("value"))
    return decoded.select(F.concat_ws("\t", german_map(F.col("word")), german_map(seg, capital_first=True)).alias("value"))


def trie_lines(segments: DataFrame) -> DataFrame:
    """One line a trie: words with the last morph set off by a blank, joined by ``_``."""
    m = F.col("morphs")
    head = F.array_join(F.slice(m, 1, F.size(m) - 1), "")
    word = F.when(F.size(m) > 1, F.concat(head, F.lit(" "), F.element_at(m, -1))).otherwise(F.element_at(m, 1))
    return segments.groupBy("trie_id").agg(F.array_join(F.sort_array(F.collect_list(word)), "_").alias("value"))


def write_text(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def write_model(tables: dict[str, DataFrame], path: str) -> None:
    """A model is a directory of Parquet tables."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def write_tries(nodes: DataFrame, path: str) -> None:
    """A folder of Parquet for each trie."""
    nodes.write.mode("overwrite").partitionBy("trie_id").parquet(path)


def nested_results(nested: DataFrame) -> DataFrame:
    """``freq stem+suffix`` lines of the words that were found."""
    return nested.where("found").select(F.concat_ws(" ", F.col("freq").cast("string"), F.array_join("morphs", "+")).alias("value"))


def nested_absents(nested: DataFrame) -> DataFrame:
    return nested.where("NOT found").select(F.concat_ws(" ", F.col("freq").cast("string"), "word").alias("value"))


def nested_totals(nested: DataFrame) -> DataFrame:
    """(kind, key, mass): word frequencies added up by result, stem, affix and absent word."""
    found = nested.where("found")
    part = lambda rows, kind, key: rows.select(F.lit(kind).alias("kind"), key.alias("key"), "freq")
    rows = part(found, "result", F.array_join("morphs", "+")).unionByName(part(found, "stem", F.element_at("morphs", 1)))
    rows = rows.unionByName(part(found, "affix", F.explode(F.expr("slice(morphs, 2, size(morphs))")))).unionByName(part(nested.where("NOT found"), "absent", F.col("word")))
    return rows.groupBy("kind", "key").agg(F.sum("freq").alias("mass"))


def nested_stems(nested: DataFrame) -> DataFrame:
    """``mass stem`` lines."""
    stems = nested_totals(nested).where("kind = 'stem'")
    return stems.select(F.concat_ws(" ", F.col("mass").cast("string"), "key").alias("value"))


def word_segmentations(samples: DataFrame) -> DataFrame:
    """word -> its distinct segmentations, the form in which samplers hand over to decoders."""
    return samples.groupBy("word").agg(F.sort_array(F.collect_set(F.array_join("morphs", "+"))).alias("segs"))
