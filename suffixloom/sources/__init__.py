"""Sources: word lists, segmentations, vectors, tries, models and raw text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def text_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Lines (value) of text files; other encodings than UTF-8, such as ISO-8859-9, go through the CSV reader."""
    if encoding.upper() == "UTF-8":
        return spark.read.text(path)
    return spark.read.schema("value STRING").csv(path, sep="\u0001", encoding=encoding, quote="")


def parse_word_list(lines: DataFrame, threshold: int = 0, min_length: int = 1) -> DataFrame:
    """(word, freq) of lines ``freq word`` with freq >= threshold and more than ``min_length`` characters."""
    parts = F.split(F.trim("value"), " +")
    rows = lines.select(F.get(parts, F.lit(1)).alias("word"), F.get(parts, F.lit(0)).try_cast("bigint").alias("freq"))
    return rows.where((F.col("freq") >= threshold) & (F.length("word") > min_length))


def decode_targets(lines: DataFrame) -> DataFrame:
    return parse_word_list(lines, 0, 0).select("word").distinct()


def until_blank(lines: DataFrame, number: str = "line_no") -> DataFrame:
    """Rows before the first blank line; ``number`` orders them."""
    stop = lines.where(F.trim("value") == "").agg(F.min(number).alias("stop"))
    return lines.join(F.broadcast(stop), F.col("stop").isNull() | (F.col(number) < F.col("stop"))).drop("stop")  # one row is broadcast


def parse_vectors(lines: DataFrame) -> DataFrame:
    parts = F.split(F.trim("value"), " +")
    return lines.select(parts[0].alias("word"), F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.cast("float")).alias("vec"))


def parse_segmented(lines: DataFrame) -> DataFrame:
    """(freq, morphs) of lines ``freq stem+suffix+...``."""
    parts = F.filter(F.split("value", "[ +]+"), lambda x: x != "")
    return lines.select(parts[0].cast("double").alias("freq"), F.slice(parts, 2, F.size(parts) - 1).alias("morphs"))


def parse_clusters(lines: DataFrame) -> DataFrame:
    """(trie_id, word): one cluster a line, named by its first word."""
    words = F.split(F.trim("value"), " +")
    return lines.select(words[0].alias("trie_id"), F.explode(words).alias("word")).where("word != ''")


def raw_tokens(texts: DataFrame, column: str = "text") -> DataFrame:
    """Tokens of raw text parted by blanks and line ends."""
    return texts.select(F.explode(F.split(column, "[ \\n\\r]+")).alias("word")).where("word != ''")


def normalised_tokens(texts: DataFrame, column: str = "text") -> DataFrame:
    """Lower-case words of letters of any script, two or more."""
    words = F.explode(F.split(F.regexp_replace(F.lower(column), "[^\\p{L}]+", " "), " "))
    return texts.select(words.alias("word")).where(F.length("word") >= 2)


def lexicon(texts: DataFrame, threshold: int = 1) -> DataFrame:
    return normalised_tokens(texts).groupBy("word").agg(F.count("*").alias("freq")).where(F.col("freq") >= threshold)


def lexicon_vectors(words: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Vectors bound to words by rank.  Only as many words as there are vectors are ranked."""
    n = embeddings.agg((F.max("vec_id") + 1).cast("int")).first()[0] or 0
    top = words.orderBy(F.desc("freq"), "word").limit(n)
    ranked = top.withColumn("vec_id", (F.row_number().over(W.orderBy(F.desc("freq"), "word")) - 1).cast("bigint"))
    return ranked.join(embeddings, "vec_id").select("word", "vec_id", F.col("embedding").alias("vec"))


def last_by_order(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A map read from rows: the last value of a key stays."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def parse_hand_segmented(lines: DataFrame) -> DataFrame:
    """(word, morphs) of lines ``stem+suffix+...``."""
    morphs = F.filter(F.split(F.trim("value"), "\\+"), lambda x: x != "")
    return lines.select(F.array_join(morphs, "").alias("word"), morphs.alias("morphs")).where("word != ''")


def load_tries(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of a directory of tries, a folder for each trie_id."""
    return spark.read.option("basePath", path).parquet(path)


def load_table(spark: SparkSession, path: str, name: str, above: int | None = None) -> DataFrame:
    """A stored model table; counts strictly above a threshold."""
    rows = spark.read.parquet(f"{path}/{name}")
    return rows if above is None else rows.where(F.col("n") > above)
