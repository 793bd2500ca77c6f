"""Token counts of a growing corpus as a Structured Streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import normalised_tokens


def token_count_stream(texts: DataFrame) -> DataFrame:
    """(word, freq) of a stream of texts; run it in complete or update mode."""
    return normalised_tokens(texts).groupBy("word").agg(F.count("*").alias("freq"))


def count_directory(spark: SparkSession, path: str, schema: str, name: str, checkpoint: str) -> DataFrame:
    """Counts all files of a directory by one streaming run and returns the table it made."""
    stream = spark.readStream.schema(schema).parquet(path)
    query = token_count_stream(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
