"""Helpers shared by the operators: shared tables, bounded filters, document input."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Bits of the fixed-size bitmap that pre-filters rows before a shuffle.  Its size, not the data's, bounds what is
#: broadcast (2**24 bits are 2 MB); a crowded bitmap lets more rows through and never loses one.
FILTER_BITS = 24


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only a single-machine session may lack one."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    set_by_code = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_by_code.isDefined():
        return set_by_code.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="suffixloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


class Scratch:
    """Tables in the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0

    def table(self, df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.root}/t{self._n}"
        df.write.options(**(options or {})).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later result reads."""
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII text takes the fast path."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _slot(key: Column, bits: int) -> Column:
    return F.xxhash64(key).bitwiseAND((1 << bits) - 1)


def bitmap_of(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """One row with an array of 2**bits bits: a Bloom filter with one hash."""
    slot = _slot(F.col(key), bits)
    words = keys.select(F.shiftrightunsigned(slot, 6).alias("w"), _one(slot).alias("b"))
    zeros = keys.sparkSession.range(1 << max(bits - 6, 0)).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    words = words.groupBy("w").agg(F.bit_or("b").alias("b")).unionByName(zeros).groupBy("w").agg(F.bit_or("b").alias("b"))
    return words.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("filter_words"))


def _one(slot: Column) -> Column:
    """The slot's bit in its word of 64."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))


def _bit(key: str, bitmap: DataFrame, bits: int) -> Column:
    slot = _slot(F.col(key), bits)
    word = F.get(bitmap.scalar(), F.shiftrightunsigned(slot, 6).cast("int"))
    return word.bitwiseAND(_one(slot)) != 0


def maybe_in(rows: DataFrame, key: str, bitmap: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose key may be in the bitmap; no row whose key is in it is lost."""
    return rows.where(_bit(key, bitmap, bits))


def maybe_in_any(rows: DataFrame, key: str, bitmaps: list[DataFrame], bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose key may be in one of the bitmaps."""
    hit = F.lit(False)
    for bitmap in bitmaps:
        hit = hit | F.coalesce(_bit(key, bitmap, bits), F.lit(False))
    return rows.where(hit)


def surely_out(rows: DataFrame, key: str, bitmap: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The other rows: their key isn't in the bitmap, or is null."""
    return rows.where(~F.coalesce(_bit(key, bitmap, bits), F.lit(False)))


def without(rows: DataFrame, key: str, gone: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """A left anti join on ``key`` that shuffles only rows that may go.  ``gone`` is read twice."""
    bitmap = bitmap_of(gone, key, bits)
    some = maybe_in(rows, key, bitmap, bits).join(gone.select(key).distinct().hint("merge"), key, "left_anti")
    return surely_out(rows, key, bitmap, bits).select(rows.columns).unionByName(some.select(rows.columns))


def sample_texts(docs: DataFrame, text_col: str, rows: int, chars: int) -> DataFrame:
    """Distinct texts of at most ``chars`` characters, about ``rows`` of them at most, chosen by a hash of the text.

    Copies are taken or left together, and the partitioning of the input doesn't matter.
    """
    total, share = docs.count(), 1 << 30
    texts = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (F.length("text") <= chars))
    return texts.where(F.pmod(F.xxhash64("text"), F.lit(share)) < min(share, -(-share * rows // max(total, 1)))).distinct()
