"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session on a single machine may lack it."""
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


class Tables:
    """Parquet tables and text files of one job."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self) -> str:
        self._n += 1
        return f"{self.root}/t{self._n}"

    def table(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
