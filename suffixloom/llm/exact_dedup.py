"""Operator 1: exact dedup by a log-structured merge index of text digests.

The log is read in ``BATCHES`` memtables.  Each is flushed as a sorted run of distinct digests with the identifier that
stays and the number of rows, and with a filter: a bitmap of fixed size.  Compaction merges the runs and the level before
them into a new level; it probes the filters of the other tables for every digest, hands on what none of them can have as
it is, and shuffles and merges the rest.  Later batches can be flushed and compacted into an existing level.
Documents whose digest the level holds more than once are hits; their normalised bytes are compared with those of the
row that stays, and a hit that differs is grouped by its text itself, so a digest collision costs time, never a row.

Skew: digests are counted before they are shuffled.  Those that hold a thousandth of all rows or more - at most a
thousand - are joined by broadcast; the text of the row that stays is replicated so that no task compares more than
``VERIFY_ROWS`` rows of a group.  Texts are only shuffled for hits, found by a bitmap of fixed size.

Defined cases: null text counts as empty; empty texts equal one another.  Rows without an identifier count in the
group size and stay only if no row of the group has one.  Rows that repeat an identifier and a text stay or go
together.  An empty table gives an empty result.  Columns besides the two named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import FILTER_BITS, Scratch, ascii_lower, bitmap_of, maybe_in, maybe_in_any, read_table, surely_out

HOT_SHARE = 1000
VERIFY_ROWS = 1024
BATCHES = 2  # memtables of the registered query


class DigestIndex:
    """A log-structured merge index: digest -> (identifier that stays, rows)."""

    def __init__(self, spark: SparkSession, keep: str = "min", digest_bits: int = 256, filter_bits: int = FILTER_BITS):
        self.scratch = Scratch(spark, "exact-dedup")
        self.pick = F.max if keep == "max" else F.min
        self.digest_bits, self.filter_bits = digest_bits, filter_bits
        self.runs: list[tuple[DataFrame, DataFrame]] = []  # sorted runs and their filters
        self.level: DataFrame | None = None

    def digested(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        text = ascii_lower(F.col(text_col))
        rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("norm"))
        rows = rows.withColumn("sha", F.unhex(F.sha2("norm", 256)))
        return rows.withColumn("digest", F.substring("sha", 1, self.digest_bits // 8))

    def log(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The rows (digest, doc_id, sha) of documents, written once."""
        return self.scratch.table(self.digested(docs, id_col, text_col).select("digest", "doc_id", "sha"))

    def _filter(self, table: DataFrame) -> DataFrame:
        return self.scratch.table(bitmap_of(table, "digest", self.filter_bits))

    def flush(self, log: DataFrame) -> DataFrame:
        """A memtable of the log becomes a sorted run of distinct digests."""
        rows = log.groupBy("digest").agg(self.pick("doc_id").alias("keep_id"), F.count("*").alias("n"))
        run = self.scratch.table(rows.sortWithinPartitions("digest"))
        self.runs.append((run, self._filter(run)))
        return run

    def compact(self) -> DataFrame:
        """Merge the runs into the level.  Digests that no other table's filter has aren't shuffled."""
        tables = self.runs + ([(self.level, self._filter(self.level))] if self.level is not None else [])
        alone, meet = [], []
        for i, (table, _) in enumerate(tables):
            others = [bitmap for j, (_, bitmap) in enumerate(tables) if j != i]
            rest = table
            for bitmap in others:
                rest = surely_out(rest, "digest", bitmap, self.filter_bits)
            alone.append(rest)
            meet += [maybe_in_any(table, "digest", others, self.filter_bits)] if others else []
        rows = _union(alone)
        if meet:
            rows = rows.unionByName(_union(meet).groupBy("digest").agg(self.pick("keep_id").alias("keep_id"), F.sum("n").alias("n")))
        self.level = self.scratch.table(rows.sortWithinPartitions("digest"))
        self.scratch.drop(*(t for pair in tables for t in pair))
        self.runs = []
        return self.level


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest_bits: int = 256, filter_bits: int = FILTER_BITS, batches: int = BATCHES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` says whether the smallest or the largest identifier of equal texts stays.  ``digest_bits`` shortens the
    digests of the index (tests use it to force collisions) and ``batches`` is the number of memtables; results don't depend on them.
    """
    spark = docs.sparkSession
    index = DigestIndex(spark, keep, digest_bits, filter_bits)
    log = index.log(docs, id_col, text_col)
    for k in range(batches):
        index.flush(log.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    level = index.compact()
    total = log.count()
    dup = level.where("n > 1")
    hot = dup.where(F.col("n") * HOT_SHARE >= total)  # at most HOT_SHARE rows, as their shares add up to one at most
    cold = dup.where(F.col("n") * HOT_SHARE < total)

    def with_group(rows: DataFrame, how: str) -> DataFrame:
        of_hot = rows.join(F.broadcast(hot), "digest")
        rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold.hint("merge"), "digest", how)
        return of_hot.unionByName(rest)

    # hits receive byte verification
    hits = index.scratch.table(maybe_in(index.digested(docs, id_col, text_col), "digest", bitmap_of(dup, "digest", filter_bits), filter_bits))
    hits = with_group(hits, "inner").withColumn("copies", F.ceil(F.col("n") / VERIFY_ROWS).cast("int"))
    first = (
        hits.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("digest", "copies")
        .agg(F.max("norm").alias("first_norm"))
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .drop("copies")
    )
    hits = hits.withColumn("copy", F.pmod(F.xxhash64("doc_id", "sha"), F.col("copies")).cast("int"))
    hits = hits.select("doc_id", "digest", "sha", "norm", "copy").join(first.hint("merge"), ["digest", "copy"])
    odd = index.scratch.table(hits.where("norm != first_norm").select("doc_id", "digest", "sha", "norm"))

    found = with_group(log, "left").select("doc_id", "digest", "sha", F.when(F.col("n") > 1, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("n"))
    if not odd.isEmpty():
        own = odd.groupBy("digest", "norm").agg(index.pick("doc_id").alias("own_keep"), F.count("*").alias("own_n"))
        own = odd.join(own, ["digest", "norm"]).select("doc_id", "digest", "sha", "own_keep", "own_n").distinct()
        fewer = odd.groupBy("digest").agg(F.count("*").alias("fewer"))
        same = [found.doc_id.eqNullSafe(own.doc_id), found.digest == own.digest, found.sha == own.sha]
        found = found.join(own, same, "left").select(found["*"], "own_keep", "own_n").join(fewer, "digest", "left")
        found = found.select(
            "doc_id", "sha",
            F.when(F.col("own_n").isNotNull(), F.col("own_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("own_n", F.col("n") - F.coalesce("fewer", F.lit(0))).alias("n"),
        )
    return found.select(
        "doc_id", "keep_id", F.col("n").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"), keep="max")


OP1_SQL = """
WITH norm AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), grouped AS (
  SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM norm
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM grouped
"""
