"""Operator 4: fuzzy line dedup by MinHash, banding, exact Jaccard verification and distributed union-find.

DataFrame operations only, as in the query, whose CPU limit that form exceeds (README has the figures).  If ``native`` is
off, lines are signed and verified in numpy over Arrow batches.  Every line that isn't blank takes part.
Its shingles are all runs of ``WIDTH`` UTF-16 code units, in numpy of characters (a shorter line is one shingle), hashed,
made distinct and sorted.  The hash range is cut at ``BANDS``
points; a band is the ``ROWS`` smallest hashes from its point on, around the end of the range: a MinHash over one
permutation that leaves no bin empty.  All lines are signed alike, so any two similar ones may share a band.  Lines
whose text is equal share two 64-bit hashes; the first names them among candidates, and a line that has it by chance
is only taken for its own copies.  Lines that share a band are candidates (``_links``: no bucket gives
all its pairs) and are verified on their full shingle sets.  Bands of small sets rarely meet, so a set of up to
``SMALL`` shingles has keys of its own: one for each subset that keeps the wanted share of it.  What two similar sets
have in common is such a subset of both, so no pair of small sets is missed; sets of less than ``LEAST`` have these keys
only, and their partners are small from a similarity of 45 on.  Of each component the line with the smallest
(doc_id, position) stays, all others go, and documents keep the order of their lines.

Skew: repeated lines are aggregated before they are shuffled; lines that make a thousandth of all lines or more, at
most a thousand, are joined back by broadcast.  Documents that lose no line are not shuffled.

Defined cases: null text has no lines and stays null; blank lines stay.  Rows that repeat an identifier and a text are
treated alike.  A document without identifier comes last when the line that stays is chosen.  Other columns of the
input stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import FILTER_BITS, Scratch, bitmap_of, maybe_in, read_table, surely_out
from ._links import link_all, outlines

WIDTH = 8
BANDS, ROWS = 12, 4
ORDERS = 3  # other bands by which the items of a bucket are put in order
OUTLINE = 16  # words of 64 bits of a line's outline: unrelated sets of up to 2,300 shingles are told apart
HOT_SHARE = 1000
LEAST = 5  # distinct shingles that a banded line has
SMALL = 9  # most distinct shingles of a line whose subsets are keys


def _hashes(units: str, starts: str, width: int) -> Column:
    """Hashes of the runs at ``starts`` of a line's UTF-16 units.  The units are bound once, outside the inner lambda."""
    return F.expr(f"transform(array({units}), u -> transform({starts}, i -> xxhash64(substring(u, i, {2 * width}))))[0]")


def shingle_hashes(line: str, width: int) -> Column:
    """Hashes of all shingles of a string column, in order."""
    return _hashes(f"encode({line}, 'UTF-16BE')", f"sequence(1, greatest(octet_length(u) - {2 * width - 1}, 1), 2)", width)


def with_shingles(rows: DataFrame, width: int, **of: str) -> DataFrame:
    """Rows with a column of ``shingle_hashes`` for each string column named, in its place.

    Units and places are columns of their own, which compiled code makes; only the hashes are left to the interpreter.
    """
    for name, line in of.items():
        rows = rows.withColumn("units", F.encode(line, "UTF-16BE")).drop(line)
        rows = rows.withColumn("starts", F.expr(f"sequence(1, greatest(octet_length(units) - {2 * width - 1}, 1), 2)"))
        # there is always a place; named twice, the column isn't merged into the interpreted expression
        rows = rows.withColumn(name, F.when(F.size("starts") > 0, _hashes("units", "starts", width))).drop("units", "starts")
    return rows


def with_hashes(lines: DataFrame, width: int) -> DataFrame:
    """A row (doc_id, row, pos, id, id2, hashes) for each line: its distinct shingles, sorted."""
    rows = with_shingles(lines, width, hashes="line")
    return rows.select("doc_id", "row", "pos", "id", "id2", F.array_distinct(F.sort_array("hashes")).alias("hashes"))


def subset_keys(similarity: int) -> Column:
    """A key for each subset of up to ``SMALL`` sorted ``hashes`` that holds ``similarity`` per cent of them."""
    masks = [[m for m in range(1, 1 << n) if m.bit_count() * 100 >= n * similarity] for n in range(1, SMALL + 1)]
    own = F.element_at(F.array(*(F.array(*map(F.lit, ms)) for ms in masks)), F.size("hashes"))
    return F.transform(own, lambda m: F.xxhash64(F.lit(-1), F.filter("hashes", lambda h, i: F.getbit(m, i) == 1)))


def native_bands(rows: DataFrame, bands: int, n: int, similarity: int) -> DataFrame:
    """Rows with a column ``bands``, the keys made of their sorted ``hashes``.

    Each array is a column, so it is made once; the code stays short enough for the JVM to compile.
    """
    step = 2**64 // bands
    cuts = [-(2**63) + step // 2 + k * step for k in range(bands)]
    rows = rows.withColumn("marked", F.sort_array(F.concat("hashes", F.array(*map(F.lit, cuts)))))
    rows = rows.withColumn("ring", F.concat("hashes", F.slice("hashes", 1, n)))
    places = [(F.array_position("marked", F.lit(c)) - k).cast("int") for k, c in enumerate(cuts)]
    keys = F.array(*(F.xxhash64(F.lit(k), F.slice("ring", at, n)) for k, at in enumerate(places)))
    none = F.array().cast("array<bigint>")
    of_bands = F.when(F.size("hashes") >= LEAST, keys).otherwise(none)
    of_subsets = F.when(F.size("hashes") <= SMALL, subset_keys(similarity)).otherwise(none)
    return rows.withColumn("bands", F.concat(of_bands, of_subsets)).withColumn("n", F.size("hashes").cast("long")).drop("hashes", "marked", "ring")


def with_bands(lines: DataFrame, width: int, bands: int, n: int, similarity: int) -> DataFrame:
    """The lines with the size of their shingle set and their keys, without their text."""

    def run(it):
        import pyarrow as pa

        from ._line_sketch import sketch
        from ._worker import claim

        claim("lines", lambda: None)
        for batch in it:
            sizes, offsets, keys = sketch(batch.column("line").to_pylist(), width, bands, n, similarity, LEAST, SMALL)
            names = [c for c in batch.schema.names if c != "line"]
            made = [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], [*names, "n", "bands"])

    schema = lines.drop("line").schema
    return lines.mapInArrow(run, T.StructType([*schema.fields, T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]))


def similar_pairs(pairs: DataFrame, width: int, similarity: int) -> DataFrame:
    """(a, b) of the pairs (a, b, la, lb) whose lines are similar on their full shingle sets."""

    def run(it):
        import pyarrow as pa

        from ._line_sketch import similar
        from ._worker import claim

        claim("lines", lambda: None)
        for batch in it:
            a, b = batch.column("a"), batch.column("b")
            holds = similar(a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False), batch.column("la").to_pylist(), batch.column("lb").to_pylist(), width, similarity)
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(holds))

    return pairs.select("a", "b", "la", "lb").mapInArrow(run, "a long, b long")


def line_outlines(lines: DataFrame, width: int, words: int) -> DataFrame:
    """(id, bits) of lines (id, line): ``_links.outlines`` of their shingle sets."""

    def run(it):
        import pyarrow as pa

        from ._line_sketch import outline
        from ._worker import claim

        claim("lines", lambda: None)
        for batch in it:
            bits = pa.array(outline(batch.column("line").to_pylist(), width, words).ravel(), pa.int64())
            offsets = pa.array(range(0, len(bits) + 1, words), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets, bits)], ["id", "bits"])

    return lines.select("id", "line").mapInArrow(run, "id long, bits array<long>")


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # the row's key is made before the lines are, not once for each of them
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("row"))
    rows = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where("trim(line) != ''").withColumn("id", F.xxhash64("line")).withColumn("id2", F.xxhash64(F.lit(1), "line"))


def line_decisions(docs: DataFrame, scratch: Scratch, similarity: int, width: int, bands: int, rows: int, id_col: str, text_col: str, filter_bits: int, native: bool) -> DataFrame:
    """(row, doc_id, drops): the positions of the lines that go, for rows of the input that lose one."""
    lines = lines_of(docs, id_col, text_col)
    if native:
        signed = native_bands(with_hashes(lines, width), bands, rows, similarity)
    else:
        signed = with_bands(lines, width, bands, rows, similarity)
    seen = scratch.table(signed.select("doc_id", "row", "pos", "id", "id2", "n", "bands"))
    places = seen.select("doc_id", "row", "pos", "id", "id2")
    total = places.count()

    # the keys after a band's own are the other sketches that order its bucket
    at = F.posexplode("bands").alias("k", "bucket")
    all_buckets = seen.select("id", "n", "bands", at).select("id", "n", "bucket", F.expr(f"transform(sequence(1, {ORDERS}), i -> bands[(k + i) % size(bands)])").alias("orders"))
    shared = all_buckets.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo != hi").select("bucket")
    shared = scratch.table(shared)
    buckets = maybe_in(all_buckets, "bucket", bitmap_of(shared, "bucket", filter_bits), filter_bits).distinct()
    buckets = scratch.table(buckets.join(shared.hint("merge"), "bucket", "left_semi"))

    # the size of a set is known, unless texts of different sizes share an identifier by chance
    sizes = buckets.groupBy("id").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    wanted = scratch.table(sizes.select("id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("n")))
    texts = maybe_in(lines.select("id", "id2", "line"), "id", bitmap_of(wanted, "id", filter_bits), filter_bits)
    texts = texts.groupBy("id").agg(F.min(F.struct("id2", "line")).alias("x")).join(wanted, "id")
    texts = scratch.table(texts.select("id", "n", "x.id2", "x.line"))

    def outline(ids: DataFrame) -> DataFrame:
        some = texts.join(ids, "id", "left_semi")
        if not native:
            return line_outlines(some, width, OUTLINE)
        sets = with_shingles(some.select("id", "line"), width, items="line")
        return outlines(sets.select("id", F.array_distinct("items").alias("items")), OUTLINE)

    def verify(pairs: DataFrame) -> DataFrame:
        # texts are exchanged and shingled where they meet: their sets are eight times as large
        of_a = texts.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("line").alias("la"))
        of_b = texts.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("line").alias("lb"))
        joined = pairs.join(of_b, "b").join(of_a, "a")
        if not native:
            return similar_pairs(joined, width, similarity)
        hashed = with_shingles(joined, width, sa="la", sb="lb")
        size_of = lambda n, hashes: F.coalesce(n, F.size(F.array_distinct(hashes)))
        sized = hashed.select("a", "b", (size_of("na", "sa") + size_of("nb", "sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("both"))
        return sized.where(F.col("both") * (100 + similarity) >= F.col("n") * similarity).select("a", "b")

    labels = link_all(buckets, verify, outline, similarity, OUTLINE, scratch)
    scratch.drop(buckets, shared)

    # a line whose 64-bit identifier is another text's by chance has no label: it is equal to its own copies only
    labels = labels.join(texts.select("id", "id2"), "id")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "pos", "row")
    groups = places.groupBy("id", "id2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    groups = groups.join(labels, ["id", "id2"], "left").where("n > 1 OR label IS NOT NULL")
    groups = scratch.table(groups.withColumn("label", F.struct(F.coalesce("label", "id").alias("of"), F.when(F.col("label").isNull(), F.col("id2")).alias("own"))))
    stays = groups.groupBy("label").agg(F.min("first").alias("stays")).withColumnRenamed("label", "of")
    groups = scratch.table(groups.join(stays, F.col("label").eqNullSafe(F.col("of"))).select("id", "id2", "n", "stays"))

    hot = F.broadcast(groups.where(F.col("n") * HOT_SHARE >= total))  # HOT_SHARE rows at most
    cold = groups.where(F.col("n") * HOT_SHARE < total)
    of_cold = maybe_in(places, "id", bitmap_of(cold, "id", filter_bits), filter_bits).join(cold.hint("merge"), ["id", "id2"])
    found = places.join(hot, ["id", "id2"]).unionByName(of_cold)
    gone = found.where(~((F.col("row") == F.col("stays.row")) & F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("pos") == F.col("stays.pos"))))
    drops = scratch.table(gone.groupBy("row", "doc_id").agg(F.collect_set("pos").alias("drops")))
    scratch.drop(seen, wanted, texts, groups)
    return drops


def line_dedup(docs: DataFrame, similarity: int = 80, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS, native: bool = True) -> DataFrame:
    """The input's rows with the text that is left, and the columns n_lines and n_dropped (renamed where taken).

    Lines are signed and verified by DataFrame functions, or in numpy over Arrow batches if not ``native``.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    drops = line_decisions(docs, scratch, similarity, width, bands, rows, id_col, text_col, filter_bits, native)
    names = docs.columns
    own = "input_row"
    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias(own), F.xxhash64(id_col, text_col).alias("row"), F.col(id_col).alias("of"))
    bitmap = bitmap_of(drops, "row", filter_bits)
    same = (F.col("row") == F.col("gone_row")) & F.col("of").eqNullSafe(F.col("gone_of"))
    drops = drops.select(F.col("row").alias("gone_row"), F.col("doc_id").alias("gone_of"), "drops")
    touched = maybe_in(plain, "row", bitmap, filter_bits).join(drops.hint("merge"), same, "left")
    rest = surely_out(plain, "row", bitmap, filter_bits).select(own, "row", F.lit(None).cast("array<int>").alias("drops"))
    all_rows = touched.select(own, "row", "drops").unionByName(rest)

    text = F.col(f"{own}.{text_col}")
    all_rows = all_rows.select(own, "drops", F.split(text, "\n").alias("lines"))  # a column, so a text is split once
    lines = F.col("lines")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drops"))
    left = F.array_join(F.transform(F.array(lines), lambda ls: F.transform(kept, lambda i: F.get(ls, i)))[0], "\n")
    new_text = F.when(F.col("drops").isNull(), text).otherwise(left)
    new = lambda name: name if name not in names else f"{name}_of_line_dedup"
    return all_rows.select(
        *(new_text.alias(c) if c == text_col else F.col(f"{own}.`{c}`").alias(c) for c in names),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias(new("n_lines")),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias(new("n_dropped")),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", "text")


#: The same rows by all pairs of lines that share a shingle; for tables of the size of the tests.
OP4_SQL = """
WITH RECURSIVE lines AS (
  SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
), places AS (SELECT * FROM lines WHERE trim(line) <> ''),
firsts AS (SELECT line, arg_min(doc_id, (doc_id, i)) AS doc_id, min((doc_id, i)) AS place, row_number() OVER (ORDER BY min((doc_id, i))) AS id FROM places GROUP BY line),
sets AS (SELECT id, list_distinct([substring(line, j, 8) for j in range(1, greatest(length(line) - 7, 1) + 1)]) AS ss FROM firsts),
items AS (SELECT id, len(ss) AS n, unnest(ss) AS s FROM sets),
links AS (
  SELECT a.id AS a, b.id AS b FROM items a JOIN items b ON a.s = b.s AND a.id < b.id AND least(a.n, b.n) * 100 >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2, a.n, b.n HAVING count(*) * 180 >= (a.n + b.n) * 80
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a, a AS b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b),
stays AS (SELECT f.line, f.place FROM firsts f LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY 1) r ON r.a = f.id WHERE r.least IS NULL OR r.least = f.id),
kept AS (SELECT l.doc_id, l.i, l.line, trim(l.line) = '' OR s.line IS NOT NULL AS stay FROM lines l LEFT JOIN stays s ON s.line = l.line AND s.place = (l.doc_id, l.i)),
done AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stay) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stay), '') AS text FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, done.text FROM documents d LEFT JOIN done USING (doc_id)
"""
