"""Operator 9: near-dedup by SuperMinHash, banding, verification on full sets and distributed union-find.

Documents with equal shingle sets are one class; their signatures are equal, so only one row of a class is banded.
Classes that share a band are candidates (``_links``: no bucket gives all its pairs).  A candidate pair is verified on
its full sets, exchanged for candidates only, which a bitmap of fixed size finds.  Twenty bands of five values miss a
pair of similarity 0.85 once in a hundred thousand.

Skew: classes absorb copies of any number; those with a thousandth of all rows are joined back by broadcast, at most a
thousand of them.

Defined cases: null and empty texts have no shingles, are linked with nothing and stay.  Rows without identifier follow
their class; the smallest identifier that isn't null names the component, and a row without identifier stays only if
none of its component has one.  Repeated rows stay or go together.  Columns besides the two named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import FILTER_BITS, Scratch, bitmap_of, maybe_in, read_table, without
from ._links import link_all, outlines

BANDS, ROWS = 20, 5
ORDERS = 3  # other bands by which the items of a bucket are put in order
NEAR = 8  # items before it that an item is paired with first, in each order of each of its bands
OUTLINE = 16  # words of 64 bits of a set's outline
HOT_SHARE = 1000
_ELEMENTS = 60_000


def _class_ids(values) -> tuple[int, int]:
    """128 bits that name a set, as two integers."""
    import hashlib

    digest = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def sketch(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, row, n, class, class2, bands) of documents (doc_id, row, text)."""

    def run(it):
        import numpy as np
        import pandas as pd

        from ._shingle import band_keys, forget, shingles, superminhash
        from ._worker import claim

        claim("shingles", forget)
        for pdf in it:
            sizes, classes, keys = [], [], []
            sets = []

            def flush():
                sig = superminhash(sets[len(keys) :], bands * rows)
                keys.extend(band_keys(sig, bands).view(np.int64))

            waiting = 0
            for t in pdf["text"]:
                s = shingles(t, width)
                sets.append(s)
                sizes.append(len(s)), classes.append(_class_ids(s))
                waiting += len(s)
                if waiting >= _ELEMENTS:
                    flush()
                    sets[:] = [()] * len(sets)
                    waiting = 0
            if len(keys) < len(sets):
                flush()
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "row": pdf["row"], "n": sizes, "class": [c for c, _ in classes], "class2": [c for _, c in classes], "bands": keys})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(run, f"doc_id {kind}, row long, n long, class long, class2 long, bands array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, id2, items) of documents (doc_id, text): the class and the sorted fingerprints."""

    def run(it):
        import numpy as np
        import pandas as pd

        from ._shingle import forget, shingles
        from ._worker import claim

        claim("shingles", forget)
        for pdf in it:
            sets = [shingles(t, width) for t in pdf["text"]]
            names = [_class_ids(s) for s in sets]
            yield pd.DataFrame({"id": [c for c, _ in names], "id2": [c for _, c in names], "items": [s.view(np.int64) for s in sets]})

    return docs.select("text").mapInPandas(run, "id long, id2 long, items array<long>")


def _renamed(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """The rows, and whether some were renamed: where different sets share a class by chance, all but one set get a class
    made of both hashes."""
    turn = 0
    while True:
        names = rows.groupBy("class").agg(F.min("class2").alias("lo"), F.max("class2").alias("hi")).where("lo != hi")
        if (names := scratch.table(names)).isEmpty():
            return rows, turn > 0
        turn += 1
        other = F.col("lo").isNotNull() & (F.col("class2") != F.col("lo"))
        rows = rows.join(names.select("class", "lo"), "class", "left")
        rows = scratch.table(rows.withColumn("class", F.when(other, F.xxhash64("class", "class2")).otherwise(F.col("class"))).drop("lo"))


def minhash_dedup(docs: DataFrame, similarity: int = 85, width: int = 3, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, row.  Links have ``similarity`` per cent or more.

    ``row`` is a hash of identifier and text, by which rows of the input are found again.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("row"))
    made = scratch.table(sketch(texts, width, bands, rows))
    total = made.count()
    full, renamed = _renamed(made.where("n > 0"), scratch)
    classes = full.groupBy("class").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("class2").alias("id2"))
    classes = scratch.table(classes.withColumnRenamed("class", "id"))
    # the keys after a band's own are the other sketches that order its bucket
    at = F.posexplode("bands").alias("k", "bucket")
    buckets = classes.select("id", "n", "bands", at).select("id", "n", "bucket", F.expr(f"transform(sequence(1, {ORDERS}), i -> bands[(k + i) % size(bands)])").alias("orders"))

    shared = buckets.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket")
    buckets = scratch.table(buckets.join(shared.hint("merge"), "bucket", "left_semi"))

    # only candidates' documents are shingled again, one for each class
    wanted = scratch.table(classes.join(buckets.select("id").distinct(), "id", "left_semi").select("id", "id2", "first_id"))
    firsts = wanted.select(F.col("first_id").alias("doc_id"))
    near = maybe_in(texts, "doc_id", bitmap_of(firsts.where("doc_id IS NOT NULL"), "doc_id", filter_bits), filter_bits)
    lone = texts.where("doc_id IS NULL")
    sets = full_sets(near.unionByName(lone), width)
    if renamed:
        sets = sets.withColumn("id", F.explode(F.array("id", F.xxhash64("id", "id2"))))
    sets = sets.join(wanted, ["id", "id2"], "left_semi")
    sets = scratch.table(sets.groupBy("id").agg(F.first("items").alias("items")))

    def outline(ids: DataFrame) -> DataFrame:
        return outlines(sets.join(ids, "id", "left_semi"), OUTLINE)

    def verify(pairs: DataFrame) -> DataFrame:
        of_a = sets.select(F.col("id").alias("a"), F.col("items").alias("sa"))
        of_b = sets.select(F.col("id").alias("b"), F.col("items").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        joined = pairs.join(of_b, "b").join(of_a, "a")
        return joined.where(both * (100 + similarity) >= (F.size("sa") + F.size("sb")) * similarity).select("a", "b")

    labels = link_all(buckets, verify, outline, similarity, OUTLINE, scratch, NEAR)
    named = classes.select("id", "first_id", "copies").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    # Classes without a link name their component themselves
    linked = named.join(labels.select("label").distinct(), "label", "left_semi").join(least, "label").select("id", "component_id", "copies")
    single = named.join(labels.select("id"), "id", "left_anti").select("id", F.col("first_id").alias("component_id"), "copies")
    of_class = scratch.table(linked.unionByName(single))

    rows_of = full.select("doc_id", "row", F.col("n").alias("n_shingles"), F.col("class").alias("id"))
    hot = F.broadcast(of_class.where(F.col("copies") * HOT_SHARE >= total))  # HOT_SHARE rows at most
    cold = of_class.where(F.col("copies") * HOT_SHARE < total).hint("merge")
    out = rows_of.join(hot, "id").unionByName(rows_of.join(hot.select("id"), "id", "left_anti").join(cold, "id"))
    none = made.where("n = 0").select("doc_id", "row", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = out.select("doc_id", "row", "n_shingles", "component_id").unionByName(none)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "row")


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of the input that stay, with all their columns."""
    scratch = Scratch(docs.sparkSession, "minhash-rows")
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    gone = scratch.table(minhash_dedup(docs, **options).where("NOT kept").select("row"))
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("input_row")
    rows = docs.select(own, F.xxhash64(id_col, text_col).alias("row"))
    return without(rows, "row", gone).select("input_row.*")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(read_table(spark, sf_dir, "documents")).drop("row")


#: The same rows by all pairs that share a shingle; for tables of the size of the tests.
OP9_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct([array_to_string(ws[i:i + 2], ' ') for i in range(1, len(ws) - 1)]) END AS ss FROM docs
), items AS (
  SELECT doc_id, len(ss) AS n, unnest(ss) AS s FROM sets
), classes AS (
  SELECT doc_id, len(ss) AS n, min(doc_id) OVER (PARTITION BY list_sort(ss)) AS class FROM sets WHERE len(ss) > 0
), firsts AS (
  SELECT items.* FROM items SEMI JOIN (SELECT DISTINCT class FROM classes) c ON c.class = items.doc_id
), shared AS MATERIALIZED (
  SELECT doc_id, n, k FROM firsts JOIN (SELECT s, row_number() OVER () AS k FROM firsts GROUP BY s HAVING count(*) > 1) USING (s)
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shared a JOIN shared b ON a.k = b.k AND a.doc_id <> b.doc_id AND least(a.n, b.n) * 100 >= 85 * greatest(a.n, b.n)
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT DISTINCT class AS a, class AS b FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), named AS (
  SELECT a AS class, min(b) AS component_id FROM reach GROUP BY 1
)
SELECT s.doc_id, CAST(len(ss) AS BIGINT) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, coalesce(component_id, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN classes c ON c.doc_id = s.doc_id LEFT JOIN named ON named.class = c.class
"""
