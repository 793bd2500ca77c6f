"""Candidate pairs from buckets, and connected components, as DataFrame operations only.

Buckets are rows (bucket, id, n, orders): ``id`` names a class of equal items, ``n`` is the size of its set and
``orders`` an array of other sketches of it.  Pairs within a bucket are never all made; a bucket makes a bounded number of
them for each of its items:

1. Stars.  Every bucket is cut into parts of about ``PART`` items; each item is paired with the smallest of its part, and
   the smallest ones with each other in a chain.  Verified pairs make components.
2. Neighbours.  In buckets that still hold more than one component, items that share another sketch too make smaller
   groups, and each item is paired with the ``near`` before it in its group that are of other components.  Buckets of up
   to ``SMALL`` items are one group, so all their open pairs are tried.
3. The rest.  In buckets that then still hold more than one component, every pair of items of different components is
   compared by size and outline, and those that may be similar are verified.  An outline is the parity of an item's
   elements in each of a number of bins: two outlines differ in no more bins than the sets do in elements, so no similar
   pair is dropped.  Items of a bucket's largest component are compared with the others only.

Steps 1 and 2 only join most components early, so that step 3 has few open pairs; what a pair costs there is a few
instructions, but their number is the square of what stays open in a bucket.  A link is missed only if its items share no
band.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import Scratch

PART = 512
JUMPS = 3
SMALL, NEAR = 9, 16
MEETING = 4096  # items of a bucket that others meet in one task


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def sizes_allow(p: Column, q: Column, similarity: int) -> Column:
    """Whether sets of such sizes can have a similarity of so many per cent."""
    return F.least(p["n"], q["n"]) * 100 >= F.greatest(p["n"], q["n"]) * similarity


def outlines_allow(p: Column, q: Column, similarity: int, words: int) -> Column:
    """Whether the outlines differ in no more bins than similar sets do in elements; items without one may be similar."""
    differ = F.bit_count(p["bits"][0].bitwiseXOR(q["bits"][0]))
    for i in range(1, words):
        differ = differ + F.bit_count(p["bits"][i].bitwiseXOR(q["bits"][i]))
    return F.coalesce(differ * (100 + similarity) <= (p["n"] + q["n"]) * (100 - similarity), F.lit(True))


def outlines(sets: DataFrame, words: int) -> DataFrame:
    """(id, bits) of sets (id, items) of 64-bit hashes: the parity of the items in each of ``64 * words`` bins."""
    rows = sets.select("id", F.explode("items").alias("x"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x").bitwiseAND(63).cast("int"))
    word = F.shiftrightunsigned(F.col("x"), 6).bitwiseAND(words - 1)  # words is a power of two
    made = [F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(words)]
    return rows.groupBy("id").agg(*made).select("id", F.array(*(f"w{i}" for i in range(words))).alias("bits"))


def parted(buckets: DataFrame) -> DataFrame:
    """The rows of buckets of two items and more, with their number.  A merge join lets skewed buckets be split."""
    many = buckets.groupBy("bucket").agg(F.count("*").alias("items")).where("items > 1")
    return buckets.join(many.hint("merge"), "bucket")


def star_pairs(rows: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b), a < b, of each item and the smallest of its part, and of the smallest ones of neighbouring parts."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "bucket"), F.ceil(F.col("items") / PART)))
    rows = rows.withColumn("me", F.struct("id", "n"))
    rows = rows.withColumn("lead", F.first("me").over(W.partitionBy("bucket", "part").orderBy("id")))
    leads = rows.where("items > %d AND lead.id = id" % PART)
    next_lead = W.partitionBy("bucket").orderBy("part")  # one row for each PART items
    leads = leads.select(F.lag("me").over(next_lead).alias("p"), F.col("me").alias("q"))
    pairs = rows.select(F.col("lead").alias("p"), F.col("me").alias("q")).unionByName(leads)
    pairs = pairs.where("p IS NOT NULL AND p.id != q.id").where(sizes_allow(F.col("p"), F.col("q"), similarity))
    return pairs.select(*_ordered(F.col("p.id"), F.col("q.id"))).distinct()


def mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows, with their label, of the buckets that hold more than one component.  Of two items the one pair is tried."""
    rows = rows.where("items > 2").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    keys = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("bucket")
    return rows.join(keys.hint("merge"), "bucket", "left_semi")


def near_pairs(rows: DataFrame, similarity: int, words: int, near: int = NEAR) -> DataFrame:
    """Pairs of items of different components that lie side by side among those that share another sketch too.

    A bucket of up to ``SMALL`` items isn't parted by its other sketches; a part holds up to PART * PART items.
    """
    rows = rows.withColumn("me", F.struct("id", "n", "label", "bits"))
    whole = F.array(F.lit(0).cast("long"))
    rows = rows.select("bucket", "me", "items", F.posexplode(F.when(F.col("items") <= SMALL, whole).otherwise(F.col("orders"))).alias("turn", "order"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("me.id"), F.ceil(F.col("items") / (PART * PART))))
    chain = W.partitionBy("bucket", "turn", "order", "part").orderBy("me.id")
    before = F.array(*(F.lag("me", k).over(chain) for k in range(1, near + 1)))
    rows = rows.select(before.alias("ps"), F.col("me").alias("q"))
    q = F.col("q")
    open_ = F.filter("ps", lambda p: p.isNotNull() & (p["label"] != q["label"]) & sizes_allow(p, q, similarity) & outlines_allow(p, q, similarity, words))
    pairs = rows.select(F.explode(open_).alias("p"), "q")
    return pairs.select(*_ordered(F.col("p.id"), F.col("q.id")))


def open_pairs(rows: DataFrame, similarity: int, words: int, meeting: int = MEETING) -> DataFrame:
    """All pairs of a bucket's items that are of different components and that size and outline allow.

    Of two such items one isn't of the bucket's largest component.  These meet all items, about ``meeting`` in a task.
    """
    of_label = rows.groupBy("bucket", "label").agg(F.count("*").alias("k"))
    most = of_label.groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("x"), F.sum("k").alias("m")).where("x.k < m")
    most = most.select("bucket", F.col("x.label").alias("main"), F.ceil(F.col("m") / meeting).cast("int").alias("parts"))
    rows = rows.select("bucket", F.struct("id", "n", "label", "bits").alias("me")).join(most.hint("merge"), "bucket")
    few = rows.where("me.label != main").select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("me").alias("p"))
    all_ = rows.select("bucket", F.pmod(F.xxhash64("me.id"), F.col("parts")).cast("int").alias("part"), "main", F.col("me").alias("q"))
    p, q = F.col("p"), F.col("q")
    open_ = (p["label"] != q["label"]) & ((q["label"] == F.col("main")) | (p["id"] < q["id"]))
    met = few.join(all_.hint("merge"), ["bucket", "part"]).where(open_ & sizes_allow(p, q, similarity) & outlines_allow(p, q, similarity, words))
    return met.select(*_ordered(p["id"], q["id"]))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label) of every id that has a link; label is an id of its component, the same for all of them.

    Each round hooks every node to its neighbour of least priority, a hash that changes with the round, jumps along the
    hooks and contracts the graph; a path loses a constant share of its nodes in a round, so rounds grow with the
    logarithm of the links.  Rounds are tables in the shared folder.
    """
    hooks: list[DataFrame] = []
    work = scratch.table(links.select(*_ordered(F.col("a"), F.col("b"))).where("a != b").distinct())
    while not work.isEmpty():
        turn = F.lit(len(hooks))
        both = work.select("a", "b").unionByName(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", turn).alias("h"), F.col("b").alias("id"))).alias("m"))
        own = F.struct(F.xxhash64("a", turn).alias("h"), F.col("a").alias("id"))
        hook = scratch.table(best.select(F.col("a").alias("id"), F.when(F.col("m") < own, F.col("m.id")).otherwise(F.col("a")).alias("label")))
        for _ in range(JUMPS):
            up = hook.select(F.col("id").alias("label"), F.col("label").alias("up"))
            hook = hook.join(up, "label", "left").select("id", F.coalesce("up", "label").alias("label"))
        hook = scratch.table(hook)
        hooks.append(hook)
        of_a = hook.select(F.col("id").alias("a"), F.col("label").alias("la"))
        of_b = hook.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        work = scratch.table(work.join(of_a, "a").join(of_b, "b").where("la != lb").select(*_ordered(F.col("la"), F.col("lb"))).distinct())
    if not hooks:
        return work.select(F.col("a").alias("id"), F.col("b").alias("label"))
    out = hooks[0]
    for hook in hooks[1:]:
        up = hook.select(F.col("id").alias("label"), F.col("label").alias("up"))
        out = out.join(up, "label", "left").select("id", F.coalesce("up", "label").alias("label"))
    return scratch.table(out)


def merged(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The labels after more links: only components that these join are worked on."""
    of_a = labels.select(F.col("id").alias("a"), F.col("label").alias("la"))
    of_b = labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    ends = links.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    up = components(ends, scratch)
    old = labels.join(up.select(F.col("id").alias("label"), F.col("label").alias("up")), "label", "left").select("id", F.coalesce("up", "label").alias("label"))
    return scratch.table(old.unionByName(up.join(labels, "id", "left_anti")))


def link_all(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], outline: Callable[[DataFrame], DataFrame], similarity: int, words: int, scratch: Scratch, near: int = NEAR) -> DataFrame:
    """Labels (id, label) of the components that verified pairs of the buckets make.

    ``verify`` keeps the pairs (a, b) that have ``similarity`` per cent; ``outline`` gives (id, bits) of ids (id).
    """
    rows = scratch.table(parted(buckets))
    tried = scratch.table(star_pairs(rows, similarity))
    labels = components(scratch.table(verify(tried)), scratch)
    open_rows = scratch.table(mixed(rows, labels))
    scratch.drop(rows)
    if open_rows.isEmpty():
        return labels
    rows = scratch.table(open_rows.join(outline(open_rows.select("id").distinct()), "id", "left"))
    scratch.drop(open_rows)
    closer = scratch.table(near_pairs(rows, similarity, words, near).distinct().join(tried, ["a", "b"], "left_anti"))
    found = scratch.table(verify(closer))
    if not found.isEmpty():
        labels = merged(labels, found, scratch)
    open_rows = scratch.table(mixed(rows.drop("label", "orders"), labels))
    scratch.drop(rows)
    rest = open_pairs(open_rows, similarity, words).distinct()
    found = scratch.table(verify(rest.join(closer.unionByName(tried), ["a", "b"], "left_anti")))
    scratch.drop(open_rows, tried, closer)
    return labels if found.isEmpty() else merged(labels, found, scratch)
