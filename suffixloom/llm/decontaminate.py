"""Operator 3: benchmark decontamination by greedy string tiling.

Runs of five words that a document shares with a benchmark item are the seeds.  A document and an item whose seeds could
cover ``coverage`` of the item are tiled: the longest common run of words that no tile holds yet is marked again and
again, found by running Karp-Rabin hashes, so passages that were reordered or cut apart still count.  The pair is
reported if the tiles cover that share of the item's words.  Words are lower-cased, and ASCII punctuation parts them.

The benchmark is the stated query set.  It is read in blocks of about ``BLOCK_CHARS`` characters, whose index is arrays of 16
bytes for each word beside the words themselves, so what a worker holds is bounded whatever the benchmark's size; documents
aren't shuffled.  A seed is looked up once for a text, however often it occurs there.

Defined cases: null and empty documents and items match nothing.  An item of fewer than five words must occur whole, as
one run.  Repeated items and repeated documents give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read_table

LEAST = 5
COVERAGE = 0.6
BLOCK_CHARS = 16_000_000
_PUNCTUATION = bytes(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_TABLE = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()


class SeedIndex:
    """The word runs of a block of benchmark items, and the search of texts for them."""

    def __init__(self, items: list[tuple[object, str | None]], least: int, coverage: float):
        import numpy as np

        self.least, self.coverage = least, coverage
        self.ids = [i for i, _ in items]
        words = [words_of(t) for _, t in items]
        self.vocab = {w: k for k, w in enumerate(sorted(set().union(*words)), 1)} if words else {}
        self.items = [[self.vocab[w] for w in ws] for ws in words]
        rng = np.random.default_rng(7)
        self.mult = rng.integers(1, 2**63, size=least, dtype=np.uint64) | np.uint64(1)
        # for each run length: the distinct keys, where the postings of each begin, and their items and places
        self.runs: dict[int, tuple] = {}
        for k in sorted({min(least, len(item)) for item in self.items if item}):
            mine = [(n, self.hashes(np.array(item, dtype=np.uint64), k)) for n, item in enumerate(self.items) if min(least, len(item)) == k]
            key = np.concatenate([h for _, h in mine])
            item = np.concatenate([np.full(len(h), n, dtype=np.int32) for n, h in mine])
            place = np.concatenate([np.arange(len(h), dtype=np.int32) for _, h in mine])
            order = np.lexsort((place, item, key))
            keys, first = np.unique(key[order], return_index=True)
            self.runs[k] = (keys, np.append(first, len(order)), item[order], place[order])

    def hashes(self, ids, k: int):
        import numpy as np

        n = max(len(ids) - k + 1, 0)
        h = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            x = ids[i : i + n] * self.mult[i]
            h += x ^ (x >> np.uint64(29))
        return h

    def search(self, text: str | None) -> list[tuple[object, float, int, int]]:
        """(item id, coverage, tiles, longest tile) of the items that the text covers."""
        import numpy as np

        words = words_of(text)
        if not words or not self.vocab:
            return []
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))
        zeros = np.concatenate(([0], np.cumsum(ids == 0)))
        out = []
        for k, (keys, first, owner, place) in self.runs.items():
            if len(ids) < k:
                continue
            full = np.nonzero(zeros[k:] == zeros[: len(zeros) - k])[0]  # runs of known words only
            if not len(full):
                continue
            h = self.hashes(ids, k)[full]
            slot = np.searchsorted(keys, h)
            slot[slot == len(keys)] = 0
            hit = keys[slot] == h
            at, slot = full[hit], slot[hit]
            # a seed is looked up once for the text, however often it occurs there
            found = np.unique(slot)
            sizes = first[found + 1] - first[found]
            post = np.repeat(first[found] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            key_of = np.repeat(found, sizes)
            order = np.argsort(owner[post], kind="stable")
            post, key_of = post[order], key_of[order]
            names, starts = np.unique(owner[post], return_index=True)
            for n, a, b in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(post)]):
                hits = self._tiled(n, k, ids, place[post[a:b]], at[np.isin(slot, key_of[a:b])])
                if hits is not None:
                    out.append((self.ids[n], *hits))
        return out

    def _tiled(self, n: int, k: int, ids, places, at) -> tuple[float, int, int] | None:
        """Coverage, tiles and longest tile of item n, whose seeds of k words are at ``places``, by a text that has them at ``at``."""
        import numpy as np

        from ._tiling import tiles

        item = self.items[n]
        could = np.zeros(len(item) + 1, dtype=np.int64)
        np.add.at(could, places, 1)
        np.add.at(could, places + k, -1)
        if (np.cumsum(could)[:-1] > 0).sum() < self.coverage * len(item):
            return None
        near = np.zeros(len(ids) + 1, dtype=np.int64)
        np.add.at(near, at, 1)
        np.add.at(near, at + k, -1)
        # what no seed touches can't be in a tile; a gap of it becomes one element that nothing equals
        where = np.nonzero(np.cumsum(near)[:-1] > 0)[0]
        part: list[int] = []
        for run in np.split(where, np.nonzero(np.diff(where) > 1)[0] + 1):
            part += [-1] * bool(part) + ids[run].tolist()
        found = tiles(item, part, k)
        share = sum(f[2] for f in found) / len(item)
        return (share, len(found), max(f[2] for f in found)) if share >= self.coverage else None


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """The items, a bounded block at a time."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    n = -(-int(items.agg(F.sum(F.length("text") + 64)).first()[0] or 0) // block_chars)
    for k in range(n):
        block = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toLocalIterator()]
        if block:
            yield block


def _index(spark: SparkSession, block, least: int, coverage: float):
    return spark.sparkContext.broadcast(SeedIndex(block, least, coverage))


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row (doc_id, item_id, coverage, n_tiles, longest_tile) for each document and item that it covers."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema[item_col].dataType.simpleString()}, coverage double, n_tiles long, longest_tile long"
    out = spark.createDataFrame([], schema)
    for block in blocks_of(benchmark, item_col, item_text_col, block_chars):
        index = _index(spark, block, least, coverage)

        def run(it, index=index):
            import pandas as pd

            for pdf in it:
                got = [(d, *hit) for d, t in zip(pdf["doc_id"], pdf["text"]) for hit in index.value.search(t)]
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "coverage", "n_tiles", "longest_tile"])

        out = out.unionByName(rows.mapInPandas(run, schema))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of the input that cover no benchmark item, with all their columns."""
    for block in blocks_of(benchmark, item_col, item_text_col, block_chars):
        index = _index(docs.sparkSession, block, least, coverage)

        @F.pandas_udf("boolean")
        def clean(texts, index=index):
            return texts.map(lambda t: not index.value.search(t))

        docs = docs.where(clean(F.col(text_col)))
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
