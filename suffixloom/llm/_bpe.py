"""Byte-level BPE: ranks, pre-token pattern and merges over numpy matrices.  Plain Python for worker processes."""

from __future__ import annotations

import base64

import numpy as np

#: White space as the tokenizer libraries know it; Python's own class also has U+001C to U+001F.  Fixed values.
SPACE = r"\t-\r \x85\xa0  -     　"


def compiled(pattern: str):
    """The pre-token pattern for Python's regex module, with the libraries' class of white space."""
    import regex

    out = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    return regex.compile(out)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MatrixBPE:
    """Encodes many pre-tokens at once.

    Pre-tokens are sorted into buckets by length and padded to matrices of token ids.  In each round every row merges
    the leftmost pair of minimum rank, found by an open-addressing hash table over pairs of ids, and the row is
    compacted; rows without a pair to merge leave the matrix.
    """

    PAD = -1
    CELLS = 1 << 21  # of one matrix, so that a long pre-token takes bounded memory

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.bytes_of[r] = b
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        left, right, made = [], [], []
        for b, r in ranks.items():
            for k in range(1, len(b)):
                x, y = ranks.get(b[:k]), ranks.get(b[k:])
                if x is not None and y is not None:
                    left.append(x), right.append(y), made.append(r)
        keys = (np.array(left, dtype=np.uint64) << np.uint64(32)) | np.array(right, dtype=np.uint64)
        self._build(keys, np.array(made, dtype=np.int64))

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.table_key = np.full(1 << self.bits, np.uint64(2**64 - 1), dtype=np.uint64)
        self.table_val = np.full(1 << self.bits, 2**31, dtype=np.int64)
        slot, todo, self.probes = self._hash(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = self.table_key[slot[todo]] == np.uint64(2**64 - 1)
            cand = todo[free]
            _, first = np.unique(slot[cand], return_index=True)
            won = cand[first]
            self.table_key[slot[won]], self.table_val[slot[won]] = keys[won], values[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merged pair, 2**31 where there is none."""
        pad = right < 0
        keys = (left.astype(np.uint64) << np.uint64(32)) | np.where(pad, 0, right).astype(np.uint64)
        slot = self._hash(keys)
        out = np.where(self.table_key[slot] == keys, self.table_val[slot], 2**31)
        unsure = (self.table_key[slot] != keys) & (self.table_key[slot] != np.uint64(2**64 - 1))
        for _ in range(self.probes):
            if not unsure.any():
                break
            at = np.nonzero(unsure)
            slot[at] = (slot[at] + 1) & ((1 << self.bits) - 1)
            got = self.table_key[slot[at]]
            out[at] = np.where(got == keys[at], self.table_val[slot[at]], out[at])
            unsure[at] = (got != keys[at]) & (got != np.uint64(2**64 - 1))
        out[pad | (left < 0)] = 2**31
        return out

    def _matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        n, width = len(pieces), max(map(len, pieces))
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        ids = np.full((n, width), self.PAD, dtype=np.int64)
        ids[np.arange(width) < sizes[:, None]] = self.byte_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        out: list[np.ndarray] = [ids[:0, 0]] * n
        row = np.arange(n)
        rank = self._rank(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((n, 0), 2**31)
        while len(row):
            if rank.shape[1]:
                at = rank.argmin(axis=1)  # the leftmost minimum
                best = rank[np.arange(len(row)), at]
                done = best >= 2**31
            else:
                done = np.ones(len(row), dtype=bool)
            if done.any():
                for r, line in zip(row[done], ids[done]):
                    out[r] = line[line >= 0]
                keep = ~done
                row, ids, rank = row[keep], ids[keep], rank[keep]
                if not len(row):
                    break
                at, best = at[keep], best[keep]
            # merge and compact: what stands right of the merged pair moves left by one
            n_cols = ids.shape[1]
            src = np.arange(n_cols - 1) + (np.arange(n_cols - 1) > at[:, None])
            ids = np.take_along_axis(ids, src, axis=1)
            k = np.arange(len(row))
            ids[k, at] = best
            if n_cols > 2:
                src = np.minimum(np.arange(n_cols - 2) + (np.arange(n_cols - 2) >= at[:, None]), n_cols - 2)
                rank = np.take_along_axis(rank, src, axis=1)
                has = at < n_cols - 2
                rank[k[has], at[has]] = self._rank(ids[k[has], at[has]], ids[k[has], at[has] + 1])
                has = at > 0
                rank[k[has], at[has] - 1] = self._rank(ids[k[has], at[has] - 1], ids[k[has], at[has]])
            else:
                rank = np.full((len(row), 0), 2**31)
        return out

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each pre-token."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(pieces)
        order = sorted((i for i, p in enumerate(pieces) if p), key=lambda i: len(pieces[i]))
        start = 0
        while start < len(order):
            least, stop = len(pieces[order[start]]), start + 1
            while stop < len(order) and len(pieces[order[stop]]) <= least + 1 + least // 4 and (stop - start + 1) * len(pieces[order[stop]]) <= self.CELLS:
                stop += 1
            for i, ids in zip(order[start:stop], self._matrix([pieces[i] for i in order[start:stop]])):
                out[i] = ids
            start = stop
        return out

    def encode_long(self, piece: bytes) -> np.ndarray:
        """One very long pre-token, merged by a heap: as many rounds of a matrix would take quadratic time."""
        import heapq

        ids = self.byte_id[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self._rank(np.array(ids[:-1]), np.array(ids[1:])) if n > 1 else []
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r < 2**31]
        heapq.heapify(heap)
        pair: dict[tuple[int, int], int] = {}

        def rank(a: int, b: int) -> int:
            if (a, b) not in pair:
                pair[a, b] = int(self._rank(np.array([a]), np.array([b]))[0])
            return pair[a, b]

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], nxt[i] = r, -1, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
                if (q := rank(r, ids[nxt[j]])) < 2**31:
                    heapq.heappush(heap, (q, i, r, ids[nxt[j]]))
            if prv[i] >= 0 and (q := rank(ids[prv[i]], r)) < 2**31:
                heapq.heappush(heap, (q, prv[i], ids[prv[i]], r))
        return np.array([x for x in ids if x >= 0], dtype=np.int64)
