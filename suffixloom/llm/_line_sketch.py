"""Character-shingle sets of lines, their bands and their overlaps, over numpy arrays.  Plain Python for worker processes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ._shingle import GAMMA, mix

#: Bits of a hash in a signature; the rest of a key is the line's place in its chunk.  Pairs are verified on more, all
#: that a chunk's number of lines leaves.
_BITS = 48
_LOW = np.uint64((1 << _BITS) - 1)


def _chunks(sizes: list[int], chars: int = 1 << 15) -> Iterator[tuple[int, int]]:
    """Ranges of lines of about so many characters, fewer than 2**(64 - _BITS) lines each."""
    start = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= chars or i - start >= (1 << (64 - _BITS)) - 2:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _runs(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` numbers from each place on: a polynomial, put together from runs of powers of two."""
    out, have, block, size, factor = None, 0, codes, 1, int(GAMMA)
    while True:
        if width & size:
            n = len(codes) - have - size + 1
            out = block if out is None else out[:n] * np.uint64(factor) + block[have : have + n]
            have += size
        if have == width:
            return mix(out)
        block = block[:-size] * np.uint64(factor) + block[size:]
        size, factor = 2 * size, factor * factor % 2**64


def _windows(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes from all places of the lines in a row, the lines' sizes, and the places whose runs leave their line.

    A shorter line is one run, filled up with line feeds, which no line has.
    """
    full = [x if len(x) >= width else x + "\n" * (width - len(x)) for x in lines]
    sizes = np.fromiter(map(len, full), dtype=np.int64, count=len(full))
    codes = np.frombuffer("".join(full).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    ends = np.cumsum(sizes)[:-1]
    return _runs(codes, width), sizes, (ends[:, None] - np.arange(1, width)).ravel()


def _sets(hashes: np.ndarray, sizes: np.ndarray, out: np.ndarray, bits: int) -> np.ndarray:
    """Sorted distinct keys: the line's number above ``bits`` bits of a hash.  Numbers stay below the last."""
    mark = np.arange(len(sizes), dtype=np.uint64) << np.uint64(bits)
    key = np.repeat(mark, sizes)[: len(hashes)]
    key |= hashes >> np.uint64(64 - bits)
    key[out] = np.uint64(2**64 - 1)
    key.sort()
    key = key[: len(key) - len(out)]
    return key[np.concatenate(([True], key[1:] != key[:-1]))]


def _subset_masks(small: int, similarity: int) -> list[np.ndarray]:
    """For each set size up to ``small``, the subsets that hold ``similarity`` per cent of it, a row of bits for each."""
    out = [np.zeros((0, 0), dtype=np.uint64)]
    for n in range(1, small + 1):
        rows = [[m >> i & 1 for i in range(n)] for m in range(1, 1 << n) if m.bit_count() * 100 >= n * similarity]
        out.append(np.array(rows, dtype=np.uint64))
    return out


def sketch(lines: list[str], width: int, bands: int, rows: int, similarity: int, least: int, small: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes, offsets into the keys (one more than lines) and the keys of all lines, band by band.

    A set of ``least`` and more has ``bands`` keys, one of up to ``small`` a key for each subset of ``_subset_masks``.
    """
    masks = _subset_masks(small, similarity)
    sizes_out, counts_out, keys_out = [], [], []
    cuts = np.array([(2 * k + 1) * ((1 << _BITS) // (2 * bands)) for k in range(bands)], dtype=np.uint64)
    for start, end in _chunks([max(len(x), width) for x in lines]):
        k = end - start
        key = _sets(*_windows(lines[start:end], width), _BITS)
        mark = np.arange(k, dtype=np.uint64) << np.uint64(_BITS)
        size = np.bincount((key >> np.uint64(_BITS)).astype(np.int64), minlength=k)
        first = np.cumsum(size) - size
        low = key & _LOW

        band = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64)), (k, bands))
        at = np.searchsorted(key, (mark[:, None] | cuts).ravel()).reshape(k, bands) - first[:, None]
        for j in range(rows):
            band = mix(band * np.uint64(3) + low[first[:, None] + (at + j) % size[:, None]])

        banded = np.where(size >= least, bands, 0)
        n_keys = banded + np.array([len(m) for m in masks])[np.where(size <= small, size, 0)]
        offset = np.cumsum(n_keys) - n_keys
        keys = np.empty(int(n_keys.sum()), dtype=np.uint64)
        some = np.flatnonzero(banded)
        keys[offset[some][:, None] + np.arange(bands)] = band[some]
        for n in range(1, small + 1):
            some = np.flatnonzero(size == n)
            if len(some):
                items = mix(low[first[some][:, None] + np.arange(n)])
                of_subsets = mix(items @ masks[n].T)  # a sum names a subset, whatever its set
                keys[(offset + banded)[some][:, None] + np.arange(len(masks[n]))] = of_subsets
        sizes_out.append(size), counts_out.append(n_keys), keys_out.append(keys)
    if not sizes_out:
        return np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(sizes_out), np.concatenate(([0], np.cumsum(np.concatenate(counts_out)))), np.concatenate(keys_out).view(np.int64)


def outline(lines: list[str], width: int, words: int) -> np.ndarray:
    """A row for each line: the parity of its distinct shingles in each of ``64 * words`` bins."""
    bins, out = 64 * words, [np.zeros((0, words), dtype=np.int64)]
    for start, end in _chunks([max(len(x), width) for x in lines]):
        k = end - start
        key = _sets(*_windows(lines[start:end], width), _BITS)
        place = (key >> np.uint64(_BITS)) * np.uint64(bins) + (key & np.uint64(bins - 1))
        odd = (np.bincount(place.astype(np.int64), minlength=k * bins) & 1).astype(np.uint8)
        out.append(np.packbits(odd, bitorder="little").view("<i8").reshape(k, words))
    return np.concatenate(out)


def similar(a: np.ndarray, b: np.ndarray, of_a: list[str], of_b: list[str], width: int, similarity: int) -> np.ndarray:
    """Whether the shingle sets of each pair of lines, named by identifiers, reach ``similarity`` per cent."""
    out = np.zeros(len(a), dtype=bool)
    for start, end in _chunks([len(x) + len(y) + 2 * width for x, y in zip(of_a, of_b)]):
        ids, places, of = np.unique(np.concatenate((a[start:end], b[start:end])), return_index=True, return_inverse=True)
        lines = of_a[start:end] + of_b[start:end]
        bits = 64 - (2 * (end - start)).bit_length()  # room for the pairs and for their lines
        key = _sets(*_windows([lines[i] for i in places], width), bits)
        size = np.bincount((key >> np.uint64(bits)).astype(np.int64), minlength=len(ids))
        first = np.cumsum(size) - size
        # the sets of a pair side by side, under the pair's number; what they share stands there twice
        k = end - start
        pair, of = np.concatenate((np.arange(k), np.arange(k))), of.ravel()
        n = size[of]
        at = np.arange(n.sum()) + np.repeat(first[of] - (np.cumsum(n) - n), n)
        low = key[at] & np.uint64((1 << bits) - 1)
        both = np.repeat(pair.astype(np.uint64) << np.uint64(bits), n) | low
        both.sort()
        twice = both[1:][both[1:] == both[:-1]]
        shared = np.bincount((twice >> np.uint64(bits)).astype(np.int64), minlength=k)
        total = n[:k] + n[k:]
        out[start:end] = shared * (100 + similarity) >= total * similarity
    return out
