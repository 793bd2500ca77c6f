"""Word shingles and SuperMinHash signatures over numpy arrays.  Plain Python for worker processes."""

from __future__ import annotations

import numpy as np

GAMMA = np.uint64(0x9E3779B97F4A7C15)
_WORDS_KEPT = 150_000


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + GAMMA
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return value


_words = _Words()


def forget() -> None:
    _words.clear()


def shingles(text: str | None, width: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of the word shingles.

    Words are parted by ASCII white space, A-Z are lower-cased.  Fewer words than ``width`` make one shingle, none make
    no shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), dtype=np.int64, count=len(words)).astype(np.uint64)
    k = min(width, len(w))
    n = len(w) - k + 1
    h = np.full(n, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(3) + w[i : i + n])
    return np.unique(h)


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures, one row of m values for each set.

    Element e visits the m positions in a random order of its own and offers j + r_j at its j-th, r_j uniform in [0, 1).
    All elements of all sets take step j together; a set stops as soon as every value is below j + 1, when later offers
    can't lower it.  Values of an empty set are infinite.
    """
    n = len(sets)
    sig = np.full(n * m, np.inf)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=n)
    elem = np.concatenate(sets) if n else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    perm = None
    for j in range(m):
        if not len(elem):
            break
        a = mix(elem + np.uint64((j + 1) * int(GAMMA) % 2**64))
        offer = (a >> np.uint64(11)).astype(np.float64) * 2.0**-53 + j
        k = j + (((mix(a) >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            at = k
        else:
            rows = np.arange(len(elem))
            at = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
            perm[rows, j] = at
        np.minimum.at(sig, owner * m + at, offer)
        going = sig.reshape(n, m).max(axis=1) >= j + 1
        if perm is None:
            stay = going[owner]
            elem, owner, k = elem[stay], owner[stay], k[stay]
            perm = np.tile(np.arange(m, dtype=np.uint16), (len(elem), 1))
            perm[np.arange(len(elem)), k] = 0
            perm[:, 0] = k
        else:
            stay = going[owner]
            if stay.sum() < 0.8 * len(elem):
                elem, owner, perm = elem[stay], owner[stay], perm[stay]
            elif not stay.any():
                break
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each row and band."""
    n, m = sig.shape
    x = sig.view(np.uint64).reshape(n, bands, m // bands)
    key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64)), (n, bands)).copy()
    for i in range(m // bands):
        key = mix(key * np.uint64(3) + x[:, :, i])
    return key
