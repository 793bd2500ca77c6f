"""A linear-chain conditional random field over words, with hashed features.  Plain numpy."""

from __future__ import annotations

import re
import zlib

import numpy as np

WORD = re.compile(r"[^\W\d_]+")
SPAN = 64  # words of a chain; longer texts are cut into spans
MARGIN = 16  # words of the neighbouring spans that a span's chain runs over, so that labels flow across
BUCKETS = 1 << 18


def words_of(text: str | None) -> list[str]:
    return [w for w in WORD.findall(text.lower())] if text else []


def features(word: str) -> list[int]:
    """Hashed lexicon, affix and n-gram features: of the whole word, of both ends, and of all three-byte runs."""
    b = b"^" + word.encode("utf-8", "surrogatepass") + b"$"
    crc, mask = zlib.crc32, BUCKETS - 1
    out = [crc(b, 1) & mask]
    for k in (2, 3, 4):
        out += (crc(b[:k], 2) & mask, crc(b[-k:], 3) & mask)
    out += [crc(b[i : i + 3]) & mask for i in range(len(b) - 2)]
    return out


def spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts texts that lie one after another into chains: start and length of each."""
    first = np.cumsum(lengths) - lengths
    n = -(-lengths // SPAN)
    text = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    start = first[text] + k * SPAN
    return start, np.minimum(SPAN, first[text] + lengths[text] - start)


def margins(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans with MARGIN words of their neighbours: start and length of each chain, its words before the span, the span's."""
    start, size = spans(lengths)
    ends = np.cumsum(lengths)
    text = np.searchsorted(ends, start, side="right")
    low = np.maximum(start - MARGIN, ends[text] - lengths[text])
    high = np.minimum(start + size + MARGIN, ends[text])
    return low, high - low, start - low, size


def forward_backward(score: np.ndarray, start: np.ndarray, size: np.ndarray, trans: np.ndarray, init: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every word, and the expected number of each transition.

    Chains run side by side, sorted by length, so that those still going are the first rows of every step.
    """
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    n_labels = score.shape[1]
    out = np.zeros_like(score)
    expected = np.zeros((n_labels, n_labels))
    if not len(start) or not n_labels:
        return out, expected
    longest = int(size[0])
    going = np.searchsorted(-size, -np.arange(longest), side="left")  # rows with size > t
    t_exp = np.exp(trans - trans.max())
    emit = np.exp(score - score.max(axis=1, keepdims=True))
    alpha = np.zeros((longest, len(start), n_labels))
    a = emit[start] * np.exp(init - init.max())
    alpha[0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, longest):
        k = going[t]
        a = (alpha[t - 1, :k] @ t_exp) * emit[start[:k] + t]
        alpha[t, :k] = a / a.sum(axis=1, keepdims=True)
    beta = np.ones((len(start), n_labels))
    for t in range(longest - 1, -1, -1):
        k = going[t]
        m = alpha[t, :k] * beta[:k]
        out[start[:k] + t] = m / m.sum(axis=1, keepdims=True)
        if t:
            eb = emit[start[:k] + t] * beta[:k]
            pair = alpha[t - 1, :k, :, None] * t_exp[None] * eb[:, None, :]
            expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = eb @ t_exp.T
            beta[:k] = b / b.max(axis=1, keepdims=True)
    return out, expected


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, trans: np.ndarray, init: np.ndarray):
        self.labels, self.weights, self.trans, self.init = labels, weights, trans, init

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: the sums of its features' weights."""
        found = [features(w) for w in words]
        count = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter((f for fs in found for f in fs), dtype=np.int64, count=int(count.sum()))
        return np.add.reduceat(self.weights[flat].astype(np.float64), np.cumsum(count) - count, axis=0)


class Reader:
    """Labels texts; keeps the scores of the words it has met, a bounded number of them."""

    def __init__(self, model: Model, limit: int = 120_000):
        self.model, self.limit, self.rows = model, limit, {}
        self.table = np.zeros((1024, len(model.labels)))

    def _ids(self, words: list[str]) -> np.ndarray:
        new = list(set(words).difference(self.rows.keys())) if len(words) < len(self.rows) else [w for w in set(words) if w not in self.rows]
        if len(self.rows) + len(new) > self.limit and self.rows:
            self.rows, self.table, new = {}, np.zeros((1024, self.table.shape[1])), list(set(words))
        if len(self.rows) + len(new) > len(self.table):
            grown = np.zeros((2 * (len(self.rows) + len(new)), self.table.shape[1]))
            grown[: len(self.rows)] = self.table[: len(self.rows)]
            self.table = grown
        if new:
            n = len(self.rows)
            self.table[n : n + len(new)] = self.model.scores(new)
            self.rows.update(zip(new, range(n, n + len(new))))
        return np.fromiter(map(self.rows.__getitem__, words), dtype=np.int64, count=len(words))

    def marginals(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ids = self._ids([w for t in texts for w in t])  # may enlarge the table
        start, size, skip, core = margins(lengths)
        # the chains, margins included, one after another
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(start - first, size)
        found = forward_backward(self.table[ids[at]], first, size, self.model.trans, self.model.init)[0]
        place = np.arange(int(core.sum())) + np.repeat(first + skip - (np.cumsum(core) - core), core)
        return found[place], lengths

    def read(self, texts: list[list[str]]) -> list[tuple[str, float, int, int]]:
        """(label, mean probability, words, label changes) of each text; without a label all are ``und``."""
        if not self.model.labels:
            return [("und", 0.0, len(t), 0) for t in texts]
        m, lengths = self.marginals(texts)
        ends = np.cumsum(lengths)
        out = []
        for n, end in zip(lengths.tolist(), ends.tolist()):
            if not n:
                out.append(("und", 0.0, n, 0))
                continue
            own = m[end - n : end]
            mean = own.mean(axis=0)
            k = int(mean.argmax())
            best = own.argmax(axis=1)
            out.append((self.model.labels[k], float(min(max(mean[k], 0.0), 1.0)), n, int((best[1:] != best[:-1]).sum())))
        return out


def train(texts: list[tuple[list[str], str]], rounds: int = 40, rate: float = 0.3, ridge: float = 1e-4, mixed: float = 0.3, seed: int = 11) -> Model:
    """Maximum likelihood by gradient ascent with adaptive rates.

    Labelled texts have one language each; a share ``mixed`` of the chains is joined from pieces of two of them, so that
    the transitions learn how long a language lasts.
    """
    labels = sorted({x for _, x in texts})
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    chains: list[tuple[list[int], list[int]]] = []
    for words, label in texts:
        ids, y = [vocab.setdefault(w, len(vocab)) for w in words], labels.index(label)
        chains += [(ids[i : i + SPAN], [y] * len(ids[i : i + SPAN])) for i in range(0, len(ids), SPAN)]
    for k in rng.permutation(len(chains))[: int(mixed * len(chains))]:
        other = chains[rng.integers(len(chains))]
        a, b = chains[k]
        cut = int(rng.integers(0, len(a) + 1))
        take = int(rng.integers(1, len(other[0]) + 1))
        chains[k] = ((a[:cut] + other[0][:take])[:SPAN], (b[:cut] + other[1][:take])[:SPAN])
    n = len(labels)
    weights, trans, init = np.zeros((BUCKETS, n)), np.zeros((n, n)), np.zeros(n)
    if not chains:
        return Model(labels, weights.astype(np.float32), trans, init)
    word = np.array([w for c in chains for w in c[0]])
    gold = np.array([y for c in chains for y in c[1]])
    size = np.array([len(c[0]) for c in chains])
    start = np.cumsum(size) - size
    feats = [features(w) for w in vocab]
    flat = np.array([f for fs in feats for f in fs])
    count = np.array([len(fs) for fs in feats])
    at = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(feats)), count)
    target = np.zeros((len(word), n))
    target[np.arange(len(word)), gold] = 1
    inner = np.ones(len(word), dtype=bool)
    inner[start] = False
    here = np.nonzero(inner)[0]
    gold_trans = np.zeros((n, n))
    np.add.at(gold_trans, (gold[here - 1], gold[here]), 1)
    used = np.unique(flat)
    gold_init = target[start].mean(axis=0)
    seen = [np.full(x.shape, 1e-8) for x in (weights, trans, init)]
    for _ in range(rounds):
        emission = np.add.reduceat(weights[flat], at, axis=0)
        m, expected = forward_backward(emission[word], start, size, trans, init)
        diff = target - m
        by_word = np.stack([np.bincount(word, diff[:, j], len(feats)) for j in range(n)], axis=1)
        grad = np.stack([np.bincount(flat, by_word[owner, j], BUCKETS) for j in range(n)], axis=1) / len(word) - ridge * weights
        grad_init = gold_init - m[start].mean(axis=0) - ridge * init
        for x, g, s in ((weights, grad, seen[0]), (trans, (gold_trans - expected) / len(word) - ridge * trans, seen[1]), (init, grad_init, seen[2])):
            s += g * g
            x += rate * g / np.sqrt(s)
    mask = np.zeros(BUCKETS, dtype=bool)
    mask[used] = True
    weights[~mask] = 0
    return Model(labels, weights.astype(np.float32), trans, init)
