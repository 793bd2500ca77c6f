"""Tilings of equal probability: the sums as they are rounded decide, then the end positions."""

import math
import random

from suffixloom.operators import decode, splits


def test_a_start_that_draws_level_by_rounding_wins_by_its_ends(spark):
    pieces = [("abcd", 0, 1, -0.5), ("abcd", 1, 3, -0.5000000000000002), ("abcd", 0, 2, -0.5), ("abcd", 2, 3, -0.5), ("abcd", 3, 4, -8.0)]
    got = splits.best_tiling(spark.createDataFrame(pieces, "word string, a int, b int, w double")).first()
    assert (got.morphs, got.score) == (["a", "bc", "d"], -9.0)


def _unigram(tiling, p):
    score = math.log10(p[tiling[0]])
    for m in tiling[1:]:
        score += math.log10(p[m])
    return score


def _model(rng):
    """Words xyz with the tilings x+yz and xy+z, and counts."""
    words, counts = [], {}
    for i in range(1500):
        x, y, z = (chr(0x4E00 + 3 * i + k) for k in range(3))
        words.append(x + y + z)
        a, b, c, d = (rng.randint(26, 400) for _ in range(4))
        counts |= {x: a * b, y + z: c * d, x + y: a * c, z: b * d}  # products of both tilings are equal
    total = sum(counts.values())
    return words, counts, {m: n / total for m, n in counts.items()}


def _best(word, score):
    tilings = [(word[:1], word[1:]), (word[:2], word[2:])]
    return max(tilings, key=lambda t: (score(t), -len(t[0])))


def test_unigram_ties(spark):
    words, counts, p = _model(random.Random(3))
    probs = spark.createDataFrame([(m, n, p[m]) for m, n in counts.items()], "morph string, n long, p double")
    got = {r.word: tuple(r.morphs) for r in decode.decode_unigram(spark.createDataFrame([(w,) for w in words], "word string"), probs).collect()}
    assert got == {w: _best(w, lambda t: _unigram(t, p)) for w in words}


#: Counts of two stems and a total; unseen pairs of either have the same probability, and Java's logarithms order them otherwise.
LEVEL = [(1241, 2196, 60214), (899, 204, 60261), (466, 2199, 60297), (2592, 2647, 60544), (1099, 1055, 60721), (662, 2712, 60760), (1523, 2619, 60957), (1896, 1240, 61046), (1127, 204, 61253)]


def test_bigram_ties(spark):
    counts, p = {}, {}
    for i, (a, b, total) in enumerate(LEVEL):
        w = "".join(chr(0x4E00 + 3 * i + k) for k in range(3))
        counts[w] = {w[:1]: a, w[:2]: b}
        p[w] = {m: n / total for m, n in counts[w].items()}
    probs = spark.createDataFrame([(m, n, p[w][m]) for w in counts for m, n in counts[w].items()], "morph string, n long, p double")
    tiled = spark.createDataFrame([(w, [w[:k], w[k:]], [k, 3]) for w in counts for k in (1, 2)], "word string, morphs array<string>, ends array<int>")
    unseen = spark.createDataFrame([], "first string, second string, n long, p double")
    got = {r.word: tuple(r.morphs) for r in decode.decode_bigram(tiled, probs, unseen).collect()}
    assert got == {w: _best(w, lambda t: math.log10(p[w][t[0]]) + math.log10(0.01 / counts[w][t[0]])) for w in counts}
