"""Samplers, priors and closures against recursions and counts by hand."""

import math

import pytest

from suffixloom.operators import priors, sampler, splits, trie


def segs(spark, rows):
    return spark.createDataFrame([(w[:3], w, m) for w, m in rows], "trie_id string, word string, morphs array<string>")


WORDS = [("walks", ["walk", "s"]), ("walked", ["walk", "ed"]), ("talks", ["talk", "s"]), ("talk", ["talk"]), ("sings", ["sings"])]


def _by_hand(word, model):
    """The bigram distribution over the splits of a word, separated tables, with the word's own counts taken out."""
    a, g, d = 0.01, 0.037, 1.0
    rest = [(m if len(m) > 1 else m + ["$"]) for w, m in WORDS if w != word]
    every = [(m if len(m) > 1 else m + ["$"]) for _, m in WORDS]
    stem = lambda x: sum(m[0] == x for m in rest)
    suff = lambda x: sum(y == x for m in rest for y in m[1:])
    pair = lambda x, y: sum((p, q) == (x, y) for m in rest for p, q in zip(m, m[1:]))
    n_s, n_f = len(rest), sum(len(m) - 1 for m in rest)
    t_s, t_f, b = len({m[0] for m in every}), len({y for m in every for y in m[1:]}), len({m[0] for m in every})
    n = len(word)
    k = 5 if n >= 6 else n - 1
    out = []
    for i in range(k):
        s, f = word[: n - i], word[n - i :] or "$"
        lf = 0 if f == "$" else len(f)
        ns, nf, nsf = stem(s), suff(f), pair(s, f)
        if model == "ml":
            ps, back = (ns or 0.01) / n_s, (nf or 0.01) / n_f
            pf = nsf / ns if ns and nsf else back
        elif model == "dp":
            ps = (ns or a * g ** (len(s) + 1)) / (n_s + a)
            pf = nsf / ns + a if ns and nsf else a * (nf or a * g ** (lf + 1)) / (n_f + a)
        else:
            ps = (ns - d if ns else (a + d * t_s) * g ** (len(s) + 1)) / (n_s + a)
            pf = (nsf - d) / ns + a if ns and nsf else (a + d * b) * (nf - d if nf else (a + d * t_f) * g ** (lf + 1)) / (n_f + a)
        out.append(max(ps * pf, 0.0))
    return [x / sum(out) for x in out]


@pytest.mark.parametrize("model", ["ml", "dp", "py"])
def test_posterior_takes_own_counts_out(spark, model):
    s = segs(spark, WORDS)
    got = {}
    for r in sampler.posterior(s, sampler.count_tables(s, True), "bi", model, True).collect():
        got.setdefault(r.word, {})[r.idx] = r.prob
    for w, _ in WORDS:
        if (want := _by_hand(w, model)) and any(want):
            assert [got[w][i] for i in range(len(want))] == pytest.approx(want)


def test_removal_and_insertion_and_sweeps(spark):
    s = segs(spark, WORDS)
    table = lambda d: {r.morph: r.n for r in d.collect()}
    counts = trie.morph_counts(s)
    gone, new = spark.createDataFrame([("walk",), ("s",)], "morph string"), spark.createDataFrame([("walks",)], "morph string")
    after = table(sampler.changed(counts, gone, new))
    assert after["walk"] == 1 and after["s"] == 1 and after["walks"] == 1 and after["talk"] == 2
    for out in (sampler.gibbs(s, "uni", "ml", False, 2), sampler.gibbs_sweep(s, "bi", "py", True)):
        rows = out.collect()
        assert {r.word: "".join(r.morphs) for r in rows} == {w: w for w, _ in WORDS} and len(rows) == len(WORDS)
    again = {r.word: r.morphs for r in sampler.gibbs(s.repartition(7), "uni", "ml", False, 2).collect()}
    assert again == {r.word: r.morphs for r in sampler.gibbs(s, "uni", "ml", False, 2).collect()}


def test_forward_weights_against_the_recursion(spark):
    word = "abcdefg"
    score = lambda p, i: 1.0 / (p + 3 * i)

    def z(p):
        k = 5 if p >= 6 else (p - 1 if p > 1 else p)
        return 1.0 if p == 2 else sum(score(p, i) * z(p - i) for i in range(1, k))

    cuts = [(word, p, i, score(p, i)) for p in range(3, 8) for i in range(1, 5 if p >= 6 else p - 1)]
    got = sampler.forward_weights(spark.createDataFrame([(word,)], "word string"), spark.createDataFrame(cuts, "word string, p int, i int, s double")).first()
    assert list(got.z) == pytest.approx([z(p) for p in range(1, 8)])


def test_prior_bundle_by_hand(spark):
    s = segs(spark, [("walks", ["walk", "s"]), ("talk", ["talk"])])
    nodes = spark.createDataFrame([("wal", "walk", 3, True), ("tal", "talk", 1, True)], "trie_id string, prefix string, n_children int, is_word boolean")
    lex = spark.createDataFrame([("walk", 6), ("walks", 4)], "word string, freq long")
    vecs = spark.createDataFrame([("walk", [1.0, 0.0]), ("walks", [1.0, 1.0])], "word string, vec array<float>")
    got = {r.word: r for r in priors.prior_bundle(s, nodes, lex, vecs).collect()}
    pois = lambda b: math.log10(4.0**b * math.exp(-4) / math.factorial(b))
    assert got["walks"].poisson == pytest.approx(pois(3)) and got["talk"].poisson == pytest.approx(pois(1))
    assert got["walks"].similarity == 0 and got["talk"].similarity == 0  # a cosine above the cut counts as one
    assert got["walks"].presence == pytest.approx(math.log10(0.6)) and got["talk"].presence == pytest.approx(math.log10(1e-8))
    assert got["walks"].length == pytest.approx(math.log10(0.037**2))
    assert priors.feature_name(True, False, True, False) == "poisson_presence"


def test_graphs(spark):
    edges = spark.createDataFrame([("a", "ab", 0.9), ("ab", "abc", 0.4), ("ab", "x", 0.9), ("abc", "a", 0.9)], "word string, neighbour string, cosine double")
    seeds = spark.createDataFrame([("a",), ("x",)], "word string")
    reach = lambda **o: {(r.trie_id, r.word) for r in trie.closure(seeds, edges, **o).collect()}
    assert reach() == {("a", "a"), ("a", "ab"), ("a", "abc"), ("a", "x"), ("x", "x")}
    assert reach(least=0.5) == {("a", "a"), ("a", "ab"), ("a", "x"), ("x", "x")}
    stems = spark.createDataFrame([("a", "a"), ("x", "x")], "word string, stem string")
    assert reach(stems=stems) == {("a", "a"), ("a", "ab"), ("a", "abc"), ("x", "x")}
    tree = spark.createDataFrame([("a", None), ("ab", "a"), ("abc", "ab"), ("z", None)], "child string, parent string")
    assert sorted(r.value for r in trie.path_lines(tree).collect()) == ["a-->ab-->abc", "z"]


def test_random_tilings_end_in_one_letter(spark):
    rows = splits.random_tiling(spark.createDataFrame([("abcdef",), ("ab",), ("a",)], "word string")).collect()
    assert all("".join(r.morphs) == r.word and len(r.morphs[-1]) == 1 for r in rows)
