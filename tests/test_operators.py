"""Golden cases computed by hand, and plan checks."""

import math

import pytest
from pyspark.sql import functions as F

from suffixloom.functions import ortho, scores
from suffixloom.operators import counts, decode, sampler, splits, trie, vectors
from suffixloom.sources import parse_clusters, parse_segmented, parse_word_list, until_blank

TRIE = "lise lisede lisenin okul okullar okulda liseninki".split()


def frame(spark, words, name="word"):
    return spark.createDataFrame([(w,) for w in words], f"{name} string")


@pytest.fixture(scope="module")
def segments(spark):
    tw = trie.single(frame(spark, TRIE))
    return trie.segment(tw, trie.boundaries(trie.trie_nodes(tw)))


def segs(rows):
    return {r.word: "+".join(r.morphs) for r in rows.collect()}


def test_trie(spark, segments):
    nodes = {r.prefix: r.n_children for r in trie.trie_nodes(trie.single(frame(spark, TRIE))).collect()}
    assert len(nodes) == 20 and nodes["lise"] == 3 and nodes["okul"] == 3 and nodes["lisenin"] == 2
    assert segs(segments) == {"lise": "lise", "lisede": "lise+de", "lisenin": "lise+nin", "liseninki": "lise+ninki", "okul": "okul", "okullar": "okul+lar", "okulda": "okul+da"}


@pytest.mark.parametrize("word,least,want", [("evdeki", 2, ["evdeki+$", "evdek+i", "evde+ki", "evd+eki", "ev+deki"]), ("evdeki", 3, ["evdeki+$", "evdek+i", "evde+ki", "evd+eki"]), ("l", 3, ["l+$"]), ("ev", 3, ["ev+$", "e+v"])])
def test_binary_splits(spark, word, least, want):
    got = splits.binary_splits(frame(spark, [word]), least).orderBy("idx").collect()
    assert [f"{r.stem}+{r.suffix}" for r in got] == want


def test_tilings_and_order(spark):
    affixes = frame(spark, "ki tap k i in ap t itap da n dan".split(), "morph")
    got = splits.tilings(frame(spark, ["kitapdan"]), affixes).orderBy("ends").collect()
    assert ["+".join(r.morphs) for r in got] == "k+i+t+ap+da+n k+i+t+ap+dan k+i+tap+da+n k+i+tap+dan k+itap+da+n k+itap+dan ki+t+ap+da+n ki+t+ap+dan ki+tap+da+n ki+tap+dan".split()


def test_best_tiling_equals_enumeration(spark):
    probs = spark.createDataFrame([(m, 0.1) for m in "ki tap k i in ap t itap da n dan".split()], "morph string, p double")
    best = decode.decode_unigram(frame(spark, ["kitapdan", "xyz"]), probs)
    assert segs(best) == {"kitapdan": "k+itap+dan", "xyz": "xyz"}


def test_laplace(spark):
    rows = spark.createDataFrame([(["lise", "de", "ki"],)], "morphs array<string>")
    pairs, morphs = counts.transition_counts(rows), counts.transition_morphs(rows)
    assert {(r.first, r.second): r.p for r in counts.laplace_transitions(pairs, morphs).collect()} == {("STR", "de"): 0.4, ("de", "ki"): 0.4, ("ki", "END"): 0.4}
    assert {r.p0 for r in counts.laplace_unseen(morphs).collect()} == {0.2}


def test_scalars(spark):
    row = spark.range(1).select(scores.poisson(F.lit(3), 4.0).alias("p"), ortho.allomorph_class(F.lit("ken")).alias("a"), ortho.allomorph_class(F.lit("dık")).alias("b"), scores.hash_uniform(F.lit("w"), F.lit("1"), F.lit("0"), F.lit("42")).alias("u"), scores.log10(F.lit(0.0)).alias("z")).first()
    assert abs(row.p - 0.19536681481316456) < 1e-12 and (row.a, row.b) == ("ken", "DHG") and row.u == 0.38571939292661783 and row.z == -math.inf


def test_multiset_diff(spark):
    old = frame(spark, "okula okulda n okulda ymış okulda lar okulu ilk okul lise ler".split(), "token")
    new = frame(spark, "okul a okul da n okul da ymış okul da lar okul u ilk okul lise ler".split(), "token")
    assert {r.token: r["diff"] for r in counts.multiset_diff(old, new).collect()} == {"okul": 5, "da": 3, "a": 1, "u": 1, "okulda": -3, "okula": -1, "okulu": -1}


def test_posteriors_sum_to_one_and_sweeps_keep_words(spark, segments):
    for grams in ("uni", "bi"):
        for separated in (False, True):
            p = sampler.posterior(segments, sampler.count_tables(segments, separated), grams, "dp", separated)
            assert all(abs(r.s - 1) < 1e-9 for r in p.groupBy("word").agg(F.sum("prob").alias("s")).collect())
    got = sampler.gibbs_sweep(segments.repartition(3), "bi", "dp", True)
    again = sampler.gibbs_sweep(segments.repartition(1), "bi", "dp", True)
    assert {w: s.replace("+", "") for w, s in segs(got).items()} == {w: w for w in TRIE}
    assert segs(got) == segs(again)


def test_nested_and_multisplit(spark):
    vs = spark.createDataFrame([("ev", [1.0, 0.0]), ("evde", [0.8, 0.6]), ("evdeki", [0.6, 0.8])], "word string, vec array<float>")
    words = spark.createDataFrame([("evdeki", 3), ("okul", 2)], "word string, freq long")
    got = {r.word: r for r in vectors.nested_segment(words, vs, 0.25).collect()}
    assert got["evdeki"].morphs == ["ev", "de", "ki"] and not got["okul"].found
    top = vectors.top_splits(vectors.multi_splits(vs.select("word"), vs), 2).where("word = 'evdeki'").first().splits
    assert top.split("+")[0] == "ev-de-ki" or top.split("+")[0] == "evde-ki"


def test_sources(spark):
    lines = frame(spark, ["12 lise", "3 okul", "x y", ""], "value")
    assert {r.word for r in parse_word_list(lines, 5).collect()} == {"lise"}
    assert parse_segmented(frame(spark, ["2 lise+de"], "value")).first().morphs == ["lise", "de"]
    assert parse_clusters(frame(spark, ["a b c"], "value")).count() == 3
    numbered = spark.createDataFrame([(1, "a"), (2, ""), (3, "b")], "line_no int, value string")
    assert [r.value for r in until_blank(numbered).collect()] == ["a"]


def test_longest_prefix_and_wildcards(spark):
    keys = frame(spark, TRIE)
    got = {r.query: r.found for r in trie.longest_prefix(frame(spark, ["lisedeki", "x", ""], "query"), keys, "").collect()}
    assert got == {"lisedeki": "lisede", "x": "", "": ""}
    assert [r.word for r in trie.keys_that_match(keys, "ok.l").collect()] == ["okul"]


def test_no_nested_loop_joins(spark, segments):
    tw = trie.single(frame(spark, TRIE))
    plan = trie.segment(tw, trie.boundaries(trie.trie_nodes(tw)))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_stream(spark, tmp_path):
    from suffixloom.streaming import count_directory

    spark.createDataFrame([("Lise lise okul",)], "text string").write.parquet(str(tmp_path / "in"))
    got = count_directory(spark, str(tmp_path / "in"), "text string", "counts_of_test", str(tmp_path / "ck"))
    assert {(r.word, r.freq) for r in got.collect()} == {("lise", 2), ("okul", 1)}


def test_sweep_and_closure_go_on_until_nothing_is_open(spark, monkeypatch):
    from pyspark.sql import functions as F

    from suffixloom.operators import sampler, trie

    def last_letter(*_, left, own):
        whole = F.length("left") == 1
        return left.select("word", "left", F.when(whole, F.col("left")).otherwise(F.expr("substring(left, 1, length(left) - 1)")).alias("stem"), F.when(whole, F.lit("$")).otherwise(F.expr("right(left, 1)")).alias("suffix"))

    monkeypatch.setattr(sampler, "posterior", last_letter)
    monkeypatch.setattr(sampler, "draw", lambda rows, *_: rows)
    word = "abcdefghijklmnopqrstuvwxyz"
    segments = spark.createDataFrame([(word, [word])], "word string, morphs array<string>")
    assert sampler.gibbs_sweep(segments, "bi", "dp", True).first().morphs == list(word)
    names = [f"a{i}" for i in range(24)]
    knn = spark.createDataFrame(list(zip(names, names[1:])), "word string, neighbour string")
    reached = trie.closure(spark.createDataFrame([("a0",)], "word string"), knn, spark.createDataFrame([("a0", "a")], "word string, stem string"))
    assert {r.word for r in reached.collect()} == set(names)
