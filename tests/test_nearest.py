"""Nearest neighbours against brute force, and how often their input is made."""

import numpy as np
from pyspark.sql import functions as F

from suffixloom.operators import trie, vectors


def test_neighbours_with_ties_and_input_made_a_bounded_number_of_times(spark):
    rng = np.random.default_rng(6)
    values = rng.integers(-1, 2, size=(300, 3)).astype(float)  # few directions, so many cosines are level
    values[~values.any(axis=1)] = 1.0
    names = [f"{'ab'[i % 2]}{i:03d}" for i in range(len(values))]
    made = spark.sparkContext.accumulator(0)

    def count(it):
        for pdf in it:
            made.add(len(pdf))
            yield pdf

    given = spark.createDataFrame([(w, [float(x) for x in v]) for w, v in zip(names, values)], "word string, vec array<double>").mapInPandas(count, "word string, vec array<double>")
    asked = spark.createDataFrame([(w,) for w in names[::3]], "word string")
    near = vectors.nearest(asked, given, 5, block=20)
    words = near.select("word").distinct()
    reached = trie.closure(words, near, words.select("word", F.substring("word", 1, 1).alias("stem"))).collect()
    assert made.value <= 2 * len(names)

    unit = values / np.sqrt((values * values).sum(axis=1))[:, None]
    best = {w: [x for _, x in sorted((-round(float(unit[i] @ unit[j]), 9), x) for j, x in enumerate(names) if x != w)[:5]] for i, w in enumerate(names) if i % 3 == 0}
    got = {}
    for r in near.orderBy("rank").collect():
        got.setdefault(r.word, []).append(r.neighbour)
    assert got == best
    todo, seen = [(w, w) for w in best], {(w, w) for w in best}
    while todo:
        seed, at = todo.pop()
        new = {(seed, x) for x in best.get(at, ()) if x[0] == seed[0]} - seen
        seen |= new
        todo += new
    assert {(r.trie_id, r.word) for r in reached} == seen
