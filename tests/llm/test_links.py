"""Links that buckets hold only once: large groups whose members are similar to one of them, not to each other."""

import random

import numpy as np
import pytest

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def test_copies_of_one_document_meet_it_in_a_large_group(spark):
    from suffixloom.llm.minhash_dedup import minhash_dedup

    rng = random.Random(11)
    words = [f"w{i}" for i in range(200)]
    rows = [(10_000, " ".join(words))]
    for i in range(1500):  # 183 of 213 shingles shared with the first text, about 168 of 228 with each other
        own = list(words)
        for k in range(5):
            own[rng.randrange(40 * k + 3, 40 * k + 37)] = f"x{i}-{k}"
        rows.append((i, " ".join(own)))
    got = minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("component_id").distinct().collect()
    assert [r.component_id for r in got] == [0]


@pytest.mark.parametrize("native", [True, False])
def test_variants_of_one_line_meet_it_in_a_large_group(spark, native):
    from suffixloom.llm.line_dedup import line_dedup

    rng = random.Random(12)
    line = "".join(rng.choice(LETTERS) for _ in range(160))
    rows = [(10_000, line)]
    for i in range(1500):  # 137 of 169 shingles shared with the line, 121 of 185 with most others
        own = list(line)
        for k in (0, 80):
            own[k + rng.randrange(10, 70)] = rng.choice(LETTERS.upper())
        rows.append((i, "".join(own)))
    left = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), native=native).where("n_dropped = 0")
    # twelve bands may miss a pair of 0.81; the links that a band holds are all found
    assert left.count() <= 15


def test_outlines_differ_no_more_than_sets(spark):
    from suffixloom.llm._line_sketch import outline
    from suffixloom.llm._links import outlines

    rng = random.Random(13)
    base = [rng.getrandbits(63) for _ in range(300)]
    sets = [base[: 300 - 7 * i] + [rng.getrandbits(64) - 2**63 for _ in range(5 * i)] for i in range(20)]
    got = {r.id: np.array(r.bits) for r in outlines(spark.createDataFrame(list(enumerate(sets)), "id long, items array<long>"), 4).collect()}
    lines = ["".join(rng.choice(LETTERS) for _ in range(n)) for n in (0, 1, 8, 100, 700)]
    lines += [x + "?" for x in lines]
    of_lines = outline(lines, 8, 4)
    shingled = [{x[j : j + 8] for j in range(max(len(x) - 7, 1))} for x in lines]
    for xs, outs in ((list(map(set, sets)), [got[i] for i in range(20)]), (shingled, of_lines)):
        for a, p in zip(xs, outs):
            assert sum(int(v).bit_count() for v in p.view(np.uint64)) % 2 == len(a) % 2
            for b, q in zip(xs, outs):
                assert sum(int(v).bit_count() for v in (p ^ q).view(np.uint64)) <= len(a ^ b)


@pytest.mark.parametrize("native", [True, False])
def test_open_pairs_of_a_group_without_links_are_few(spark, native):
    from suffixloom.llm import line_dedup
    from suffixloom.llm._links import near_pairs, open_pairs, outlines

    rng = random.Random(14)
    line = "".join(rng.choice(LETTERS) for _ in range(600))
    rows = []
    for i in range(200):  # about 460 of 730 shingles shared with each other, none similar
        own = list(line)
        for k in range(0, 600, 40):
            own[k + rng.randrange(40)] = rng.choice(LETTERS.upper())
        rows.append((i, "".join(own)))
    lines = spark.createDataFrame(rows, "id long, line string")
    if native:
        sets = lines.select("id", line_dedup.F.array_distinct(line_dedup.shingle_hashes("line", line_dedup.WIDTH)).alias("items"))
        bits = outlines(sets, line_dedup.OUTLINE)
    else:
        bits = line_dedup.line_outlines(lines, line_dedup.WIDTH, line_dedup.OUTLINE)
    met = bits.selectExpr("id", "id AS label", "0L AS bucket", "200L AS items", "593L AS n", "bits", "array(0L) AS orders").localCheckpoint()
    assert open_pairs(met, 80, line_dedup.OUTLINE).count() <= 20
    assert near_pairs(met, 80, line_dedup.OUTLINE).count() <= 20


def test_op4_is_dataframe_operations_only(spark, tmp_path, monkeypatch):
    import __spark_entry__

    rows = [(1, "a line of text that stands first\nanother"), (2, "a line of text that stands first!\n" + "-" * 20), (3, "-" * 10), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))

    def python(*_a, **_k):
        raise AssertionError("Python on the executors")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(docs), name, python)
    got = __spark_entry__.queries()["op4_line_dedup"](spark, str(tmp_path))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in sorted(got.collect())] == [(1, 2, 0, rows[0][1]), (2, 2, 1, "-" * 20), (3, 1, 1, ""), (4, 0, 0, None)]
