"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "a very long text of many words " * 4000 + "x" * 30_000
ROWS = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (None, "no identifier here at all", None, "s", 1), (None, None, None, None, None),
    (3, "Same Text of more words than five", "en", "s", 9), (4, "same text of more words than five", "en", "s", 9), (4, "same text of more words than five", "en", "s", 9),
    (5, LONG, "en", "s", len(LONG)), (6, "é\n\n é", "fr", "s", 5), (7, "12 34 -- !", None, "s", 9), (8, "\n\n", None, "s", 2),
]
BENCH = [(1, "same text of more words than five"), (2, None), (3, ""), (1, "same text of more words than five")]
CLASH = "row id label class bands bucket part hashes input_row n_lines n_dropped n_tokens ids kept digest norm copy n_bytes lang_pred score item_id coverage filter_words n of kind base html url held_out".split()


def _ops(spark):
    import public_tokenizers as P

    from suffixloom.llm import byte_bpe, decontaminate, exact_dedup, language_id, line_dedup, minhash_dedup, pseudonyms, secrets, token_counts

    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    model = language_id.fit(spark.createDataFrame([(1, "the of and house", "en"), (2, "le la et maison", "fr")] * 3, "doc_id long, text string, lang string"))
    ratios = [0.0] * len(secrets.ALPHABET) ** 2
    return {
        1: lambda d: exact_dedup.exact_dedup(d, keep="max"),
        3: lambda d: decontaminate.contamination(d, bench),
        4: line_dedup.line_dedup,
        5: lambda d: secrets.find_secrets(d, ratios),
        6: lambda d: pseudonyms.pseudonymise(d, b"k"),
        7: lambda d: language_id.identify(d, model),
        8: lambda d: token_counts.token_counts(d, P.path("byte_bpe_50k.json"), P.PATTERN),
        9: minhash_dedup.minhash_dedup,
        10: lambda d: byte_bpe.bpe_round_trip(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    }


def _rows(df, columns):
    return sorted(map(repr, df.select(*columns).collect()))


@pytest.mark.parametrize("n", [1, 3, 4, 5, 6, 7, 8, 9, 10])
def test_operator(spark, n):
    op = _ops(spark)[n]
    docs = spark.createDataFrame(ROWS, DOCS)
    plain = op(docs)
    columns = [c for c in plain.columns if c != "row"]
    got = _rows(plain, columns)
    if n == 3:
        assert sorted(r.doc_id for r in plain.collect()) == sorted([3, 4, 4] * 2)
    else:
        assert len(got) == len(ROWS)
    assert got == _rows(op(docs.repartition(5)), columns)  # ties don't depend on the partitioning
    clashing = docs
    for c in CLASH:
        clashing = clashing.withColumn(c, F.lit(0))
    out = op(clashing)
    if n == 4:  # its rows are those of the input; its own columns step aside
        out = out.select("doc_id", "text", "lang", "source", "n_chars", F.col("n_lines_of_line_dedup").alias("n_lines"), F.col("n_dropped_of_line_dedup").alias("n_dropped"))
    assert got == _rows(out, columns)
    empty = op(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and empty.columns == plain.columns


def test_defined_results(spark):
    ops = _ops(spark)
    docs = spark.createDataFrame(ROWS, DOCS)
    of = lambda n: ops[n](docs).where("doc_id IN (1, 2)").collect()
    assert all(r.group_size == 4 - 1 and r.keep_id == 2 for r in of(1))  # both nulls and the empty text are equal
    assert [r.text for r in sorted(of(4))] == [None, ""] and [r.text for r in sorted(of(6))] == [None, ""]
    assert all(r.n_assign == r.n_access == r.n_hex == 0 and not r.base for r in of(5))
    assert all(r.lang_pred == "und" and r.score == 0 for r in of(7))
    assert all(r.n_tokens == r.n_bytes == 0 for r in of(8))
    assert all(r.kept and r.n_shingles == 0 and r.component_id == r.doc_id for r in of(9))
    assert all(r.n_tokens == 0 for r in of(10))


def test_pages(spark):
    from suffixloom.llm.html_text import extract_text

    long = "<p>" + "word " * 60_000 + "</p>"
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "u", "<p>some text here</p>"), (3, "u", long), (4, "u", "<" * 5000 + '<a "' * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = extract_text(pages).collect()
    assert len(got) == len(rows) and [r.n_chars for r in got if r.page_id == 3] == [5 * 60_000 - 1]
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (1, 2))
    clash = pages.withColumn("text", F.lit("z")).withColumn("n_chars", F.lit("z"))
    assert sorted(map(repr, extract_text(clash).collect())) == sorted(map(repr, got))
    assert extract_text(pages.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    more = [(100 + i, " ".join(f"{w}{(i * 7 + k) % 50}" for k, w in enumerate(["the", "of", "and", "house"] * 10)), "en", "s", 1) for i in range(12)]
    docs = spark.createDataFrame(ROWS + more, DOCS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() <= len(ROWS) + 12, name
        clashing = docs
        for c in [c for c in CLASH if c not in ("lang_pred",)]:
            clashing = clashing.withColumn(c, F.lit(0))
        twice = stage(spark, clashing, str(tmp_path))
        key = [c for c in (docs.columns if name != corpus_pipeline.STAGES[-1][0] else ["doc_id", "n_tokens", "ids_sha256"]) if c in twice.columns]
        assert sorted(map(repr, out.select(*key).collect())) == sorted(map(repr, twice.select(*key).collect())), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and twice.columns == clashing.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
