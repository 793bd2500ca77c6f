"""What op4 leaves to the interpreter and how often it splits a text."""

import re

ROWS = [(1, "a line of text that stands first\nanother"), (2, "a line of text that stands first!\n" + "-" * 20), (3, "ab"), (4, "x\U0001f600" * 9), (5, None)]


def test_hashes_are_all_that_the_inner_lambda_makes(spark):
    from suffixloom.llm import line_dedup

    lines = line_dedup.lines_of(spark.createDataFrame(ROWS, "doc_id long, text string"), "doc_id", "text")
    found = line_dedup.with_hashes(lines, line_dedup.WIDTH)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" in plan and not re.search(r"lambdafunction\([^\n]*(sequence|encode)\(", plan)
    want = lines.select("id", line_dedup.F.sort_array(line_dedup.F.array_distinct(line_dedup.shingle_hashes("line", line_dedup.WIDTH))).alias("hashes"))
    assert sorted(map(tuple, found.select("id", "hashes").collect())) == sorted(map(tuple, want.collect()))


def test_a_text_is_split_once_for_the_result(spark):
    from suffixloom.llm.line_dedup import line_dedup

    left = line_dedup(spark.createDataFrame(ROWS, "doc_id long, text string"))
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2  # rows that may lose a line, and the others
    assert [(r.n_lines, r.n_dropped, r.text) for r in sorted(left.collect())] == [(2, 0, ROWS[0][1]), (2, 1, "-" * 20), (1, 0, "ab"), (1, 0, ROWS[3][1]), (0, 0, None)]
