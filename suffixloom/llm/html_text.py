"""Operator 2: main text of web pages by composite text density.

For every node of a page's tree the characters for each tag, adjusted by the share of links, are computed; the subtree
with the largest sum over its children is the article, and the least density on the path from it to the body is the
threshold for the blocks beside it, with the headings before them.  Elements that are no text by their name or role (menus,
headers, footers, asides, forms, scripts) have no density.  Class and id names are a weak prior: they take three
quarters of an element's density, unless it holds most of the page's text.  Pages are independent: nothing is shuffled,
and time grows with their length, also for broken tags.

Defined cases: null or empty pages, and pages without text, give an empty text; rows repeat as often as in the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read_table


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(it):
        import pandas as pd

        from ._dom import extract

        for pdf in it:
            texts = [extract(h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": list(map(len, texts))})

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))
