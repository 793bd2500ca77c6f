"""Operator 6: format-preserving pseudonyms of personal data by a keyed Feistel network.

Values that pass their format's check - card numbers by their check digit, IBANs by theirs, dates by the calendar, IPv4
addresses by their range, social security and phone numbers by their form - are permuted within their format under a
secret key, so equal values stay linked across documents and the result still passes the check.  Numbers that fail
their check are no personal data and stay.  Names of mail boxes are permuted character class by character class, those of
other scripts within the letters around them; a name without any letter or digit stays.
Documents are independent: nothing is shuffled.

Defined cases: null text stays null; a text without such values is returned as it is; rows repeat as in the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read_table
from ._feistel import KINDS

#: The key of the registered query; production runs pass their own.
QUERY_KEY = b"public key of the registered query"


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text, n_found and a count n_<kind> for each kind of value."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = [f"n_{k}" for k in KINDS]

    def run(it):
        import pandas as pd

        from ._feistel import Pseudonyms

        p = Pseudonyms(key)
        for pdf in it:
            made = [(None, []) if t is None else p.replace(t) for t in pdf["text"]]
            out = {"doc_id": pdf["doc_id"], "text": [t for t, _ in made], "n_found": [len(k) for _, k in made]}
            yield pd.DataFrame(out | {f"n_{kind}": [k.count(kind) for _, k in made] for kind in KINDS})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, text string, n_found long, " + ", ".join(f"{n} long" for n in names))


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read_table(spark, sf_dir, "documents"), QUERY_KEY)
