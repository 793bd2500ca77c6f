"""Operator 5: secrets by fixed patterns and by a Markov log-likelihood ratio, as DataFrame operations only.

Base spans are the matches of three patterns.  The method adds spans of kind ``markov``: runs of at least ``RUN``
characters of tokens that a first-order Markov model of random strings explains better than one of ordinary identifiers,
by ``MARGIN`` nats or more and ``RATE`` for each pair, and that touch no base span.  Both models are counts of character pairs over labelled
samples: values of base matches and digests in base64 are random; other words, and the joints of ``two_words``,
``two-words`` and ``twoWords`` made of neighbouring ones, are ordinary, each of them once.  The samples come from about ``SAMPLE_ROWS`` distinct texts of at
most ``SAMPLE_CHARS`` characters, chosen by a hash of the text; the table has a row for each pair of an alphabet of 66
characters, whatever the input's size, and doesn't depend on partitioning.

Positions count code points.  A match's place follows from the lengths of the parts between matches, so texts
without any match are only searched.

Defined cases: null text counts as empty; texts without secrets have empty spans; rows repeat as in the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read_table, sample_texts

#: The patterns of the contract.  Fixed values.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8

KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
RUN = 20
MARGIN = 12.0
RATE = 0.7  # least mean ratio of a pair, in nats: names of parts that no sample has stay below
SAMPLE_ROWS = 2_000
SAMPLE_CHARS = 20_000
RANDOM_STRINGS = 3_000
BACK_OFF = 20.0  # pairs that the share of a character weighs
_CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}" % RUN
_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def spans(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 0) -> Column:
    """(start, kind, end) of the pattern's matches whose group has at least so many characters, in order."""
    p = F.lit(pattern)
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, 0).alias("all"), F.regexp_extract_all(text, p, value_group).alias("value")
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["all"])
        one = F.when(F.length(x["value"]) >= least, F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))).otherwise(_none())
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x["all"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), _none().alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(pieces, start, step, lambda acc: acc["out"])).otherwise(_none())


def _pairs(strings: DataFrame) -> DataFrame:
    """Counts n of neighbouring characters x, y of a column s of strings over the alphabet."""
    at = F.explode(F.sequence(F.lit(1), F.length("s") - 1)).alias("i")
    rows = strings.where("length(s) > 1").select("s", at).select(F.expr("substring(s, i, 1)").alias("x"), F.expr("substring(s, i + 1, 1)").alias("y"))
    return rows.groupBy("x", "y").agg(F.count("*").alias("n"))


def fit(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[float]:
    """Log-likelihood ratios of all pairs of the alphabet, row by row: random over ordinary."""
    spark = docs.sparkSession
    texts = sample_texts(docs, text_col, rows, SAMPLE_CHARS)
    values = texts.select(F.explode(F.regexp_extract_all("text", F.lit(ASSIGN), 2)).alias("s"))
    values = values.unionByName(texts.select(F.explode(F.regexp_extract_all("text", F.lit(f"({ACCESS}|{HEX})"), 1)).alias("s")))
    made = spark.range(RANDOM_STRINGS).select(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))).alias("s"))
    random = values.unionByName(made).select(F.explode(F.regexp_extract_all("s", F.lit("([A-Za-z0-9+/_-]{8,})"), 1)).alias("s"))
    rest = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    words = texts.select(F.split(rest, "[^A-Za-z0-9+/_-]+").alias("ws")).select(F.filter("ws", lambda w: (F.length(w) >= 2) & (F.length(w) < RUN)).alias("ws"))
    # what may be a secret itself, a run of RUN characters, isn't a sample of ordinary words; each counts once, however
    # frequent it is, as do the joints of names that are made of neighbouring words
    first = lambda w: F.substring(w, 1, 1)
    joints = F.zip_with(F.slice("ws", 1, F.greatest(F.size("ws") - 1, F.lit(0))), F.slice("ws", 2, F.size("ws")), lambda x, y: F.array(F.concat(F.right(x, F.lit(1)), F.lit("_"), first(y)), F.concat(F.right(x, F.lit(1)), F.lit("-"), first(y)), F.concat(F.right(x, F.lit(1)), F.upper(first(y)), F.lower(F.substring(y, 2, 1)))))
    ordinary = words.select(F.explode(F.concat("ws", F.flatten(joints))).alias("s")).distinct()
    size = len(ALPHABET)

    def logs(strings: DataFrame) -> list[list[float]]:
        """Log-probabilities of y after x, smoothed towards how frequent y is in its class."""
        counts = [[0.0] * size for _ in range(size)]
        for r in _pairs(strings).collect():  # as many rows as the alphabet has pairs, at most
            counts[ALPHABET.index(r.x)][ALPHABET.index(r.y)] += r["n"]
        each = [sum(row[k] for row in counts) + 0.5 for k in range(size)]
        share = [e / sum(each) for e in each]
        return [[math.log((c + BACK_OFF * s) / (sum(row) + BACK_OFF)) for c, s in zip(row, share)] for row in counts]

    a, b = logs(random), logs(ordinary)
    return [round(x - y, 9) for p, q in zip(a, b) for x, y in zip(p, q)]


def find_secrets(docs: DataFrame, ratios: list[float], margin: float = MARGIN, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, counts, and the arrays of structs ``base`` and ``added``."""
    size = len(ALPHABET)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    rows = rows.select(
        "doc_id", "text",
        spans(text, ASSIGN, 0, 2, LEAST_VALUE).alias("assign"), spans(text, ACCESS, 1).alias("access"), spans(text, HEX, 2).alias("hexes"),
        spans(text, _CANDIDATE, 3).alias("runs"),
    )
    rows = rows.withColumn("base", F.array_sort(F.concat("assign", "access", "hexes")))
    free = F.filter("runs", lambda r: ~F.exists(F.col("base"), lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    rows = rows.withColumn("free", free)

    word = "substring(text, cast(r.start as int) + 1, cast(r.end - r.start as int))"
    place = "locate(substring(w, {0}, 1), '%s')" % ALPHABET
    score = f"aggregate(sequence(1, length(w) - 1), 0D, (s, i) -> s + get(ratios, ({place.format('i')} - 1) * {size} + {place.format('i + 1')} - 1))"
    kept = F.expr(f"filter(free, r -> transform(array({word}), w -> {score})[0] >= greatest({margin}D, {rate}D * (r.end - r.start - 1)))")
    table = F.array(*map(F.lit, ratios))
    rows = rows.withColumn("ratios", F.when(F.size("free") > 0, table)).withColumn("added", F.when(F.size("free") > 0, kept).otherwise(_none()))
    return rows.select(
        "doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hexes").cast("long").alias("n_hex"), "base", "added"
    )


def joined(column: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = find_secrets(docs, fit(docs))
    every = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.size("added").cast("long").alias("n_markov"))
