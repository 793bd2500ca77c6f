"""Operator 8: token counts by a map-side two-tier lookup; no pre-token is shuffled.

Tier one is a compact table, broadcast to the workers: pre-token -> number of tokens, for the pre-tokens that are most
frequent in a sample of about ``SAMPLE_ROWS`` distinct texts of at most ``SAMPLE_CHARS`` characters, chosen by a hash of the
text, cut to ``TABLE_SIZE`` entries.  It only saves work: a pre-token has the same
number of tokens wherever it is looked up.  Tier two is a cache in each worker, bounded by ``CACHE`` entries; misses are
encoded by the tokenizer library itself, a batch at a time.

Special strings are handled as the library does by default: one inside a text is one token, and parts the text there.
Defined cases: null and empty texts have no bytes and no tokens; rows repeat as often as in the input.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read_table, sample_texts

SAMPLE_ROWS = 256
SAMPLE_CHARS = 20_000
TABLE_SIZE = 1 << 15
CACHE = 200_000
_counters: dict[tuple[str, str], "TokenCounter"] = {}


class TokenCounter:
    def __init__(self, tokenizer_path: str, pattern: str, table: dict[str, int] | None = None, cache: int = CACHE):
        import json

        from tokenizers import Tokenizer

        from ._bpe import compiled

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.split = compiled(pattern).findall
        with open(tokenizer_path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"] if t["content"]]
        self.special.sort(key=len, reverse=True)
        self.table, self.limit, self.cache = table or {}, cache, {}

    def parts(self, text: str) -> tuple[list[str], int]:
        """What stands between special strings, and how many of them there are."""
        if not any(s in text for s in self.special):
            return [text], 0
        import re

        parts = re.split("|".join(map(re.escape, self.special)), text)
        return parts, len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        table, cache, split = self.table, self.cache, self.split
        pieces, n_special = [], []
        for t in texts:
            parts, k = self.parts(t)
            pieces.append([x for p in parts for x in split(p)])
            n_special.append(k)
        new = {x for x in set().union(*pieces) if x not in table and x not in cache}
        if len(cache) + len(new) > self.limit:
            cache = self.cache = {}
            new = {x for x in set().union(*pieces) if x not in table}
        if new:
            names = list(new)
            for x, e in zip(names, self.tokenizer.encode_batch_fast(names, add_special_tokens=False)):
                cache[x] = len(e)
        out = []
        for p, k in zip(pieces, n_special):
            n = k
            for x in p:
                n += table[x] if x in table else cache[x]
            out.append(n)
        return out


def frequent_lengths(docs: DataFrame, text_col: str, tokenizer_path: str, pattern: str, rows: int = SAMPLE_ROWS, size: int = TABLE_SIZE) -> dict[str, int]:
    """The table of tier one, from a bounded sample of rows; which rows it sees changes no count."""
    counter, seen = TokenCounter(tokenizer_path, pattern), Counter()
    for row in sample_texts(docs, text_col, rows, SAMPLE_CHARS).collect():
        for part in counter.parts(row.text)[0]:
            seen.update(counter.split(part))
    names = [x for x, _ in seen.most_common(size)]
    return {x: len(e) for x, e in zip(names, counter.tokenizer.encode_batch_fast(names, add_special_tokens=False))}


def token_counts(docs: DataFrame, tokenizer_path: str, pattern: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    from ._arrow_text import batches

    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, text_col, tokenizer_path, pattern))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))

    def run(it):
        import os

        import pandas as pd

        from ._worker import claim

        claim("token counts", _counters.clear)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        key = (tokenizer_path, pattern)
        if key not in _counters:
            _counters[key] = TokenCounter(tokenizer_path, pattern, table.value)
        c = _counters[key]
        c.table = table.value
        for pdf in it:
            texts, n = pdf["text"].tolist(), []
            for a, b in batches(texts):
                n += c.count(texts[a:b])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": pdf["n_bytes"], "n_tokens": n, "over_limit": [x > limit for x in n]})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
