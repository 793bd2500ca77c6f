"""Operator 10: byte-level BPE encoding and decoding over length-bucketed padded numpy matrices.

A text is cut into pre-tokens; each worker keeps a bounded cache from pre-token to its ids.  The distinct pre-tokens of
an Arrow batch that the cache lacks are encoded together (``MatrixBPE``).  A pre-token of more than ``LONG`` bytes takes
the same merges from a heap, as a matrix of one row would need a round for every byte.  Nothing is shuffled.

Defined cases: null and empty texts have no tokens and decode to no bytes; rows repeat as often as in the input.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow_text import batches
from ._common import read_table

CACHE = 200_000
LONG = 2_000
_coders: dict[tuple[str, str], "Coder"] = {}


class Coder:
    """Encodes texts to little-endian unsigned 32-bit ids, and decodes them."""

    def __init__(self, ranks_path: str, pattern: str, cache: int = CACHE):
        from ._bpe import MatrixBPE, compiled, load_ranks

        self.bpe = MatrixBPE(load_ranks(ranks_path))
        self.split = compiled(pattern).findall
        self.limit, self.cache = cache, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces = [self.split(t) for t in texts]
        new = set().union(*pieces).difference(self.cache) if self.cache else set().union(*pieces)
        if len(self.cache) + len(new) > self.limit:
            self.cache = {}
            new = set().union(*pieces)
        if new:
            names = sorted(new)
            raw = [p.encode() for p in names]
            short = [i for i, p in enumerate(raw) if len(p) <= LONG]
            for i, ids in zip(short, self.bpe.encode([raw[i] for i in short])):
                self.cache[names[i]] = ids.astype("<u4").tobytes()
            for i, p in enumerate(raw):
                if len(p) > LONG:
                    self.cache[names[i]] = self.bpe.encode_long(p).astype("<u4").tobytes()
        get = self.cache.__getitem__
        return [b"".join(map(get, p)) for p in pieces]

    def decode(self, ids: bytes) -> bytes:
        import numpy as np

        return b"".join(map(self.bpe.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def coder(ranks_path: str, pattern: str) -> Coder:
    from ._worker import claim

    claim("byte bpe", _coders.clear)
    if (ranks_path, pattern) not in _coders:
        _coders[ranks_path, pattern] = Coder(ranks_path, pattern)
    return _coders[ranks_path, pattern]


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (little-endian unsigned 32-bit integers), n_tokens."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(it):
        import pandas as pd

        c = coder(ranks_path, pattern)
        for pdf in it:
            texts, ids = pdf["text"].tolist(), []
            for a, b in batches(texts):
                ids += c.encode(texts[a:b])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": ids, "n_tokens": [len(x) // 4 for x in ids]})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, ids binary, n_tokens long")


def bpe_decode(rows: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The rows with a column ``decoded`` of bytes."""

    @F.pandas_udf("binary")
    def back(ids):
        c = coder(ranks_path, pattern)
        return ids.map(c.decode)

    return rows.withColumn("decoded", back(F.col(ids_col)))


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids where asked for."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(it):
        import pandas as pd

        c = coder(ranks_path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for pdf in it:
            texts, n, a_sha, b_sha, kept = pdf["text"].tolist(), [], [], [], []
            for a, b in batches(texts):
                for ids in c.encode(texts[a:b]):
                    kept += [ids] if with_ids else []
                    n.append(len(ids) // 4), a_sha.append(sha(ids)), b_sha.append(sha(c.decode(ids)))
            out = {"doc_id": pdf["doc_id"], "n_tokens": n, "ids_sha256": a_sha, "decoded_sha256": b_sha}
            yield pd.DataFrame(out | ({"ids": kept} if with_ids else {}))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
