"""Scoring functions as column expressions.  Logarithms of zero are minus infinity."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x)).otherwise(F.lit(float("-inf")))


def libm_log10(x: Column) -> Column:
    """``log10`` as the C library rounds it.

    Java's differs in the last bit of about one value in a hundred, which decides between tilings of equal probability.
    """

    @F.pandas_udf(T.DoubleType())
    def run(v: pd.Series) -> pd.Series:
        from math import log10

        return v.map(lambda p: log10(p) if p > 0 else float("-inf"))

    return F.when(x > 0, run(x)).otherwise(F.lit(float("-inf")))


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(float("-inf")))


def poisson(b: Column, lam: float) -> Column:
    """lam^b e^-lam / b!, as a sum of logarithms so that large b don't overflow."""
    log_fact = F.aggregate(F.when(b > 1, F.sequence(F.lit(2), b.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + F.ln(i.cast("double")))
    return F.exp(b * math.log(lam) - lam - log_fact)


def length_prior(length: Column, parts: Column) -> Column:
    """log10 of 0.037 ^ (length div parts)."""
    return F.log10(F.pow(F.lit(0.037), F.floor(length / parts)))


def affix_prior(length: Column) -> Column:
    """Natural logarithm of (1/29)^(length + 1)."""
    return F.ln(F.pow(F.lit(1 / 29.0), length + 1))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where a vector is missing or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def stored_cosine(c: Column) -> Column:
    """-1 stands for a word without vector or a value outside [0, 1]."""
    return F.when(c.isNull() | (c < 0) | (c > 1), F.lit(-1.0)).otherwise(c)


def similarity(stored: Column, unfound: float) -> Column:
    return F.when(stored.isNull() | (stored == -1), F.lit(unfound)).otherwise(stored)


def cut_similarity(stored: Column, unfound: float, low: float, cut: float = 0.25) -> Column:
    s = similarity(stored, unfound)
    return F.when(s < cut, F.lit(low)).when(s > cut, F.lit(1.0)).otherwise(s)


def hash_uniform(*parts: Column) -> Column:
    """A uniform number in [0, 1) that depends only on the parts, so results don't depend on partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / float(2**52)
