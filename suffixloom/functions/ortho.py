"""Orthography: evaluator letters and allomorph classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def turkish_ascii(x: Column) -> Column:
    return F.translate(F.lower(x), "öçüığş", "OCUIGS")


def german_map(x: Column, capital_first: bool = False) -> Column:
    """ä, ö, ü, ß written out; ``capital_first`` keeps the ö of segmentations as O."""
    out = F.replace(F.lower(x), F.lit("ä"), F.lit("ae"))
    out = F.replace(out, F.lit("ö"), F.lit("O" if capital_first else "oe"))
    return F.replace(F.replace(out, F.lit("ü"), F.lit("ue")), F.lit("ß"), F.lit("ss"))


def allomorph_class(m: Column) -> Column:
    """a, e, ı, i -> H; t, d -> D; c, ç -> C; k, ğ -> G; but ``ken`` stays."""
    return F.when(m == "ken", m).otherwise(F.translate(m, "aeıitdcçkğ", "HHHHDDCCGG"))
