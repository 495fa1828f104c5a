"""Scalar scores on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0; vectors of unlike length are an error."""
    lengths = F.when(norm(a) * norm(b) == 0, F.lit(0.0)).otherwise(dot(a, b) / (norm(a) * norm(b)))
    return F.when(F.size(a) == F.size(b), lengths).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def cleared(clearance: Column, caller: int, default: int = 1) -> Column:
    """Whether a caller may see a row; rows without clearance count as default."""
    return F.coalesce(clearance, F.lit(default)) <= F.lit(caller)


def synaptic_score(utility: Column, energy: Column, retrievals: Column, hours: Column, base: float = 0.05) -> Column:
    """utility * energy * exp(-rate * hours), the rate falling with retrievals; nulls count as 1, 1, 1 and 0."""
    one = F.lit(1.0)
    rate = base / (1 + 0.1 * F.sqrt(F.coalesce(retrievals.cast("double"), one)))
    return F.coalesce(utility, one) * F.coalesce(energy, one) * F.exp(-rate * F.coalesce(hours, F.lit(0.0)))


def dynamic_decay(energy: Column, retrievals: Column, hours: Column, base: float = 0.05, damping: float = 0.5) -> Column:
    """Energy after some hours, within [0, 1]; negative retrievals are an error."""
    rate = base / (1 + damping * F.sqrt(retrievals.cast("double")))
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), energy * F.exp(-rate * F.greatest(F.lit(0.0), hours))))
    return F.when(retrievals < 0, F.raise_error(F.lit("negative retrievals")).cast("double")).otherwise(value)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length, in lower case; two empty strings are alike."""
    a, b = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)
