"""Column arithmetic whose results agree across engines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTROPY_FLOOR = 1e-9
DEFAULT_CONFIDENCE = 0.5


def rounded(c: Column, digits: int = 4) -> Column:
    """Half-up rounding by ``floor``, the same in every SQL engine."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def rounded_mean(c: Column) -> Column:
    """The mean of a group to four digits, half up, whatever the order of its rows.

    Sums are whole numbers of 1e-9, so a mean that lies half-way is found half-way; sums of
    doubles miss it by the order they are added in.
    """
    n = F.count(c)
    whole, unit = 2 * F.sum(F.round(c * 1e9).cast("long")) + n * 100_000, 2 * n * 100_000
    return F.when(n > 0, (whole - F.pmod(whole, unit)) / unit / 10000.0)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; null (an abstention) where ``b`` is zero."""
    return F.try_divide(a, b)


def clamp01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def binary_entropy(p: Column) -> Column:
    """Entropy in bits of a probability, clamped away from 0 and 1."""
    p = F.least(F.lit(1 - ENTROPY_FLOOR), F.greatest(F.lit(ENTROPY_FLOOR), p))
    return -p * F.log2(p) - (1 - p) * F.log2(1 - p)


def decisiveness(value: Column, reported: Column | None = None) -> Column:
    """The reported confidence clamped to [0, 1], else 1 minus the value's entropy."""
    own = 1 - binary_entropy(value)
    return own if reported is None else F.coalesce(clamp01(reported), own)


def weighted_mean(values: Mapping[str, Column], weights: Mapping[str, Column | float]) -> Column:
    """Mean of the values that aren't null; null if none is or their weights sum to zero."""
    num, den = F.lit(0.0), F.lit(0.0)
    for name, value in values.items():
        w = weights.get(name, 1.0)
        w = w if isinstance(w, Column) else F.lit(float(w))
        num = num + F.when(value.isNotNull(), w * value).otherwise(0.0)
        den = den + F.when(value.isNotNull(), w).otherwise(0.0)
    return ratio(num, den)


def margin_gate(sn: Column, sp: Column, margin: float = 0.05, floor: float = 0.0) -> Column:
    return ((sn - sp) > margin) & (sn > floor)


def margin_score(sn: Column, sp: Column, temperature: float = 0.1) -> Column:
    return 1 / (1 + F.exp(-(sn - sp) / temperature))


def total_tokens(prompt: Column, completion: Column) -> Column:
    """Null if either count is."""
    return prompt + completion
