"""Fusing the scores of several filters into one confidence."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unpaired.functions.numeric import DEFAULT_CONFIDENCE, clamp01, decisiveness, rounded, weighted_mean


def fuse(streams: Mapping[str, Column], weights: Mapping[str, float] | None = None, mode: str = "mean", lam: float = 1.0, reported: Mapping[str, Column] | None = None) -> Column:
    """Weighted mean of the streams that don't abstain; 0.5 if all do.

    In mode ``entropy`` a stream weighs ``1 + lam`` times its decisiveness more: its
    reported confidence if it has one, else 1 minus its entropy.
    """
    weights, reported = weights or {}, reported or {}
    if mode == "mean":
        own: dict[str, Column | float] = dict(weights)
    elif mode == "entropy":
        own = {}
        for name, value in streams.items():
            said = reported.get(name)
            sure = decisiveness(value) if said is None else F.coalesce(said, decisiveness(value))
            own[name] = F.lit(float(weights.get(name, 1.0))) * (1 + lam * sure)
    else:
        raise ValueError(f"fusion mode {mode!r}")
    return rounded(F.coalesce(weighted_mean(streams, own), F.lit(DEFAULT_CONFIDENCE)))


def contributing(streams: Mapping[str, Column]) -> Column:
    """Names of the streams that don't abstain."""
    return F.filter(F.array(*[F.when(v.isNotNull(), F.lit(n)) for n, v in streams.items()]), lambda x: x.isNotNull())


def sub_scores(streams: Mapping[str, Column]) -> Column:
    """Map of the streams that don't abstain."""
    return F.map_filter(F.create_map(*[x for n, v in streams.items() for x in (F.lit(n), v)]), lambda k, v: v.isNotNull())


def disagreement(streams: Mapping[str, Column]) -> Column:
    """Population standard deviation of the values present; 0 for fewer than two."""
    values = F.filter(F.array(*streams.values()), lambda x: x.isNotNull())
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
    square = F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    return F.when(n >= 2, F.sqrt(square)).otherwise(0.0)


def reported_or_own(value: Column, said: Column) -> Column:
    return F.coalesce(clamp01(said), decisiveness(value))


def zscore_sum(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Adds ``out``: the sum of the columns' z-scores (a constant column adds 0)."""
    stats = df.agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = df.join(F.broadcast(stats))
    total = sum((F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)) for c in columns), F.lit(0.0))
    return joined.withColumn(out, total).select(*df.columns, out)
