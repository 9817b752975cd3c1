"""Ranks and running sums over a whole table without a single-task window.

Values are first counted per distinct value; cut points from ``percentile_approx``
deal the distinct values to buckets, a window runs inside each bucket, and a small
table of bucket totals carries the sums on. Results don't depend on the cut points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from unpaired.tables import settle

BUCKETS = 64
#: Rows that one task may sort for a choice, and ranges that are counted at once.
FEW = 10_000
RANGES = 4096
#: Distinct values whose ranks are sent to tasks.
VALUES = 100_000


def running_sums(df: DataFrame, order: str, values: list[str], descending: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``cum_<value>``: sums of ``values`` up to and with each row, by distinct ``order``."""
    df = settle(df, "counts")  # read three times below
    shares = [i / buckets for i in range(1, buckets)]
    cuts = df.agg(F.percentile_approx(order, F.array(*[F.lit(x) for x in shares]), 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = F.lit(0)
    if cuts:
        bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(order)))
    dealt = df.withColumn("_bucket", -bucket if descending else bucket)
    by = F.desc(order) if descending else F.asc(order)
    inside = W.Window.partitionBy("_bucket").orderBy(by).rowsBetween(W.Window.unboundedPreceding, 0)
    totals = dealt.groupBy("_bucket").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    earlier = W.Window.orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)  # at most ``buckets`` rows
    before = totals.select(F.col("_bucket").alias("_of"), *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_b_{v}") for v in values])
    out = dealt.select("*", *[F.sum(v).over(inside).alias(f"_i_{v}") for v in values]).join(F.broadcast(before), F.col("_bucket") == F.col("_of"))
    return out.select(*df.columns, *[(F.col(f"_i_{v}") + F.col(f"_b_{v}")).alias(f"cum_{v}") for v in values])


def percent_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds ``out``: the share of the other rows that are strictly below."""
    df = settle(df, "ranked")
    ranked = _of_values(percent_ranks(df.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("n")), out))
    return df.join(ranked, F.col(value).eqNullSafe(F.col("_v"))).drop("_v")


def _of_values(ranked: DataFrame) -> DataFrame:
    """Ranks of distinct values, settled; up to ``VALUES`` of them are sent to the rows, which then stay where they are."""
    ranked = settle(ranked, "ranks")
    return F.broadcast(ranked) if ranked.count() <= VALUES else ranked


def percent_ranks(counts: DataFrame, out: str) -> DataFrame:
    """(_v, ``out``) of counted values (_v, n): the share of the other rows that are strictly below."""
    counts = settle(counts, "values")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_all"))
    counts = running_sums(counts, "_v", ["n"])
    return counts.join(F.broadcast(total)).select("_v", F.when(F.col("_all") > 1, (F.col("cum_n") - F.col("n")) / (F.col("_all") - 1)).otherwise(0.0).alias(out))


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds ``out``: the rank from 1, ties sharing their mean."""
    counts = running_sums(df.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("n")), "_v", ["n"])
    ranked = _of_values(counts.select("_v", (F.col("cum_n") - (F.col("n") - 1) / 2).alias(out)))
    return df.join(ranked, F.col(value) == F.col("_v")).drop("_v")


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows; ties by (u, v)."""
    return first(df, n, *order, "u", "v")


def smallest(df: DataFrame, n: int, key: Column | str, high: int, *ties: Column | str, few: int = FEW, ranges: int = RANGES) -> DataFrame:
    """The ``n`` rows of smallest ``key``, whole numbers from 0 to below ``high``; ties by ``ties``.

    Ranges of keys are counted, and the one that holds the last row is split again until it
    has ``few`` rows at most (or one key). All rows below it are taken where they lie; only
    that range is sorted. ``df`` is read a few times, so settle it first.
    """
    keyed = df.withColumn("_key", F.col(key) if isinstance(key, str) else key)
    if n <= few:
        return keyed.orderBy("_key", *ties).limit(max(n, 0)).drop("_key")
    low, width, before = 0, high, 0
    while True:
        step = -(-width // ranges)
        own = keyed.where((F.col("_key") >= low) & (F.col("_key") < low + width))
        counted = own.groupBy(F.floor((F.col("_key") - low) / step).cast("long").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()  # ``ranges`` rows at most
        inside = None
        for b, count in sorted((r["b"], r["n"]) for r in counted):
            if before + count >= n:
                inside = (b, count)
                break
            before += count
        if inside is None:
            return df
        low, width = low + inside[0] * step, step
        if inside[1] <= few or step == 1:
            break
    below = keyed.where(F.col("_key") < low)
    last = keyed.where((F.col("_key") >= low) & (F.col("_key") < low + width)).orderBy("_key", *ties).limit(n - before)
    return below.unionByName(last).drop("_key")


def first(df: DataFrame, n: int, *order: Column | str, few: int = FEW) -> DataFrame:
    """The first ``n`` rows in ``order``: of many, by sorted ranges whose sizes tell where the last one lies."""
    if n <= few:
        return df.orderBy(*order).limit(max(n, 0))
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = settle(placed.withColumn("_range", F.shiftright("_at", 33)), "in-order")
    sizes, before = {r["_range"]: r["n"] for r in placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}, 0  # a row for each task
    for number in sorted(sizes):
        if before + sizes[number] >= n:
            return placed.where(F.col("_at") < (number << 33) + n - before).drop("_at", "_range")
        before += sizes[number]
    return placed.drop("_at", "_range")
