"""Choosing evaluation and training pairs from a scored pool.

A scored pool has ``u, v, confidence, hardness, degsum``. Every order ends in (u, v).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from unpaired.functions.hashing import hash52, sha1_order, uniform
from unpaired.graph import excluding
from unpaired.operators.ranking import first, top
from unpaired.tables import settle

PROPORTIONS = (0.6, 0.3, 0.1)
PSM_CAP = 0.7
OVERSAMPLE = 4
#: Pairs that a capped choice looks at first, and times as many whenever they don't suffice.
PREFIX = 8


without = excluding


def degree_matched(pool: DataFrame, n: int, weight: str = "degsum", seed: int = 0) -> DataFrame:
    """Weighted sampling without replacement: the largest ln(U)/weight win.

    Pairs of weight 0 come last, in order of their hash; if all are, the draw is uniform.
    """
    draw = uniform(seed, F.col("u"), F.col("v"))
    key = F.when(F.col(weight) > 0, F.log(draw) / F.col(weight))
    return first(pool, n, F.desc_nulls_last(key), F.desc(draw), "u", "v")


def hard(pool: DataFrame, n: int) -> DataFrame:
    return top(pool, n, F.desc("hardness"))


def safe(pool: DataFrame, n: int) -> DataFrame:
    return top(pool, n, F.desc("confidence"))


def stacked(pool: DataFrame, n: int, oversample: int = OVERSAMPLE) -> DataFrame:
    """Of the ``oversample`` n hardest, the n most confident."""
    return safe(hard(pool, oversample * n), n)


def mixture(pool: DataFrame, n: int, proportions: tuple[float, float, float] = PROPORTIONS, seed: int = 0) -> DataFrame:
    """A blend (representative, safe, hard): stacked first, then confident, then by hash."""
    n_hard, n_safe = round(n * proportions[2]), round(n * proportions[1])
    tail = stacked(pool, n_hard)
    second = safe(without(pool, tail), n_safe)
    third = first(without(pool, tail, second), max(0, n - n_hard - n_safe), sha1_order(seed, F.col("u"), F.col("v")), "u", "v")
    return tail.unionByName(second).unionByName(third)


def quotas(supply: dict[int, int], wanted: list[tuple[int, int]], n: int, seed: int = 0) -> dict[int, int]:
    """How many pairs each bucket of degree sums gives, by nearest match without replacement.

    ``supply`` counts pairs by degree sum, ``wanted`` has (sum, count) of targets, of which
    ``n`` are matched (:func:`shares`). Targets of one sum come together, sums in order of a hash; each takes what is left of the nearest buckets, the
    lower one on ties. The work is in proportion to the number of different sums, whatever
    the number of pairs: full runs of buckets are stepped over by links to the next that has any left.
    """
    import hashlib
    from bisect import bisect_left

    left = {k: v for k, v in supply.items() if v > 0}
    keys, out = sorted(left), {}
    # the next bucket with any left, from a place on: ``up`` of bucket i at i, ``down`` of bucket i at i + 1 (0: none)
    up, down = list(range(len(keys) + 1)), list(range(len(keys) + 1))

    def open_at(links: list[int], i: int) -> int:
        root = i
        while links[root] != root:
            root = links[root]
        while links[i] != root:
            links[i], i = root, links[i]
        return root

    matched = shares(dict(wanted), n, seed)
    for d in sorted(matched, key=lambda x: hashlib.md5(f"{seed}:{x}".encode()).hexdigest()):
        need = matched[d]
        at = bisect_left(keys, d)
        while need:
            low, high = open_at(down, at) - 1, open_at(up, at)
            near = [i for i in (low, high) if 0 <= i < len(keys)]
            if not near:
                return out
            i = min(near, key=lambda j: (abs(keys[j] - d), keys[j]))
            take = min(need, left[keys[i]])
            out[keys[i]] = out.get(keys[i], 0) + take
            left[keys[i]] -= take
            need -= take
            if not left[keys[i]]:
                down[i + 1], up[i] = i, i + 1
    return out


def shares(counts: dict[int, int], n: int, seed: int = 0) -> dict[int, int]:
    """``n`` of the counted targets, spread over their degree sums in proportion; remainders go by hash."""
    import hashlib

    total = sum(counts.values())
    if total <= n:
        return dict(counts)
    parts = {d: divmod(c * n, total) for d, c in counts.items()}
    spare = n - sum(q for q, _ in parts.values())
    by = sorted(counts, key=lambda d: (-parts[d][1], hashlib.md5(f"{seed}:{d}".encode()).hexdigest()))
    return {d: parts[d][0] + (i < spare) for i, d in enumerate(by)}


def psm(pool: DataFrame, positives: DataFrame | None, n: int, cap: float = PSM_CAP, seed: int = 0) -> DataFrame:
    """Degree sums matched to those of the positives (``degsum``), from pairs of hardness up to ``cap``.

    ``n`` targets follow the positives' degree sums in proportion. Counts of degree sums, of which there are at
    most twice the largest degree, come to the driver, which decides how many pairs each
    sum gives; which ones is decided by hash, inside the sum.
    """
    clean = pool.where(F.col("hardness") <= cap)
    if clean.isEmpty():
        clean = pool
    bucket = F.round("degsum").cast("long")
    count = lambda df: {r[0]: r[1] for r in df.groupBy(bucket.alias("b")).count().collect()}
    supply = count(clean)
    give = quotas(supply, sorted((count(positives) if positives is not None else supply).items()), n, seed)
    if not give:
        return pool.limit(0)
    table = pool.sparkSession.createDataFrame(sorted(give.items()), "_b long, _quota long")
    order = W.Window.partitionBy("_b").orderBy(hash52(seed, F.col("u"), F.col("v")), "u", "v")
    ranked = clean.withColumn("_b", bucket).join(table, "_b").withColumn("_r", F.row_number().over(order))
    return ranked.where(F.col("_r") <= F.col("_quota")).select(*pool.columns)


def length_matched(pool: DataFrame, picks: DataFrame, lengths: DataFrame, seed: int = 0) -> DataFrame:
    """As many other pairs of ``pool`` as there are ``picks``, with like sums of their ends' lengths (id, length)."""

    def summed(pairs: DataFrame) -> DataFrame:
        a, b = (lengths.select(F.col("id").alias(end), F.col("length").alias(f"_{end}")) for end in ("u", "v"))
        return pairs.select("u", "v").join(a, "u").join(b, "v").select("u", "v", (F.col("_u") + F.col("_v")).alias("degsum"), F.lit(0.0).alias("hardness"))

    wanted = summed(picks)
    return psm(summed(without(pool, picks)), wanted, wanted.count(), seed=seed).select("u", "v", F.col("degsum").alias("length"))


def select_train(pool: DataFrame, n: int, exclude: DataFrame | None = None, mode: str = "stacked", proportions: tuple[float, float, float] = PROPORTIONS, seed: int = 0, positives: DataFrame | None = None, cap: float = PSM_CAP) -> DataFrame:
    pool = pool if exclude is None else without(pool, exclude)
    if mode == "hard":
        return hard(pool, n)
    if mode == "safe":
        return safe(pool, n)
    if mode == "stacked":
        return stacked(pool, n)
    if mode == "mixture":
        return mixture(pool, n, proportions, seed)
    if mode == "psm":
        return psm(pool, positives, n, cap, seed)
    raise ValueError(f"unknown selection mode {mode!r}")


def bio_filtered(pool: DataFrame, n: int, flag: str = "different_compartment") -> DataFrame:
    """The ``n`` hardest pairs that carry a flag."""
    return hard(pool.where(F.array_contains("flags", flag)), n)


def per_entity_cap(pool: DataFrame, n: int, cap: int, by: str = "confidence") -> DataFrame:
    """Greedy top ``n`` in which no entity occurs more than ``cap`` times.

    Whether a pair is taken depends on the pairs before it alone, so only the first
    ``PREFIX`` n pairs are looked at, then ever more until ``n`` are found. In a prefix, a
    pair is safe to take if it is among the first ``cap`` of all open pairs of both its
    ends. Rounds take those, drop pairs whose ends are full, and go on; a round settles
    at least the first pair left. Counts are carried per entity, so nothing is collected.
    """
    order = F.struct((-F.col(by)).alias("o"), F.col("u").alias("a"), F.col("v").alias("b"))
    pool = settle(pool.withColumn("_order", order), "capped")
    total, size = pool.count(), PREFIX * n
    while True:
        taken = _capped(first(pool, size, "_order"), cap)
        if size >= total or taken.count() >= n:
            return first(taken, n, "_order").drop("_order")
        size *= PREFIX


def _capped(left: DataFrame, cap: int) -> DataFrame:
    """All pairs that greedy taking in ``_order`` gives."""
    taken = None
    while taken is None or not left.isEmpty():
        ends = left.select("u", "v", "_order", F.explode(F.array("u", "v")).alias("e"))
        if taken is not None:
            used = taken.select(F.explode(F.array("u", "v")).alias("e")).groupBy("e").count()
            ends = ends.join(used, "e", "left").na.fill(0, ["count"])
        else:
            ends = ends.withColumn("count", F.lit(0))
        ranked = ends.withColumn("_r", F.row_number().over(W.Window.partitionBy("e").orderBy("_order")) + F.col("count"))
        both = ranked.groupBy("u", "v").agg(F.max("_r").alias("_r"), F.max("count").alias("_c"))
        own = settle(left.join(both, ["u", "v"]), "round")
        now = own.where(F.col("_r") <= cap).drop("_r", "_c")
        taken = now if taken is None else taken.unionByName(now)
        left = own.where((F.col("_r") > cap) & (F.col("_c") < cap)).drop("_r", "_c")
    return taken


def drop_and_backfill(pool: DataFrame, chosen: DataFrame, flagged: DataFrame, n: int) -> DataFrame:
    """``chosen`` without the ``flagged`` pairs, refilled to ``n`` by the next most confident."""
    kept = without(chosen, flagged)
    spare = without(pool, chosen, flagged).withColumn("_late", F.lit(1))
    return first(kept.withColumn("_late", F.lit(0)).unionByName(spare), n, "_late", F.desc("confidence"), "u", "v").drop("_late")
