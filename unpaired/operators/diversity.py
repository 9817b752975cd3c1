"""Diverse subsets by greedy log-determinant, and how diverse a subset is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unpaired.functions.numeric import ratio, rounded
from unpaired.operators import manifold
from unpaired.tables import settle

EPSILON = 1e-10
#: Rows that one task chooses from.
CELL = 20_000
#: Rows of a block of vectors that are compared with one another at once.
BLOCK = 2_000


def greedy_map(quality: np.ndarray, vectors: np.ndarray, k: int) -> list[int]:
    """Rows that greedily maximise the log-determinant of the kernel q S q."""
    q = np.asarray(quality, float)
    gains = q * q * (vectors * vectors).sum(1)
    factor = np.zeros((min(k, len(q)), len(q)))
    chosen: list[int] = []
    while len(chosen) < min(k, len(q)):
        j = int(np.argmax(gains))
        if gains[j] <= EPSILON:
            break
        step = len(chosen)
        row = (q[j] * (vectors @ vectors[j]) * q - factor[:step, j] @ factor[:step]) / np.sqrt(gains[j])
        factor[step] = row
        gains = gains - row * row
        gains[j] = -np.inf
        chosen.append(j)
    return chosen


def log_determinant(quality: np.ndarray, vectors: np.ndarray) -> float:
    """Of the kernel q S q of some rows: what :func:`greedy_map` makes large."""
    own = np.asarray(quality, float)[:, None] * vectors
    return float(np.linalg.slogdet(own @ own.T)[1])


def diverse(pool: DataFrame, k: int, quality: str = "quality", vector: str = "rep", group: str | None = None, cell: int = CELL) -> DataFrame:
    """Up to ``k`` rows of each group with ``dpp_rank``; order in a group by (u, v).

    Core-sets: a group of more than ``cell`` rows is dealt to cells by hash, each picks its
    ``k``, and the picks compete again until one cell holds them all. The choice is that of
    one group if it has ``cell`` rows at most.
    """
    keys = [group] if group else []
    own = pool.withColumn("_cell", F.lit(0))

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["u", "v"], kind="stable").reset_index(drop=True)
        at = greedy_map(rows[quality].to_numpy(float), np.stack(rows[vector].to_numpy()).astype(float), k)
        out = rows.iloc[at].copy()
        out["dpp_rank"] = np.arange(len(at), dtype=np.int64)
        return out

    sizes = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    largest, target = sizes.agg(F.max("_n")).first()[0] or 0, max(cell, 2 * k)
    while largest > target:
        cells = F.ceil(F.col("_n") / target)
        counted = own.join(sizes, keys) if keys else own.join(F.broadcast(sizes))
        dealt = counted.withColumn("_cell", F.pmod(F.xxhash64("u", "v"), cells).cast("int")).drop("_n")
        own = settle(dealt.groupBy(*keys, "_cell").applyInPandas(pick, dealt.withColumn("dpp_rank", F.lit(0).cast("long")).schema).drop("dpp_rank"), "picks")
        sizes = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        largest = sizes.agg(F.max("_n")).first()[0] or 0
    own = own.withColumn("_cell", F.lit(0))
    return own.groupBy(*keys, "_cell").applyInPandas(pick, own.withColumn("dpp_rank", F.lit(0).cast("long")).schema).drop("_cell")


def diversity(chosen: DataFrame, vector: str = "rep", block: int = BLOCK) -> DataFrame:
    """Mean and largest pairwise cosine, and distinct nodes.

    The mean comes from the sum of the unit vectors: its squared norm counts every pair
    twice and every row once. The largest is found block against block in a cross join: a task has
    some blocks of ``block`` rows and takes them past the others, so each vector is exchanged once.
    """
    unit = chosen.select("u", "v", F.col(vector).alias("_x"), F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)).alias("_n"))
    unit = settle(unit.select("u", "v", F.transform("_x", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(0.0)).alias("_x")), "unit")
    sums = unit.select(F.posexplode("_x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("own"))
    total = sums.agg(F.sum(F.col("s") * F.col("s") - F.col("own")).alias("_twice"))
    n = unit.count()
    mean = total.select(rounded(ratio(F.col("_twice"), F.lit(float(n) * (n - 1)))).alias("mean_cosine"))
    width = unit.agg(F.max(F.size("_x"))).first()[0] or 1
    blocks = settle(manifold.packed_vectors(unit, 8 * width * block, "_x"), "blocks", maxRecordsPerFile=1)
    a, b = (blocks.select(*[F.col(c).alias(f"{c}_{end}") for c in ("number", "width", "packed")]) for end in ("a", "b"))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(2))
    # every two blocks meet once, in the task of the one or the other by a hash, so that tasks have alike to do
    mine = F.when(F.col("number_a") < F.col("number_b"), place("number_a") == place("number_b")).otherwise((F.col("number_a") == F.col("number_b")) | (place("number_a") != place("number_b")))

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = -np.inf
        for batch in batches:
            for i in range(batch.num_rows):
                same = batch.column("number_a")[i] == batch.column("number_b")[i]
                x, y = (manifold.unpacked(batch, i, f"packed_{end}", f"width_{end}") for end in "ab")
                for at in range(0, len(x), manifold.AT_ONCE):
                    sims = x[at : at + manifold.AT_ONCE] @ y.T
                    if same:
                        sims[np.arange(len(sims)), at + np.arange(len(sims))] = -np.inf
                    most = max(most, float(sims.max()))
        yield pa.RecordBatch.from_arrays([pa.array([most] if most > -np.inf else [], pa.float64())], ["c"])

    met = a.coalesce(1).crossJoin(b.repartition(max(1, -(-n // block))).hint("shuffle_replicate_nl")).where(mine)
    top = met.mapInArrow(largest, "c double").agg(rounded(F.max("c")).alias("max_cosine"))
    nodes = chosen.select(F.explode(F.array("u", "v")).alias("n")).agg(F.countDistinct("n").alias("nodes"))
    return mean.join(F.broadcast(top)).join(F.broadcast(nodes))  # one row each
