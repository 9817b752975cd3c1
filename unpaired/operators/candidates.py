"""Candidate non-edges: enumerated where few pairs are admissible, sampled elsewhere."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unpaired.functions.hashing import hash52, hash52_of
from unpaired.graph import Graph, Types, excluding
from unpaired.operators import numbers
from unpaired.operators.ranking import FEW, first, smallest
from unpaired.tables import settle

MAX_POOL = 200_000
#: Above this many admissible pairs (or twice the pool), pairs are drawn, not listed.
ENUMERATE_MAX = 1_000_000
#: Pairs that one task lists, and the sample size that one task still sorts.
CELL_PAIRS = 2_000_000
LARGE_SAMPLE = FEW
#: Attempts of a task that draws.
TASK_ATTEMPTS = 5_000_000


def type_counts(graph: Graph) -> DataFrame:
    return graph.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def admissible_sizes(graph: Graph) -> DataFrame:
    """(t1, t2, pairs) of each admissible type pair; ('*', '*') if all are admitted."""
    counts = type_counts(graph)
    if graph.admissible is None:
        n = F.coalesce(F.sum("n"), F.lit(0))
        return counts.agg((F.floor(n * (n - 1) / 2)).cast("long").alias("pairs")).select(F.lit("*").alias("t1"), F.lit("*").alias("t2"), "pairs")
    pairs = graph.nodes.sparkSession.createDataFrame(list(graph.admissible), "t1 string, t2 string")
    a, b = counts.select(F.col("type").alias("t1"), F.col("n").alias("n1")), counts.select(F.col("type").alias("t2"), F.col("n").alias("n2"))
    own = pairs.join(a, "t1", "left").join(b, "t2", "left").na.fill(0, ["n1", "n2"])
    same = F.floor(F.col("n1") * (F.col("n1") - 1) / 2).cast("long")
    return own.select("t1", "t2", F.when(F.col("t1") == F.col("t2"), same).otherwise(F.col("n1") * F.col("n2")).alias("pairs"))


def non_edges(graph: Graph, pairs: DataFrame) -> DataFrame:
    """``pairs`` without the graph's edges."""
    return excluding(pairs, graph.edges)


def enumerate_pairs(graph: Graph) -> DataFrame:
    """All admissible pairs (u, v), u of the type that sorts first.

    The result is as large as that, so ask for it behind a count, or where the whole
    complement is wanted. Each type pair is listed from the nodes of its two types alone:
    the second side is dealt to cells of about ``CELL_PAIRS`` pairs and the first is
    copied to each, so no side is broadcast and no task lists more than its cell.
    """
    counts = {r["type"]: r["n"] for r in type_counts(graph).collect()}  # a handful of types
    out = None
    for pair in graph.type_pairs():
        kind = lambda t: graph.nodes if t is None else graph.nodes.where(F.col("type") == t)
        first, second = pair or (None, None)
        size = lambda t: sum(counts.values()) if t is None else counts.get(t, 0)
        cells = max(16, -(-size(first) * size(second) // CELL_PAIRS))
        a = kind(first).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("_cell"))
        b = kind(second).select(F.col("id").alias("v"), F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int").alias("_cell"))
        listed = a.join(b.hint("shuffle_hash"), "_cell")
        listed = (listed.where("u < v") if first == second else listed).select("u", "v")
        out = listed if out is None else out.unionByName(listed)
    return out


def hash_sample(pairs: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` pairs of the smallest hash: uniform, without replacement, repeatable."""
    if n > LARGE_SAMPLE:
        pairs = settle(pairs, "sampled")
    return smallest(pairs, n, hash52(seed, F.col("u"), F.col("v")), 1 << 52, "u", "v", few=LARGE_SAMPLE)


def _slots(graph: Graph) -> DataFrame:
    return numbers.slots(graph)


def rejection_sample(graph: Graph, n: int, seed: int = 0) -> DataFrame:
    """``n`` distinct admissible non-edges at most, drawn by hash.

    An attempt draws a type pair, then an address for each end; an address without a
    node, a self-pair, an edge or a repeat is rejected. Attempts: as many as should give
    ``n``, then 4 n + 1000, and 20 n + 1000 where those don't suffice; the first ``n`` that
    succeed are the same. A warning tells if fewer than ``n`` were found.
    """
    most = 20 * n + 1000
    for attempts in sorted({min(_attempts(graph, n), most), 4 * n + 1000, most}):
        drawn = settle(_drawn_keys(graph, seed, attempts), "drawn")
        if (found := drawn.count()) >= n:
            break
    else:
        warnings.warn(f"{found} of {n} pairs drawn: the graph leaves too few, enumerate them instead", stacklevel=2)
    return numbers.keyed(graph, settle(smallest(drawn, n, "attempt", attempts).select("key"), "pool"))


def _attempts(graph: Graph, n: int) -> int:
    """How many attempts should give ``n`` different non-edges, with a margin.

    An attempt meets two nodes by the share of filled addresses, and then each admissible
    pair alike; type pairs of different sizes make this an estimate.
    """
    own = numbers.of(graph)
    filled = own.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()  # a handful of types
    share = {r["kind"]: r["n"] / (own.kinds[r["kind"]][1] * own.kinds[r["kind"]][2]) for r in filled}
    kinds = _kinds(graph)
    both = sum(share.get(a, 0.0) * share.get(b, 0.0) for a, b in kinds) / max(len(kinds), 1)
    pairs = admissible_sizes(graph).agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
    free = pairs - graph.edge_count
    if both == 0 or free <= n:
        return 20 * n + 1000
    return int(1.02 * pairs / both * math.log(free / (free - n))) + 1000


def _kinds(graph: Graph) -> list[Types]:
    return [p or (numbers.ANY, numbers.ANY) for p in graph.type_pairs()]


def _drawn_keys(graph: Graph, seed: int, attempts: int) -> DataFrame:
    """(key, attempt): the non-edges that so many attempts give, in numbers, each with its first attempt.

    An address leads to its node by where its bucket begins, so attempts are exchanged once, as
    numbers, to meet the edges and their repeats.
    """
    own, kinds, spark = numbers.of(graph), _kinds(graph), graph.nodes.sparkSession
    # of each type pair, by end: where the buckets of the type begin (-1: none), how many, and their slots
    addresses = np.array([[own.kinds.get(t, (-1, 1, 1)) for t in pair] for pair in kinds], np.int64)
    sent = spark.sparkContext.broadcast((own.begin, own.size))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, size = sent.value
        for batch in batches:
            attempt = batch.column(0).to_numpy()
            draw = lambda what, limit: hash52_of(f"{seed}:{what}", attempt) % limit  # noqa: E731, B023
            kind = draw("t", len(kinds)) if len(kinds) > 1 else np.zeros(len(attempt), np.int64)  # one type pair needs no draw
            ends, good = [], np.ones(len(attempt), bool)
            for i, end in enumerate("uv"):
                first, buckets, depth = addresses[kind, i].T
                at, slot = first + draw(end + "b", buckets), draw(end + "s", depth)
                good &= (first >= 0) & (slot < size[at])
                ends.append(begin[at] + slot)
            good &= ends[0] != ends[1]
            low, high = np.minimum(*ends)[good], np.maximum(*ends)[good]
            yield pa.RecordBatch.from_arrays([pa.array(low << 32 | high), pa.array(attempt[good])], ["key", "attempt"])

    parts = max(spark.sparkContext.defaultParallelism, -(-attempts // TASK_ATTEMPTS))
    tried = spark.range(0, attempts if own.total else 0, 1, parts).mapInArrow(work, "key long, attempt long")
    met = tried.unionByName(numbers.edge_keys(graph).select("key", F.lit(-1).cast("long").alias("attempt")))
    return met.groupBy("key").agg(F.min("attempt").alias("attempt")).where("attempt >= 0")


def _draw(graph: Graph, slots: DataFrame, seed: int, attempts: int) -> DataFrame:
    """(u, v, attempt) of :func:`_drawn_keys`; ``slots`` are the graph's own."""
    return numbers.named(graph, _drawn_keys(graph, seed, attempts))


def generate_candidates(graph: Graph, max_pool: int | None = MAX_POOL, seed: int = 0) -> DataFrame:
    """The candidate pool: the complement if it is small, else a sample of ``max_pool``.

    With ``max_pool`` None the whole complement, whatever its size.
    """
    if max_pool is None:
        return settle(non_edges(graph, enumerate_pairs(graph)), "pool")
    size = admissible_sizes(graph).agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
    if size > max(ENUMERATE_MAX, 2 * max_pool):
        return rejection_sample(graph, max_pool, seed)
    pool = non_edges(graph, enumerate_pairs(graph))
    return settle(pool if size <= max_pool else hash_sample(pool, max_pool, seed), "pool")


def topology_hard_nonedges(pairs: DataFrame, common: str, n: int) -> DataFrame:
    """The ``n`` pairs with the most common neighbours, of those with any."""
    return first(pairs.where(F.col(common) > 0), n, F.desc(common), "u", "v")
