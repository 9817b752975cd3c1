"""Neighbour sums over an adjacency that is small enough to send to every task.

A graph of up to ``PACKED_EDGES`` edges is packed into compressed rows of numbers and
broadcast; tasks then sum over the neighbours of their own pairs, and no row for each
(pair, neighbour) is made or exchanged. Larger graphs take the joins of
:mod:`unpaired.operators.topology`, with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unpaired.graph import Graph
from unpaired.tables import settle

#: Edges of the largest graph that is sent to tasks (8 bytes each, and 24 a node).
PACKED_EDGES = 5_000_000
#: Rows of a record batch of paths.
BATCH = 100_000
#: Starts of one task.
TASK_STARTS = 500


class Adjacency:
    """Neighbours of node i: ``to[begin[i] : begin[i + 1]]``."""

    def __init__(self, ids: pa.Array, u: np.ndarray, v: np.ndarray) -> None:
        n = len(ids)
        self.ids = ids
        a, b = np.concatenate([u, v]), np.concatenate([v, u])
        self.to = b[np.argsort(a, kind="stable")].astype(np.int32)
        self.degree = np.bincount(a, minlength=n)
        self.begin = np.concatenate([[0], np.cumsum(self.degree)])

    def neighbors(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours of all ``nodes``, one node after another, and how many each has."""
        count = self.degree[nodes]
        return self.to[np.repeat(self.begin[nodes] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))], count


class Sums:
    """Sums over common neighbours and over paths, for one start after another."""

    def __init__(self, graph: Adjacency, max_degree: int | None) -> None:
        self.graph = graph
        k = graph.degree.astype(np.float64)
        middle = graph.degree > 0 if max_degree is None else (graph.degree > 0) & (graph.degree <= max_degree)
        one = np.divide(1.0, k, out=np.zeros(len(k)), where=middle)
        #: What a node adds as a common neighbour, and its factor as a middle of a path.
        self.count, self.share, self.root = middle.astype(np.float64), one, np.sqrt(one)
        self.log = np.divide(1.0, np.log(np.maximum(k, 2)), out=np.zeros(len(k)), where=middle & (k > 1))
        self.near, self.walks = np.zeros(len(k), bool), np.zeros(len(k))

    def walk(self, start: int) -> np.ndarray:
        """Leaves in ``walks`` the weight of all walks of two steps by their end; returns the ends, with repeats."""
        first = self.graph.neighbors(np.array([start]))[0]
        ends, count = self.graph.neighbors(first)
        np.add.at(self.walks, ends, np.repeat(self.root[first], count) * self.root[ends])
        return ends

    def of_pairs(self, start: int, others: np.ndarray) -> np.ndarray:
        """Rows cn, ra, aa and l3 of the pairs of ``start`` and ``others``."""
        out = np.zeros((4, len(others)))
        ends = self.walk(start)
        own = self.graph.neighbors(np.array([start]))[0]
        self.near[own] = True
        met, count = self.graph.neighbors(others)
        has = np.flatnonzero(count)
        if len(has):
            at = (np.cumsum(count) - count)[has]
            near = self.near[met]
            for i, x in enumerate((near * self.count[met], near * self.share[met], near * self.log[met], self.walks[met])):
                out[i, has] = np.add.reduceat(x, at)
        self.near[own] = False
        self.walks[ends] = 0
        return out


    def of_edge(self, start: int, other: int) -> float:
        """l3 of the ends of an edge, without walks over the edge itself."""
        first = self.graph.neighbors(np.array([start]))[0]
        first = first[first != other]
        ends, count = self.graph.neighbors(first)
        np.add.at(self.walks, ends, np.repeat(self.root[first], count) * self.root[ends])
        own = self.graph.neighbors(np.array([other]))[0]
        l3 = float(self.walks[own[own != start]].sum())
        self.walks[ends] = 0
        return l3


@dataclass(frozen=True)
class Packed:
    """A packed adjacency, its broadcast, and the numbers (``_n``) of its nodes (``_id``)."""

    own: Adjacency
    shipped: Broadcast
    numbers: DataFrame


def adjacency(graph: Graph) -> Packed | None:
    """The packed adjacency of a graph, or None if it has no edges or more than ``PACKED_EDGES``."""
    found = graph.__dict__.get("_packed", False)
    if found is False:
        found = None
        if graph.edge_count <= PACKED_EDGES:
            ends = graph.adjacency.select(F.col("u").alias("id")).distinct().toArrow()["id"].combine_chunks()
            ids = ends.take(pc.sort_indices(ends))
            edges = graph.edges.select("u", "v").toArrow()
            number = lambda c: pc.index_in(edges[c].combine_chunks(), value_set=ids).to_numpy()
            found = Adjacency(ids, number("u"), number("v"))
            spark = graph.edges.sparkSession
            shipped = spark.sparkContext.broadcast(found)
            numbers = pa.table({"_id": ids, "_n": np.arange(len(ids), dtype=np.int32)})
            found = Packed(found, shipped, settle(spark.createDataFrame(numbers), "numbers")) if len(ids) else None
        graph.__dict__["_packed"] = found
    return found


def _numbered(packed: Packed, pairs: DataFrame) -> DataFrame:
    """(u, v) of ``pairs`` with the numbers of both ends; null for one without neighbours."""
    a, b = (packed.numbers.select(F.col("_id").alias(end), F.col("_n").alias(f"_{end}")) for end in ("u", "v"))
    return pairs.select("u", "v").join(a, "u", "left").join(b, "v", "left").select("u", "v", "_u", "_v")


def sums_of_edges(packed: Packed, edges: DataFrame) -> DataFrame:
    """(u, v, l3) of edges, without walks over the edge itself."""
    shipped = packed.shipped

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(shipped.value, None)
        for batch in batches:
            l3 = [sums.of_edge(u, v) for u, v in zip(batch.column("_u").to_pylist(), batch.column("_v").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(l3, pa.float64())], ["u", "v", "l3"])

    return _numbered(packed, edges).mapInArrow(work, "u string, v string, l3 double")


def sums_of_pairs(packed: Packed, pairs: DataFrame, max_degree: int | None = None) -> DataFrame:
    """(u, v, cn, ra, aa, l3) of ``pairs``; 0 where there is none."""
    shipped, numbered = packed.shipped, _numbered(packed, pairs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(shipped.value, max_degree)
        for batch in batches:
            u, v = (batch.column(c).fill_null(-1).to_numpy() for c in ("_u", "_v"))
            out = np.zeros((4, len(u)))
            rows = np.flatnonzero((u >= 0) & (v >= 0))  # the others have no neighbours
            rows = rows[np.argsort(u[rows], kind="stable")]
            cuts = np.flatnonzero(np.diff(u[rows], prepend=-1, append=-1))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                out[:, rows[i:j]] = sums.of_pairs(int(u[rows[i]]), v[rows[i:j]])
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(out[0].astype(np.int64)), *map(pa.array, out[1:])], ["u", "v", "cn", "ra", "aa", "l3"])

    # pairs of one start lie together, and a start with many of them in several tasks
    ordered = numbered.repartitionByRange("_u", "v").sortWithinPartitions("_u")
    return ordered.mapInArrow(work, "u string, v string, cn long, ra double, aa double, l3 double")


def all_path_sums(packed: Packed, graph: Graph) -> DataFrame:
    """(u, v, l3) of every non-edge u < v with a path of length 3, each from its end of higher rank."""
    shipped, own = packed.shipped, packed.own
    n = len(own.ids)
    order = np.argsort(own.degree, kind="stable")  # ids are sorted, so ties go by id
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    lowest = rank
    for _ in range(3):  # the lowest rank that walks of 1, 2, 3 steps lead to
        lowest = np.minimum.reduceat(lowest[own.to], own.begin[:-1])
    starts = np.flatnonzero(lowest < rank)
    spark = graph.edges.sparkSession
    table = spark.createDataFrame(pa.table({"start": pa.array(starts, pa.int32())})) if len(starts) else spark.createDataFrame([], "start int")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-len(starts) // TASK_STARTS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        sums, total = Sums(own, None), np.zeros(len(own.ids))
        order = np.argsort(own.degree, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            size = 0
            for start in batch.column(0).to_numpy().tolist():
                ends = np.unique(sums.walk(start))
                met, count = own.neighbors(ends)
                np.add.at(total, met, np.repeat(sums.walks[ends], count))
                sums.walks[ends] = 0
                others = np.unique(met) if len(met) < len(total) else np.flatnonzero(total)
                l3 = total[others]
                total[others] = 0
                good = (rank[others] < rank[start]) & (l3 > 0)
                good &= ~np.isin(others, own.neighbors(np.array([start]))[0])
                found.append((np.minimum(others[good], start), np.maximum(others[good], start), l3[good]))
                size += int(good.sum())
                if size >= BATCH:
                    yield _batch(own, found)
                    found, size = [], 0
            if found:
                yield _batch(own, found)

    return table.repartition(parts, "start").mapInArrow(work, "u string, v string, l3 double")


def _batch(own: Adjacency, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    u, v, l3 = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([own.ids.take(pa.array(u)), own.ids.take(pa.array(v)), pa.array(l3)], ["u", "v", "l3"])
