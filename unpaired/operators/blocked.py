"""Neighbour sums of pairs over a graph that is too large to send to every task.

Nodes are numbered. The adjacency lies in cells: one wide row has some middles y, their neighbours,
ids and types. The starts u of pairs are dealt the same way; a chunk has some starts with their
neighbours and pairs. A task takes its chunks past all cells in a cross join, sums over the paths
u-x-y-v and the common neighbours y of one cell after another, and finds id and degree of v in the
cell that holds it. No row for each (pair, neighbour) or (start, end of a walk) is made, a pair is
exchanged once, as eight bytes, and nothing is joined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unpaired.graph import Graph
from unpaired.operators import numbers
from unpaired.tables import settle

#: Neighbours in a cell, and pairs in a chunk (some 100 bytes each).
ENTRIES = 4_000_000
PAIRS = 2_000_000
#: Chunks for each core, unless they have fewer pairs than that; chunks that are made at once.
CHUNKS_A_CORE = 4
FEWEST_PAIRS = 100_000
GROUPED = 4
#: Steps that a task takes at once, and cells of its table of walks.
STEPS = 1_000_000
CELLS = 4_000_000
#: Rows of a record batch.
BATCH = 100_000

CELL = "c int, ys binary, xs binary, counts binary, at binary, ids array<string>, types array<string>"
CHUNK = "g int, starts binary, n_near binary, near binary, n_pairs binary, others binary, own_ids array<string>, own_types array<string>"
SUMS = "u string, v string, t_u string, t_v string, k_u long, k_v long, cn long, ra double, aa double, l3 double"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(x, np.int32).tobytes()], pa.binary())


def _one(x: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays([0, len(x)], x)


def _flat(x: pa.ChunkedArray) -> pa.Array:
    out = x.combine_chunks()
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def _cell(ends: pa.Table, nodes: pa.Table) -> pa.Table:
    """One row: the middles y with ids and types, and for each neighbour x of any how many of them it has and where they are among ``ys``."""
    if not nodes.num_rows:
        return pa.table({n: pa.array([], t) for n, t in zip(_names(CELL), [pa.int32(), *[pa.binary()] * 4, *[pa.list_(pa.string())] * 2], strict=True)})
    nodes = nodes.sort_by("n")
    ys, keys = nodes["n"].to_numpy(), ends["key"].to_numpy()
    at, x = np.searchsorted(ys, keys >> 32), keys & 0xFFFFFFFF
    order = np.lexsort((at, x))
    xs, counts = np.unique(x[order], return_counts=True)
    return pa.table(dict(zip(_names(CELL), [nodes["c"][:1].combine_chunks(), *map(_packed, (ys, xs, counts, at[order])), _one(_flat(nodes["id"])), _one(_flat(nodes["type"]))], strict=True)))


def _chunks(pairs: pa.Table, cells: pa.Table, once: bool, apart: bool, stride: int, parts: int) -> pa.Table:
    """:func:`_chunk` of up to ``parts`` shares of the starts of one cell, which have numbers that differ by multiples of ``stride``."""
    if not pairs.num_rows or not cells.num_rows:
        return _chunk(pairs, cells, once, apart, 0)
    g = pairs["g"][0].as_py() * parts
    of = (pairs["key"].to_numpy() >> 32) // stride % parts
    return pa.concat_tables([_chunk(pairs.filter(pa.array(of == i)), cells, once, apart, g + i) for i in np.unique(of).tolist()])


def _chunk(pairs: pa.Table, cells: pa.Table, once: bool, apart: bool, number: int) -> pa.Table:
    """One row: its ``number``, starts, their neighbours, and the other ends of their pairs.

    ``once`` drops repeats. ``apart`` makes each pair a start of its own, whose neighbours leave the other end out.
    """
    if not pairs.num_rows or not cells.num_rows:
        return pa.table({n: pa.array([], t) for n, t in zip(_names(CHUNK), [pa.int32(), *[pa.binary()] * 5, *[pa.list_(pa.string())] * 2], strict=True)})
    key = pairs["key"].to_numpy()
    key = np.unique(key) if once else np.sort(key)
    u, v = key >> 32, key & 0xFFFFFFFF
    starts, n_pairs = (u, np.ones(len(u), np.int64)) if apart else np.unique(u, return_counts=True)
    ys, xs, counts, at = (np.frombuffer(cells[c][0].as_buffer(), np.int32) for c in ("ys", "xs", "counts", "at"))
    order = np.argsort(at, kind="stable")
    to, degree = np.repeat(xs, counts)[order], np.bincount(at, minlength=len(ys))
    place = np.searchsorted(ys, starts)
    n_near = degree[place]
    near = to[_spread((np.cumsum(degree) - degree)[place], n_near)]
    if apart:
        kept = near != np.repeat(v, n_near)
        near, n_near = near[kept], np.bincount(np.repeat(np.arange(len(starts)), n_near)[kept], minlength=len(starts))
    ids, types = (cells[c][0].values.take(pa.array(place)) for c in ("ids", "types"))
    return pa.table(dict(zip(_names(CHUNK), [pa.array([number], pa.int32()), *map(_packed, (starts, n_near, near, n_pairs, v)), _one(ids), _one(types)], strict=True)))


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... for ``count[i]`` places, one i after another."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class _Middles:
    """A cell made ready: where the middles next to a node lie, and what each adds."""

    def __init__(self, row: dict[str, np.ndarray], n: int, max_degree: int | None) -> None:
        self.ys, self.at = row["ys"], row["at"]
        self.count = np.zeros(n, np.int32)
        self.count[row["xs"]] = row["counts"]
        self.begin = np.zeros(n, np.int64)
        self.begin[row["xs"]] = np.cumsum(row["counts"], dtype=np.int64) - row["counts"]
        self.place = np.full(n, -1, np.int32)
        self.place[self.ys] = np.arange(len(self.ys), dtype=np.int32)
        k = np.bincount(self.at, minlength=len(self.ys)).astype(np.float64)  # a cell has all neighbours of its middles
        middle = k > 0 if max_degree is None else k <= max_degree
        self.one = middle.astype(np.float64)
        self.share = self.one / np.maximum(k, 1)
        self.root = np.sqrt(self.share)
        self.log = np.divide(1.0, np.log(np.maximum(k, 2)), out=np.zeros(len(k)), where=middle & (k > 1))

    def sums(self, chunk: dict[str, np.ndarray], degrees: np.ndarray, max_degree: int | None, apart: bool) -> Iterator[tuple[np.ndarray, ...]]:
        """Places of the chunk's pairs that have anything to sum here, with cn, ra, aa and l3."""
        near, others, starts = chunk["near"], chunk["others"], chunk["starts"]
        k = degrees[near].astype(np.float64)
        root = np.sqrt(1 / k) if max_degree is None else np.where(k <= max_degree, np.sqrt(1 / k), 0.0)
        n_near, n_pairs = (chunk[c].astype(np.int64) for c in ("n_near", "n_pairs"))
        ends_near, ends_pairs = (np.concatenate([[0], np.cumsum(x)]) for x in (n_near, n_pairs))
        # work of each start: walks to middles, and middles next to the other ends
        work = np.concatenate([[0], np.cumsum(self.count[near], dtype=np.int64)])[ends_near] + np.concatenate([[0], np.cumsum(self.count[others], dtype=np.int64)])[ends_pairs]
        width = len(self.ys)
        rows = max(1, CELLS // width)
        walks, met = np.zeros(rows * width), np.zeros(rows * width, bool)
        i = 0
        while i < len(n_near):
            j = min(i + rows, max(i + 1, int(np.searchsorted(work, work[i] + STEPS, "right")) - 1), len(n_near))
            x, r = near[ends_near[i] : ends_near[j]], root[ends_near[i] : ends_near[j]]
            base = np.repeat(np.arange(j - i) * width, n_near[i:j])
            count = self.count[x]
            y = self.at[_spread(self.begin[x], count)]
            cells = np.repeat(base, count) + y
            np.add.at(walks, cells, np.repeat(r, count) * self.root[y])
            if apart:  # no walk back to its start
                back = self.place[starts[i:j]]
                walks[(np.arange(j - i) * width + back)[back >= 0]] = 0
            here = self.place[x] >= 0
            own = base[here] + self.place[x][here]
            met[own] = True
            v = others[ends_pairs[i] : ends_pairs[j]]
            count = self.count[v]
            has = np.flatnonzero(count)
            if len(has):
                start, first_pair = np.repeat(np.arange(i, j), n_pairs[i:j])[has], ends_pairs[i]
                v, count = v[has], count[has]
                y = self.at[_spread(self.begin[v], count)]
                at = np.repeat((start - i) * width, count) + y
                first = np.cumsum(count) - count
                l3 = np.add.reduceat(walks[at], first)
                common = np.flatnonzero(met[at])  # few
                pair, y = np.searchsorted(first, common, "right") - 1, y[common]
                cn, ra, aa = (np.bincount(pair, w[y], len(first)) for w in (self.one, self.share, self.log))
                good = np.flatnonzero((l3 > 0) | (cn > 0))
                if len(good):
                    yield first_pair + has[good], cn[good], ra[good], aa[good], l3[good]
            walks[cells] = 0
            met[own] = False
            i = j


class _Sums:
    """The pairs of a chunk with what the cells so far have added."""

    def __init__(self, chunk: dict[str, np.ndarray], ids: pa.Array, types: pa.Array) -> None:
        self.chunk, self.ids, self.types = chunk, ids, types
        self.out = np.zeros((4, len(chunk["others"])))
        self.found: list[tuple[np.ndarray, pa.Array, pa.Array]] = []

    def add(self, cell: _Middles, ids: pa.Array, types: pa.Array, degrees: np.ndarray, max_degree: int | None, apart: bool) -> None:
        for at, *got in cell.sums(self.chunk, degrees, max_degree, apart):
            for i, x in enumerate(got):
                self.out[i, at] += x
        place = cell.place[self.chunk["others"]]
        here = np.flatnonzero(place >= 0)
        self.found.append((here, ids.take(pa.array(place[here])), types.take(pa.array(place[here]))))

    def batches(self, degrees: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = pa.array(np.argsort(np.concatenate([x[0] for x in self.found])))
        v, t_v = (pa.concat_arrays([x[i] for x in self.found]).take(order) for i in (1, 2))
        start = np.repeat(np.arange(len(self.chunk["starts"])), self.chunk["n_pairs"])
        for i in range(0, len(start), BATCH):
            own = pa.array(start[i : i + BATCH])
            k_u, k_v = (degrees[x[i : i + BATCH]].astype(np.int64) for x in (self.chunk["starts"][start], self.chunk["others"]))
            cn, *sums = self.out[:, i : i + BATCH]
            yield pa.RecordBatch.from_arrays([self.ids.take(own), v[i : i + BATCH], self.types.take(own), t_v[i : i + BATCH], *map(pa.array, (k_u, k_v, cn.astype(np.int64), *sums))], _names(SUMS))


def degrees(graph: Graph) -> np.ndarray:
    """The degrees of a graph's nodes by number."""
    found = graph.__dict__.get("_degrees_by_number")
    if found is None:
        own = numbers.of(graph)
        found = np.zeros(own.total, np.int32)
        for row in graph.degrees.join(graph.sent(own.nodes.select("id", "n")), "id").select("n", F.col("k").cast("int").alias("k")).toArrow().to_batches():
            found[row.column(0).to_numpy()] = row.column(1).to_numpy()
        graph.__dict__["_degrees_by_number"] = found
    return found


def cells(graph: Graph) -> tuple[DataFrame, int, np.ndarray]:
    """The cells of a graph, how many there are, and its degrees by number (4 bytes a node, sent to tasks)."""
    found = graph.__dict__.get("_cells")
    if found is None:
        own, edges = numbers.of(graph), numbers.edge_keys(graph)
        n = max(1, -(-2 * graph.edge_count // ENTRIES))
        ends = edges.unionByName(edges.select(numbers.key(numbers.second_of(), numbers.first_of()).alias("key")))
        nodes = own.nodes.join(graph.nodes.select("id", "type"), "id").select("n", "id", "type", (F.col("n") % n).alias("c"))
        ends = ends.select("key", (numbers.first_of() % n).alias("c"))
        made = ends.groupBy("c").cogroup(nodes.groupBy("c")).applyInArrow(_cell, CELL)
        made = settle(made, "cells", maxRecordsPerFile=1)
        found = made, n, degrees(graph)
        graph.__dict__["_cells"] = found
    return found


def of_pairs(graph: Graph, pairs: DataFrame, max_degree: int | None = None, once: bool = False, apart: bool = False) -> DataFrame:
    """(u, v, t_u, t_v, k_u, k_v, cn, ra, aa, l3) of the ``pairs`` of known nodes, each way round as given; 0 where there is no sum.

    ``once`` drops repeats; with ``apart`` no path goes over the pair itself, for pairs that are edges.
    """
    made, n, by_number = cells(graph)
    spark = made.sparkSession
    known = keys = numbers.keys_of(graph, pairs)
    if keys is None:
        known = numbers.numbered(graph, pairs.select("u", "v"), "inner").select(numbers.key(F.col("_u"), F.col("_v")).alias("key"))
    size = (pairs if keys is None else keys).count() * (1 if not apart else 1 + 2 * graph.edge_count // max(graph.node_count, 1))
    spread = min(CHUNKS_A_CORE * spark.sparkContext.defaultParallelism, -(-size // FEWEST_PAIRS))
    times = max(1, -(-size // (n * GROUPED * PAIRS)))  # groups that share the starts of a cell, and chunks of a group
    parts = max(1, -(-size // (n * times * PAIRS)), -(-spread // (n * times)))
    left = known.select("key", (numbers.first_of() % (n * times)).alias("g")).repartition(n * times, "g")
    copies = made.withColumn("g", F.explode(F.array(*[F.col("c") + n * i for i in range(times)]))).repartition(n * times, "g")
    chunks = left.groupBy("g").cogroup(copies.groupBy("g")).applyInArrow(lambda p, c: _chunks(p, c, once, apart, n * times, parts), CHUNK)
    chunks = chunks.repartitionById(n * times * parts, F.col("g")).drop("g")  # one for each task, which holds it
    total, sent = len(by_number), spark.sparkContext.broadcast(by_number)
    of_cell, of_chunk = ("ys", "xs", "counts", "at"), _names(CHUNK)[1:6]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, middles, degrees = None, None, sent.value
        held: dict[tuple[int, int], _Sums] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = lambda names: {c: np.frombuffer(batch.column(c)[i].as_buffer(), np.int32) for c in names}  # noqa: E731, B023
                listed = lambda c: batch.column(c)[i].values  # noqa: E731, B023
                cell, chunk = row(of_cell), row(of_chunk)
                if name != int(cell["ys"][0]):  # cells share no middle
                    name, middles = int(cell["ys"][0]), _Middles({c: x.copy() for c, x in cell.items()}, total, max_degree)
                of = (int(chunk["starts"][0]), int(chunk["others"][0]))
                if of not in held:
                    copied = [pa.concat_arrays([listed(c), pa.array([], pa.string())]) for c in ("own_ids", "own_types")]
                    held[of] = _Sums({c: x.copy() for c, x in chunk.items()}, *copied)
                held[of].add(middles, listed("ids"), listed("types"), degrees, max_degree, apart)
        for own in held.values():
            yield from own.batches(degrees)

    out = made.drop("c").coalesce(1).crossJoin(chunks.hint("shuffle_replicate_nl")).mapInArrow(work, SUMS)
    return out if keys is None else _turned(graph, out)


def _turned(graph: Graph, out: DataFrame) -> DataFrame:
    """Pairs of keys as :func:`numbers.named` has them: within a kind the smaller id is u."""
    turned = F.col("u") > F.col("v")
    if graph.admissible is not None:
        turned &= F.col("t_u") == F.col("t_v")
    swap = lambda c, d: F.when(turned, F.col(d)).otherwise(F.col(c)).alias(c)
    ends = [swap(f"{c}{a}", f"{c}{b}") for c in ("", "t_", "k_") for a, b in ("uv", "vu")]
    return out.select(*ends, "cn", "ra", "aa", "l3")


def sums_of_pairs(graph: Graph, pairs: DataFrame, max_degree: int | None = None) -> DataFrame:
    """(u, v, cn, ra, aa, l3) of the ``pairs`` that have a common neighbour or a path of length 3."""
    return of_pairs(graph, pairs, max_degree, once=True).where("cn > 0 or l3 > 0").select("u", "v", "cn", "ra", "aa", "l3")
