"""Nodes and edges of a graph as whole numbers, so that a pair is exchanged as eight bytes.

A node's number follows from its address (type, bucket, slot): the buckets of all types stand one
after another, and only where each begins, a row for some ``BUCKET`` nodes, is sent to tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from unpaired.functions.hashing import hash52
from unpaired.graph import Graph
from unpaired.tables import settle

BUCKET = 64
ANY = "*"


@dataclass(frozen=True)
class Numbers:
    """``nodes`` (id, kind, n): n from 0 without gaps, by (kind, bucket, slot). ``begin`` and ``size``: of the buckets of all kinds, one after another.

    A kind is the type, or ``ANY`` for all if the graph admits every pair. ``kinds`` has, by kind, the
    first of its buckets, how many it has and the slots of its fullest.
    """

    nodes: DataFrame
    begin: np.ndarray
    size: np.ndarray
    kinds: dict[str, tuple[int, int, int]]
    total: int


def slots(graph: Graph) -> DataFrame:
    """Each node's address (type, bucket, slot), and how many buckets its type has.

    Buckets hold about ``BUCKET`` nodes, so addresses come from many small windows.
    """
    nodes = graph.nodes if graph.admissible is not None else graph.nodes.select("id", F.lit(ANY).alias("type"))
    counted = nodes.groupBy("type").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / BUCKET)).cast("long").alias("buckets"))
    placed = nodes.join(F.broadcast(counted), "type").withColumn("bucket", hash52("slot", F.col("id")) % F.col("buckets"))
    own = W.Window.partitionBy("type", "bucket").orderBy("id")
    return placed.select("id", "type", "bucket", "buckets", (F.row_number().over(own) - 1).cast("long").alias("slot"))


def of(graph: Graph) -> Numbers:
    """The numbers of a graph's nodes; its edges aren't read."""
    found = graph.__dict__.get("_numbers")
    if found is None:
        own = settle(slots(graph), "slots")
        spark = own.sparkSession
        rows = own.groupBy("type", "bucket").agg(F.max("buckets").alias("buckets"), F.count(F.lit(1)).alias("size")).toArrow().sort_by([("type", "ascending"), ("bucket", "ascending")])
        kinds: dict[str, tuple[int, int, int]] = {}
        ats, total, begins = [], 0, []
        for kind, bucket, buckets, size in zip(*(rows[c].to_pylist() for c in ("type", "bucket", "buckets", "size")), strict=True):
            first, _, depth = kinds.get(kind) or (sum(k[1] for k in kinds.values()), 0, 0)
            kinds[kind] = (first, buckets, max(depth, size))
            ats.append(first + bucket)
            begins.append(total)
            total += size
        begin, size = (np.zeros(max(1, sum(k[1] for k in kinds.values())), np.int64) for _ in range(2))
        begin[ats], size[ats] = begins, rows["size"].to_numpy()
        table = pa.table({"type": rows["type"], "bucket": rows["bucket"], "begin": pa.array(begins, pa.int64())})
        buckets = spark.createDataFrame(table) if total else spark.createDataFrame([], "type string, bucket long, begin long")
        nodes = own.join(F.broadcast(buckets), ["type", "bucket"]).select("id", F.col("type").alias("kind"), (F.col("begin") + F.col("slot")).cast("int").alias("n"))
        found = Numbers(settle(nodes, "numbers"), begin, size, kinds, total)
        graph.__dict__["_numbers"] = found
    return found


def key(a: Column, b: Column) -> Column:
    """Two numbers in one."""
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))


def first_of(k: str = "key") -> Column:
    return F.shiftright(F.col(k), 32).cast("int")


def second_of(k: str = "key") -> Column:
    return F.col(k).bitwiseAND(0xFFFFFFFF).cast("int")


def edge_keys(graph: Graph) -> DataFrame:
    """(key) of all edges, the lower number first."""
    found = graph.__dict__.get("_edge_keys")
    if found is None:
        found = settle(numbered(graph, graph.edges, "inner").select(key(F.least("_u", "_v"), F.greatest("_u", "_v")).alias("key")), "edge-keys")
        graph.__dict__["_edge_keys"] = found
    return found


def numbered(graph: Graph, pairs: DataFrame, how: str = "left") -> DataFrame:
    """``pairs`` with the numbers ``_u``, ``_v`` of both ends."""
    own = of(graph).nodes
    for end in ("u", "v"):
        pairs = pairs.join(graph.sent(own.select(F.col("id").alias(end), F.col("n").alias(f"_{end}"))), end, how)
    return pairs


def named(graph: Graph, keys: DataFrame) -> DataFrame:
    """``keys`` with (u, v) for ``key``: within a kind the smaller id is u, else the kind that sorts first."""
    own, others = of(graph).nodes, [c for c in keys.columns if c != "key"]
    for end, n in (("a", first_of()), ("b", second_of())):
        keys = keys.join(graph.sent(own.select(F.col("n").alias(f"_n{end}"), F.col("id").alias(f"_{end}"), F.col("kind").alias(f"_k{end}"))), n == F.col(f"_n{end}"))
    turned = (F.col("_ka") == F.col("_kb")) & (F.col("_a") > F.col("_b"))
    return keys.select(F.when(turned, F.col("_b")).otherwise(F.col("_a")).alias("u"), F.when(turned, F.col("_a")).otherwise(F.col("_b")).alias("v"), *others)


def keyed(graph: Graph, keys: DataFrame) -> DataFrame:
    """:func:`named` of settled ``keys`` alone; steps that take numbers find them by :func:`keys_of`, so that no name is made for them."""
    out = named(graph, keys)
    graph.__dict__.setdefault("_keyed", []).append((out, keys))
    return out


def keys_of(graph: Graph, pairs: DataFrame) -> DataFrame | None:
    """The keys of a table made by :func:`keyed`, else None."""
    return next((keys for own, keys in graph.__dict__.get("_keyed", []) if own is pairs), None)


def graph_of_keys(own: Graph, edges: DataFrame) -> Graph:
    """The graph of the nodes of ``own``, with the settled keys ``edges`` as edges."""
    count = edges.count()
    graph = Graph(own.nodes, named(own, edges).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), own.admissible, own.name, own.meta)
    ends = edges.select(F.explode(F.array(first_of(), second_of())).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    degrees = of(own).nodes.join(ends, "n", "left").select("id", F.coalesce("k", F.lit(0)).alias("k")).join(own.nodes, "id").select("id", "type", "k")
    graph.__dict__.update({"_numbers": of(own), "_edge_keys": edges, "edge_count": count, "node_count": own.node_count, "degrees": settle(degrees, "degrees")})
    return graph
