"""Typed interaction graphs as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unpaired.tables import settle

Types = tuple[str, str]
#: Up to so many nodes, a table of a row for each is sent to every task where pairs are joined with it.
SENT_NODES = 2_000_000


def canonical(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """Distinct unordered pairs ``u < v``; self-pairs and nulls go."""
    return edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def same_pair(a: str = "u", b: str = "v"):
    """Join condition: the unordered pair (a, b) is (``_lo``, ``_hi``)."""
    return (F.least(a, b) == F.col("_lo")) & (F.greatest(a, b) == F.col("_hi"))


def unordered(pairs: DataFrame) -> DataFrame:
    """(``_lo``, ``_hi``) of pairs, whichever way round they are."""
    return pairs.select(F.least("u", "v").alias("_lo"), F.greatest("u", "v").alias("_hi"))


def excluding(pairs: DataFrame, *others: DataFrame) -> DataFrame:
    """``pairs`` without those that occur in ``others``, whichever way round."""
    for other in others:
        pairs = pairs.join(unordered(other), same_pair(), "left_anti")
    return pairs


@dataclass(frozen=True)
class Graph:
    """``nodes`` (id, type), ``edges`` (u < v, distinct) and the admissible type pairs.

    ``admissible`` is part of the schema (a handful of pairs), so it is Python data;
    ``None`` admits every pair.
    """

    nodes: DataFrame
    edges: DataFrame
    admissible: tuple[Types, ...] | None = None
    name: str = "graph"
    meta: dict = field(default_factory=dict)

    @classmethod
    def from_edges(cls, edges: DataFrame, nodes: DataFrame, admissible: list[Types] | None = None, name: str = "graph", meta: dict | None = None) -> Graph:
        """Duplicates collapse, isolated nodes stay, edges to unknown nodes go."""
        nodes = nodes.select("id", "type").dropDuplicates(["id"])
        known = nodes.select("id")
        own = canonical(edges).join(known.withColumnRenamed("id", "u"), "u", "left_semi").join(known.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v")
        pairs = None if admissible is None else tuple(sorted({tuple(sorted(p)) for p in admissible}))
        return cls(nodes, own, pairs, name, meta or {})

    def settled(self) -> Graph:
        """The graph with its tables settled, for the many joins that read them; one made from settled keys is as it is."""
        if "_edge_keys" in self.__dict__ and "degrees" in self.__dict__:
            return self
        own = Graph(settle(self.nodes, "nodes"), settle(self.edges, "edges"), self.admissible, self.name, self.meta)
        own.__dict__["degrees"] = settle(own.degrees, "degrees")
        return own

    @cached_property
    def adjacency(self) -> DataFrame:
        """Both directions of every edge: (u, v)."""
        return self.edges.select("u", "v").union(self.edges.select("v", "u"))

    @cached_property
    def degrees(self) -> DataFrame:
        """(id, type, k); isolated nodes have degree 0."""
        counted = self.adjacency.groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("k"))
        return self.nodes.join(counted, "id", "left").select("id", "type", F.coalesce("k", F.lit(0)).alias("k"))

    @cached_property
    def node_count(self) -> int:
        return self.nodes.count()

    @cached_property
    def edge_count(self) -> int:
        return self.edges.count()

    def sent(self, table: DataFrame) -> DataFrame:
        """A table of at most a row for each node, hinted for joins with pairs: sent whole to tasks up to ``SENT_NODES`` nodes, else merged."""
        return table.hint("broadcast" if self.node_count <= SENT_NODES else "merge")

    def is_admissible(self, a: str, b: str):
        """Predicate on two type columns."""
        if self.admissible is None:
            return F.lit(True)
        low, high = F.least(a, b), F.greatest(a, b)
        out = F.lit(False)
        for s, t in self.admissible:
            out = out | ((low == s) & (high == t))
        return out

    def type_pairs(self) -> list[Types | None]:
        return [None] if self.admissible is None else list(self.admissible)

    def positives(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are edges."""
        return pairs.join(unordered(self.edges), same_pair(), "left_semi")

    def oriented(self, pairs: DataFrame) -> DataFrame:
        """(u, v) of ``pairs`` as candidates have them: the type that sorts first is u, within a type the smaller id."""
        a, b = (self.nodes.select(F.col("id").alias(end), F.col("type").alias(f"_{end}")) for end in ("u", "v"))
        typed = pairs.select("u", "v").join(a, "u").join(b, "v")
        turned = (F.col("_u") > F.col("_v")) | ((F.col("_u") == F.col("_v")) & (F.col("u") > F.col("v")))
        return typed.select(F.when(turned, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(turned, F.col("u")).otherwise(F.col("v")).alias("v"))

    def nodes_of_type(self, kind: str) -> DataFrame:
        return self.nodes.where(F.col("type") == kind)

    def summary(self) -> DataFrame:
        """Long table (what, n): nodes, edges, and nodes of each type."""
        count = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
        kinds = self.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("type:"), "type").alias("what"), "n")
        return count(self.nodes, "nodes").union(count(self.edges, "edges")).union(kinds)
