"""Graphs and fixtures over the driver's tables.

``supply`` joins parts to suppliers (two types), ``coorder`` joins parts of one order
(one type, so pairs have common neighbours). ``supply`` takes every returned line item;
the other return flags are its known positives. ``coorder`` takes every line item; an
order has a bounded number of lines, so pairs of one order stay few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unpaired.graph import SENT_NODES, Graph
from unpaired.operators import numbers
from unpaired.tables import settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(key("P", "p_partkey").alias("id"), F.lit("part").alias("type"))


def supply_pairs(spark: SparkSession, sf_dir: str, returned: str | None = "R") -> DataFrame:
    """Distinct part-supplier pairs (u, v) of all line items with a return flag (None: of any)."""
    lines = table(spark, sf_dir, "lineitem")
    lines = lines if returned is None else lines.where(F.col("l_returnflag") == returned)
    return lines.select(key("P", "l_partkey").alias("u"), key("S", "l_suppkey").alias("v")).distinct()


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    suppliers = table(spark, sf_dir, "supplier").select(key("S", "s_suppkey").alias("id"), F.lit("supplier").alias("type"))
    return Graph.from_edges(supply_pairs(spark, sf_dir), parts(spark, sf_dir).unionByName(suppliers), [("part", "supplier")], "supply").settled()


def coorder(spark: SparkSession, sf_dir: str) -> Graph:
    """Its pairs are found and told apart as numbers; they get their ids where those are asked for."""
    kinds = [("part", "part")]
    nodes = settle(parts(spark, sf_dir).dropDuplicates(["id"]), "nodes")
    own = Graph(nodes, spark.createDataFrame([], "u string, v string"), tuple(kinds), "coorder")
    known = own.sent(numbers.of(own).nodes.select(F.col("id").alias("p"), "n"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", key("P", "l_partkey").alias("p")).join(known, "p").select("l_orderkey", "n")
    pairs = lines.alias("a").join(lines.alias("b"), "l_orderkey").where("a.n < b.n").select(numbers.key(F.col("a.n"), F.col("b.n")).alias("key"))
    return numbers.graph_of_keys(own, settle(pairs.distinct(), "edge-keys"))


def embedded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v) of the edges of :func:`coorder` both of whose parts have a vector, settled; lines of other parts go before pairs are made."""
    owned = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"))
    vectors = table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("l_partkey"))
    known = settle(vectors.join(owned, "l_partkey", "left_semi").distinct(), "embedded")
    known = known.hint("broadcast" if known.count() <= SENT_NODES else "merge")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(known, "l_partkey", "left_semi")
    a, b = (lines.select("l_orderkey", F.col("l_partkey").alias(end)) for end in ("a", "b"))
    pairs = a.join(b, "l_orderkey").where(key("P", "a") < key("P", "b")).select("a", "b").distinct()
    return settle(pairs.select(key("P", "a").alias("u"), key("P", "b").alias("v")), "known")


def part_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, compartments, surface_hydrophobicity): words of the type; retail price scaled to [0, 1]; sizes over 40 are unmeasured."""
    p = table(spark, sf_dir, "part")
    scaled = F.when(F.col("p_size") <= 40, F.pmod(F.col("p_partkey"), F.lit(1000)) / 1000.0)
    return p.select(key("P", "p_partkey").alias("node"), F.array_distinct(F.split(F.lower("p_type"), " ")).alias("compartments"), scaled.alias("surface_hydrophobicity"))


def embedding_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the ``embeddings`` table as those of parts (id, vec), in the floats they are stored in."""
    return table(spark, sf_dir, "embeddings").select(key("P", "vec_id").alias("id"), F.col("embedding").alias("vec"))


def label_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, y, score): quality against the logarithm of the length, 3 digits kept."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    score = F.floor(F.log(F.col("n_chars").cast("double") + 1) * 1000 + 0.5) / 1000.0
    return labels.join(docs.select("doc_id", "n_chars", "source"), "doc_id").select("doc_id", "source", F.col("quality").alias("y"), score.alias("score"))
