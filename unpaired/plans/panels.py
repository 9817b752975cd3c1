"""The tables behind each panel of a report, and a plain HTML rendering."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unpaired.functions.numeric import rounded, rounded_mean
from unpaired.functions.sets import jaccard
from unpaired.graph import Graph
from unpaired.operators import topology

# Wording of flags in a report.
FLAG_LABELS = {
    "different_compartment": "never found in one compartment",
    "hydrophobicity_interface_calibrated": "hydrophobic surface",
    "easy_negative": "far apart in the graph",
    "near_boundary": "close to known positives",
    "suspected_false_negative": "may be a true interaction",
}


def flag_breakdown(records: DataFrame) -> DataFrame:
    return records.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def common_neighbor_histogram(graph: Graph, pairs: DataFrame, clip: int = 12) -> DataFrame:
    """(cn, n): pairs by number of common neighbours, the last bin open."""
    own = pairs.select("u", "v").join(topology.common_neighbors(graph, pairs).select("u", "v", "cn"), ["u", "v"], "left")
    return own.select(F.least(F.coalesce("cn", F.lit(0)), F.lit(clip)).alias("cn")).groupBy("cn").agg(F.count(F.lit(1)).alias("n"))


def path_histogram(graph: Graph, pairs: DataFrame, cutoff: int = 6) -> DataFrame:
    return topology.shortest_paths(graph, pairs, cutoff).groupBy("dist").agg(F.count(F.lit(1)).alias("n"))


def quadrant(scored: DataFrame, annotations: DataFrame) -> DataFrame:
    """Topology risk against compartment similarity: (u, v, risk, similarity, quadrant)."""
    a = annotations.select(F.col("node").alias("u"), F.col("compartments").alias("_a"))
    b = annotations.select(F.col("node").alias("v"), F.col("compartments").alias("_b"))
    own = scored.join(a, "u").join(b, "v").select("u", "v", F.col("hardness_raw").alias("risk"), rounded(jaccard(F.col("_a"), F.col("_b"))).alias("similarity"))
    side = F.concat(F.when(F.col("risk") >= 0.5, "risky").otherwise("safe"), F.lit("_"), F.when(F.col("similarity") >= 0.5, "similar").otherwise("different"))
    return own.withColumn("quadrant", side)


def confidence_groups(records: DataFrame) -> DataFrame:
    group = F.when(F.array_contains("flags", "suspected_false_negative"), "suspect").when(F.array_contains("flags", "near_boundary"), "boundary").otherwise("plain")
    return records.groupBy("mode", group.alias("group")).agg(F.count(F.lit(1)).alias("n"), rounded_mean(F.col("confidence")).alias("mean_confidence"), rounded_mean(F.col("hardness")).alias("mean_hardness"))


def principal_components(features: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """(u, v, pc): components of log1p, standardised features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    logs = features.select("u", "v", *[F.log1p(F.col(c).cast("double")).alias(c) for c in columns])
    steps = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True), PCA(k=k, inputCol="_z", outputCol="_p")])
    return steps.fit(logs).transform(logs).select("u", "v", vector_to_array("_p").alias("pc"))


def traces(scored: DataFrame, annotations: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(u, v, x, y, z, text): risk, compartment similarity and surface similarity; 0 where unknown."""
    side = lambda end: annotations.select(F.col("node").alias(end), F.col("compartments").alias(f"_c{end}"), F.col("surface_hydrophobicity").alias(f"_h{end}"))
    own = scored.join(side("u"), "u", "left").join(side("v"), "v", "left")
    text = F.concat_ws(" – ", "u", "v")
    if names is not None:
        own = own.join(names.select(F.col("id").alias("u"), F.col("name").alias("_nu")), "u", "left").join(names.select(F.col("id").alias("v"), F.col("name").alias("_nv")), "v", "left")
        text = F.concat_ws(" – ", F.coalesce("_nu", "u"), F.coalesce("_nv", "v"))
    zero = F.lit(0.0)
    return own.select("u", "v", F.coalesce("hardness_raw", zero).alias("x"), F.coalesce(jaccard(F.col("_cu"), F.col("_cv")), zero).alias("y"), F.coalesce(1 - F.abs(F.col("_hu") - F.col("_hv")), zero).alias("z"), text.alias("text"))


def render(title: str, tables: dict[str, DataFrame], rows: int = 50) -> str:
    """A static page with the first rows of small tables, everything escaped."""
    out = [f"<!DOCTYPE html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(x))}</td>" for x in r) + "</tr>" for r in df.limit(rows).collect())
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "".join(out)
