"""Graph topology of pairs: common neighbours, resource allocation, paths of length 3.

Neighbour sums of pairs are summed inside tasks: a graph of a checked size is sent to all of them
(:mod:`unpaired.operators.packed`), a larger one meets the pairs in blocks
(:mod:`unpaired.operators.blocked`). Sums of all non-edges of a larger graph are chained equi-joins. ``max_degree`` drops hubs as intermediate nodes only where the caller asks for it;
by default every path counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unpaired.functions.hashing import hash52
from unpaired.functions.numeric import rounded
from unpaired.graph import Graph
from unpaired.operators import blocked, numbers, packed
from unpaired.tables import settle

# Fixed values of the risk model.
L3_WEIGHT, RA_WEIGHT = 0.7, 0.3
NO_OVERLAP_VALUE, NO_OVERLAP_CONFIDENCE = 0.98, 0.9
CALIBRATION_EDGES = 2000
# Starts of walks that share a row.
LANES = 16


def common_neighbors(graph: Graph, pairs: DataFrame, max_degree: int | None = None) -> DataFrame:
    """(u, v, cn, ra, aa): counts and sums over common neighbours; pairs without any are absent."""
    own = path_sums(graph, pairs, max_degree).where("cn > 0")
    return own.select("u", "v", "cn", "ra", F.when(F.col("aa") > 0, F.col("aa")).alias("aa"))


def l3(graph: Graph, pairs: DataFrame, max_degree: int | None = None) -> DataFrame:
    """(u, v, l3) of non-edges: sum of 1/sqrt(k_x k_y) over paths u-x-y-v; absent if none."""
    return path_sums(graph, pairs, max_degree).where("l3 > 0").select("u", "v", "l3")


def path_sums(graph: Graph, pairs: DataFrame, max_degree: int | None = None) -> DataFrame:
    """(u, v, cn, ra, aa, l3) of ``pairs``: both neighbour sums at once; pairs without any have zeros or are absent."""
    if (small := packed.adjacency(graph)) is not None:
        return packed.sums_of_pairs(small, pairs, max_degree)
    return blocked.sums_of_pairs(graph, pairs, max_degree)


def all_path_sums(graph: Graph) -> DataFrame:
    """(u, v, cn, ra, l3) of every pair u < v with a common neighbour, and of every non-edge u < v with a path of length 3."""
    step = graph.adjacency.select(F.col("u").alias("x"), F.col("v").alias("end")).join(graph.degrees.select(F.col("id").alias("x"), "k"), "x")
    ends = step.select("x", "k", F.col("end").alias("u")).join(step.select("x", F.col("end").alias("v")), "x").where("u < v")
    common = ends.groupBy("u", "v").agg(F.count(F.lit(1)).alias("cn"), F.sum(1.0 / F.col("k")).alias("ra"))
    return common.join(all_l3(graph), ["u", "v"], "full_outer")


def l3_of_edges(graph: Graph, edges: DataFrame) -> DataFrame:
    """(u, v, l3) of edges, without walks over the edge itself (x = v or y = u)."""
    if (small := packed.adjacency(graph)) is not None:
        return packed.sums_of_edges(small, edges).where("l3 > 0")
    return blocked.of_pairs(graph, edges, apart=True).where("l3 > 0").select("u", "v", "l3")


def _lanes(starts: DataFrame) -> DataFrame:
    """Adds ``block`` and ``lane``: starts in groups of ``LANES``, so that a row can carry a sum for each of them."""
    buckets = max(1, starts.count() // (16 * LANES))
    own = starts.withColumn("bucket", F.pmod(F.xxhash64("a"), F.lit(buckets)))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("k_a", "a")) - 1
    return own.select("a", "k_a", (F.col("bucket") * 2**31 + F.floor(place / LANES)).alias("block"), (place % LANES).alias("lane"))


def all_l3(graph: Graph) -> DataFrame:
    """(u, v, l3) of every non-edge u < v that has a path of length 3.

    Nodes are ranked by (degree, id). A pair is summed once, from its end of higher rank;
    walks that lead to no end of lower rank go before they are grouped (``low`` is the
    lowest rank next to a node, ``low2`` the lowest two steps away). Starts lie in lanes of
    wide rows, which divides the rows of the last join and of its grouping. A graph small
    enough to be sent to tasks is summed there (:mod:`unpaired.operators.packed`).
    """
    if (small := packed.adjacency(graph)) is not None:
        return packed.all_path_sums(small, graph)
    nodes = graph.degrees.select("id", "k", F.struct("k", "id").alias("r"))
    edges = graph.adjacency.select(F.col("u").alias("id"), F.col("v").alias("to"))
    steps = edges.join(nodes.select(F.col("id").alias("to"), F.col("k").alias("k_to"), F.col("r").alias("r_to")), "to")
    low = steps.groupBy("id").agg(F.min("r_to").alias("low"))
    low2 = edges.join(low.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("low").alias("low2"))
    first = edges.join(nodes, "id").join(low2.withColumnRenamed("id", "to"), "to").where("low2 < r")
    first = settle(first.select(F.col("id").alias("a"), F.col("k").alias("k_a"), F.col("to").alias("x")), "first-steps")
    starts = settle(_lanes(first.select("a", "k_a").distinct()), "starts")
    second = steps.join(low.withColumnRenamed("id", "to"), "to").join(nodes.select("id", "k"), "id")
    second = second.select(F.col("id").alias("x"), F.col("to").alias("y"), "low", (1.0 / F.sqrt(F.col("k").cast("double") * F.col("k_to"))).alias("w"))
    r_a, r_b = F.struct(F.col("k_a").alias("k"), F.col("a").alias("id")), F.struct(F.col("k_b").alias("k"), F.col("b").alias("id"))
    lanes = [f"w{i}" for i in range(LANES)]
    walks = first.join(starts.drop("k_a"), "a").join(second, "x").where(F.col("low") < r_a).groupBy("block", "y")
    walks = walks.agg(*[F.sum(F.when(F.col("lane") == i, F.col("w"))).alias(c) for i, c in enumerate(lanes)], F.max(r_a).alias("top"))
    ends = steps.select(F.col("id").alias("y"), F.col("to").alias("b"), F.col("k_to").alias("k_b"))
    sums = walks.join(ends, "y").where(r_b < F.col("top")).groupBy("block", "b", "k_b").agg(*[F.sum(c).alias(c) for c in lanes])
    flat = sums.select("block", "b", "k_b", F.posexplode(F.array(*lanes)).alias("lane", "l3")).where("l3 is not null").join(starts, ["block", "lane"]).where(r_b < r_a)
    return flat.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "l3").join(graph.edges, ["u", "v"], "left_anti")


def config_expectation(graph: Graph) -> Column:
    """Expected edges between nodes of degree ``k_u`` and ``k_v``; needs column ``two_m``."""
    return F.col("k_u") * F.col("k_v") / F.greatest(F.col("two_m"), F.lit(1))


def with_degrees(graph: Graph, pairs: DataFrame) -> DataFrame:
    """Adds types ``t_u``, ``t_v`` and degrees ``k_u``, ``k_v``."""
    d = graph.degrees
    a = d.select(F.col("id").alias("u"), F.col("type").alias("t_u"), F.col("k").alias("k_u"))
    b = d.select(F.col("id").alias("v"), F.col("type").alias("t_v"), F.col("k").alias("k_v"))
    return pairs.join(graph.sent(a), "u", "left").join(graph.sent(b), "v", "left").na.fill(0, ["k_u", "k_v"])


def with_two_m(graph: Graph, pairs: DataFrame) -> DataFrame:
    """Adds ``two_m``, twice the number of edges."""
    return pairs.withColumn("two_m", F.lit(2 * graph.edge_count).cast("long"))


def calibration(graph: Graph, limit: int = CALIBRATION_EDGES, seed: int = 0) -> DataFrame:
    """One row (s3, sr): medians of the positive L3 and RA of sampled edges, 1.0 if none."""
    sample = settle(graph.edges.orderBy(hash52(seed, F.col("u"), F.col("v")), "u", "v").limit(limit), "calibration")
    if packed.adjacency(graph) is None:
        paths = common = settle(blocked.of_pairs(graph, sample, apart=True), "calibrated")
    else:
        paths, common = l3_of_edges(graph, sample), common_neighbors(graph, sample)
    scale = paths.where("l3 > 0").agg(F.coalesce(F.median("l3"), F.lit(1.0)).alias("s3"))
    shares = common.where("ra > 0").agg(F.coalesce(F.median("ra"), F.lit(1.0)).alias("sr"))
    return settle(scale.join(F.broadcast(shares)), "scales")


def topology_score(graph: Graph, pairs: DataFrame, scales: DataFrame | None = None, max_degree: int | None = None) -> DataFrame:
    """Pairs with degrees, cn, ra, l3, ``expected``, ``risk``, ``value``, ``confidence``, ``bucket`` and ``flags``.

    Abstains (null value) if an end has no neighbours. Without common neighbours and
    paths the pair is an easy negative of a fixed value.
    """
    scales = calibration(graph) if scales is None else scales
    return topology_of(graph, with_ends_and_sums(graph, pairs, max_degree), scales, pairs.columns)


def with_ends_and_sums(graph: Graph, pairs: DataFrame, max_degree: int | None = None) -> DataFrame:
    """Pairs with types, degrees and neighbour sums; of a larger graph all at once, where there is nothing else to carry."""
    if packed.adjacency(graph) is not None or set(pairs.columns) != {"u", "v"}:
        return with_sums(with_degrees(graph, pairs), path_sums(graph, pairs, max_degree))
    return _all_sums(graph, pairs, max_degree).drop("aa")


def _all_sums(graph: Graph, pairs: DataFrame, max_degree: int | None = None) -> DataFrame:
    """Pairs (u, v) of a graph above the bound with types, degrees, cn, ra, aa and l3; those drawn as numbers aren't named before."""
    known = blocked.of_pairs(graph, pairs, max_degree)
    if numbers.keys_of(graph, pairs) is not None:
        return known
    numbered = numbers.numbered(graph, pairs)
    unknown = with_degrees(graph, numbered.where("_u is null or _v is null").select("u", "v"))
    zero = {"cn": F.lit(0).cast("long"), "ra": F.lit(0.0), "aa": F.lit(0.0), "l3": F.lit(0.0)}
    return known.unionByName(unknown.withColumns(zero))


def ends(pairs: DataFrame) -> DataFrame:
    """(u, v) of pairs; a table of just those stays the same."""
    return pairs if pairs.columns == ["u", "v"] else pairs.select("u", "v")


def degree_sums(graph: Graph) -> DataFrame:
    """(degsum): the sum of both degrees of every edge, from its numbers."""
    sent = graph.nodes.sparkSession.sparkContext.broadcast(blocked.degrees(graph))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, k = batch.column(0).to_numpy(), sent.value
            yield pa.RecordBatch.from_arrays([pa.array(k[key >> 32].astype(np.int64) + k[key & 0xFFFFFFFF])], ["degsum"])

    return numbers.edge_keys(graph).select("key").mapInArrow(work, "degsum long")


def with_sums(pairs: DataFrame, sums: DataFrame) -> DataFrame:
    """Adds ``cn``, ``ra`` and ``l3``; 0 where ``sums`` has none."""
    return pairs.join(sums.select("u", "v", "cn", "ra", "l3"), ["u", "v"], "left").na.fill(0, ["cn"]).na.fill(0.0, ["ra", "l3"])


def topology_of(graph: Graph, own: DataFrame, scales: DataFrame, columns: list[str]) -> DataFrame:
    """:func:`topology_score` of pairs that have their degrees and sums."""
    own = with_two_m(graph, own).join(F.broadcast(scales))
    abstains = (F.col("k_u") == 0) | (F.col("k_v") == 0)
    easy = (F.col("cn") == 0) & (F.col("l3") == 0)
    l3n = F.col("l3") / (F.col("l3") + F.col("s3"))
    ran = F.when(F.col("ra") > 0, F.col("ra") / (F.col("ra") + F.col("sr"))).otherwise(0.0)
    risk = L3_WEIGHT * l3n + RA_WEIGHT * ran
    pick = lambda easy_value, other: F.when(abstains, None).when(easy, easy_value).otherwise(other)
    return own.select(
        *columns, "t_u", "t_v", "k_u", "k_v", "cn", rounded(F.col("ra")).alias("ra"), rounded(F.col("l3")).alias("l3"),
        rounded(config_expectation(graph)).alias("expected"),
        pick(F.lit(1 - NO_OVERLAP_VALUE), risk).alias("_risk"),
        rounded(pick(F.lit(1 - NO_OVERLAP_VALUE), risk)).alias("risk"),
        rounded(pick(F.lit(NO_OVERLAP_VALUE), 1 - risk)).alias("value"),
        rounded(pick(F.lit(NO_OVERLAP_CONFIDENCE), F.least(F.lit(1.0), l3n + ran))).alias("confidence"),
        pick(F.lit("no_overlap"), F.lit("overlap")).alias("bucket"),
        pick(F.array(F.lit("easy_negative")), F.array().cast("array<string>")).alias("flags"),
    ).drop("_risk")


def structured_score(graph: Graph, pairs: DataFrame) -> DataFrame:
    """Pairs with ``promiscuity`` and ``value``: 1 minus the larger degree share within its type."""
    return structured_of(graph, with_degrees(graph, pairs), pairs.columns)


def structured_of(graph: Graph, own: DataFrame, columns: list[str]) -> DataFrame:
    """:func:`structured_score` of pairs that have their types and degrees; other columns of ``own`` named in ``columns`` stay."""
    top = graph.degrees.groupBy("type").agg(F.greatest(F.max("k"), F.lit(1)).alias("top"))
    for end in ("u", "v"):  # a handful of types
        own = own.join(F.broadcast(top.select(F.col("type").alias(f"t_{end}"), F.col("top").alias(f"top_{end}"))), f"t_{end}", "left")
    share = F.greatest(F.col("k_u") / F.col("top_u"), F.col("k_v") / F.col("top_v"))
    return own.select(*columns, "k_u", "k_v", rounded(share).alias("promiscuity"), rounded(1 - share).alias("value"))


def pair_features(graph: Graph, pairs: DataFrame) -> DataFrame:
    """deg_u, deg_v, cn, jaccard, aa, ra, pref: the classical link features."""
    if packed.adjacency(graph) is not None or pairs.columns != ["u", "v"]:
        own = with_degrees(graph, pairs).join(common_neighbors(graph, pairs), ["u", "v"], "left").na.fill(0, ["cn"]).na.fill(0.0, ["ra", "aa"])
    else:
        own = _all_sums(graph, pairs)
    union = F.col("k_u") + F.col("k_v") - F.col("cn")
    return own.select(
        *pairs.columns, F.col("k_u").alias("deg_u"), F.col("k_v").alias("deg_v"), "cn",
        rounded(F.when(union > 0, F.col("cn") / union).otherwise(0.0)).alias("jaccard"), rounded(F.col("aa")).alias("aa"), rounded(F.col("ra")).alias("ra"), (F.col("k_u") * F.col("k_v")).alias("pref"),
    )


def shortest_paths(graph: Graph, pairs: DataFrame, cutoff: int = 6) -> DataFrame:
    """Pairs with ``dist``: hops between their ends, ``cutoff`` + 1 if more.

    The search goes from both ends and meets in the middle. Each hop grows the side whose
    frontiers have fewer edges, and a pair is found when the frontiers of its ends share a
    node; so neither side goes deeper than the other needs, three hops each for the default.
    A pair drops out once found, and an end once all of its pairs are. A hop only needs the
    two before it on its side, as no node of an earlier one is next to its frontier.
    """
    open_ = settle(pairs.select("u", "v").distinct(), "open-pairs")
    found = open_.where("u = v").withColumn("dist", F.lit(0))
    left = open_.where("u <> v")
    step = graph.adjacency.select(F.col("u").alias("n"), F.col("v").alias("next"))
    degree = graph.degrees.select(F.col("id").alias("n"), "k")
    sides = {end: left.select(F.col(end).alias("s")).distinct().withColumn("n", F.col("s")) for end in ("u", "v")}
    before = {end: sides[end].limit(0) for end in sides}
    for hop in range(1, cutoff + 1):
        edges = lambda end: sides[end].join(degree, "n").agg(F.sum("k").alias("k")).first()[0] or 0
        grows, other = sorted(sides, key=edges)
        nexts = sides[grows].join(step, "n").select("s", F.col("next").alias("n")).distinct()
        new = settle(nexts.join(sides[grows].unionByName(before[grows]), ["s", "n"], "left_anti"), "frontier")
        before[grows], sides[grows] = sides[grows], new
        mine = left.join(new.select(F.col("s").alias(grows), "n"), grows)
        hit = mine.join(sides[other].select(F.col("s").alias(other), "n"), [other, "n"], "left_semi").select("u", "v").distinct()
        hit = settle(hit.withColumn("dist", F.lit(hop)), "found")
        found = found.unionByName(hit)
        left = settle(left.join(hit, ["u", "v"], "left_anti").select("u", "v"), "open-pairs")
        if left.isEmpty() or new.isEmpty():
            break
        for end in sides:
            ends = left.select(F.col(end).alias("s")).distinct()
            sides[end] = settle(sides[end].join(ends, "s", "left_semi"), "frontier")
            before[end] = before[end].join(ends, "s", "left_semi")
    return pairs.join(found, ["u", "v"], "left").withColumn("dist", F.coalesce("dist", F.lit(cutoff + 1)))
