"""Candidates, vetoes, scores, fusion, selection, review and records as one lineage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unpaired.graph import Graph
from unpaired.operators import candidates, fusion, metrics, numbers, ranking, routing, selection, topology
from unpaired.operators.filters import ENDS, Context, Filter, Stage, build_filters
from unpaired.operators.judge import Judge
from unpaired.operators.rules import Rule
from unpaired.tables import settle


@dataclass(frozen=True)
class PipelineConfig:
    modality: str = "ppi"
    n_eval: int = 300
    n_train: int = 300
    max_pool: int = candidates.MAX_POOL
    seed: int = 0
    weights: dict[str, float] = field(default_factory=dict)
    filters: tuple[str, ...] | None = None
    train_selection: str = "stacked"
    proportions: tuple[float, float, float] = selection.PROPORTIONS
    psm_cap: float = selection.PSM_CAP
    fusion_mode: str = "mean"
    entropy_lambda: float = 1.0
    false_negative_pct: float = routing.TAIL
    gated_max: int | None = None
    disagreement: float = routing.DISAGREEMENT
    disagreement_pairs: tuple[tuple[str, str], ...] = (("topology", "manifold"),)
    match_on_type: str | None = None
    match_weight: Callable[[Graph], DataFrame] | None = None
    sources_version: str = "unversioned"
    max_degree: int | None = None


@dataclass
class PipelineResult:
    scored: DataFrame
    eval: DataFrame
    train: DataFrame
    contested: DataFrame
    records: DataFrame
    funnel: DataFrame

    @cached_property
    def stats(self) -> dict:
        """Counts of each step, in one job."""
        return {r["step"]: r["n"] for r in self.funnel.collect()}


def match_weights(graph: Graph, scored: DataFrame, config: PipelineConfig) -> DataFrame:
    """Adds ``match_weight``: the pair's sum of a node statistic (its degree by default)."""
    if config.match_weight is None and config.match_on_type is None and "degsum" in scored.columns:
        return scored.withColumn("match_weight", F.col("degsum").cast("double"))
    stat = config.match_weight(graph) if config.match_weight else graph.degrees.select("id", F.col("k").cast("double").alias("weight"), "type")
    if config.match_on_type is not None and "type" in stat.columns:
        stat = stat.where(F.col("type") == config.match_on_type)
    stat = stat.select("id", F.col("weight").cast("double").alias("weight"))
    out = scored
    for end in ("u", "v"):
        out = out.join(stat.select(F.col("id").alias(end), F.col("weight").alias(f"_w_{end}")), end, "left")
    return out.withColumn("match_weight", F.coalesce("_w_u", F.lit(0.0)) + F.coalesce("_w_v", F.lit(0.0))).drop("_w_u", "_w_v")


def fused(scored: DataFrame, names: list[str], config: PipelineConfig, out: str = "confidence") -> DataFrame:
    streams = {n: F.col(f"stream_{n}") for n in names}
    said = {n: F.col(f"conf_{n}") for n in names if f"conf_{n}" in scored.columns}
    return scored.withColumn(out, fusion.fuse(streams, config.weights, config.fusion_mode, config.entropy_lambda, said))


def run_pipeline(graph: Graph, config: PipelineConfig = PipelineConfig(), filters: list[Filter] | None = None, context: Context | None = None, rules: list[Rule] | None = None, judge: Judge | None = None) -> PipelineResult:
    """Matched, scored and explained negative pairs of a graph.

    ``context`` carries annotations, further positives, vectors and verdicts. The pool
    is bounded by ``max_pool``; it is settled, as evaluation, training and counts
    all read it.
    """
    graph = graph.settled()
    context = context or Context(graph)
    context.graph = graph
    context.seed, context.max_degree = config.seed, config.max_degree
    context.rules = rules if rules is not None else context.rules
    context.judge = judge or context.judge
    filters = filters or build_filters(config.modality, list(config.filters) if config.filters else None)
    for f in filters:
        f.fit(context)
    pool = candidates.generate_candidates(graph, config.max_pool, config.seed)
    kept = pool
    context.non_edges = True
    for f in filters:
        if f.stage is Stage.VETO:
            kept = f.score(context, kept)
    context.non_edges = False
    scored = kept
    graded = [f for f in filters if f.stage is Stage.GRADED]
    # what sums over neighbours comes first: it needs no join with pairs that have nothing else, and finds the degrees for others
    for f in sorted(graded, key=lambda f: not f.provides_hardness):
        scored = f.score(context, scored)
    scored = scored.drop(*ENDS)
    names = [f.name for f in graded]
    if "degsum" not in scored.columns:
        degrees = graph.degrees
        for end in ("u", "v"):
            scored = scored.join(degrees.select(F.col("id").alias(end), F.col("k").alias(f"_k_{end}")), end, "left")
        scored = scored.withColumn("degsum", F.coalesce("_k_u", F.lit(0)) + F.coalesce("_k_v", F.lit(0))).drop("_k_u", "_k_v")
    if not any(f.provides_hardness for f in graded):
        scored = scored.withColumn("hardness", F.lit(0.0))
    else:
        scored = ranking.percent_rank(scored, "hardness_raw", "_rank")
        scored = scored.withColumn("hardness", F.floor(F.col("_rank") * 10000 + 0.5) / 10000.0).drop("_rank")
    scored = fused(scored, names, config)
    lists = [F.col(c) for c in scored.columns if c.startswith("flags_")]
    none = F.array().cast("array<string>")
    graded_flags = F.array_distinct(F.concat(*[F.coalesce(c, none) for c in lists])) if lists else none
    scored = scored.withColumn("graded_flags", graded_flags)
    pairs = [(a, b) for a, b in config.disagreement_pairs if a in names and b in names]
    scored = scored.withColumn("disagreement", routing.disagreement_flags(pairs, config.disagreement))
    scored = settle(match_weights(graph, scored, config), "scored")

    chosen = settle(selection.degree_matched(scored, config.n_eval, "match_weight", config.seed), "eval")
    positives = None
    if config.train_selection == "psm":
        positives = topology.degree_sums(graph)
    train = settle(selection.select_train(scored, config.n_train, chosen, config.train_selection, config.proportions, config.seed, positives, config.psm_cap), "train")
    emitted = chosen.withColumn("mode", F.lit("eval")).unionByName(train.withColumn("mode", F.lit("train")))

    emitted = settle(emitted, "emitted")
    contested = routing.contested(emitted, config.false_negative_pct, cap=config.gated_max)
    gated = [f for f in filters if f.stage is Stage.GATED]
    gated_names = []
    reviewed = emitted.withColumn("gated_flags", F.col("disagreement"))
    for f in gated:
        seen = f.score(context, contested.select("u", "v", "confidence"))
        columns = [c for c in seen.columns if c not in ("confidence", "u", "v")]
        reviewed = reviewed.join(seen.select("u", "v", *columns), ["u", "v"], "left")
        if f"flags_{f.name}" in columns:
            reviewed = reviewed.withColumn("gated_flags", F.array_union("gated_flags", F.coalesce(f"flags_{f.name}", none)))
        gated_names.append(f.name)
    if gated_names:
        again = fused(reviewed, names + gated_names, config, "_again")
        touched = F.lit(False)
        for n in gated_names:
            touched = touched | F.col(f"stream_{n}").isNotNull()
        reviewed = again.withColumn("confidence", F.when(touched, F.col("_again")).otherwise(F.col("confidence"))).drop("_again")
    records = routing.tail_flag(records_of(graph, reviewed, names, gated_names, config), config.false_negative_pct)
    count = lambda df, step: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(step).alias("step"), "n")
    keys = numbers.keys_of(graph, pool)
    funnel = count(pool if keys is None else keys, "candidates").union(count(scored, "after_veto")).union(count(chosen, "eval")).union(count(train, "train")).union(count(contested, "contested"))
    if gated_names:
        risky = reviewed.agg(F.count_if(F.col(f"stream_{gated_names[0]}").isNotNull()).alias("n")).select(F.lit("judged").alias("step"), "n")
        funnel = funnel.union(risky)
    return PipelineResult(scored, chosen, train, contested, records, funnel)


def records_of(graph: Graph, scored: DataFrame, names: list[str], gated: list[str], config: PipelineConfig) -> DataFrame:
    """The output contract: pair, mode, confidence, hardness, streams, flags and provenance."""
    kinds = graph.nodes
    own = scored.join(kinds.select(F.col("id").alias("u"), F.col("type").alias("_tu")), "u", "left").join(kinds.select(F.col("id").alias("v"), F.col("type").alias("_tv")), "v", "left")
    streams = {n: F.col(f"stream_{n}") for n in names + gated}
    flags = routing.merge_flags(F.col("gated_flags"), F.col("graded_flags"), F.col("hardness"))
    provenance = F.struct(
        F.lit(graph.name).alias("source_graph"), F.lit(config.sources_version).alias("sources_version"),
        F.array(F.lit("candidate_nonedge"), F.lit("known_positive_veto")).alias("filters_fired"),
        F.array("_tu", "_tv").alias("node_types"), fusion.sub_scores(streams).alias("sub_scores"), _reviewed(scored, gated).alias("gated"),
    )
    return own.select("u", "v", "mode", "confidence", "hardness", *[c.alias(f"stream_{n}") for n, c in streams.items()], flags.alias("flags"), provenance.alias("provenance"))


def _reviewed(scored: DataFrame, gated: list[str]) -> Column:
    """What reviews said of a record: (value, agreement, verdict) by stream; null if none did."""
    kind = "struct<value:double,agreement:double,verdict:string>"
    of = lambda n: F.struct(F.col(f"stream_{n}").alias("value"), *[(F.col(c) if c in scored.columns else F.lit(None)).cast(t).alias(a) for c, t, a in ((f"conf_{n}", "double", "agreement"), ("verdict", "string", "verdict"))])
    said = [x for n in gated for x in (F.lit(n), of(n))]
    if not said:
        return F.lit(None).cast(f"map<string,{kind}>")
    found = F.map_filter(F.create_map(*said).cast(f"map<string,{kind}>"), lambda k, v: v["value"].isNotNull() | v["verdict"].isNotNull())
    return F.when(F.size(found) > 0, found)


def risky_coverage(result: PipelineResult, config: PipelineConfig, stream: str = "literature") -> DataFrame:
    """(risky, judged, unjudged, gated_cap, contested_total), one row.

    Risky are the records flagged as suspected false negatives; judged are those of them
    that a review has said anything about, be it that it can't tell.
    """
    seen = F.coalesce(F.array_contains(F.map_keys("provenance.gated"), stream), F.lit(False))
    risky = result.records.where(routing.is_risky(F.col("flags"))).agg(F.count(F.lit(1)).alias("risky"), F.count_if(seen).alias("judged"))
    emitted = result.eval.unionByName(result.train)
    total = routing.contested(emitted, config.false_negative_pct).agg(F.count(F.lit(1)).alias("contested_total"))
    cap = F.lit(config.gated_max).cast("long").alias("gated_cap")
    return risky.join(F.broadcast(total)).select("risky", "judged", (F.col("risky") - F.col("judged")).alias("unjudged"), cap, "contested_total")


def validation(graph: Graph, result: PipelineResult, gold: DataFrame | None = None) -> dict[str, DataFrame]:
    """Leakage, hardness of the two sets, and recall of gold negatives."""
    out = {"leakage": metrics.leakage(graph, result.records), "hardness": metrics.hardness_split(result.records)}
    if gold is not None:
        out["gold"] = metrics.gold_recall(result.scored, gold)
    return out
