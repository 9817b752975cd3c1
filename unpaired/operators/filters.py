"""The plug-in surface: filters score a whole pool at a time, in three stages.

A filter adds ``stream_<name>`` (null: it abstains) and may add ``conf_<name>``,
``flags_<name>`` and ``hardness_raw``; a veto filter keeps the pairs that pass.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field, replace
from enum import Enum
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unpaired.functions.numeric import rounded
from unpaired.graph import Graph, excluding, same_pair
from unpaired.operators import judge as judging
from unpaired.operators import complement, manifold, rules, topology
from unpaired.sources.writers import latest_verdicts


class Stage(Enum):
    VETO = "veto"
    GRADED = "graded"
    GATED = "gated"


@dataclass
class Context:
    """What filters may look at besides the graph."""

    graph: Graph
    annotations: DataFrame | None = None
    pair_fields: DataFrame | None = None
    pair_field_names: tuple[str, ...] = ()
    known_positives: DataFrame | None = None
    embeddings: DataFrame | None = None
    rules: list[rules.Rule] = field(default_factory=list)
    judge: judging.Judge | None = None
    verdicts: DataFrame | None = None
    names: DataFrame | None = None
    seed: int = 0
    max_degree: int | None = None
    #: Whether the pairs are drawn or listed without the graph's edges.
    non_edges: bool = False


class Filter(ABC):
    name: str = ""
    stage: Stage = Stage.GRADED
    modalities: frozenset[str] = frozenset({"ppi", "pli"})
    default: bool = True
    provides_hardness: bool = False

    def fit(self, context: Context) -> None:  # noqa: B027  optional hook
        """Prepare tables; called once before scoring."""

    @abstractmethod
    def score(self, context: Context, pairs: DataFrame) -> DataFrame:
        """``pairs`` (keyed by u, v) with this filter's columns."""


#: What a filter may leave for later ones.
ENDS = ("t_u", "t_v", "k_u", "k_v")
_REGISTERED: dict[str, type[Filter]] = {}


def register(kind: type[Filter]) -> type[Filter]:
    """Make a filter available by name; a later one of the same name replaces it."""
    if not kind.name:
        raise ValueError("a filter needs a name")
    _REGISTERED[kind.name] = kind
    return kind


def registered() -> dict[str, type[Filter]]:
    return dict(_REGISTERED)


def build_filters(modality: str = "ppi", names: list[str] | None = None) -> list[Filter]:
    """The named filters, or the defaults of a modality in the order of registration."""
    if names is not None:
        return [_REGISTERED[n]() for n in names]
    return [k() for k in _REGISTERED.values() if k.default and modality in k.modalities]


def known_pairs(graph: Graph, *others: DataFrame | None) -> DataFrame:
    """Edges and further positives (u, v) as distinct (lo, hi)."""
    out = graph.edges.select(F.col("u").alias("lo"), F.col("v").alias("hi"))
    for other in others:
        if other is not None:
            out = out.unionByName(other.select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")))
    return out.distinct()


@register
class KnownPositiveVeto(Filter):
    name, stage = "known_positive_veto", Stage.VETO

    def score(self, context: Context, pairs: DataFrame) -> DataFrame:
        if context.non_edges:
            return pairs if context.known_positives is None else excluding(pairs, context.known_positives)
        known = known_pairs(context.graph, context.known_positives)
        return pairs.join(known, (F.least("u", "v") == F.col("lo")) & (F.greatest("u", "v") == F.col("hi")), "left_anti")

    def complement(self, context: Context) -> DataFrame:
        """(u, v): all admissible pairs that stay, listed with the further positives as edges, so that no pair is exchanged."""
        graph = context.graph
        known = known_pairs(graph, context.known_positives).select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        return complement.pairs(Graph.from_edges(known, graph.nodes, list(graph.admissible) if graph.admissible is not None else None, graph.name).settled()).select("u", "v")


@register
class StructuredFilter(Filter):
    name = "structured"

    def score(self, context: Context, pairs: DataFrame) -> DataFrame:
        added = [F.col("value").alias("stream_structured"), F.lit(None).cast("double").alias("conf_structured"), (F.col("k_u") + F.col("k_v")).alias("degsum")]
        if set(ENDS) <= set(pairs.columns):  # they have their types and degrees
            kept = [c for c in pairs.columns if c not in ENDS]
            return topology.structured_of(context.graph, pairs, [*kept, "t_u", "t_v"]).select(*kept, *ENDS, *added)
        own = topology.structured_score(context.graph, pairs.select("u", "v"))
        return pairs.join(own.select("u", "v", *added), ["u", "v"])


@register
class TopologyFilter(Filter):
    name, provides_hardness = "topology", True

    def score(self, context: Context, pairs: DataFrame) -> DataFrame:
        own = topology.topology_score(context.graph, topology.ends(pairs), max_degree=context.max_degree)
        added = [F.col("value").alias("stream_topology"), F.col("confidence").alias("conf_topology"), F.col("flags").alias("flags_topology"), F.coalesce("risk", F.lit(0.0)).alias("hardness_raw")]
        if pairs.columns == ["u", "v"]:
            return own.select("u", "v", *added, *ENDS)
        return pairs.join(own.select("u", "v", *added), ["u", "v"])


class _RuleFilter(Filter):
    def annotated(self, context: Context, pairs: DataFrame) -> DataFrame:
        table = rules.annotate(context.graph, context.annotations)
        return rules.annotated_pairs(context.graph, pairs.select("u", "v"), table, context.pair_fields, context.pair_field_names)


@register
class RuleVetoFilter(_RuleFilter):
    name, stage = "rule_veto", Stage.VETO

    def score(self, context: Context, pairs: DataFrame) -> DataFrame:
        if not any(r.effect == "veto" for r in context.rules):
            return pairs
        vetoed = rules.apply_veto(self.annotated(context, pairs), context.rules).where("veto").select("u", "v")
        return pairs.join(vetoed, ["u", "v"], "left_anti")


@register
class RuleGradedFilter(_RuleFilter):
    name = "rules"

    def score(self, context: Context, pairs: DataFrame) -> DataFrame:
        if not any(r.effect != "veto" for r in context.rules):
            return pairs.select("*", F.lit(None).cast("double").alias("stream_rules"), F.array().cast("array<string>").alias("flags_rules"))
        own = rules.apply_graded(self.annotated(context, pairs), context.rules)
        return pairs.join(own.select("u", "v", F.col("rule_value").alias("stream_rules"), F.col("rule_flags").alias("flags_rules")), ["u", "v"])


@register
class JudgeFilter(Filter):
    """Reviews pairs by votes; verdicts already known (``context.verdicts``) aren't asked for again.

    Known verdicts with a ``key`` hold for what the judge would see now: the pair, its
    types, degrees and names (``context.names``: id, name), the model and the number of
    votes (:meth:`keyed`), so a name that changes asks again. The last one of a key counts.
    Without a key they hold for the pair.
    """

    name, stage = "literature", Stage.GATED

    @staticmethod
    def described(context: Context, pairs: DataFrame) -> DataFrame:
        """``pairs`` with types, degrees and names of both ends: what a judge is told of a pair."""
        own = topology.with_degrees(context.graph, pairs)
        names = context.names.dropDuplicates(["id"]) if context.names is not None else None
        for end in ("u", "v"):
            own = own.withColumn(f"name_{end}", F.lit(None).cast("string")) if names is None else own.join(names.select(F.col("id").alias(end), F.col("name").alias(f"name_{end}")), end, "left")
        return own

    @staticmethod
    def keyed(context: Context, pairs: DataFrame) -> DataFrame:
        """``pairs`` with ``key``, by which verdicts are remembered."""
        config = getattr(context.judge, "config", judging.JudgeConfig())
        own = JudgeFilter.described(context, pairs)
        seen = F.sort_array(F.array(*[F.struct(F.col(end).alias("id"), F.col(f"t_{end}").alias("type"), F.col(f"k_{end}").alias("degree"), F.col(f"name_{end}").alias("name")) for end in ("u", "v")]))
        key = judging.feature_key(seen.alias("ends"), F.lit(config.model).alias("model"), F.lit(config.votes).alias("votes"))
        return own.select(*[F.col(c) for c in pairs.columns], key.alias("key"))

    def score(self, context: Context, pairs: DataFrame) -> DataFrame:
        cards = None
        if context.verdicts is not None and "key" in context.verdicts.columns:
            stored = context.verdicts.drop("u", "v")
            stored = latest_verdicts(stored) if "written_at" in stored.columns else stored.dropDuplicates(["key"])
            known = self.keyed(context, pairs.select("u", "v")).join(stored, "key")
            context = replace(context, verdicts=known)
        if context.verdicts is not None:
            cards = context.verdicts.select("u", "v", "verdict", "confidence", "agreement")
        if context.judge is not None:
            open_ = pairs if cards is None else excluding(pairs, cards)
            new = judging.majority(context.judge.judge(self.described(context, open_))).select("u", "v", "verdict", "confidence", "agreement")
            cards = new if cards is None else cards.unionByName(new)
        if cards is None:
            cards = pairs.sparkSession.createDataFrame([], "u string, v string, verdict string, confidence double, agreement double")
        flag = F.when(F.col("verdict") == judging.VERDICTS[1], F.array(F.lit("suspected_false_negative"))).otherwise(F.array().cast("array<string>"))
        own = cards.select(F.least("u", "v").alias("_lo"), F.greatest("u", "v").alias("_hi"), rounded(judging.card_value(F.col("verdict"), F.col("confidence"))).alias("stream_literature"), F.col("agreement").alias("conf_literature"), flag.alias("flags_literature"), "verdict")
        return pairs.join(own, same_pair(), "left").drop("_lo", "_hi")


class _Manifold(Filter):
    default = False
    operator, k = "hadamard", 10

    def vectors(self, context: Context) -> DataFrame | None:
        return context.embeddings

    def score(self, context: Context, pairs: DataFrame) -> DataFrame:
        vectors = self.vectors(context)
        names = (f"stream_{self.name}", f"conf_{self.name}", f"flags_{self.name}")
        if vectors is None:
            return pairs.select("*", F.lit(None).cast("double").alias(names[0]), F.lit(None).cast("double").alias(names[1]), F.array().cast("array<string>").alias(names[2]))
        own = manifold.manifold_score(context.graph, pairs.select("u", "v"), vectors, self.operator, self.k, context.seed)
        return pairs.join(own.select("u", "v", F.col("value").alias(names[0]), F.col("confidence").alias(names[1]), F.coalesce("flags", F.array().cast("array<string>")).alias(names[2])), ["u", "v"])


@register
class GraphManifoldFilter(_Manifold):
    name, modalities = "manifold", frozenset({"ppi"})

    def vectors(self, context: Context) -> DataFrame | None:
        return manifold.spectral_embeddings(context.graph)


@register
class SequenceManifoldFilter(_Manifold):
    name, operator, k = "sequence_manifold", "concat", 25


def default_rules() -> list[rules.Rule]:
    """The rules that ship with the package."""
    return rules.load_rules(Path(__file__).parent.parent / "rules")
