"""Declarative rules on annotated pairs."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unpaired.functions.numeric import rounded
from unpaired.functions.rule_language import RuleError, compile_rule, parse
from unpaired.graph import Graph

EFFECTS = ("safer_negative", "riskier_negative", "veto")
#: Rule files, one for each modality.
FILES = ("ppi.yaml", "pli.yaml")


@dataclass(frozen=True)
class Rule:
    id: str
    modality: str
    applies_to: tuple[str, str]
    when: str
    effect: str
    weight: float = 0.0
    rationale: str = ""
    source: str = ""
    flag: str | None = None

    def __post_init__(self) -> None:
        if self.effect not in EFFECTS:
            raise RuleError(f"{self.id}: effect {self.effect!r}")
        if len(self.applies_to) != 2:
            raise RuleError(f"{self.id}: applies_to needs two types")
        parse(self.when)


def load_rules(folder: str | Path) -> list[Rule]:
    """The rules of the YAML files in a folder; absent files have none."""
    import yaml

    rules = []
    for name in FILES:
        path = Path(folder) / name
        for entry in (yaml.safe_load(path.read_text()) or []) if path.exists() else []:
            try:
                rules.append(Rule(entry["id"], entry["modality"], tuple(entry["applies_to"]), entry["when"], entry["effect"], float(entry.get("weight", 0.0)), entry.get("rationale", ""), entry.get("source", ""), entry.get("flag")))
            except KeyError as e:
                raise RuleError(f"{path.name}: missing {e}") from e
    return rules


#: What the graph itself tells of a node.
DERIVED = ("neighbors", "degree", "graph_two_m")


def annotate(graph: Graph, annotations: DataFrame | None = None, derived: Iterable[str] = DERIVED) -> DataFrame:
    """(node, fields..., neighbors, degree, graph_two_m); given values win over derived ones.

    ``derived`` names those of the last three that rules ask for; the graph's edges aren't read for others.
    """
    base, derived = graph.nodes.select(F.col("id").alias("node")), [x for x in DERIVED if x in set(derived)]
    if "neighbors" in derived:
        near = graph.adjacency.groupBy(F.col("u").alias("node")).agg(F.collect_set("v").alias("_neighbors"))
        base = base.join(near, "node", "left").withColumn("_neighbors", F.coalesce("_neighbors", F.array().cast("array<string>")))
    if "degree" in derived:
        base = base.join(graph.degrees.select(F.col("id").alias("node"), F.col("k").alias("_degree")), "node", "left").na.fill(0, ["_degree"])
    if "graph_two_m" in derived:
        base = base.withColumn("_graph_two_m", F.lit(2 * graph.edge_count).cast("long"))
    if annotations is not None:
        base = base.join(annotations, "node", "left")
    for name in derived:
        own = F.coalesce(F.col(name), F.col("_" + name)) if annotations is not None and name in annotations.columns else F.col("_" + name)
        base = base.withColumn(name, own)
    return base.drop(*["_" + name for name in derived])


def annotated_pairs(graph: Graph, pairs: DataFrame, annotations: DataFrame, pair_fields: DataFrame | None = None, names: Iterable[str] = ()) -> DataFrame:
    """Pairs with types ``t_u``, ``t_v`` and columns ``u.field``, ``v.field``.

    ``pair_fields`` (lo, hi, field, value) belong to ``u`` alone; ``names`` lists them.
    """
    sides = []
    for end in ("u", "v"):
        sides.append(annotations.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}.{c}") for c in annotations.columns if c != "node"]))
    kinds = [graph.nodes.select(F.col("id").alias(end), F.col("type").alias("t_" + end)) for end in ("u", "v")]
    out = pairs
    for end, side, kind in zip(("u", "v"), sides, kinds, strict=True):
        out = out.join(graph.sent(kind), end, "left").join(side, end, "left")
    if pair_fields is not None:
        wide = pair_fields.groupBy("lo", "hi").pivot("field", list(names)).agg(F.max("value")).select("lo", "hi", *[F.col(f"`{n}`").alias(f"u.{n}") for n in names])
        out = out.join(wide, (F.least("u", "v") == F.col("lo")) & (F.greatest("u", "v") == F.col("hi")), "left").drop("lo", "hi")
    return out


def predicate(rule: Rule, columns: Iterable[str]) -> Column:
    """Whether a rule fires on an annotated pair: null if it abstains or doesn't apply."""
    known = set(columns)
    t1, t2 = rule.applies_to

    def side(first: str, second: str) -> Column:
        entities = {"a": first, "b": second} | ({t1: first, t2: second} if t1 != t2 else {})

        def lookup(entity: str, field: str) -> Column | None:
            if entity not in entities:
                raise RuleError(f"{rule.id}: unknown entity {entity!r}")
            name = f"{entities[entity]}.{field}"
            return F.col(f"`{name}`") if name in known else None

        return compile_rule(rule.when, lookup)

    forward = (F.col("t_u") == t1) & (F.col("t_v") == t2)
    backward = (F.col("t_u") == t2) & (F.col("t_v") == t1)
    return F.when(forward, side("u", "v")).when(backward, side("v", "u"))


def apply_graded(pairs: DataFrame, rules: list[Rule], prefix: str = "rule") -> DataFrame:
    """Adds ``rule_value``, ``rule_flags`` and ``rule_fired`` to annotated pairs.

    Each fired rule says 0.5 plus or minus half its weight; the value is their mean by
    weight (0 if all weights are 0), null if none fired.
    """
    graded = [r for r in rules if r.effect != "veto"]
    fired = {r.id: F.coalesce(predicate(r, pairs.columns), F.lit(False)) for r in graded}
    total = sum((F.when(fired[r.id], r.weight).otherwise(0.0) for r in graded), F.lit(0.0))
    value = {r.id: 0.5 + 0.5 * r.weight * (1 if r.effect == "safer_negative" else -1) for r in graded}
    summed = sum((F.when(fired[r.id], r.weight * value[r.id]).otherwise(0.0) for r in graded), F.lit(0.0))
    some = F.lit(False)
    for r in graded:
        some = some | fired[r.id]
    listed = lambda name: F.filter(F.array(*[F.when(fired[r.id], F.lit(name(r))) for r in graded]), lambda x: x.isNotNull()) if graded else F.array().cast("array<string>")
    return pairs.select(
        "*",
        rounded(F.when(some, F.when(total > 0, summed / total).otherwise(0.0))).alias(f"{prefix}_value"),
        F.array_distinct(F.filter(listed(lambda r: r.flag or ""), lambda x: x != "")).alias(f"{prefix}_flags"),
        listed(lambda r: r.id).alias(f"{prefix}_fired"),
    )


def apply_veto(pairs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``veto`` and ``veto_flag`` (flag or id of the first veto rule that fires)."""
    vetoes = [(F.coalesce(predicate(r, pairs.columns), F.lit(False)), r.flag or r.id) for r in rules if r.effect == "veto"]
    fires = F.lit(False)
    for p, _ in vetoes:
        fires = fires | p
    flag = F.coalesce(*[F.when(p, F.lit(name)) for p, name in vetoes], F.lit(None).cast("string"))
    return pairs.select("*", fires.alias("veto"), flag.alias("veto_flag"))
