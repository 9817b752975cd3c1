"""``python -m unpaired --edges FILE --nodes FILE --out DIR``: negatives of a graph.

``--judge-remaining --out DIR`` judges the next risky pairs of a run instead.
"""

from __future__ import annotations

import argparse
from importlib import import_module

from pyspark.sql import SparkSession

from unpaired.graph import Graph
from unpaired.operators.filters import Context, default_rules
from unpaired.operators.judge import VOTES, CallableJudge, Judge, JudgeConfig, OfflineJudge
from unpaired.plans import runs
from unpaired.plans.pipeline import PipelineConfig, risky_coverage, run_pipeline
from unpaired.sources import readers


def judge_of(name: str, votes: int) -> Judge:
    """``offline``, or ``module:function``, which answers a dict with text."""
    if name == "offline":
        return OfflineJudge(JudgeConfig(votes=votes))
    module, _, function = name.partition(":")
    return CallableJudge(getattr(import_module(module), function), votes)


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="unpaired", description=__doc__)
    p.add_argument("--edges", help="two ids a line")
    p.add_argument("--nodes", help="CSV with a header: id,type")
    p.add_argument("--types", nargs="*", default=[], help="admissible type pairs a:b")
    p.add_argument("--sources", help="manifest of further positives")
    p.add_argument("--names", help="CSV with a header: id,name; what the judge is told")
    p.add_argument("--out", required=True)
    p.add_argument("--modality", default="ppi")
    p.add_argument("--n-eval", type=int, default=300)
    p.add_argument("--n-train", type=int, default=300)
    p.add_argument("--max-pool", type=int, default=200_000)
    p.add_argument("--mode", default="stacked")
    p.add_argument("--fusion", default="mean")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--judge", nargs="?", const="offline", help="review contested pairs: 'offline', or module:function")
    p.add_argument("--no-judge", action="store_true", help="no review, whatever --judge says")
    p.add_argument("--judge-k", type=int, default=40, help="most pairs reviewed in one go")
    p.add_argument("--votes", type=int, default=VOTES)
    p.add_argument("--judge-remaining", action="store_true", help="judge the next risky pairs of the run in --out")
    return p


def main(args: list[str] | None = None) -> None:
    p = arguments()
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("unpaired").getOrCreate()
    if a.judge_remaining:
        print(runs.judge_rest(spark, a.out, judge_of(a.judge or "offline", a.votes), a.judge_k))
        return
    if not (a.edges and a.nodes):
        p.error("--edges and --nodes are needed")
    who = judge_of(a.judge, a.votes) if a.judge and not a.no_judge else None
    kinds = [tuple(t.split(":")) for t in a.types] or None
    graph = Graph.from_edges(readers.edge_list(spark, a.edges), spark.read.csv(a.nodes, header=True), kinds)
    names = ["known_positive_veto", "structured", "topology", "rule_veto", "rules"] + ["literature"] * (who is not None)
    config = PipelineConfig(a.modality, a.n_eval, a.n_train, a.max_pool, a.seed, filters=tuple(names), train_selection=a.mode, fusion_mode=a.fusion, gated_max=a.judge_k)
    known = readers.positive_sources(spark, a.sources, graph.nodes, a.modality)[0] if a.sources else None
    called = spark.read.csv(a.names, header=True).select("id", "name") if a.names else None
    result = run_pipeline(graph, config, context=Context(graph, known_positives=known, names=called), rules=default_rules(), judge=who)
    stats = result.stats | {"risky_coverage": risky_coverage(result, config).first().asDict(), "settings": runs.settings(config)}
    cards = None
    if who is not None:
        said = result.records.select("u", "v", "provenance.gated")
        card = said.select("u", "v", said["gated"]["literature"].alias("c")).where("c is not null").dropDuplicates(["u", "v"])
        cards = card.select("u", "v", "c.verdict", "c.value", "c.agreement")
    runs.save(result.records, cards, stats, a.out)
    print(stats)


if __name__ == "__main__":
    main()
