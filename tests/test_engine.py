"""Graph scores against brute force, selection, metrics and the whole pipeline."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from unpaired.functions import hashing, numeric
from unpaired.graph import Graph
from unpaired.operators import candidates, diversity, filters, fusion, judge, metrics, ranking, routing, selection, topology
from unpaired.plans.pipeline import PipelineConfig, run_pipeline


def make(spark, edges, nodes, admissible=(("protein", "protein"),)):
    kinds = nodes if isinstance(nodes, dict) else {n: "protein" for n in nodes}
    return Graph.from_edges(spark.createDataFrame(list(edges), "u string, v string"), spark.createDataFrame(list(kinds.items()), "id string, type string"), list(admissible) if admissible else None)


@pytest.fixture(scope="module")
def clustered(spark):
    """Three cliques of ten with two bridges, some edges hidden, one isolated node."""
    rng = random.Random(0)
    edges = [(f"c{c}_{i}", f"c{c}_{j}") for c in range(3) for i, j in itertools.combinations(range(10), 2)]
    edges += [("c0_0", "c1_0"), ("c1_0", "c2_0")]
    hidden = set(rng.sample(edges[:-2], 12))
    nodes = [f"c{c}_{i}" for c in range(3) for i in range(10)] + ["lone"]
    return make(spark, [e for e in edges if e not in hidden], nodes).settled(), hidden


def neighbors(graph):
    out = {r["id"]: set() for r in graph.nodes.collect()}
    for r in graph.edges.collect():
        out[r["u"]].add(r["v"])
        out[r["v"]].add(r["u"])
    return out


def brute_l3(n, u, v, direct=False):
    return sum(1 / math.sqrt(len(n[x]) * len(n[y])) for x in n[u] for y in n[v] if y in n[x] and not (direct and (x == v or y == u)))


def test_topology_matches_brute_force(clustered):
    graph, _ = clustered
    n = neighbors(graph)
    pairs = candidates.generate_candidates(graph)
    got = {(r["u"], r["v"]): r for r in topology.topology_score(graph, pairs).collect()}
    ids = sorted(n)
    assert set(got) == {(a, b) for a, b in itertools.combinations(ids, 2) if b not in n[a]}
    edges = [(r["u"], r["v"]) for r in graph.edges.collect()]
    s3 = np.median([x for x in (brute_l3(n, u, v, True) for u, v in edges) if x > 0])
    sr = np.median([x for x in (sum(1 / len(n[w]) for w in n[u] & n[v]) for u, v in edges) if x > 0])
    for (u, v), r in got.items():
        l3, ra = brute_l3(n, u, v), sum(1 / len(n[w]) for w in n[u] & n[v])
        assert r["cn"] == len(n[u] & n[v]) and math.isclose(r["l3"], l3, abs_tol=1e-4) and math.isclose(r["ra"], ra, abs_tol=1e-4)
        if not n[u] or not n[v]:
            assert r["value"] is None
        elif not l3 and not r["cn"]:
            assert (r["value"], r["confidence"], r["bucket"], r["flags"]) == (0.98, 0.9, "no_overlap", ["easy_negative"])
        else:
            assert math.isclose(r["risk"], 0.7 * l3 / (l3 + s3) + 0.3 * (ra / (ra + sr) if ra else 0), abs_tol=2e-4)
    every = {(r["u"], r["v"]): r["l3"] for r in topology.all_l3(graph).collect()}
    assert {p: round(x, 9) for p, x in every.items()} == {p: round(brute_l3(n, *p), 9) for p in got if brute_l3(n, *p) > 0}


def test_all_paths_with_starts_in_many_blocks(spark):
    """A hub, ties of degree and more starts than one bucket of lanes holds; a graph without edges has no paths."""
    rng, n = random.Random(2), 700
    names = [f"n{i}" for i in range(n)]
    edges = {tuple(sorted(rng.sample(names, 2))) for _ in range(1100)} | {tuple(sorted((names[0], x))) for x in names[1::3]}
    at = {x: i for i, x in enumerate(names)}
    a = np.zeros((n, n))
    for u, v in edges:
        a[at[u], at[v]] = a[at[v], at[u]] = 1
    half = np.diag(1 / np.sqrt(np.maximum(a.sum(1), 1)))
    sums = a @ half @ a @ half @ a
    want = {(u, v): round(sums[at[u], at[v]], 9) for u, v in itertools.combinations(sorted(names), 2) if sums[at[u], at[v]] > 0 and (u, v) not in edges}
    graph = make(spark, edges, names).settled()
    rows = topology.all_l3(graph).collect()
    assert len(rows) == len(want) and {(r["u"], r["v"]): round(r["l3"], 9) for r in rows} == want
    pairs = spark.createDataFrame(rng.sample(sorted(want), 300), "u string, v string")
    turned = pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))
    for some in (pairs, turned):
        assert {tuple(sorted((r["u"], r["v"]))): round(r["l3"], 9) for r in topology.l3(graph, some).collect()} == {tuple(r): want[tuple(r)] for r in pairs.collect()}
    assert topology.all_l3(make(spark, [], names[:3]).settled()).isEmpty()


def test_shortest_paths(spark):
    graph = make(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")], "abcdef")
    pairs = spark.createDataFrame([("a", "c"), ("a", "e"), ("a", "f")], "u string, v string")
    assert {r["v"]: r["dist"] for r in topology.shortest_paths(graph, pairs, 3).collect()} == {"c": 2, "e": 4, "f": 4}


def test_candidates_respect_types_and_edges(spark):
    nodes = {f"h{i}": "host" for i in range(30)} | {f"v{i}": "viral" for i in range(9)}
    graph = make(spark, [("h1", "v1"), ("h1", "h2"), ("v1", "h1")], nodes, [("viral", "host")])
    assert candidates.admissible_sizes(graph).first()["pairs"] == 270
    pairs = [(r["u"], r["v"]) for r in candidates.generate_candidates(graph).collect()]
    assert len(pairs) == len(set(pairs)) == 269 and all(u[0] == "h" and v[0] == "v" for u, v in pairs) and ("h1", "v1") not in pairs
    drawn = [(r["u"], r["v"]) for r in candidates.rejection_sample(graph, 100).collect()]
    assert len(drawn) == len(set(drawn)) == 100 and set(drawn) <= set(pairs)
    assert drawn == [(r["u"], r["v"]) for r in candidates.rejection_sample(graph, 100).collect()]
    assert make(spark, [("a", "a"), ("a", "b"), ("b", "a")], "abc", None).edges.count() == 1


def test_rejection_sampling_is_uniform(spark):
    graph = make(spark, [], [f"n{i}" for i in range(150)])
    seen = candidates.rejection_sample(graph, 8000).select(F.explode(F.array("u", "v")).alias("n")).groupBy("n").count().collect()
    counts = np.array([r["count"] for r in seen])
    assert len(counts) == 150 and counts.min() > 60 and counts.max() < 160


def test_fusion_goldens(spark):
    df = spark.createDataFrame([(0.9, 0.6), (0.8, None), (None, None), (0.9, 0.1)], "a double, b double")
    streams = {"a": F.col("a"), "b": F.col("b")}
    assert [r[0] for r in df.select(fusion.fuse(streams)).collect()] == [0.75, 0.8, 0.5, 0.5]
    assert [r[0] for r in df.select(fusion.fuse(streams, mode="entropy", lam=0.0)).collect()] == [0.75, 0.8, 0.5, 0.5]
    assert df.select(fusion.fuse(streams, mode="entropy")).first()[0] > 0.75
    said = {"a": F.lit(0.0), "b": F.lit(1.0)}
    assert df.select(fusion.fuse(streams, mode="entropy", reported=said)).first()[0] == 0.7
    h = [r[0] for r in spark.createDataFrame([(0.5,), (0.0,), (1.0,)], "p double").select(numeric.binary_entropy(F.col("p"))).collect()]
    assert h[0] == 1.0 and h[1] < 1e-6 and h[2] < 1e-6


def test_percent_rank_and_running_sums(spark):
    values = [random.Random(1).randrange(40) / 10 for _ in range(300)]
    df = spark.createDataFrame([(v, 1) for v in values], "x double, n int")
    got = ranking.percent_rank(df, "x", "r").collect()
    assert all(math.isclose(r["r"], sum(v < r["x"] for v in values) / 299) for r in got)
    sums = ranking.running_sums(df.groupBy("x").agg(F.sum("n").alias("n")), "x", ["n"], buckets=7).collect()
    assert all(r["cum_n"] == sum(v <= r["x"] for v in values) for r in sums)


@pytest.fixture(scope="module")
def pool(spark):
    rng = random.Random(3)
    rows = [(f"a{i % 17}", f"b{i}", rng.randrange(100) / 100, rng.randrange(100) / 100, rng.randrange(8)) for i in range(400)]
    return spark.createDataFrame(rows, "u string, v string, confidence double, hardness double, degsum long").persist()


def test_selections(pool):
    rows = pool.collect()
    hard = sorted(rows, key=lambda r: (-r["hardness"], r["u"], r["v"]))
    assert [r["v"] for r in selection.hard(pool, 20).collect()] == [r["v"] for r in hard[:20]]
    best = sorted(hard[:80], key=lambda r: (-r["confidence"], r["u"], r["v"]))[:20]
    assert {r["v"] for r in selection.stacked(pool, 20).collect()} == {r["v"] for r in best}
    mixed = [r["v"] for r in selection.mixture(pool, 50).collect()]
    assert len(mixed) == len(set(mixed)) == 50
    first = selection.hard(pool, 10)
    assert not {r["v"] for r in selection.select_train(pool, 20, first, "hard").collect()} & {r["v"] for r in hard[:10]}
    with pytest.raises(ValueError, match="unknown"):
        selection.select_train(pool, 1, mode="other")


def test_degree_matched_prefers_weight_and_is_repeatable(pool):
    a = selection.degree_matched(pool, 100)
    assert a.collect() == selection.degree_matched(pool, 100).collect()
    assert a.agg(F.avg("degsum")).first()[0] > pool.agg(F.avg("degsum")).first()[0] and a.where("degsum = 0").isEmpty()
    assert selection.degree_matched(pool.withColumn("degsum", F.lit(0)), 30).count() == 30


def test_psm_quota(pool):
    assert selection.quotas({1: 1, 5: 2}, [(2, 3)], 3) == {1: 1, 5: 2}
    assert selection.quotas({1: 5, 3: 5}, [(2, 2)], 9) == {1: 2}
    got = selection.psm(pool, None, 60).collect()
    assert len(got) == 60 and max(r["hardness"] for r in got) <= 0.7


def test_per_entity_cap_equals_greedy(pool):
    taken, used = [], {}
    for r in sorted(pool.collect(), key=lambda r: (-r["confidence"], r["u"], r["v"])):
        if used.get(r["u"], 0) < 3 and used.get(r["v"], 0) < 3:
            taken.append(r["v"])
            used[r["u"]], used[r["v"]] = used.get(r["u"], 0) + 1, used.get(r["v"], 0) + 1
    assert [r["v"] for r in selection.per_entity_cap(pool, 30, 3).collect()] == taken[:30]


def test_backfill(pool):
    chosen = selection.hard(pool, 10)
    flagged = chosen.limit(4)
    got = selection.drop_and_backfill(pool, chosen, flagged, 10).collect()
    assert len(got) == 10 and not {r["v"] for r in got} & {r["v"] for r in flagged.collect()}


def test_metrics(spark):
    rng = random.Random(5)
    rows = [(rng.random() < 0.4, rng.randrange(20) / 20) for _ in range(200)]
    df = spark.createDataFrame([(i, int(y), s) for i, (y, s) in enumerate(rows)], "i long, y int, score double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert math.isclose(metrics.auroc(df).first()[0], auc, abs_tol=1e-4)
    ap, last = 0.0, 0
    for s in sorted({s for _, s in rows}, reverse=True):
        tp, n = sum(x >= s for x in pos), sum(x >= s for _, x in rows)
        ap, last = ap + (tp - last) / len(pos) * tp / n, tp
    assert math.isclose(metrics.average_precision(df).first()[0], ap, abs_tol=1e-4)
    a, b = df.where("y = 1").select("score"), df.where("y = 0").select("score")
    ks = max(abs(sum(x <= s for x in pos) / len(pos) - sum(x <= s for x in neg) / len(neg)) for _, s in rows)
    assert math.isclose(metrics.ks_statistic(a, b, "score").first()[0], ks, abs_tol=1e-4)
    assert metrics.auroc(df.where("y = 1")).first()[0] is None


def test_disagreement_needs_both_values(spark):
    df = spark.createDataFrame([("a", "b", 0.9, 0.3), ("c", "d", 0.5, 0.55), ("e", "f", 0.8, None)], "u string, v string, stream_x double, stream_y double")
    flags = lambda t: [r[0] for r in df.select(routing.disagreement_flags([("x", "y")], t)).collect()]
    assert flags(0.25) == [["x_y_disagreement"], [], []] and flags(0) == [[], [], []]


def test_majority_vote_and_json(spark):
    votes = [("a", "b", i, v, c) for i, (v, c) in enumerate([("safe_negative", 0.9), ("safe_negative", 0.7), ("uncertain", 0.2)])] + [("c", "d", 0, "safe_negative", 0.9), ("c", "d", 1, "suspected_false_negative", 0.8)]
    df = spark.createDataFrame(votes, "u string, v string, vote_no int, verdict string, confidence double").withColumn("rationale", F.lit("r")).withColumn("evidence", F.array().cast("array<string>"))
    got = {r["u"]: (r["verdict"], r["confidence"], r["agreement"]) for r in judge.majority(df).collect()}
    assert got == {"a": ("safe_negative", 0.8, 0.667), "c": ("uncertain", 0.5, 0.0)}
    replies = ['{"verdict":"safe_negative","confidence":0.7}', 'so:\n```json\n{"verdict":"odd"}\n```', 'x {"confidence":0.1} y', "none", None]
    cards = [r[0] for r in spark.createDataFrame([(r,) for r in replies], "r string").select(judge.parse_card(F.col("r"))).collect()]
    assert [c and (c["verdict"], c["confidence"]) for c in cards] == [("safe_negative", 0.7), ("uncertain", 0.0), ("uncertain", 0.1), None, None]


def test_greedy_dpp_avoids_repeats():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(30, 6))
    v[1] = v[0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = diversity.greedy_map(np.ones(30), v, 10)
    assert len(got) == len(set(got)) == 6 and not {0, 1} <= set(got)


def test_hash_parity_and_folds(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("id"))
    assert {r[0] for r in df.select(hashing.parity(0, F.col("id"))).collect()} == {0, 1}
    assert {r[0] for r in df.select(hashing.fold(0, 5, F.col("id"))).collect()} == set(range(5))


def test_pipeline_invariants(spark, clustered):
    graph, hidden = clustered
    result = run_pipeline(graph, PipelineConfig(n_eval=40, n_train=40, filters=("known_positive_veto", "structured", "topology")))
    records = result.records.collect()
    n = neighbors(graph)
    assert not [r for r in records if r["v"] in n[r["u"]]]
    by = {m: {(r["u"], r["v"]) for r in records if r["mode"] == m} for m in ("eval", "train")}
    assert len(by["eval"]) == len(by["train"]) == 40 and not by["eval"] & by["train"]
    assert all(0 <= r["confidence"] <= 1 and 0 <= r["hardness"] <= 1 for r in records)
    assert result.stats["eval"] == 40 and result.stats["after_veto"] <= result.stats["candidates"]
    risk = {(r["u"], r["v"]): r["hardness"] for r in result.scored.collect()}
    concealed = [risk[tuple(sorted(e))] for e in hidden]
    assert np.mean(concealed) > np.mean(list(risk.values()))


def test_plugins_judge_and_known_positives(spark, clustered):
    graph, hidden = clustered

    class Nothing(filters.Filter):
        name, stage = "nothing", filters.Stage.VETO

        def score(self, context, pairs):
            return pairs.limit(0)

    assert run_pipeline(graph, PipelineConfig(n_eval=5, n_train=5), [Nothing(), filters.StructuredFilter(), filters.TopologyFilter()]).records.count() == 0
    assert [f.name for f in filters.build_filters("ppi")] == ["known_positive_veto", "structured", "topology", "rule_veto", "rules", "literature"]
    with pytest.raises(KeyError):
        filters.build_filters("ppi", ["absent"])
    known = spark.createDataFrame([(b, a) for a, b in hidden], "u string, v string")
    config = PipelineConfig(n_eval=30, n_train=30, fusion_mode="entropy", gated_max=10, train_selection="psm")
    result = run_pipeline(graph, config, context=filters.Context(graph, known_positives=known), rules=filters.default_rules(), judge=judge.OfflineJudge())
    records = result.records.collect()
    assert not {(r["u"], r["v"]) for r in records} & hidden
    assert 0 < sum(r["stream_literature"] is not None for r in records) <= 10 and result.stats["contested"] <= 10
