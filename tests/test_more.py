"""Selection of many rows, paths, spectra, diversity, packed files, verdict tables and runs against brute force."""

import hashlib
import io
import json
import random
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from unpaired import queries
from unpaired.graph import Graph
from unpaired.operators import candidates, complement, diversity, filters, judge, manifold, metrics, ranking, selection, topology
from unpaired.plans import bindings as B
from unpaired.plans import experiments, panels, runs
from unpaired.plans.pipeline import PipelineConfig, risky_coverage, run_pipeline
from unpaired.sources import readers
from unpaired.streaming import verdicts
from unpaired.tables import folders


DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def graph_of(spark, edges, n, kind="p"):
    e = spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a, b in edges], "u string, v string")
    return Graph.from_edges(e, spark.createDataFrame([(f"n{i:03}", kind) for i in range(n)], "id string, type string"))


def random_edges(n, m, seed):
    rng = random.Random(seed)
    return {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}


@pytest.mark.parametrize("n", [0, 1, 37, 500, 990, 1000, 2000])
@pytest.mark.parametrize("few,ranges", [(5, 4), (10, 1000)])
def test_smallest_and_first_equal_a_sort(spark, n, few, ranges):
    rng = random.Random(n)
    table = [(rng.choice([3, 3, 3, rng.randint(0, 10**6), rng.randint(0, 500)]), i) for i in range(1000)]
    df = spark.createDataFrame(table, "k long, i long").repartition(3)
    assert rows(ranking.smallest(df, n, "k", 10**6 + 1, "i", few=few, ranges=ranges)) == sorted(table)[:n]
    assert rows(ranking.first(df, n, "k", "i", few=few)) == sorted(table)[:n]
    assert ranking.first(df, n, "k", "i", few=few).columns == ["k", "i"]


def test_draw_of_many_has_no_one_task_stage(spark):
    """A pool above the bound is cut by counts of key ranges; the same rows as a sort."""
    g = graph_of(spark, random_edges(300, 900, 1), 300).settled()
    drawn = candidates._draw(g, candidates._slots(g), 0, 4 * 12_000 + 1000)
    want = sorted((r["attempt"], r["u"], r["v"]) for r in drawn.collect())[:12_000]
    got = candidates.rejection_sample(g, 12_000)
    assert rows(got) == sorted((u, v) for _, u, v in want)
    cut = ranking.smallest(drawn, 12_000, "attempt", 49_000)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=12000" not in plan


def test_packed_sums_equal_joins(spark, monkeypatch):
    edges = random_edges(60, 200, 5) | {(0, i) for i in range(1, 40)} | {(70, 71), (71, 72), (72, 73)}
    pairs = spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a in range(76) for b in range(a + 1, 76) if (a, b) not in edges], "u string, v string")
    rounded_rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.na.fill(0).collect())

    def results():
        g = graph_of(spark, edges, 76).settled()
        out = [f(g, pairs, limit) for limit in (None, 6) for f in (topology.common_neighbors, topology.l3)]
        return [rounded_rows(x) for x in (*out, topology.all_l3(g), topology.l3_of_edges(g, g.edges))]

    small = results()
    monkeypatch.setattr(topology.packed, "PACKED_EDGES", 0)
    assert results() == small and all(small)


@pytest.mark.parametrize("entries,steps,cells", [(150, 20, 100), (10**6, 7, 1)])
def test_sums_in_blocks_equal_packed_sums(spark, monkeypatch, entries, steps, cells):
    """A graph above the bound: no row for each pair and neighbour is made, whatever the blocks."""
    edges = random_edges(60, 200, 5) | {(0, i) for i in range(1, 40)} | {(70, 71), (71, 72), (72, 73)}
    listed = [(f"n{a:03}", f"n{b:03}") for a in range(76) for b in range(76) if a != b and (min(a, b), max(a, b)) not in edges]
    pairs = spark.createDataFrame([*listed, *listed[:40]], "u string, v string")
    some = lambda df: {(r["u"], r["v"]): tuple(round(r[c], 9) for c in ("cn", "ra", "aa", "l3")) for r in df.where("cn > 0 or l3 > 0").collect()}
    want = [some(topology.path_sums(graph_of(spark, edges, 76).settled(), pairs, limit)) for limit in (None, 6)]
    for name, value in (("ENTRIES", entries), ("STEPS", steps), ("CELLS", cells)):
        monkeypatch.setattr(topology.blocked, name, value)
    monkeypatch.setattr(topology.packed, "PACKED_EDGES", 0)
    sums = [topology.path_sums(graph_of(spark, edges, 76).settled(), pairs, limit) for limit in (None, 6)]
    assert [some(df) for df in sums] == want and all(want)
    assert all(df.count() == len(some(df)) for df in sums)
    empty = spark.createDataFrame([], "u string, v string")
    assert topology.path_sums(graph_of(spark, edges, 76).settled(), empty).isEmpty()
    assert topology.path_sums(Graph.from_edges(empty, spark.createDataFrame([("a", "p")], "id string, type string")), pairs).isEmpty()


def test_whole_complement_listed_and_scored(spark, monkeypatch):
    """Every admissible non-edge with its scores and its rank among all of them, listed in tasks or joined."""
    rng = random.Random(3)
    kinds = [(f"p{i}", "part") for i in range(30)] + [(f"s{i}", "supplier") for i in range(8)]
    edges = {(f"p{rng.randrange(25)}", f"s{rng.randrange(7)}") for _ in range(60)}
    both = [tuple(sorted(rng.sample(range(30), 2))) for _ in range(40)]
    edges |= {tuple(sorted((f"p{a}", f"p{b}"))) for a, b in both}

    def results():
        out = []
        for admissible in ([("part", "supplier")], [("part", "supplier"), ("part", "part")]):
            g = Graph.from_edges(spark.createDataFrame(sorted(edges), "u string, v string"), spark.createDataFrame(kinds, "id string, type string"), admissible).settled()
            own = experiments.scored_complement(g)
            out.append(sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in own.select(sorted(own.columns)).collect()))
            names = sorted(own.columns)
            pool = candidates.generate_candidates(g, None)
            old = experiments.frozen_pool(g, None, pairs=pool)
            assert out[-1] == sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in old.select(names).collect())
            assert len(out[-1]) == pool.count() == complement.pairs(g).count()
            known = spark.createDataFrame([("s7", "p1"), ("p2", "s6")], "u string, v string")
            context = filters.Context(g, known_positives=known)
            veto = filters.KnownPositiveVeto()
            assert rows(veto.complement(context)) == rows(veto.score(context, pool).select("u", "v"))
        return out

    small = results()
    monkeypatch.setattr(topology.packed, "PACKED_EDGES", 0)
    assert results() == small and all(small)


def test_choices_of_the_complement_list_no_pairs_without_sums(spark, monkeypatch):
    """The first pairs by hardness or confidence are those of listing and sorting all, ties and isolated nodes included."""
    rng = random.Random(7)
    kinds = [(f"p{i}", "part") for i in range(40)] + [(f"s{i}", "supplier") for i in range(12)]
    edges = {(f"p{a}", f"s{rng.randrange(a % 3 * 3, a % 3 * 3 + 3)}") for a in (rng.randrange(33) for _ in range(60))} | {("p34", "p35"), ("p35", "p36")}
    monkeypatch.setattr(complement, "TASK_STARTS", 5)
    admissible = [("part", "supplier"), ("part", "part")]
    g = Graph.from_edges(spark.createDataFrame(sorted(edges), "u string, v string"), spark.createDataFrame(kinds, "id string, type string"), admissible).settled()
    whole = experiments.scored_complement(g).toPandas().round(9)
    counted = complement.counted(g)
    assert counted.agg({"n": "sum"}).first()[0] == len(whole) and counted.where("n > 1").count() > 0
    monkeypatch.setattr(complement, "pairs", None)
    for by, n in (("hardness", 30), ("confidence", 200)):
        want = whole.sort_values([by, "u", "v"], ascending=[False, True, True]).head(n)
        got = experiments.first_of_complement(g, n, by).toPandas().round(9)
        columns = [c for c in got.columns if c in want.columns]
        assert set(want.columns) - set(columns) <= ({"hardness"} if by == "confidence" else set())
        key = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))  # noqa: B023, E731
        assert key(got) == key(want)


def test_complement_of_a_large_graph_is_not_exchanged(spark, monkeypatch):
    """Above the bound of packed sums the non-edges are listed in tasks too; above that of the complement they are joined, with the same rows."""
    monkeypatch.setattr(topology.packed, "PACKED_EDGES", 0)
    made = lambda: graph_of(spark, random_edges(40, 90, 2), 45)
    g = Graph(made().nodes, made().edges, (("p", "p"),)).settled()
    own = complement.pairs(g, sums=True)
    assert "Exchange" not in own._jdf.queryExecution().toString()
    rounded_rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select("u", "v", "k_u", "k_v", "cn", "ra", "l3").collect())
    monkeypatch.setattr(complement, "EDGES", 0)
    joined = Graph(g.nodes, g.edges, g.admissible).settled()
    assert rounded_rows(own) == rounded_rows(complement.pairs(joined, sums=True))
    columns = ["u", "v", "hardness", "confidence"]
    monkeypatch.undo()
    few = [rows(experiments.first_of_complement(x, 25, "hardness").select(columns)) for x in (g, joined)]
    assert few[0] == few[1] and len(few[0]) == 25


def test_complement_above_the_bounds_passes_cells(spark, monkeypatch):
    """Above the bounds too no pair is exchanged: cells and chunks of any size give the rows of a graph that is sent, with and without sums and names."""
    rng = random.Random(5)
    kinds = [(f"p{i}", "part") for i in range(50)] + [(f"s{i}", "supplier") for i in range(13)]
    edges = {(f"p{rng.randrange(44)}", f"s{rng.randrange(11)}") for _ in range(110)} | {tuple(sorted((f"p{a}", f"p{b}"))) for a, b in random_edges(44, 30, 8)}
    admissible = [("part", "part"), ("part", "supplier"), ("part", "none")]
    made = lambda: Graph.from_edges(spark.createDataFrame(sorted(edges), "u string, v string"), spark.createDataFrame(kinds, "id string, type string"), admissible).settled()
    key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(sorted(df.columns)).collect())
    forms = ({"sums": True}, {}, {"sums": True, "names": False})
    small = made()
    want = [key(complement.pairs(small, **f)) for f in forms]
    monkeypatch.setattr(complement, "EDGES", 0)
    for sizes in ({}, {"ENTRIES": 9, "ENDS": 7, "PAIRS": 60, "BATCH": 4}):
        for name, size in sizes.items():
            monkeypatch.setattr(complement.listing, name, size)
        large = made()
        assert [key(complement.pairs(large, **f)) for f in forms] == want
        plan = complement.pairs(large, sums=True)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "HashJoin" not in plan


def test_ranks_above_the_bounds_exchange_few_counts(spark, monkeypatch):
    """The counts behind ranks come from a bounded number of tasks, however many list the pairs, with the same ranks."""
    edges = random_edges(40, 90, 2)
    made = lambda: Graph(graph_of(spark, edges, 45).nodes, graph_of(spark, edges, 45).edges, (("p", "p"),)).settled()
    key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select("u", "v", "hardness_raw", "hardness").collect())
    want = key(experiments.scored_complement(made()))
    monkeypatch.setattr(complement, "EDGES", 0)
    monkeypatch.setattr(complement.listing, "PAIRS", 90)
    monkeypatch.setattr(experiments, "COUNTING", 3)
    large = made()
    assert key(experiments.scored_complement(large)) == want
    assert complement.pairs(large, sums=True).rdd.getNumPartitions() > 3
    assert "Coalesce 3" in experiments._counts(large, "hardness_raw")._jdf.queryExecution().executedPlan().toString()


def test_only_lines_of_embedded_parts_are_paired(spark, monkeypatch):
    """The pairs with vectors are those of the whole graph, which isn't built for them; a few are dealt to several tasks."""
    vec = B.embedding_table(spark, DATA).where("id like '%7'")
    want = rows(manifold.known_pairs(B.coorder(spark, DATA).edges, vec))
    whole = B.table
    monkeypatch.setattr(B, "table", lambda s, d, name: whole(s, d, name).where("vec_id % 10 = 7") if name == "embeddings" else whole(s, d, name))
    monkeypatch.setattr(B, "coorder", None)
    got = B.embedded_pairs(spark, DATA)
    assert rows(got) == want and want
    assert manifold.dealt(got).rdd.getNumPartitions() == 4
    assert queries.QUERIES["topk_mean_similarity"](spark, DATA).count() == len(want)


def test_vectors_move_only_for_pairs_that_need_them(spark):
    """Pairs are drawn and left out by ids; the vectors and scores are those of joining every pair with both."""
    rng = np.random.default_rng(4)
    vec = spark.createDataFrame([(f"n{i:03}", rng.normal(size=6).astype(np.float32).tolist()) for i in range(0, 40, 2)], "id string, vec array<float>")
    g = graph_of(spark, random_edges(40, 300, 6), 40).settled()
    want = candidates.hash_sample(manifold.pair_vectors(g.edges, vec).where("rep is not null"), 20)
    got = manifold.sampled_vectors(g.edges, vec, 20)
    assert rows(got.select("u", "v", "rep")) == rows(want.select("u", "v", "rep"))
    assert rows(manifold.known_vectors(manifold.known_pairs(g.edges, vec), vec).select("u", "v", "rep")) == rows(manifold.pair_vectors(g.edges, vec).where("rep is not null").select("u", "v", "rep"))
    pairs = spark.createDataFrame([(f"n{a:03}", f"n{b:03}", a) for a in range(40) for b in range(a + 1, 40, 3)], "u string, v string, extra int")
    scored = {(r["u"], r["v"]): r for r in manifold.manifold_score(g, pairs, vec).collect()}
    assert len(scored) == pairs.count()
    assert all((r["resemblance"] is None) == (int(u[1:]) % 2 + int(v[1:]) % 2 > 0) for (u, v), r in scored.items())


def test_means_half_way_are_rounded_up_in_any_order(spark):
    """Means like 0.94485 come out as 0.9449, where sums of doubles may fall below."""
    rng = random.Random(8)
    table, want = [], {}
    for i in range(60):
        ints = [rng.randint(9000, 9999) for _ in range(26)]
        while sum(ints) % 26 != 13:
            ints[-1] -= 1
        table += [(str(i), x / 10000, x / 10000, []) for x in ints]
        want[str(i)] = (sum(ints) + 13) // 26 / 10000
    assert any(np.floor(sum(h for m, _, h, _ in table if m == i) / 26 * 10000 + 0.5) / 10000 != w for i, w in want.items())
    records = spark.createDataFrame(table, "mode string, confidence double, hardness double, flags array<string>").repartition(3)
    got = panels.confidence_groups(records).collect()
    assert {r["mode"]: r["mean_hardness"] for r in got} == want == {r["mode"]: r["mean_confidence"] for r in got}
    assert {r["mode"]: r["mean_hardness"] for r in metrics.hardness_split(records).collect()} == want


@pytest.mark.parametrize("name", ["candidate_hash_sample", "known_positive_veto", "structured_score", "hidden_positives"])
def test_supply_queries_take_every_non_edge(spark, name):
    """A draw of as many pairs as edges isn't the job: the SQL and the code take the whole complement."""
    assert "attempt" not in queries.ORACLES[name] and "tries" not in queries.ORACLES[name]
    if name == "structured_score":
        assert queries.QUERIES[name](spark, DATA).count() == queries.QUERIES["candidate_pairs"](spark, DATA).count()


def test_shortest_paths_equal_breadth_first_search(spark):
    edges = {(i, i + 1) for i in range(12)} | {(20, 21), (20, 22), (3, 30), (30, 31)} | {(a + 40, b + 40) for a, b in random_edges(12, 20, 4)}

    def distances(s):
        d, queue = {s: 0}, [s]
        for x in queue:
            for a, b in edges:
                for y in (b,) if a == x else (a,) if b == x else ():
                    if y not in d:
                        d[y] = d[x] + 1
                        queue.append(y)
        return d

    pairs = [(a, b) for a in range(55) for b in range(a, 55, 4)]
    g = graph_of(spark, edges, 55)
    asked = spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a, b in pairs], "u string, v string")
    got = {(r["u"], r["v"]): r["dist"] for r in topology.shortest_paths(g, asked).collect()}
    assert got == {(f"n{a:03}", f"n{b:03}"): min(distances(a).get(b, 7), 7) for a, b in pairs}


def test_spectral_embeddings_equal_a_dense_decomposition(spark):
    n = 40
    edges = random_edges(n, 110, 2)
    dense = np.zeros((n + 2, n + 2))
    for a, b in edges:
        dense[a, b] = dense[b, a] = 1
    got = manifold.spectral_embeddings(graph_of(spark, edges, n + 2), 6, tolerance=1e-9, iterations=80).collect()
    x = np.zeros((n + 2, 6))
    for r in got:
        x[int(r["id"][1:])] = r["vec"]
    assert len(got) == len({i for e in edges for i in e})
    assert np.abs(np.linalg.norm(x, axis=0) - np.linalg.svd(dense)[1][:6]).max() < 1e-6


def test_spectral_embeddings_of_low_rank_and_tiny_graphs(spark):
    star = manifold.spectral_embeddings(graph_of(spark, {(0, i) for i in range(1, 8)}, 8), 4).collect()
    norms = np.linalg.norm(np.array([r["vec"] for r in star]), axis=0)
    assert np.allclose(norms, 7**0.5) and len(norms) == 2
    assert manifold.spectral_embeddings(graph_of(spark, {(0, 1)}, 2)).count() == 0


def vectors(spark, n, seed, size=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x, spark.createDataFrame([(f"a{i}", f"b{i % 7}", 1.0, v.tolist()) for i, v in enumerate(x)], "u string, v string, quality double, rep array<double>")


@pytest.mark.parametrize("block", [1000, 7])
def test_diversity_equals_all_pairs(spark, block):
    x, df = vectors(spark, 40, 3)
    sims = (x @ x.T)[np.triu_indices(40, 1)]
    r = diversity.diversity(df, block=block).first()
    assert (r["mean_cosine"], r["max_cosine"], r["nodes"]) == (pytest.approx(sims.mean(), abs=1e-4), pytest.approx(sims.max(), abs=1e-4), 47)
    one = diversity.diversity(df.limit(1)).first()
    assert (one["mean_cosine"], one["max_cosine"]) == (None, None)


def test_core_sets_come_near_one_group(spark):
    x, df = vectors(spark, 600, 5, 12)
    whole = diversity.diverse(df, 8)
    parts = diversity.diverse(df, 8, cell=40)
    at = lambda d: [int(r["u"][1:]) for r in d.collect()]
    score = lambda d: diversity.log_determinant(np.ones(8), x[at(d)])
    assert len(set(at(parts))) == 8 and sorted(r["dpp_rank"] for r in parts.collect()) == list(range(8))
    assert score(parts) > score(whole) - 0.5
    assert at(whole) == diversity.greedy_map(np.ones(600), x[order := sorted(range(600), key=lambda i: f"a{i}")], 8) or {order[i] for i in diversity.greedy_map(np.ones(600), x[order], 8)} == set(at(whole))


def test_quotas_equal_taking_one_by_one():
    rng = random.Random(1)
    for _ in range(500):
        supply = {rng.randint(0, 30): rng.randint(0, 6) for _ in range(rng.randint(0, 10))}
        wanted = {rng.randint(0, 30): rng.randint(0, 8) for _ in range(rng.randint(0, 8))}
        n, left, want = rng.randint(0, 40), {k: v for k, v in supply.items() if v}, {}
        matched = selection.shares(wanted, n)
        assert sum(matched.values()) == min(n, sum(wanted.values())) and all(matched[d] <= wanted[d] for d in matched)
        for d in sorted(matched, key=lambda x: hashlib.md5(f"0:{x}".encode()).hexdigest()):
            for _ in range(matched[d]):
                if left:
                    k = min(left, key=lambda k: (abs(k - d), k))
                    want[k] = want.get(k, 0) + 1
                    left[k] -= 1
                    if not left[k]:
                        del left[k]
        assert selection.quotas(supply, sorted(wanted.items()), n) == want
    began = time.time()
    assert sum(selection.quotas({i: 2_000 for i in range(3_000)}, [(i, 1_000) for i in range(3_000)], 3_000_000).values()) == 3_000_000
    assert time.time() - began < 5


def test_entity_cap_equals_greedy(spark, monkeypatch):
    monkeypatch.setattr(selection, "PREFIX", 2)
    rng = random.Random(9)
    pairs = [(f"e{a}", f"e{b}", rng.randint(0, 50) / 50) for a, b in random_edges(25, 160, 7)]
    df = spark.createDataFrame(pairs, "u string, v string, confidence double")
    for n, cap in ((5, 1), (20, 2), (100, 3)):
        used, want = {}, []
        for u, v, c in sorted(pairs, key=lambda x: (-x[2], x[0], x[1])):
            if len(want) < n and used.get(u, 0) < cap and used.get(v, 0) < cap:
                used[u], used[v] = used.get(u, 0) + 1, used.get(v, 0) + 1
                want.append((u, v, c))
        assert rows(selection.per_entity_cap(df, n, cap)) == sorted(want)


def test_contamination_and_recall(spark):
    scored = [(i, int(i < 10), None if i == 3 else (i % 7) / 7, i % 3 == 0, i / 100) for i in range(60)]
    r = metrics.contamination(spark.createDataFrame(scored, "id long, y int, signal double, flag boolean, other double"), 0.1).first()
    assert (r["n_hidden"], r["n_clean"], r["added"]) == (9, 50, 5) and r["dropped_clean"] == sum(1 for x in scored[10:] if x[3])
    said = spark.createDataFrame([(1, "suspected_false_negative"), (1, "uncertain"), (0, "safe_negative"), (0, "suspected_false_negative"), (0, "safe_negative"), (0, "uncertain")], "y int, verdict string")
    assert tuple(metrics.judged_recall(said).first()) == (0.5, 0.25, 0.25)
    assert rows(metrics.verdict_shares(said)) == [("safe_negative", 0.0, 0.5), ("suspected_false_negative", 0.5, 0.25), ("uncertain", 0.5, 0.25)]


def test_injection_has_matched_arms_and_harm(spark):
    g = graph_of(spark, random_edges(60, 300, 3), 60).settled()
    out = experiments.injection(g, experiments.hidden_edges(g, 20), 300, 60, models=("lr",)).collect()
    assert {r["arm"] for r in out} == {"random_raw", "random_veto", "topology_hard", "topology_safe", "stacked", "mixture", "counterfactual", "psm[0.7]", "psm[0.5]"}
    assert all(r["injected"] == 20 and 0 <= r["selected"] <= 20 and 0 <= r["auroc_lr"] <= 1 for r in out)


def test_benchmark_measures_both_ends(spark):
    predictions = [(f"u{i}", "v", int(i % 2), i / 40, i > 8) for i in range(40)]
    r = experiments.measures(spark.createDataFrame(predictions, "u string, v string, y int, score double, linked boolean"), 20, 20, hits=4).first()
    assert (r["hits_high"], r["hits_low"]) == (0.5, 0.5) and r["auroc_linked"] is not None
    few = spark.createDataFrame(predictions[:12], "u string, v string, y int, score double, linked boolean")
    assert experiments.measures(few, 6, 6).first()["auroc_linked"] is None


# --- the judge ---


def test_prompt_and_patience(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "b", "Alpha", None), ("c", "d", None, None)], "u string, v string, name_u string, name_v string")
    texts = [r[0] for r in pairs.select(judge.prompt({"first": F.col("name_u"), "second": F.col("name_v")})).collect()]
    assert "- first: Alpha" in texts[0] and "second" not in texts[0] and "known of them" not in texts[1] and "a and b" in texts[0]
    tries = str(tmp_path)

    def ask(row):
        import os
        import time

        at = f"{tries}/{row['u']}-{row['vote_no']}"
        first = not os.path.exists(at)
        open(at, "w").close()
        if row["u"] == "a" and first:
            raise RuntimeError("busy")
        if row["u"] == "c":
            time.sleep(3)
        assert row["prompt"].startswith("Two entities")
        return '{"verdict": "uncertain", "confidence": 0.5}'

    who = judge.CallableJudge(ask, 2, judge.JudgeConfig(timeout_s=0.5, retries=1))
    got = who.judge(pairs).collect()
    assert sorted((r["u"], r["vote_no"]) for r in got) == [("a", 0), ("a", 1)]


def test_verdict_key_holds_names(spark):
    g = graph_of(spark, {(0, 1), (1, 2)}, 4)
    pairs = spark.createDataFrame([("n000", "n002"), ("n000", "n003")], "u string, v string")
    name = lambda text: spark.createDataFrame([("n002", text)], "id string, name string")
    key = lambda context: {r["v"]: r["key"] for r in filters.JudgeFilter.keyed(context, pairs).collect()}
    old, new, none = key(filters.Context(g, names=name("x"))), key(filters.Context(g, names=name("y"))), key(filters.Context(g))
    assert old["n002"] != new["n002"] != none["n002"] and old["n003"] == new["n003"] == none["n003"]
    stored = spark.createDataFrame([(old["n002"], "safe_negative", 0.9, 1.0, 1), (old["n002"], "uncertain", 0.5, 1.0, 2)], "key string, verdict string, confidence double, agreement double, written_at int")
    scored = filters.JudgeFilter().score(filters.Context(g, names=name("x"), verdicts=stored), pairs)
    assert rows(scored.select("u", "v", F.coalesce("verdict", F.lit("-")))) == [("n000", "n002", "uncertain"), ("n000", "n003", "-")]


# --- packed files ---


def test_npz(spark, tmp_path):
    for part, ids in (("a", np.array(["x", "y"])), ("b", np.arange(5000))):
        np.savez(tmp_path / f"{part}.npz", ids=ids, emb=np.arange(len(ids) * 3, dtype=np.float32).reshape(-1, 3))
    got = {r["id"]: r["vec"] for r in readers.embeddings_npz(spark, str(tmp_path)).collect()}
    assert len(got) == 5002 and got["y"] == [3.0, 4.0, 5.0] and got["4999"] == [14997.0, 14998.0, 14999.0]


def workbook(cells):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared = sorted({c for r in cells for c in r if isinstance(c, str)})
    body = ""
    for i, row in enumerate(cells, 1):
        body += f"<row r='{i}'>" + "".join(f"<c r='{chr(65 + j)}{i}' t='s'><v>{shared.index(c)}</v></c>" if isinstance(c, str) else f"<c r='{chr(65 + j)}{i}'><v>{c}</v></c>" for j, c in enumerate(row) if c is not None) + "</row>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook xmlns='{main}' xmlns:r='{rel}'><sheets><sheet name='Other' sheetId='1' r:id='rId1'/><sheet name='Network_Table' sheetId='2' r:id='rId2'/></sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'><Relationship Id='rId1' Target='worksheets/sheet1.xml'/><Relationship Id='rId2' Target='worksheets/sheet2.xml'/></Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst xmlns='{main}'>" + "".join(f"<si><r><t>{x[:1]}</t></r><r><t>{x[1:]}</t></r></si>" for x in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet xmlns='{main}'><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet xmlns='{main}'><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_spreadsheet_graph(spark, tmp_path):
    (tmp_path / "t.xlsx").write_bytes(workbook([["Bait", "n", "PreyUniprotAcc", "PreyGeneName"], ["nsp1", 1, "P1", "G1"], ["G1", 2.5, "P2", None], ["E", None, "P2", "G2"], [None, 3, "P9", "G9"]]))
    table = readers.spreadsheet(spark, str(tmp_path / "t.xlsx"), "Network_Table", ["Bait", "PreyUniprotAcc", "PreyGeneName", "n"])
    assert [r["n"] for r in table.orderBy("n").collect()] == [None, "1", "2.5", "3"]
    g = readers.host_pathogen_graph(table)
    assert rows(g.edges) == [("E", "P2"), ("P1", "P2"), ("P1", "nsp1")]
    with pytest.raises(Exception, match="no column"):
        readers.spreadsheet(spark, str(tmp_path / "t.xlsx"), "Network_Table", ["absent"]).collect()
    with pytest.raises(Exception, match="no sheet"):
        readers.spreadsheet(spark, str(tmp_path / "t.xlsx"), "absent", ["Bait"]).collect()


def test_pocket_descriptors(spark, tmp_path):
    (tmp_path / "A1_info.txt").write_text("\n\nPocket 1 :\n\tScore : \t0.5\n\tVolume : \t512.12345\n\tHydrophobicity score:\t33.25\n\tProportion of polar atoms: \t41.5\n\tNot a number: x\n\nPocket 2 :\n\tVolume : 9\n")
    (tmp_path / "B2_info.txt").write_text("\n \n")
    (tmp_path / "C3_info.txt").write_text("Pocket 1 :\n\tVolume : 7\n")
    (tmp_path / "D4_info.txt").write_text("Pocket 1 :\n\tScore : 7\n\nPocket 2 :\n\tVolume : 8\n")
    got = sorted(map(tuple, readers.pocket_descriptors(spark, str(tmp_path)).collect()))
    assert got == [("A1", 512.1235, 33.25, 0.415), ("C3", 7.0, None, None)]


def atom(serial, name, residue, chain, number, xyz, plddt):
    return f"ATOM  {serial:5d} {name:^4s} {residue:3s} {chain}{number:4d}    {xyz[0]:8.3f}{xyz[1]:8.3f}{xyz[2]:8.3f}  1.00{plddt:6.2f}"


def test_interface_contacts_equal_all_distances(spark, tmp_path):
    rng = np.random.default_rng(3)
    chains = {c: [(i + 1, rng.uniform(0, 30, 3).round(3), round(float(rng.uniform(30, 99)), 2)) for i in range(40)] for c in "BAC"}
    lines = ["HEADER", atom(1, "CB", "ALA", "B", 1, (500, 500, 500), 10.0)]  # a later record of the residue counts
    for c, own in chains.items():
        for i, xyz, p in own:
            lines += [atom(i, "CA", "ALA", c, i, (0, 0, 0), 1.0)] if i % 5 else []
            lines.append(atom(i, "CA" if i % 5 == 0 else "CB", "GLY" if i % 5 == 0 else "ALA", c, i, xyz, p))
    (tmp_path / "x.pdb").write_text("\n".join([*lines, "END"]))
    (tmp_path / "far.pdb").write_text("\n".join([atom(1, "CB", "ALA", "A", 1, (0, 0, 0), 50.0), atom(2, "CB", "ALA", "B", 1, (8, 0, 0), 50.0)]))
    got = {(r["file"].rsplit("/", 1)[1], r["a"], r["b"]): (r["contacts"], r["plddt"], r["pdockq"]) for r in readers.interface_contacts(readers.residues(spark, str(tmp_path))).collect()}
    assert got.pop(("far.pdb", "A", "B")) == (0, None, 0.0)
    assert set(got) == {("x.pdb", "B", "A"), ("x.pdb", "B", "C"), ("x.pdb", "A", "C")}
    for (_, a, b), (contacts, plddt, score) in got.items():
        near = [(i, j) for i, (_, x, _) in enumerate(chains[a]) for j, (_, y, _) in enumerate(chains[b]) if np.linalg.norm(x - y) < 8]
        mean = np.mean([chains[a][i][2] for i in {i for i, _ in near}] + [chains[b][j][2] for j in {j for _, j in near}])
        assert contacts == len(near) and plddt == pytest.approx(mean)
        assert score == pytest.approx(0.724 / (1 + np.exp(-0.052 * (mean * np.log(len(near)) - 152.611))) + 0.018, abs=1e-4)


# --- verdict tables and runs ---


def written(path, name, verdicts_):
    (path / name).write_text("\n".join(json.dumps({"key": k, "u": "a", "v": "b", "verdict": v, "confidence": 0.5, "agreement": 1.0, "written_at": f"2024-01-01T00:00:{t:02}.000Z"}) for k, v, t in verdicts_))


def test_verdict_table_rewrites_touched_buckets_only(spark, tmp_path):
    incoming, table, check = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "check")
    incoming.mkdir()
    written(incoming, "1.json", [(f"k{i}", "safe_negative", 5) for i in range(200)])
    follow = lambda: verdicts.follow(spark, str(incoming), table, check, 32).awaitTermination()
    follow()
    before = verdicts._versions(spark, table)
    assert sum(map(len, before.values())) == len(before) > 20
    written(incoming, "2.json", [("k7", "uncertain", 9), ("k7", "safe_negative", 8)])
    follow()
    after = verdicts._versions(spark, table)
    assert [b for b in after if after[b] != before[b]] and sum(after[b] != before[b] for b in after) == 1
    written(incoming, "3.json", [("k7", "suspected_false_negative", 1), ("new", "uncertain", 1)])  # late
    follow()
    written(incoming, "4.json", [("k7", "uncertain", 9)])  # repeated
    follow()
    got = {r["key"]: r["verdict"] for r in verdicts.current(spark, table).collect()}
    assert len(got) == 201 and got["k7"] == "uncertain" and got["k8"] == "safe_negative"
    assert max(map(len, verdicts._versions(spark, table).values())) <= 2  # old versions are gone
    assert verdicts.current(spark, str(tmp_path / "none")) is None


def test_run_is_judged_on_and_survives_a_crash(spark, tmp_path):
    g = graph_of(spark, random_edges(40, 120, 8), 40)
    config = PipelineConfig(n_eval=40, n_train=20, filters=("known_positive_veto", "structured", "topology", "literature"), false_negative_pct=0.2, gated_max=3, fusion_mode="entropy")
    votes = '{"verdict": "safe_negative", "confidence": 0.9}'
    who = judge.CallableJudge(lambda row, votes=votes: votes, 1)
    result = run_pipeline(g, config, judge=who)
    coverage = risky_coverage(result, config).first().asDict()
    assert coverage["judged"] <= 3 == coverage["gated_cap"] and coverage["risky"] == coverage["judged"] + coverage["unjudged"] and coverage["contested_total"] >= 3
    out = str(tmp_path / "run")
    runs.save(result.records, None, {"risky_coverage": coverage, "settings": runs.settings(config)}, out)
    old, cards, _ = runs.load(spark, out)
    old = {(r["u"], r["v"], r["mode"]): r for r in old.collect()}
    assert cards is None
    stats = runs.judge_rest(spark, out, who, 2)
    records, cards, again = runs.load(spark, out)
    assert again == stats and cards.count() == 2 and stats["risky_coverage"]["judged"] >= 1 and stats["settings"]["fusion_mode"] == "entropy"
    judged = {(r["u"], r["v"]) for r in cards.collect()}
    for r in records.collect():
        was = old[r["u"], r["v"], r["mode"]]
        if (r["u"], r["v"]) in judged:
            assert "llm_safe_negative" in r["flags"] and r["stream_literature"] == 0.9
        else:
            assert r["confidence"] == was["confidence"] and r["flags"] == was["flags"]
    at = runs.begin(records.where("false"), None, {}, out)  # a crash before the switch
    assert runs.load(spark, out)[0].count() == len(old)
    runs.judge_rest(spark, out, who, 2)
    assert runs.load(spark, out)[1].count() == 4
    assert len([x for x in folders(spark, out) if x.startswith("version=")]) == 2 and at.startswith(out)


# --- pairs as numbers ---


def test_pairs_of_a_large_graph_are_exchanged_as_numbers(spark, monkeypatch):
    """Above the bound, no exchange of the scores of pairs carries ids, and no pair is joined with its sums; the scores stay the same."""
    edges = random_edges(50, 160, 7)
    pairs = spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a in range(50) for b in range(50) if a != b and (min(a, b), max(a, b)) not in edges][:600] + [("n001", "none")], "u string, v string")
    scores = lambda: topology.topology_score(graph_of(spark, edges, 52).settled(), pairs)
    small = scores()
    monkeypatch.setattr(topology.packed, "PACKED_EDGES", 0)
    large = scores()
    settled = lambda df: sorted(tuple(str(x) for x in r) for r in df.select("u", "v", "k_u", "k_v", "cn", "ra", "l3", "risk", "value", "bucket").collect())
    assert settled(large) == settled(small)
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(u#" not in plan and "SortMergeJoin" not in plan and "hashpartitioning(g#" in plan


def test_attempts_are_hashed_in_batches(spark):
    """Many hashes at once are those of the column, and rules that ask for no neighbours read no edges."""
    from unpaired.functions.hashing import hash52, hash52_of
    from unpaired.operators import rules

    numbers_ = np.array([0, 9, 10, 99, 100, 12_345, 10**9, 10**17, 10**18, *range(7, 4000, 37)])
    want = [r[0] for r in spark.createDataFrame([(x,) for x in numbers_.tolist()], "x long").select(hash52(3, "ub", F.col("x"))).collect()]
    assert hash52_of("3:ub", numbers_).tolist() == want
    g = graph_of(spark, random_edges(20, 40, 2), 20).settled()
    whole, none = rules.annotate(g), rules.annotate(g, derived=())
    assert none.columns == ["node"] and whole.columns == ["node", "neighbors", "degree", "graph_two_m"] and "/edges-" not in str(none.inputFiles())
    count = g.edges.count()
    assert all(len(r["neighbors"]) == r["degree"] and r["graph_two_m"] == 2 * count for r in whole.collect())
