"""Whole jobs: nothing is drawn, capped or kept where the result is of all pairs."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_more import graph_of, random_edges, rows
from unpaired import queries
from unpaired.functions.hashing import Endings
from unpaired.graph import Graph
from unpaired.operators import blocked, candidates, complement, filters, manifold, metrics, numbers, topology
from unpaired.plans import bindings as B
from unpaired.plans import experiments
from unpaired.plans.pipeline import PipelineConfig, run_pipeline

DATA = "/root/testdata/sf0.001"


def unit_rows(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.fixture(scope="module")
def embedded(spark):
    """The edges of ``coorder`` with vectors, and their unit vectors by numpy."""
    vec = {r["id"]: np.array(r["vec"], float) for r in B.embedding_table(spark, DATA).collect()}
    known = [tuple(r) for r in B.embedded_pairs(spark, DATA).collect()]
    return known, unit_rows(np.stack([vec[u] * vec[v] for u, v in known]))


def test_resemblance_is_to_all_known_pairs(spark, embedded, monkeypatch):
    """More known pairs than the sample of 2,000 had; blocks and chunks of few rows give the same."""
    known, x = embedded
    assert len(known) > manifold.BACKGROUND
    monkeypatch.setattr(manifold, "BLOCK_BYTES", 8 * 64 * 1000)
    monkeypatch.setattr(manifold, "CHUNK_BYTES", 8 * 64 * 700)
    want = dict(zip(known, np.sort(x @ x.T, axis=1)[:, -10:].mean(1), strict=True))
    got = {(r["u"], r["v"]): r["resemblance"] for r in queries.QUERIES["topk_mean_similarity"](spark, DATA).collect()}
    assert got.keys() == want.keys()
    assert all(got[p] == pytest.approx(want[p], abs=1e-4) for p in want)


def test_diversity_is_of_all_known_pairs(spark, embedded):
    known, x = embedded
    sims = x @ x.T
    np.fill_diagonal(sims, -1)
    r = queries.QUERIES["pairwise_diversity"](spark, DATA).first()
    n = len(known)
    assert r["nodes"] == len({i for p in known for i in p})
    assert r["max_cosine"] == pytest.approx(sims.max(), abs=1e-4)
    assert r["mean_cosine"] == pytest.approx((sims.sum() + n) / (n * (n - 1)), abs=1e-4)


def test_manifold_of_all_edges(spark):
    """Without a sample every edge with vectors is compared with, and calibrates against all others."""
    rng = np.random.default_rng(4)
    vec = {f"n{i:03}": rng.normal(size=6) for i in range(0, 60, 2)}
    table = spark.createDataFrame([(i, x.tolist()) for i, x in vec.items()], "id string, vec array<double>")
    g = graph_of(spark, random_edges(60, 700, 6), 60).settled()
    rep = lambda p: np.concatenate([np.minimum(vec[p[0]], vec[p[1]]), np.maximum(vec[p[0]], vec[p[1]])])
    base = unit_rows(np.stack([rep(e) for e in map(tuple, g.edges.collect()) if e[0] in vec and e[1] in vec]))
    sims = base @ base.T
    np.fill_diagonal(sims, -2)
    seen = np.sort(sims, axis=1)[:, -5:].mean(1)
    scale = np.median(seen[seen > 0])
    pairs = spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a in range(60) for b in range(a + 1, 60, 3)], "u string, v string")
    got = manifold.manifold_score(g, pairs, table, "concat", 5, sample=False).collect()
    assert len(got) == pairs.count()
    for r in got:
        if r["u"] not in vec or r["v"] not in vec:
            assert r["resemblance"] is None and r["flags"] is None
            continue
        x = rep((r["u"], r["v"]))
        want = np.sort(base @ (x / np.linalg.norm(x)))[-5:].mean()
        assert r["resemblance"] == pytest.approx(want, abs=1e-4) and r["risk"] == pytest.approx(max(want, 0) / (max(want, 0) + scale), abs=1e-4)
        assert bool(r["flags"]) == (want >= np.quantile(seen, 0.5))
    assert pairs.where(F.col("u") == "n000").count()


def test_no_known_pairs(spark):
    none = spark.createDataFrame([], "u string, v string, rep array<double>")
    one = spark.createDataFrame([("a", "b", [1.0, 0.0])], "u string, v string, rep array<double>")
    assert [tuple(r) for r in manifold.resemblance_to_all(one, none, 3).collect()] == [("a", "b", 0.0)]
    assert manifold.resemblance_to_all(one, one, 3, own=True).first()["resemblance"] is None


def test_drawn_pairs_are_summed_as_numbers(spark, monkeypatch):
    """Above the bound a drawn pool isn't named before its sums, which are the same, each pair the same way round; chunks hold few pairs."""
    edges = random_edges(80, 300, 5)
    made = lambda: graph_of(spark, edges, 80).settled()
    g = made()
    want = rows(topology.topology_score(g, candidates.rejection_sample(g, 400)))
    monkeypatch.setattr(topology.packed, "PACKED_EDGES", 0)
    for entries, pairs, fewest in ((150, 30, 10), (10**6, 50, 10)):
        for name, value in (("ENTRIES", entries), ("PAIRS", pairs), ("FEWEST_PAIRS", fewest)):
            monkeypatch.setattr(blocked, name, value)
        g = made()
        pool = candidates.rejection_sample(g, 400)
        assert numbers.keys_of(g, pool) is not None
        assert rows(topology.topology_score(g, pool)) == want
    assert len(want) == 400


def test_a_run_neither_vetoes_nor_joins_its_own_draw(spark, monkeypatch):
    """The pool of a run has no edges, so only further positives are vetoed, and its scores come without a join of pairs; the records are the same."""
    g = graph_of(spark, random_edges(90, 400, 3), 90).settled()
    config = PipelineConfig(n_eval=30, n_train=30, max_pool=10**6, filters=("known_positive_veto", "structured", "topology"))
    monkeypatch.setattr(topology.packed, "PACKED_EDGES", 0)
    monkeypatch.setattr(filters, "known_pairs", None)
    result = run_pipeline(g, config)
    scored = {(r["u"], r["v"]): (r["stream_structured"], r["stream_topology"], r["degsum"]) for r in result.scored.collect()}
    whole = experiments.frozen_pool(g, None, pairs=candidates.generate_candidates(g, None))
    assert scored == {(r["u"], r["v"]): (r["stream_structured"], r["stream_topology"], r["degsum"]) for r in whole.collect()}
    assert metrics.leakage(g, result.records).first()[0] == 0 and metrics.leakage(g, g.edges.limit(7)).first()[0] == 7
    kept = next(iter(scored))
    less = run_pipeline(g, config, context=filters.Context(g, known_positives=spark.createDataFrame([kept[::-1]], "u string, v string"))).scored
    assert {(r["u"], r["v"]) for r in less.collect()} == scored.keys() - {kept}


def test_degree_sums_of_edges(spark):
    edges = random_edges(40, 90, 2)
    g = graph_of(spark, edges, 45).settled()
    k = {r["id"]: r["k"] for r in g.degrees.collect()}
    want = sorted(k[r["u"]] + k[r["v"]] for r in g.edges.collect())
    assert sorted(r[0] for r in topology.degree_sums(g).collect()) == want


def test_complement_hashed_in_tasks(spark, monkeypatch):
    """The choice by hash is that of all listed non-edges, which don't leave the tasks; ids of all lengths are hashed as the column is."""
    texts = [b"S" * k + str(k).encode() for k in range(1, 40)]
    endings = Endings(texts)
    for prefixes in ([b"7:P1:"], [b"7:P12:", b"7:P13:"], [b"0:P123:"], [b"12:P1234:", b"12:P9999:", b"12:Q9999:"]):
        got = {(int(first + i // len(places)), int(places[i % len(places)])): int(h) for first, places, keys in endings.hashed(prefixes) for i, h in enumerate(keys)}
        assert got == {(k, i): int(hashlib.md5(x + text).hexdigest()[:13], 16) for k, x in enumerate(prefixes) for i, text in enumerate(texts)}
    edges = random_edges(60, 200, 5)
    one = Graph(graph_of(spark, edges, 64).nodes, graph_of(spark, edges, 64).edges, (("p", "p"),)).settled()
    for g in (B.supply(spark, DATA), one):
        monkeypatch.setattr(complement, "HASHED", 300)
        monkeypatch.setattr(complement, "ALIKE", 3)
        for n, seed in ((25, 7), (10**6, 0)):
            want = candidates.hash_sample(complement.pairs(g).select("u", "v"), n, seed)
            assert rows(complement.first_by_hash(g, n, seed)) == rows(want)
    monkeypatch.setattr(complement, "pairs", None)
    assert queries.QUERIES["candidate_hash_sample"](spark, DATA).count() == 749
    assert queries.QUERIES["hidden_positives"](spark, DATA).first()["n"] == 749


def test_pairs_with_paths_are_listed_without_joins(spark, monkeypatch):
    """Pairs and paths of a larger graph come out of tasks as they are, neither exchanged nor written; the paths are those of the joins."""
    near = lambda df: {(r["u"], r["v"]): pytest.approx(r["l3"], abs=1e-9) for r in df.collect()}
    edges = random_edges(60, 150, 5)
    one = lambda: Graph(graph_of(spark, edges, 64).nodes, graph_of(spark, edges, 64).edges, (("p", "p"),)).settled()
    monkeypatch.setattr(topology.packed, "PACKED_EDGES", 0)
    for made in (lambda: B.supply(spark, DATA), one):
        want = near(topology.all_l3(made()))
        assert near(complement.paths(made())) == want and want
        with monkeypatch.context() as m:
            m.setattr(complement, "EDGES", 0)
            assert near(complement.paths(made())) == want
    for name in ("l3_score", "candidate_pairs"):
        plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "FileScan" not in plan
