"""Pairs whichever way round, and the parts that no other test reaches."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_engine import make
from tests.test_io import put, rows
from unpaired.functions import numeric
from unpaired.graph import Graph, excluding
from unpaired.operators import candidates, filters, fusion, judge, metrics, selection, topology
from unpaired.plans import experiments, panels
from unpaired.plans.pipeline import PipelineConfig, run_pipeline, validation
from unpaired.sources import readers, writers
from unpaired.streaming import verdicts


@pytest.fixture(scope="module")
def typed(spark):
    """Hosts z* and virals a*: ids sort against their types."""
    nodes = {f"z{i}": "host" for i in range(7)} | {f"a{i}": "viral" for i in range(5)}
    edges = [(f"a{i % 5}", f"z{i % 7}") for i in range(0, 35, 3)] + [("a0", "z1")]
    return make(spark, edges, nodes, [("host", "viral")]).settled()


def ends(df):
    return {frozenset((r["u"], r["v"])) for r in df.collect()}


def test_known_pairs_are_vetoed_whichever_way_round(spark, typed):
    pool = candidates.generate_candidates(typed)
    assert all(u[0] == "z" and v[0] == "a" for u, v in rows(pool.select("u", "v")))
    known = spark.createDataFrame([tuple(sorted(x)) for x in list(ends(pool))[:5]], "u string, v string")
    assert ends(known) & ends(pool) == ends(known)
    for arm, got in experiments.arms(experiments.frozen_pool(typed, None, pairs=pool), known, 100).items():
        assert bool(ends(got) & ends(known)) == (arm == "random_raw")
    assert not ends(excluding(pool, known)) & ends(known) and selection.without(pool, known).count() == pool.count() - 5


def test_hidden_edges_enter_the_pool_once(spark, typed):
    hidden = experiments.hidden_edges(typed, 6)
    assert all(u < v for u, v in rows(hidden))
    got = {r["arm"]: r for r in experiments.injection(typed, hidden, None, 1000).collect()}
    assert got["random_raw"]["injected"] == 6 and got["random_raw"]["selected"] == got["random_veto"]["selected"] == 6
    turned = typed.oriented(hidden)
    assert all(u[0] == "z" for u, _ in rows(turned)) and ends(turned) == ends(hidden)


def test_the_whole_complement_is_listed_by_types(spark, typed):
    pool = candidates.generate_candidates(typed, max_pool=None)
    assert pool.count() == 35 - typed.edges.count() == len(ends(pool))
    free = make(spark, [("a", "b")], "abcde", None)
    assert ends(candidates.generate_candidates(free, max_pool=None)) == {frozenset(p) for p in itertools.combinations("abcde", 2)} - {frozenset("ab")}


def test_large_hash_samples_are_those_of_the_sort(spark, monkeypatch):
    pairs = spark.range(3000).selectExpr("concat('u', id) as u", "concat('v', id) as v")
    want = rows(candidates.hash_sample(pairs, 400))
    monkeypatch.setattr(candidates, "LARGE_SAMPLE", 100)
    assert rows(candidates.hash_sample(pairs, 400)) == want


def test_short_draws_are_reported(spark):
    graph = make(spark, [("a", "b")], "abc")
    with pytest.warns(UserWarning, match="2 of 50 pairs"):
        assert candidates.rejection_sample(graph, 50).count() == 2


def test_matched_arms(spark, typed):
    pool = experiments.frozen_pool(typed, None)
    degrees = typed.degrees
    positives = typed.edges.join(degrees.select(F.col("id").alias("u"), F.col("k").alias("a")), "u").join(degrees.select(F.col("id").alias("v"), F.col("k").alias("b")), "v").selectExpr("a + b as degsum")
    got = experiments.arms(pool, typed.edges, 6, positives=positives, cap=0.5)
    assert {"counterfactual", "psm", "eval_matched", "eval_matched_clean"} <= set(got)
    assert all(got[a].count() == 6 for a in ("counterfactual", "eval_matched"))
    assert all(r["hardness"] <= 0.5 for a in ("psm", "eval_matched_clean") for r in got[a].collect())


def test_entity_cap_is_greedy(spark):
    rng = np.random.default_rng(0)
    pairs = sorted({tuple(sorted(rng.choice(12, 2, replace=False).tolist())) for _ in range(200)})
    table = [(f"n{a:02}", f"n{b:02}", float(c)) for (a, b), c in zip(pairs, rng.permutation(len(pairs)), strict=True)]
    want, used = [], {}
    for u, v, _ in sorted(table, key=lambda x: -x[2]):
        if len(want) < 9 and used.get(u, 0) < 2 and used.get(v, 0) < 2:
            want.append((u, v))
            used[u], used[v] = used.get(u, 0) + 1, used.get(v, 0) + 1
    got = selection.per_entity_cap(spark.createDataFrame(table, "u string, v string, confidence double"), 9, 2)
    assert rows(got.select("u", "v")) == sorted(want)


def test_paths_of_many_pairs_match_breadth_first_search(spark):
    rng = np.random.default_rng(1)
    names = [f"n{i:02}" for i in range(40)]
    edges = {tuple(sorted(rng.choice(names, 2, replace=False))) for _ in range(45)}
    graph = make(spark, edges, names)
    near = {n: {b if a == n else a for a, b in edges if n in (a, b)} for n in names}
    want = {}
    for s in names:
        seen, front, d = {s: 0}, {s}, 0
        while front and d < 4:
            d += 1
            front = {y for x in front for y in near[x]} - set(seen)
            seen |= dict.fromkeys(front, d)
        want |= {(s, t): seen.get(t, 5) for t in names}
    pairs = spark.createDataFrame(list(want), "u string, v string")
    assert {(r["u"], r["v"]): r["dist"] for r in topology.shortest_paths(graph, pairs, 4).collect()} == want


def test_lengths_of_the_control_follow_the_picks(spark):
    lengths = spark.createDataFrame([(f"p{i}", 100 * (i + 1)) for i in range(10)], "id string, length long")
    pool = spark.createDataFrame([(f"p{a}", f"p{b}") for a, b in itertools.combinations(range(10), 2)], "u string, v string")
    picks = spark.createDataFrame([("p1", "p0"), ("p2", "p3"), ("p8", "p9")], "u string, v string")
    got = selection.length_matched(pool, picks, lengths)
    assert got.count() == 3 and not ends(got) & ends(picks)
    assert max(abs(a - b) for a, b in zip(sorted(r["length"] for r in got.collect()), [300, 700, 1900], strict=True)) <= 300


def test_strata_hidden_positives_and_isolated_ends(spark, typed):
    df = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(None, 1)], "x long, y long")
    assert rows(metrics.quantile_strata(df, "x", "y", 2)) == [(0, 4, 0.5), (1, 4, 0.5)]
    chosen = spark.createDataFrame([("a", "b"), ("d", "c")], "u string, v string")
    assert rows(metrics.hidden_positives(chosen, spark.createDataFrame([("c", "d"), ("d", "c")], "u string, v string"))) == [(2, 1, 0.5)]
    lone = make(spark, [("a", "b")], "abc")
    assert rows(metrics.non_isolated(lone, spark.createDataFrame([("a", "b"), ("a", "c")], "u string, v string"))) == [("a", "b")]
    xs = np.random.default_rng(0).normal(size=(60, 3)).round(2)
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() - 1) / 2 for v in x])
    ab, ag, bg = (np.corrcoef(rank(xs[:, i]), rank(xs[:, j]))[0, 1] for i, j in ((0, 1), (0, 2), (1, 2)))
    got = metrics.partial_spearman(spark.createDataFrame(xs.tolist(), "a double, b double, g double"), "a", "b", "g").first()[0]
    assert abs(got - (ab - ag * bg) / np.sqrt((1 - ag**2) * (1 - bg**2))) < 1e-4
    one, two, three = (spark.createDataFrame([(float(x),) for x in xs], "degsum double") for xs in ([1, 2], [1, 2], [5, 6]))
    assert rows(metrics.degree_match(one, two, three)) == [(0.0, 1.0, 1.5, 1.5, 5.5)]


def test_interaction_files(spark, tmp_path):
    head = "Experimental System Type\tOrganism ID Interactor A\tOrganism ID Interactor B\tSWISS-PROT Accessions Interactor A\tSWISS-PROT Accessions Interactor B\n"
    text = head + "physical\t9606\t9606\tP12345|Q1\tQ67890\nPhysical\t9606\t10090\tP12345\tQ67890\ngenetic\t9606\t9606\tP1AAAA\tP2AAAA\nphysical\t9606\t9606\t-\tQ67890\n"
    assert rows(readers.biogrid(spark, put(tmp_path / "b.tab", text))) == [("P12345", "Q67890")]
    line = lambda a, b, x="taxid:9606(human)": "\t".join([a, b, *["-"] * 7, x, x]) + "\n"
    text = "#head\n" + line("uniprotkb:P2-1", "uniprotkb:P1") + line("chebi:1", "uniprotkb:P1") + line("uniprotkb:P3", "uniprotkb:P4", "taxid:10090") + "short\tline\n"
    assert rows(readers.mitab(spark, put(tmp_path / "m.txt", text))) == [("P1", "P2")]
    genes = spark.createDataFrame([("1", "ABC", "a b c", ["x", "y"]), ("2", "D", None, [])], "id string, symbol string, full string, aliases array<string>")
    assert rows(readers.display_names(genes)) == [("1", "ABC — a b c (aka x, y)"), ("2", "D")]


def test_channels_are_asked_and_answered_in_own_ids(spark, tmp_path):
    links = put(tmp_path / "links.txt", "protein1 protein2 experimental text\n9.A 9.B 950 10\n9.B 9.A 950 10\n9.A 9.C 900 700\n9.C 9.D 990 1\n")
    aliases = spark.createDataFrame([("9.A", "P1", "UniProt_AC", 0), ("9.A", "P1b", "UniProt_AC", 1), ("9.B", "P2", "UniProt_AC", 2), ("9.C", "P3", "UniProt_AC", 3), ("9.C", "P1", "UniProt_AC", 4), ("9.D", "P4", "Other", 5)], "target string, alias string, source string, at long")
    pairs = spark.createDataFrame([("P2", "P1"), ("P1", "P3"), ("P1", "P9")], "u string, v string")
    assert rows(readers.mapped_channel_scores(spark, links, "experimental", aliases, pairs)) == [("P1", "P2", 0.95), ("P1", "P3", 0.9)]
    nodes = spark.createDataFrame([("P1",), ("P2",)], "id string")
    assert rows(readers.mapped_channel_scores(spark, links, "experimental", aliases, nodes=nodes)) == [("P1", "P2", 0.95)]
    assert rows(readers.known_links(spark, links, aliases)) == [("P1", "P2")]


def test_sinks(spark, tmp_path):
    records = spark.createDataFrame([("a", "b", ["x"])], "u string, v string, flags array<string>")
    writers.write_jsonl(records, str(tmp_path / "r"))
    assert rows(spark.read.json(str(tmp_path / "r")).select("u", "v")) == [("a", "b")]
    writers.write_stats({"n": 2}, str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == {"n": 2}
    writers.shortlist(records.select("u", "v"), str(tmp_path / "l"))
    assert rows(spark.read.csv(str(tmp_path / "l"), sep="\t", header=True)) == [("a", "b")]
    assert rows(writers.fasta(records, spark.createDataFrame([("a", "MK"), ("b", "LL")], "id string, sequence string"))) == [(">a_b\nMK:LL",)]


class Said:
    """A judge that says one thing, and counts what it is asked."""

    config = judge.JudgeConfig()

    def __init__(self, verdict="suspected_false_negative"):
        self.verdict, self.asked = verdict, []

    def judge(self, pairs):
        self.asked += rows(pairs.select("u", "v"))
        return pairs.select("u", "v", F.lit(0).alias("vote_no"), F.lit(self.verdict).alias("verdict"), F.lit(0.8).alias("confidence"), F.lit("r").alias("rationale"), F.array(F.lit("e")).alias("evidence"))


def test_verdicts_are_remembered_by_what_the_judge_sees(spark, typed):
    pool = candidates.generate_candidates(typed).orderBy("u", "v").limit(3).withColumn("confidence", F.lit(0.5))
    pairs, who, one = rows(pool.select("u", "v")), Said(), filters.JudgeFilter()
    context = filters.Context(typed, judge=who)
    keys = one.keyed(context, pool.select("u", "v")).collect()
    assert len({r["key"] for r in keys}) == 3
    turned = one.keyed(context, pool.select(F.col("v").alias("u"), F.col("u").alias("v"))).collect()
    assert {r["key"] for r in turned} == {r["key"] for r in keys}
    known = spark.createDataFrame([(keys[0]["key"], "safe_negative", 0.9, 1.0), ("other", "safe_negative", 0.9, 1.0)], "key string, verdict string, confidence double, agreement double")
    got = {(r["u"], r["v"]): r["verdict"] for r in one.score(filters.Context(typed, judge=who, verdicts=known), pool).collect()}
    asked = (keys[0]["u"], keys[0]["v"])
    assert got == {p: "safe_negative" if p == asked else "suspected_false_negative" for p in pairs} and sorted(set(who.asked)) == [p for p in pairs if p != asked]
    plain = spark.createDataFrame([(asked[1], asked[0], "safe_negative", 0.9, 1.0)], "u string, v string, verdict string, confidence double, agreement double")
    who.asked.clear()
    again = {(r["u"], r["v"]): r["verdict"] for r in one.score(filters.Context(typed, judge=who, verdicts=plain), pool).collect()}
    assert again == got and asked not in who.asked


def test_only_suspected_pairs_are_judged_later(spark):
    records = spark.createDataFrame([("z", "a", 0.3, 0.3, ["suspected_false_negative"]), ("z", "b", 0.2, 0.2, ["near_boundary"]), ("z", "c", 0.4, 0.4, ["suspected_false_negative"])], "u string, v string, confidence double, stream_topology double, flags array<string>")
    done = spark.createDataFrame([("a", "z")], "u string, v string")
    who = Said()
    got = {r["v"]: r["flags"] for r in verdicts.judge_remaining(records, done, who, 5).collect()}
    assert set(who.asked) == {("z", "c")} and got["c"][-1] == "llm_suspected_false_negative" and len(got["b"]) == 1


def test_records_tell_what_reviews_said(spark, typed):
    config = PipelineConfig(n_eval=6, n_train=6, filters=("known_positive_veto", "structured", "topology", "literature"), false_negative_pct=0.3)
    result = run_pipeline(typed, config, judge=Said())
    got = result.records.selectExpr("provenance.gated as g", "stream_literature as s").collect()
    assert any(r["g"] for r in got) and all((r["g"] is None) == (r["s"] is None) for r in got)
    assert next(r["g"]["literature"]["verdict"] for r in got if r["g"]) == "suspected_false_negative"
    checks = validation(typed, result, spark.createDataFrame([("a0", "z0")], "lo string, hi string"))
    assert checks["leakage"].first()[0] == 0 and set(checks) == {"leakage", "hardness", "gold"}
    assert "suspect" in {r["group"] for r in panels.confidence_groups(result.records).collect()}
    page = panels.render("<t>", {"records": writers.flattened(result.records)})
    assert "&lt;t&gt;" in page and page.count("<tr>") == 1 + result.records.count()


def test_small_columns(spark):
    row = spark.range(1).select(
        numeric.total_tokens(F.lit(2), F.lit(3)).alias("t"), numeric.total_tokens(F.lit(2), F.lit(None).cast("int")).alias("n"),
        fusion.contributing({"a": F.lit(0.1), "b": F.lit(None).cast("double")}).alias("c"), fusion.reported_or_own(F.lit(1.0), F.lit(None).cast("double")).alias("o"), fusion.reported_or_own(F.lit(1.0), F.lit(7.0)).alias("s"),
    ).first()
    assert (row["t"], row["n"], row["c"], row["s"]) == (5, None, ["a"], 1.0) and row["o"] is not None
    flagged = spark.createDataFrame([("a", "b", 0.9, ["different_compartment"]), ("a", "c", 1.0, []), ("a", "d", 0.1, ["different_compartment"])], "u string, v string, hardness double, flags array<string>")
    assert rows(selection.bio_filtered(flagged, 1).select("u", "v")) == [("a", "b")]
    marked = spark.createDataFrame([("a", "b", 0.7), ("a", "c", None)], "u string, v string, hardness_raw double")
    notes = spark.createDataFrame([("a", ["x"], 0.5), ("b", ["x"], 0.25)], "node string, compartments array<string>, surface_hydrophobicity double")
    names = spark.createDataFrame([("a", "Alpha")], "id string, name string")
    assert rows(panels.traces(marked, notes, names)) == [("a", "b", 0.7, 1.0, 0.75, "Alpha – b"), ("a", "c", 0.0, 0.0, 0.0, "Alpha – c")]


def test_reports_of_experiments(spark):
    results = spark.createDataFrame([("random_veto", "lr", 0.5), ("random_veto", "lr", 0.7), ("stacked", "lr", 0.9)], "arm string, model string, auroc double")
    assert rows(experiments.seed_summary(results)) == [("random_veto", "lr", 0.6, 0.0), ("stacked", "lr", 0.9, 0.3)]
    said = spark.createDataFrame([("a", "b", "safe_negative"), ("c", "d", "safe_negative")], "u string, v string, verdict string")
    assert rows(experiments.judge_report(said, spark.createDataFrame([("b", "a")], "u string, v string"))) == [("safe_negative", 2, 0.5)]
    rng = np.random.default_rng(0)
    table = [(f"u{i}", f"v{i}", int(i % 2), float(i % 2 + rng.normal() / 4)) for i in range(60)]
    scored = experiments.out_of_fold(spark.createDataFrame(table, "u string, v string, y int, x double"), ["x"], folds=3)
    assert scored.count() == 60 and metrics.auroc(scored).first()[0] > 0.9
    marked = spark.createDataFrame([(1, 0.9, 0.2, True, False), (0, 0.1, 0.8, True, True), (0, 0.95, None, False, True)], "y int, a double, b double, odd boolean, tough boolean")
    got = {r["signal"]: r for r in experiments.signal_table(marked, {"a": "a", "b": "b"}, "y", "odd", "tough").collect()}
    assert (got["a"]["coverage"], got["a"]["auroc_random"], got["a"]["auroc_hard"]) == (1.0, 1.0, 0.5) and got["b"]["coverage"] == 0.6667


@pytest.mark.parametrize("model", ["rf", "gbt"])
def test_other_learners(spark, model):
    rng = np.random.default_rng(0)
    rows_ = [(int(i % 2), float(i % 2 + rng.normal() / 3)) for i in range(40)]
    df = spark.createDataFrame(rows_, "y int, x double")
    assert metrics.auroc(experiments.fit_predict(df, df, ["x"], model)).first()[0] > 0.9


def test_graphs_are_plain_tables(spark, typed):
    assert isinstance(typed, Graph) and typed.positives(typed.oriented(typed.edges)).count() == typed.edges.count()
