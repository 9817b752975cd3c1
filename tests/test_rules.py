"""The rule language and the shipped rules."""

import pytest
from pyspark.sql import functions as F

from unpaired.functions import rule_language as rl
from unpaired.graph import Graph
from unpaired.operators import filters, rules


@pytest.mark.parametrize("bad", ["a.x >", "x", "__import__('os')", "a.b.c > 1", "-a.x > 1", "f(a.x, b.x)", "disjoint(a.x, y=b.x)", "a.x if b.x else 1", "[1]", "a.x ** 2 > 1", "contains('abc', 'a')", "None"])
def test_unsafe_rules_are_rejected(bad):
    with pytest.raises(rl.RuleError):
        rl.parse(bad)


def test_bad_effect_and_types():
    with pytest.raises(rl.RuleError):
        rules.Rule("r", "ppi", ("a", "b"), "a.x > 1", "maybe")
    with pytest.raises(rl.RuleError):
        rules.Rule("r", "ppi", ("a",), "a.x > 1", "veto")


def test_short_circuit_over_all_cases(spark):
    values = [None, 0.1, 0.9]
    rows = [(a, b) for a in values for b in values]
    df = spark.createDataFrame(rows, "x double, y double")
    lookup = lambda e, f: F.col(f)
    got = df.select("x", "y", rl.compile_rule("a.x > 0.5 or b.y > 0.5", lookup).alias("o"), rl.compile_rule("a.x > 0.5 and b.y > 0.5", lookup).alias("n"), rl.compile_rule("not a.x > 0.5", lookup).alias("i"), rl.compile_rule("0 < a.x < b.y", lookup).alias("c"), rl.compile_rule("a.x / (b.y - 0.1) > 1", lookup).alias("d")).collect()

    def either(x, y):
        return None if x is None else True if x > 0.5 else None if y is None else y > 0.5

    def both(x, y):
        return None if x is None else False if not x > 0.5 else None if y is None else y > 0.5

    for r in got:
        assert r["o"] == either(r["x"], r["y"]) and r["n"] == both(r["x"], r["y"])
        assert r["i"] == (None if r["x"] is None else not r["x"] > 0.5)
        assert r["c"] == (None if r["x"] is None or r["y"] is None else 0 < r["x"] < r["y"])
        if r["y"] == 0.1:
            assert r["d"] is None  # division by zero abstains


def test_set_functions(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], ["c"]), (None, ["a"])], "x array<string>, y array<string>")
    lookup = lambda e, f: F.col(f)
    run = lambda text: [r[0] for r in df.select(rl.compile_rule(text, lookup)).collect()]
    assert run("disjoint(a.x, b.y)") == [False, True, True, None]
    assert run("overlap(a.x, b.y)") == [True, False, False, None]
    assert run("shared(a.x, b.y) == 1") == [True, False, False, None]
    assert run("jaccard(a.x, b.y) > 0.3") == [True, False, False, None]
    assert run("contains(a.x, 'b')") == [True, False, False, None]


def graph(spark, kinds):
    nodes = spark.createDataFrame(list(kinds.items()), "id string, type string")
    return Graph.from_edges(spark.createDataFrame([("a", "b")], "u string, v string"), nodes, [("protein", "protein")])


def test_graded_value_orientation_and_silence(spark):
    g = graph(spark, {"a": "protein", "b": "protein", "l": "ligand"})
    ann = spark.createDataFrame([("a", ["x"], 0.2, None), ("b", ["y"], 0.1, None), ("l", None, None, 9.0)], "node string, compartments array<string>, pocket_volume double, volume double")
    pairs = spark.createDataFrame([("a", "b"), ("l", "a"), ("a", "l"), ("l", "l")], "u string, v string")
    own = rules.annotated_pairs(g, pairs, rules.annotate(g, ann))
    got = {(r["u"], r["v"]): (r["rule_value"], r["rule_flags"], r["rule_fired"]) for r in rules.apply_graded(own, filters.default_rules()).collect()}
    assert got["a", "b"] == (0.85, ["different_compartment"], ["colocalization_mismatch"])
    assert got["l", "a"][2] == got["a", "l"][2] == ["ligand_pocket_size_mismatch"] and got["l", "l"] == (None, [], [])


def test_pair_fields_stay_with_their_pair(spark):
    g = graph(spark, {"P1": "protein", "P2": "protein", "P3": "protein"})
    fields = spark.createDataFrame([("P1", "P2", "s", 0.05), ("P1", "P3", "s", 0.9)], "lo string, hi string, field string, value double")
    pairs = spark.createDataFrame([("P1", "P2"), ("P1", "P3"), ("P2", "P3")], "u string, v string")
    own = rules.annotated_pairs(g, pairs, rules.annotate(g), fields, ["s"])
    low = [rules.Rule("low", "ppi", ("protein", "protein"), "a.s < 0.1", "riskier_negative", 0.5)]
    got = {(r["u"], r["v"]): r["rule_value"] for r in rules.apply_graded(own, low).collect()}
    assert got == {("P1", "P2"): 0.25, ("P1", "P3"): None, ("P2", "P3"): None}
    veto = [rules.Rule("no", "ppi", ("protein", "protein"), "a.s > 0.8", "veto", flag="stop")]
    assert [(r["u"], r["v"], r["veto_flag"]) for r in rules.apply_veto(own, veto).where("veto").collect()] == [("P1", "P3", "stop")]


def test_lint_and_missing_yaml_key(tmp_path):
    assert rl.lint([("r", "a.x > b.y")], ["x"]) == [("r", ["y"])]
    (tmp_path / "ppi.yaml").write_text("- id: r\n  when: a.x > 1\n")
    with pytest.raises(rl.RuleError):
        rules.load_rules(tmp_path)
    assert rules.load_rules(tmp_path / "none") == [] and len(filters.default_rules()) == 6
