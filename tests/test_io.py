"""Readers, writers and the followed verdict table on tiny files."""

import math

from pyspark.sql import functions as F

from unpaired.functions import domain
from unpaired.operators.judge import OfflineJudge
from unpaired.sources import readers, writers
from unpaired.streaming import verdicts


def put(path, text):
    path.write_text(text)
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_pair_files(spark, tmp_path):
    text = put(tmp_path / "e.txt", "b a\na b\nx x\nshort\n# c d\nc\td\n")
    assert rows(readers.edge_list(spark, text)) == [("#", "c"), ("a", "b"), ("c", "d")]
    assert rows(readers.pair_list(spark, text)) == [("a", "b"), ("c", "d")]
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert rows(readers.pair_list(spark, text, nodes)) == [("a", "b")]


def test_last_line_wins_and_bad_lines_go(spark, tmp_path):
    loc = put(tmp_path / "l.tsv", "p\tNucleus, cytosol,,nucleus\nq\t,\np\tMembrane\n")
    assert [(r["node"], r["compartments"]) for r in readers.localization(spark, loc).collect()] == [("p", ["membrane"])]
    num = put(tmp_path / "n.tsv", "p 0.5\nq x\np 0.7\n")
    assert rows(readers.scalar(spark, num, "s")) == [("p", 0.7)]
    pair = put(tmp_path / "p.tsv", "b\ta\t0.5\na\tb\t0.9\na\tc\tz\n")
    assert rows(readers.pair_values(spark, pair, "f")) == [("a", "b", "f", 0.9)]


def test_maps_and_manifest(spark, tmp_path):
    m = readers.id_map(spark, put(tmp_path / "m.tsv", "id\tx\nu1\te1,e2\nu2\te2, e3\n"))
    pairs = spark.createDataFrame([("u1", "u2")], "u string, v string")
    nodes = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "id string")
    assert rows(readers.map_pairs(pairs, m, nodes)) == [("e1", "e2"), ("e1", "e3"), ("e2", "e3")]
    put(tmp_path / "s1.tsv", "a\tc\n# note\nd b\nX Y\n")
    manifest = put(tmp_path / "sources.yaml", "- {name: one, path: s1.tsv}\n- {name: off, path: s1.tsv, enabled: false}\n- {name: gone, path: none.tsv}\n")
    own = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    got, report, missing = readers.positive_sources(spark, manifest, own)
    assert rows(got.select("u", "v")) == [("a", "c"), ("b", "d")] and missing == ["gone"] and rows(report) == [("one", 2), ("union", 2)]
    assert readers.certified(report).first()[0] is True


def test_host_pathogen(spark):
    t = spark.createDataFrame([("nsp1", "A1", "G1"), ("E", "A2", "G2"), ("G1", "A2", "G2"), (None, "A3", "G3"), ("Orf8", None, "x")], "Bait string, PreyUniprotAcc string, PreyGeneName string")
    g = readers.host_pathogen_graph(t)
    assert rows(g.edges) == [("A1", "A2"), ("A1", "nsp1"), ("A2", "E")]
    assert dict(rows(g.nodes)) == {"nsp1": "viral", "E": "viral", "A1": "host", "A2": "host"}
    assert readers.host_pathogen_graph(t, include_host_host=False).edges.count() == 2


def test_channel_scan(spark, tmp_path):
    links = put(tmp_path / "links.txt", "protein1 protein2 experimental combined_score\np1 p2 120 900\np2 p1 120 900\np1 p9 500 1\n")
    aliases = spark.createDataFrame([("p1", "Q1", "UniProt_AC", 1), ("pX", "Q1", "UniProt_AC", 2), ("p2", "ENSG2", "Ensembl_gene", 3), ("bad", "ENSG2", "Decoy", 0)], "target string, alias string, source string, at long")
    ids = spark.createDataFrame([("Q1",), ("ENSG2",)], "id string")
    assert rows(readers.alias_map(aliases, ids)) == [("ENSG2", "p2"), ("Q1", "p1")]
    pairs = spark.createDataFrame([("p2", "p1")], "u string, v string")
    assert rows(readers.channel_scores(spark, links, "experimental", pairs)) == [("p1", "p2", 0.12)]
    nodes = spark.createDataFrame([("p1",), ("p2",)], "id string")
    assert rows(readers.channel_scores(spark, links, "experimental", nodes=nodes)) == [("p1", "p2", 0.12)]


def test_labelled_pairs_and_complexes(spark, tmp_path):
    assert rows(readers.labelled_pairs(spark, put(tmp_path / "d.tsv", "pair\tc\nA_B\tpositive\nC_D\tnegative\n"))) == [("A", "B", 1), ("C", "D", 0)]
    assert rows(readers.complexes(spark, put(tmp_path / "c.csv", "Name,pDockQ\nA-B,0.5\nA-B-C,0.1\nX-Y,?\n"))) == [("A", "B", 0.5)]


def test_upsert_and_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    assert rows(writers.upsert(old, spark.createDataFrame([("b", 9), ("c", 3)], "id string, n int"), ["id"])) == [("a", 1), ("b", 9), ("c", 3)]
    rec = spark.createDataFrame([("a", "b", "eval", 0.5, 0.1, 0.4, ["x", "y"])], "u string, v string, mode string, confidence double, hardness double, stream_t double, flags array<string>")
    writers.write_csv(rec, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first()["flags"] == "x;y"


def test_verdicts_are_followed(spark, tmp_path):
    incoming, table, check = (str(tmp_path / n) for n in ("in", "table", "check"))
    one = spark.createDataFrame([("k1", "a", "b", "uncertain", 0.1, 1.0), ("k2", "c", "d", "safe_negative", 0.9, 1.0)], "key string, u string, v string, verdict string, confidence double, agreement double")
    writers.append_verdicts(one, incoming)
    verdicts.follow(spark, incoming, table, check).awaitTermination()
    writers.append_verdicts(one.where("key = 'k1'").withColumn("verdict", F.lit("safe_negative")), incoming)
    verdicts.follow(spark, incoming, table, check).awaitTermination()
    got = {r["key"]: r["verdict"] for r in verdicts.current(spark, table).collect()}
    assert got == {"k1": "safe_negative", "k2": "safe_negative"}


def test_judge_remaining(spark):
    rec = spark.createDataFrame([("a", "b", 0.4, 0.4, None, ["suspected_false_negative"]), ("c", "d", 0.2, 0.2, None, ["suspected_false_negative"]), ("e", "f", 0.1, 0.1, None, [])], "u string, v string, confidence double, stream_t double, stream_literature double, flags array<string>")
    done = spark.createDataFrame([("c", "d")], "u string, v string")
    got = {r["u"]: r for r in verdicts.judge_remaining(rec, done, OfflineJudge(), 5).collect()}
    assert any(f.startswith("llm_") for f in got["a"]["flags"]) and got["c"]["flags"] == ["suspected_false_negative"] and got["e"]["confidence"] == 0.1


def test_domain_scores(spark):
    df = spark.createDataFrame([("AI", 90.0, 100), ("??", 50.0, 0), ("R", 0.0, 1)], "s string, p double, n int")
    got = df.select(domain.hydrophobicity(F.col("s")), domain.pdockq(F.col("p"), F.col("n"))).collect()
    assert abs(got[0][0] - (3.15 + 4.5) / 9) < 1e-9 and got[1][0] is None and got[2][0] == 0.0
    assert abs(got[0][1] - (0.724 / (1 + math.exp(-0.052 * (90 * math.log(100) - 152.611))) + 0.018)) < 1e-9 and got[1][1] == 0.0
