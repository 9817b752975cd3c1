"""Runs kept in a folder: records, cards and statistics in numbered versions.

A version is written whole before the marker that makes it count, and the newest marked
one is the run. So a run can be read while it is rewritten, and a crash at any time
leaves the version before; what it had half written is deleted by the next one.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unpaired.operators import judge
from unpaired.plans import panels
from unpaired.plans.pipeline import PipelineConfig
from unpaired.sources import writers
from unpaired.streaming import verdicts
from unpaired.tables import delete, folders, read_text, write_text

MARKER = "_WHOLE"


def _numbers(spark: SparkSession, out: str) -> tuple[list[int], list[int]]:
    """Versions that count, and all others."""
    found = sorted(int(x.split("=")[1]) for x in folders(spark, out) if x.startswith("version="))
    whole = [n for n in found if MARKER in folders(spark, f"{out}/version={n}")]
    return whole, [n for n in found if n not in whole]


def begin(records: DataFrame, cards: DataFrame | None, stats: dict, out: str) -> str:
    """Write the next version of a run, which doesn't count yet; returns its folder."""
    spark = records.sparkSession
    whole, broken = _numbers(spark, out)
    for n in broken:
        delete(spark, f"{out}/version={n}")
    at = f"{out}/version={max(whole, default=0) + 1}"
    records.write.parquet(f"{at}/records")
    records = spark.read.parquet(f"{at}/records")
    writers.write_csv(records, f"{at}/negatives.csv")
    writers.write_jsonl(records, f"{at}/negatives.jsonl")
    if cards is not None:
        cards.write.parquet(f"{at}/cards")
    write_text(spark, f"{at}/stats.json", json.dumps(stats, indent=2, sort_keys=True))
    tables = {"flags": panels.flag_breakdown(records), "groups": panels.confidence_groups(records), "statistics": spark.createDataFrame([(k, json.dumps(v)) for k, v in sorted(stats.items())], "what string, value string")}
    write_text(spark, f"{at}/report.html", panels.render("Negatives", tables))
    return at


def finish(spark: SparkSession, at: str) -> None:
    """Make a written version the run, and delete versions but the one before it."""
    write_text(spark, f"{at}/{MARKER}", "")
    out = at.rsplit("/", 1)[0]
    for n in _numbers(spark, out)[0][:-2]:
        delete(spark, f"{out}/version={n}")


def save(records: DataFrame, cards: DataFrame | None, stats: dict, out: str) -> None:
    finish(records.sparkSession, begin(records, cards, stats, out))


def load(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame | None, dict]:
    """Records, cards (None if nothing was judged) and statistics of a run."""
    whole, _ = _numbers(spark, out)
    if not whole:
        raise FileNotFoundError(f"no run in {out}")
    at = f"{out}/version={whole[-1]}"
    cards = spark.read.parquet(f"{at}/cards") if "cards" in folders(spark, at) else None
    return spark.read.parquet(f"{at}/records"), cards, json.loads(read_text(spark, f"{at}/stats.json"))


def settings(config: PipelineConfig) -> dict:
    """What a later pass must know to fuse as the run did."""
    return {"fusion_mode": config.fusion_mode, "entropy_lambda": config.entropy_lambda, "weights": config.weights}


def judge_rest(spark: SparkSession, out: str, who: judge.Judge, k: int) -> dict:
    """Judge the next ``k`` risky records of a run, rewrite it, and return its statistics.

    Confidences are fused as the run's own were; cards, files and the risky coverage follow.
    """
    records, cards, stats = load(spark, out)
    new = verdicts.next_cards(records, cards, who, k).select("u", "v", "verdict", "confidence", "rationale", "evidence", "n_votes", "agreement", "vote_counts")
    at = f"{out}/judging"
    new.write.mode("overwrite").parquet(at)  # asked once: what follows reads it
    new = spark.read.parquet(at)
    judged = new.count()
    if judged:
        own = stats.get("settings", {})
        after = verdicts.with_cards(records, new, own.get("weights"), own.get("fusion_mode", "mean"), own.get("entropy_lambda", 1.0))
        every = new if cards is None else cards.unionByName(new, allowMissingColumns=True)
        coverage = stats.get("risky_coverage", {})
        risky = after.where(F.array_contains("flags", "suspected_false_negative")).select("u", "v").distinct()
        seen = risky.join(every.select("u", "v").distinct(), ["u", "v"], "left_semi").count()
        stats["risky_coverage"] = coverage | {"risky": risky.count(), "judged": seen, "unjudged": risky.count() - seen}
        save(after, every, stats, out)
    delete(spark, at)
    return stats
