"""Sinks of records, cards, statistics and merged tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def flattened(records: DataFrame) -> DataFrame:
    """Records as flat columns: flags joined by semicolons, no provenance."""
    streams = [c for c in records.columns if c.startswith("stream_")]
    return records.select("u", "v", "mode", "confidence", "hardness", F.concat_ws(";", "flags").alias("flags"), *streams)


def write_csv(records: DataFrame, path: str, sep: str = ",") -> None:
    flattened(records).write.mode("overwrite").csv(path, header=True, sep=sep)


def write_jsonl(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def write_stats(stats: dict, path: str) -> None:
    """A small dictionary of counts as one JSON file."""
    Path(path).write_text(json.dumps(stats, indent=2, sort_keys=True))


def cards(records: DataFrame, stream: str = "literature") -> DataFrame:
    """Distinct pairs that a judge has given a verdict."""
    return records.where(F.col(f"stream_{stream}").isNotNull()).dropDuplicates(["u", "v"])


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key, and the others added."""
    both = old.withColumn("_p", F.lit(1)).unionByName(new.withColumn("_p", F.lit(0)), allowMissingColumns=True)
    order = W.Window.partitionBy(*key).orderBy("_p", *[c for c in old.columns if c not in key])
    return both.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_p")


def append_verdicts(verdicts: DataFrame, path: str) -> None:
    """Add verdicts (key, verdict, ...) to the append-only table."""
    verdicts.withColumn("written_at", F.current_timestamp()).write.mode("append").json(path)


def latest_verdicts(table: DataFrame, key: str = "key", at: str = "written_at") -> DataFrame:
    """The last verdict of each key."""
    order = W.Window.partitionBy(key).orderBy(F.desc(at), "verdict")
    return table.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def shortlist(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").csv(path, header=True, sep="\t")


def fasta(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """Lines of a complex FASTA: one entry for each pair, chains joined by a colon."""
    a, b = sequences.select(F.col("id").alias("u"), F.col("sequence").alias("_a")), sequences.select(F.col("id").alias("v"), F.col("sequence").alias("_b"))
    return pairs.join(a, "u").join(b, "v").select(F.concat(F.lit(">"), "u", F.lit("_"), "v", F.lit("\n"), "_a", F.lit(":"), "_b").alias("value"))
