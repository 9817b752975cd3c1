"""A verdict table kept up to date by Structured Streaming, and judging the rest of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from unpaired.graph import excluding
from unpaired.operators import fusion, judge
from unpaired.sources.writers import latest_verdicts
from unpaired.tables import delete, folders

VERDICT_SCHEMA = "key string, u string, v string, verdict string, confidence double, agreement double, written_at timestamp"
#: Buckets of keys; a batch rewrites only those it has keys of.
VERDICT_BUCKETS = 256


def follow(spark: SparkSession, incoming: str, table: str, checkpoint: str, buckets: int = VERDICT_BUCKETS) -> StreamingQuery:
    """Fold verdict files that appear in ``incoming`` into ``table``, the last of each key.

    The table lies in buckets of keys, each with versions numbered by the batch that wrote
    them. A batch merges the buckets of its keys and leaves the others alone, so what it
    writes is in proportion to what it touches. Late, repeated and reordered files change
    nothing, as the last ``written_at`` counts; a batch that is run again reads the versions
    before it and overwrites its own. One version before the newest stays, for readers.
    """

    def fold(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).persist()
        try:
            touched = sorted(r["bucket"] for r in batch.select("bucket").distinct().collect())  # ``buckets`` at most
            if not touched:
                return
            versions = _versions(spark, table)
            before = {b: [n for n in versions.get(b, []) if n < number] for b in touched}
            old = [f"{table}/bucket={b}/version={max(n)}" for b, n in before.items() if n]
            both = batch
            if old:
                stored = spark.read.option("basePath", table).schema(f"{VERDICT_SCHEMA}, bucket int, version long").parquet(*old)
                both = batch.unionByName(stored.drop("version"))
            merged = latest_verdicts(both).withColumn("version", F.lit(number).cast("long"))
            writer = merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("bucket", "version").parquet(table)
            for b, n in before.items():
                for gone in sorted(n)[:-1]:
                    delete(spark, f"{table}/bucket={b}/version={gone}")
        finally:
            batch.unpersist()

    stream = spark.readStream.schema(VERDICT_SCHEMA).json(incoming)
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, table: str) -> dict[int, list[int]]:
    """The versions of each bucket of a followed table."""
    numbers = lambda path, name: sorted(int(x.split("=")[1]) for x in folders(spark, path) if x.startswith(f"{name}="))
    return {b: numbers(f"{table}/bucket={b}", "version") for b in numbers(table, "bucket")}


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The newest verdicts of a followed table, None if there are none."""
    newest = [f"{table}/bucket={b}/version={max(n)}" for b, n in _versions(spark, table).items() if n]
    if not newest:
        return None
    return spark.read.option("basePath", table).schema(f"{VERDICT_SCHEMA}, bucket int, version long").parquet(*newest).drop("bucket", "version")


def next_cards(records: DataFrame, verdicts: DataFrame | None, who: judge.Judge, k: int) -> DataFrame:
    """Cards of the next ``k`` suspected false negatives without a verdict, least confident first."""
    risky = records.where(F.array_contains("flags", "suspected_false_negative"))
    open_ = (risky if verdicts is None else excluding(risky, verdicts)).select("u", "v", "confidence").distinct()
    return judge.majority(who.judge(open_.orderBy("confidence", "u", "v").limit(k)))


def with_cards(records: DataFrame, cards: DataFrame, weights: dict[str, float] | None = None, mode: str = "mean", strength: float = 1.0) -> DataFrame:
    """The records of a run after ``cards``: judged ones are fused anew and flagged ``llm_<verdict>``."""
    seen = cards.select("u", "v", F.col("verdict").alias("_verdict"), judge.card_value(F.col("verdict"), F.col("confidence")).alias("_value"))
    streams = {c.removeprefix("stream_"): F.col(c) for c in records.columns if c.startswith("stream_") and c != "stream_literature"} | {"literature": F.col("_value")}
    own = records.join(seen, ["u", "v"], "left")
    judged = F.col("_verdict").isNotNull()
    out = own.withColumn("confidence", F.when(judged, fusion.fuse(streams, weights, mode, strength)).otherwise(F.col("confidence")))
    out = out.withColumn("flags", F.when(judged, F.array_union("flags", F.array(F.concat(F.lit("llm_"), "_verdict")))).otherwise(F.col("flags")))
    if "stream_literature" in records.columns:
        out = out.withColumn("stream_literature", F.when(judged, F.col("_value")).otherwise(F.col("stream_literature")))
    return out.select(*records.columns)


def judge_remaining(records: DataFrame, verdicts: DataFrame, who: judge.Judge, k: int, weights: dict[str, float] | None = None) -> DataFrame:
    """The records of a run after the next ``k`` unjudged suspected false negatives have been judged."""
    return with_cards(records, next_cards(records, verdicts, who, k), weights)
