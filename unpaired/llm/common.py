"""Shared helpers: tables in the shared folder, native prefix sums, reading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where the session names none (tests, a laptop), a temporary folder is made
    once and remembered in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("unpaired.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-unpaired-")
        spark.conf.set("unpaired.shared.dir", found)
    return found.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: later jobs read the files, which survive the loss of
    any executor, and every reader sees the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    if (made := _MADE.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders of the tables that were kept inside of :func:`only`.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def only(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Keep the table that ``make`` returns, and delete all that were kept on the way to it."""
    token = _MADE.set([])
    try:
        out = make()
        made = list(_MADE.get())
        kept = keep(out, name)
    finally:
        _MADE.reset(token)
    if (outer := _MADE.get()) is not None:
        outer.extend(x.rsplit("/", 1)[0] for x in kept.inputFiles()[:1])
    for path in made:
        _delete(kept.sparkSession, path)
    return kept


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_kept(df: DataFrame) -> None:
    """Delete a table made by :func:`keep` that nothing will read again."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rsplit("/", 1)[0])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that an operator's own names can't clash with them."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])


def renamed(df: DataFrame, *outputs: str) -> DataFrame:
    """``df`` whose columns named like one of ``outputs`` (in any case) get ``_`` behind the name.

    The rule for operators that add columns: their results have the documented names, and
    an input column of that name stays, as ``name_`` (``name__`` where that exists too).
    """
    taken, given = {c.lower() for c in df.columns} | {o.lower() for o in outputs}, {}
    for c in df.columns:
        if c.lower() in {o.lower() for o in outputs}:
            new = f"{c}_"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            given[c] = new
    return df.withColumnsRenamed(given)


def partitions(df: DataFrame, rows: int, per_partition: int = 2_000_000) -> int:
    """Tasks for small rows: at least the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


def ordered_rows(df: DataFrame, order: list[str], name: str, parts: int) -> DataFrame:
    """Range-partition and sort by ``order``, keep the table, and number it.

    Adds ``_pid`` (the partition) and ``_idx`` (place in it). Both come from one
    exchange and are written once, so every later reader agrees on them. Rows that are
    equal in ``order`` are told apart by their place, so that no partition is larger
    than a range.
    """
    numbered = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(parts, *order, "_tie")
        .sortWithinPartitions(*order, "_tie")
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright("_at", 33).cast("int"))
        .withColumn("_idx", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_at", "_tie")
    )
    return keep(numbered, name)


def running_total(df: DataFrame, order: list[str], group: list[str], value: str, out: str, name: str, parts: int) -> DataFrame:
    """Adds ``out``: the inclusive running sum of ``value`` over ``order``.

    With ``group`` the sum restarts for each group; ``order`` must then begin with
    the group's columns. Two levels: rows of one range partition are summed among
    themselves, and a small table with a row for each partition and group carries
    the totals of earlier partitions. A group with a third of all rows is spread
    over a third of the partitions.
    """
    table = ordered_rows(df, order, name, parts)
    cell = ["_pid", *group]
    per_cell = table.groupBy(*cell).agg(F.sum(value).alias("_sum"))
    before = W.Window.partitionBy(*group).orderBy("_pid").rowsBetween(W.Window.unboundedPreceding, -1)
    before_cell = per_cell.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    before_cell = before_cell.select([F.col(c).alias(f"_k_{c}") for c in cell] + ["_before"])
    within = W.Window.partitionBy(*cell).orderBy("_idx").rowsBetween(W.Window.unboundedPreceding, 0)
    local = table.withColumn("_local", F.sum(value).over(within))
    on = F.lit(True)
    for c in cell:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    joined = local.join(before_cell, on, "left")
    return joined.withColumn(out, F.col("_local") + F.col("_before")).drop("_local", "_before", "_pid", "_idx", *[f"_k_{c}" for c in cell])


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def bounded_sample(df: DataFrame, rows: int) -> list:
    """At most ``rows`` different rows, those of the smallest hash; the same each time.

    A cut on the hash, from the number of rows, keeps what reaches the driver near
    ``rows`` however many partitions there are. Equal rows count once, so a row that
    is repeated a great many times can't fill the sample.
    """
    count = df.count()
    hashed = df.withColumn("_hash", F.xxhash64(*df.columns))
    if count > rows:
        spread = 1.3 * rows / count + 100 / count
        hashed = hashed.where(F.col("_hash") <= int(-(1 << 63) + min(1.0, spread) * ((1 << 64) - 1)) - 1)
    return hashed.dropDuplicates(["_hash"]).orderBy("_hash").limit(rows).drop("_hash").collect()
