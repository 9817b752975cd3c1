"""Settled tables: written once, read many times, with no lineage behind them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that all executors share.

    Only where a session names none (tests, a laptop), a temporary folder is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("unpaired.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-unpaired-")
        spark.conf.set("unpaired.shared.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame, name: str = "table", **options: object) -> DataFrame:
    """``df`` written to the shared folder (with the writer's ``options``) and read back.

    Tables that many joins read are settled: plans stay small, nothing is computed
    twice, and a lost executor costs no more than the task it ran.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it doesn't exist."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, on whatever file system the path names; it appears whole or not at all."""
    where, partly = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, path + ".part"))
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(partly, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(where, False)
    files.rename(partly, where)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
