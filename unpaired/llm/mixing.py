"""Mixing sources to target weights by weighted fair queueing, DataFrame functions only.

Documents of a source queue up in shuffled order (by digest of the id), a second time
after the first where the target asks for repeats. A document's virtual finish time
is the source's cumulative tokens divided by the source's target. All copies are
range-sorted by it and taken until the total budget is used up. Tokens are counted
to a document's middle, so the cut rounds each source to its nearest document.

Targets: the budget is shared by weight; a source whose share is above ``REPEATS``
times its size gets that, and the rest is shared anew until none is above.

Defined results: a null text has size 0, and a document of size 0 is taken 0 times
its words; a null source is a source of its own, last in order; repeated rows queue
separately; with no words at all every target is 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unpaired.llm.common import drop_kept, keep, only, partitions, running_total, text_or_empty, whole

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
REPEATS = 2


def n_words(text: str | Column = "text") -> Column:
    """Number of runs of ``[^\\x20\\x09-\\x0D]+``."""
    return F.regexp_count(text_or_empty(text), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """``sizes`` (source, source_size) with rank, weight and ``target``; kept in a table.

    The driver only gets sums: each round tells how much of the budget the capped
    sources leave, and for what weight.
    """
    spark = sizes.sparkSession
    own = keep(sizes.withColumn("_last", F.col("source").isNull().cast("int")).withColumn("_one", F.lit(1).cast("long")), "source-sizes")
    parts = partitions(own, own.count())
    ranked = running_total(own, ["_last", "source"], [], "_one", "_nth", "source-order", parts)
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = keep(ranked.select("source", "source_size", (F.col("_nth") - 1).alias("rank"), cycle[((F.col("_nth") - 1) % len(weights)).cast("int")].cast("long").alias("weight")), "sources")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, seen = 0.0, None
    while True:
        capped = F.col("source_size") * repeats <= F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.coalesce(F.sum(F.when(capped, F.col("source_size") * repeats)), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)),
        ).first()
        if row == seen or not row[1]:
            break
        seen, level = row, (budget * total - row[0]) / row[1]
    drop_kept(own)
    full = F.col("source_size") * repeats
    return ranked.withColumn("target", F.when(full <= F.lit(level) * F.col("weight"), full.cast("double")).otherwise(F.lit(level) * F.col("weight")))


def mix(documents: DataFrame, row: str, key: str, source: str, size: str, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """``row`` (unique), ``key``, ``size``, ``source_size``, ``target``, ``taken`` and ``copies``."""
    rows = keep(documents.select(F.col(row).alias("_row"), F.col(key).alias("_key"), F.col(source).alias("source"), F.col(size).alias("_size"), F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("_shuffled")), "mix-rows")
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    targets = source_targets(rows.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, budget, repeats)
    targets = targets.select(F.col("source").alias("_source"), "source_size", "rank", "target")
    parts = partitions(rows, count)
    queued = rows.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
    served = running_total(queued, ["rank", "_shuffled", "_key", "_row"], ["rank"], "_size", "_served", "mix-queues", parts)
    copies = served.withColumn("_copy", F.explode(F.array(*[F.lit(i) for i in range(repeats)])))
    tokens = 2 * (F.col("_served") + F.col("_copy") * F.col("source_size")) - F.col("_size")
    finish = F.when(F.col("target") > 0, tokens / (2 * F.col("target"))).otherwise(F.lit(0.0))
    copies = copies.withColumn("_finish", finish).drop("_served")
    # equal times are ordered by source, shuffle and row, so that reruns agree
    cut = running_total(copies, ["_finish", "rank", "_shuffled", "_key", "_row", "_copy"], [], "_size", "_used", "mix-order", parts)
    taken = F.col("_used") <= F.lit(budget * total)
    own = [F.col("_row"), F.col("_key"), F.col("_size"), F.col("source_size"), F.col("target")]
    out = cut.groupBy(*own).agg(F.sum(F.when(taken, F.col("_size")).otherwise(F.lit(0))).alias("taken"), F.count_if(taken & (F.col("_size") > 0)).alias("copies"))
    return out.withColumnsRenamed({"_row": row, "_key": key, "_size": size})


def document_mix(documents: DataFrame) -> DataFrame:
    """The op9 rows."""
    own = documents.select("doc_id", "source", n_words().alias("size"), F.monotonically_increasing_id().alias("row"))
    return mix(own, "row", "doc_id", "source", "size").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(documents: DataFrame) -> DataFrame:
    """``documents`` as the mix takes them: each as often as it is taken, columns as they were.

    Rows are numbered once, in a table that both sides of the last join read.
    """
    placed = keep(documents.select(whole(documents).alias("doc"), F.monotonically_increasing_id().alias("row")), "mix-numbered")
    own = placed.select("row", F.col("doc.doc_id").alias("id"), F.col("doc.source").alias("source"), n_words(F.col("doc.text")).alias("words"))
    taken = only(lambda: mix(own, "row", "id", "source", "words").where("copies > 0").select("row", "copies"), "mix-taken")
    # the rows taken grow with the input: never a broadcast
    chosen = placed.join(taken.hint("merge"), "row")
    return chosen.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


ORACLE = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, row_number() OVER () AS rid FROM documents),
tot AS (SELECT CAST(sum(size) AS BIGINT) AS total FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(rank % 3) + 1] AS weight FROM s),
o AS (SELECT *, 2.0 * source_size / weight AS full_at,
        coalesce(sum(2 * source_size) OVER (ORDER BY 2.0 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(weight) OVER (ORDER BY 2.0 * source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
lv AS (SELECT arg_min(CAST(1.5 * total - before AS DOUBLE) / open, (full_at, rank)) AS level FROM o, tot WHERE CAST(1.5 * total - before AS DOUBLE) / open <= full_at),
t AS (SELECT source, source_size, rank, CASE WHEN 2 * source_size <= level * weight THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(level AS DOUBLE) * weight END AS target FROM w, lv),
q AS (SELECT d.doc_id, d.size, d.rid, t.source_size, t.target, t.rank, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS sh,
        CAST(sum(d.size) OVER (PARTITION BY t.rank ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, rid) AS BIGINT) AS served
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, k, CASE WHEN target > 0 THEN CAST(2 * (served + k * source_size) - size AS DOUBLE) / (2 * target) ELSE 0.0 END AS finish FROM q, (VALUES (0), (1)) AS copies(k)),
u AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, sh, doc_id, rid, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM c)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN used <= 1.5 * total THEN size ELSE 0 END) AS BIGINT) AS taken FROM u, tot GROUP BY doc_id, size, source_size, target, rid
"""
