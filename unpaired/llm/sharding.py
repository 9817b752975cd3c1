"""Sharding by histogram sort, with DataFrame functions only.

Keys are (hash of the text, doc_id): equal texts lie together, and the id splits
even a text that a third of all rows share. Rounds count exact bytes and rows below
evenly spaced key boundaries, only in the intervals that still hold a splitter, until
every splitter is within ``TOLERANCE`` of its share; then rows are exchanged once, in
key order, and numbered within their shard.

Law ``bytes``: shards have near equal bytes. Defined results: a null text has size 1
and the checksum of no bytes; a null id sorts first; an empty table gives no rows;
repeated rows stay, next to each other. With all sizes in one key (the same id and
text throughout) no boundary can part the rows: they share a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from unpaired.llm.common import drop_kept, keep, ordered_rows, partitions, renamed, text_or_empty, whole

SHARDS = 8
#: A splitter is good if the bytes below it are within this share of a shard's bytes.
TOLERANCE = 0.001
#: Probes for each open splitter and round.
PROBES = 256

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _interval(column: str, edges: list[tuple[int, int, int]]) -> Column:
    """The cell of a key: the probe interval of ``edges`` (first, width, count) it is in, else null."""
    cell = F.lit(None).cast("string")
    for i, (first, width, count) in enumerate(edges):
        last = min(first + width * count - 1, HIGH)
        # differences of two longs may not fit a long: count from the first in decimals
        step = F.floor((F.col(column).cast("decimal(20,0)") - F.lit(first).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)"))
        cell = F.when((F.col(column) >= first) & (F.col(column) <= last), F.concat_ws(":", F.lit(i), step.cast("long"))).otherwise(cell)
    return cell


def _refine(sized: DataFrame, column: str, goals: list[tuple[int, float, int, int, int]], slack: float, last: bool = False) -> dict[int, tuple[int, bool]]:
    """Boundaries of ``column`` for goals (name, bytes wanted, bytes before, low, high).

    Returns, for each, a value and whether bytes of rows below it are near the goal;
    if not, the goal lies within the rows that have this very value. On the ``last``
    column, those rows go to the side that leaves the bytes nearer to the goal.
    """
    done: dict[int, tuple[int, bool]] = {}
    while goals:
        spans = sorted({(low, high) for _, _, _, low, high in goals})
        edges = []
        for low, high in spans:
            width = max(1, -(-(high - low + 1) // PROBES))
            edges.append((low, width, -(-(high - low + 1) // width)))
        cells = sized.select("size", _interval(column, edges).alias("cell")).where("cell is not null")
        found = {tuple(map(int, r[0].split(":"))): r[1] for r in cells.groupBy("cell").agg(F.sum("size")).collect()}
        left = []
        for name, wanted, before, low, high in goals:
            i = spans.index((low, high))
            first, width, count = edges[i]
            below = before
            for step in range(count):
                inside = found.get((i, step), 0)
                if below + inside > wanted or step == count - 1:
                    break
                below += inside
            begin = first + step * width
            end = min(begin + width - 1, high)
            if abs(below - wanted) <= slack:
                done[name] = (begin, True)
            elif abs(below + inside - wanted) <= slack and end < HIGH:
                done[name] = (end + 1, True)
            elif begin == end:
                after = last and end < HIGH and below + inside - wanted < wanted - below
                done[name] = (end + 1 if after else begin, False)
            else:
                left.append((name, wanted, below, begin, end))
        goals = left
    return done


def splitters(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, int | None]]:
    """``shards - 1`` boundaries (h, d): a row is below if its (h, id) is; d None bounds h alone.

    ``keys`` has ``h``, ``id`` and ``size``. The driver gets counts of probe
    intervals: at most ``PROBES`` for each open splitter.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    goals = [(k, total * k / shards, 0, LOW, HIGH) for k in range(1, shards)]
    out: dict[int, tuple[int, int | None]] = {}
    within: dict[int, list[int]] = {}
    for k, (value, near) in _refine(keys, "h", goals, slack).items():
        if near:
            out[k] = (value, None)
        else:
            within.setdefault(value, []).append(k)
    for value, names in within.items():  # a text too large for the tolerance: split it by id
        below = keys.where(F.col("h") < value).agg(F.sum("size")).first()[0] or 0
        own = keys.where(F.col("h") == value)
        low, high = own.agg(F.min("id"), F.max("id")).first()
        if low is None:
            out |= {k: (value, None) for k in names}
            continue
        below += own.where("id is null").agg(F.sum("size")).first()[0] or 0
        for k, (d, near) in _refine(own, "id", [(k, total * k / shards, below, low, high) for k in names], slack, last=True).items():
            out[k] = (value, d)
    return sorted((out[k] for k in out), key=lambda x: (x[0], x[1] is not None, x[1] or 0))


def shard_of(h: Column, key: Column, bounds: list[tuple[int, int | None]]) -> Column:
    """How many boundaries are at or below a row's key."""
    shard = F.lit(0)
    for value, d in bounds:
        past = (h >= value) if d is None else (h > value) | ((h == value) & F.coalesce(key >= d, F.lit(False)))
        shard = shard + past.cast("int")
    return shard


def histogram_shards(rows: DataFrame, h: str, key: str, size: str, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, exchanged once in key order.

    ``h`` and ``key`` are long columns, ``size`` the bytes of a row. ``rows`` has no other
    columns named ``shard``, ``slot`` or beginning with an underscore.
    """
    keys = keep(rows.select(F.col(h).alias("h"), F.col(key).cast("long").alias("id"), F.col(size).cast("long").alias("size")), "shard-keys")
    bounds = splitters(keys, shards, tolerance)
    parts = partitions(rows, keys.count())
    drop_kept(keys)
    placed = rows.withColumn("shard", shard_of(F.col(h), F.col(key).cast("long"), bounds))
    table = ordered_rows(placed, ["shard", h, key], "shards", parts)
    counted = table.groupBy("shard", "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_idx").alias("_first"))
    before = W.Window.partitionBy("shard").orderBy("_pid").rowsBetween(W.Window.unboundedPreceding, -1)
    offset = counted.select(F.col("shard").alias("_shard"), F.col("_pid").alias("_of"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    # one row for each partition and shard: bounded by partitions + shards
    placed = table.join(F.broadcast(offset), (F.col("shard") == F.col("_shard")) & (F.col("_pid") == F.col("_of")))
    return placed.withColumn("slot", F.col("_idx") + F.col("_offset")).drop("_shard", "_of", "_offset", "_pid", "_idx")


def sized(text: str = "text") -> list[Column]:
    """``h`` (hash of the text) and ``size`` (its UTF-8 bytes plus 1)."""
    return [F.xxhash64(text_or_empty(text)).alias("h"), (F.octet_length(text_or_empty(text)).cast("long") + 1).alias("size")]


def shard_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """``documents`` with their ``shard`` and ``slot`` (see :func:`unpaired.llm.common.renamed` for columns of these names)."""
    given = renamed(documents, "shard", "slot")
    rows = given.select(whole(given).alias("doc"), F.col(key).alias("key"), *sized(text))
    return histogram_shards(rows, "h", "key", "size", shards).select("doc.*", "shard", "slot")


def document_shards(documents: DataFrame) -> DataFrame:
    """The op7 rows."""
    own = documents.select("doc_id", *sized(), F.crc32(F.encode(text_or_empty("text"), "UTF-8")).alias("text_crc32"))
    placed = histogram_shards(keep(own, "sized"), "h", "doc_id", "size")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
