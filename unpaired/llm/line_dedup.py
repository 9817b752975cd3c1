"""Line deduplication across documents, giving keep bitmaps instead of text.

Lines are hashed where the documents lie; the 128-bit hashes are dealt out by ranges of
(hash, document descending), so a line that a third of all documents hold spreads over a
third of the ranges. Each range is streamed in order: the first occurrences of a line pass,
which are those of its largest document, and from its ``min_docs``-th document on all others
are dropped. A line that a range begins or ends with is settled by the counts of its parts,
of which there are at most two for each range. What comes out are compressed bitmaps of the
lines that each document keeps; only :func:`drop_lines` moves texts.

Defined results: a null or empty text is one empty line; a row is a document, so repeated rows
count each and share their results; a null id is smaller than all others; of a line's
documents all rows of the largest id keep it; an empty table gives no rows; a text of any
length is read whole, in one task. Columns named like an output stay, as ``name_``
(:func:`unpaired.llm.common.renamed`). Two different lines of one 128-bit hash would count
as one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unpaired.llm.common import keep, renamed, whole

MIN_CHARS = 40
MIN_DOCS = 5
#: Rows of lines in one record batch.
BATCH_ROWS = 50_000

_LOWER = bytes(i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))


def line_keys(text: bytes) -> list[bytes]:
    """The keys of the lines of a UTF-8 text: without blanks at both ends, A-Z lower-cased."""
    return [x.strip(b"\t\n\v\f\r ") for x in text.translate(_LOWER).split(b"\n")]


def _long_enough(key: bytes, chars: int) -> bool:
    return len(key) >= chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= chars)


def line_hashes(documents: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """A row for each document and line key of at least ``min_chars``: ``key``, ``tag``, ``n_lines``, ``h1``, ``h2`` and the numbers of its lines.

    ``tag`` tells rows of one id apart by their texts, in every scan alike.
    """
    kind = dict(documents.dtypes)[key]
    schema = pa.schema([("tag", pa.int64()), ("n_lines", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("lines", pa.list_(pa.int32()))])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            digests: list[bytes] = []
            owners: list[int] = []

            def flush(batch=batch, rows=rows, digests=digests, owners=owners) -> pa.RecordBatch:
                pair = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
                whose = pa.array(owners, pa.int32())
                columns = [batch.column(0).take(whose), batch.column(1).take(whose), pa.array([r[0] for r in rows], pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array([r[1] for r in rows], schema.field("lines").type)]
                rows.clear(), digests.clear(), owners.clear()
                return pa.RecordBatch.from_arrays(columns, ["key", *schema.names])

            for i, value in enumerate(batch.column(2)):
                keys = line_keys(value.as_py() or b"")
                own: dict[bytes, list[int]] = {}
                for at, line in enumerate(keys):
                    if _long_enough(line, min_chars):
                        own.setdefault(xxhash.xxh3_128_digest(line), []).append(at)
                for digest, places in own.items():
                    rows.append((len(keys), places))
                    digests.append(digest)
                    owners.append(i)
                    if len(rows) >= BATCH_ROWS:
                        yield flush()
            if rows:
                yield flush()

    own = documents.select(F.col(key).alias("key"), F.xxhash64(text).alias("tag"), F.col(text).cast("binary").alias("text"))
    return own.mapInArrow(hashes, f"key {kind}, tag long, n_lines long, h1 long, h2 long, lines array<int>")


class _Run:
    """The rows of one line, as a range gives them one batch after another."""

    def __init__(self, line: tuple[int, int], top: pa.Scalar, begins_range: bool, least: int) -> None:
        self.line, self.top, self.begins_range, self.least = line, top, begins_range, least
        self.rows = 0
        self.held: list[pa.RecordBatch] = []

    def add(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.rows += len(part)
        if self.begins_range:  # its largest document may lie in the range before
            yield _result(part, "open")
            return
        self.held.append(part)
        if self.rows >= self.least:
            for x in self.held:
                first = pc.is_null(x.column("key")) if not self.top.is_valid else pc.fill_null(pc.equal(x.column("key"), self.top), False)
                yield _result(x.filter(pc.invert(first)), "dropped")
            self.held = []

    def close(self, ends_range: bool) -> Iterator[pa.RecordBatch]:
        if self.begins_range or ends_range:
            for x in self.held:
                yield _result(x, "open")
            arrays = [pa.array([self.top.as_py()], self.top.type), *(pa.array([x], pa.int64()) for x in (None, self.rows, *self.line)), pa.array([None], pa.list_(pa.int32())), pa.array(["part"])]
            yield pa.RecordBatch.from_arrays(arrays, _NAMES)


_NAMES = ["key", "tag", "n_lines", "h1", "h2", "lines", "state"]


def _result(rows: pa.RecordBatch, state: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(rows.column(c) for c in _NAMES[:-1]), pa.array([state] * len(rows), pa.string())], _NAMES)


def first_occurrences(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Streams one range of rows in order of (line, document descending).

    Gives the rows that lose their lines (``dropped``), those of which another range decides
    (``open``), and what this range knows of such lines (``part``: its rows in ``n_lines`` and
    its largest id).
    """
    run: _Run | None = None
    for batch in batches:
        if not len(batch):
            continue
        h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
        change = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
        begins, ends = np.concatenate([[0], change]), np.concatenate([change, [len(batch)]])
        at = 0
        if run is None or run.line == (int(h1[0]), int(h2[0])):
            run = run or _Run((int(h1[0]), int(h2[0])), batch.column("key")[0], True, least)
            yield from run.add(batch.slice(0, int(ends[0])))
            at = 1
        if at == len(begins):
            continue
        yield from run.close(False)
        inner = slice(at, len(begins) - 1)
        size = ends[inner] - begins[inner]
        if (many := size >= least).any():
            starts, counts = begins[inner][many], size[many]
            rows = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            ids = pc.dictionary_encode(batch.column("key"), null_encoding="encode").indices.to_numpy()
            other = ids[rows] != ids[np.repeat(starts, counts)]
            yield _result(batch.take(pa.array(rows[other])), "dropped")
        last = int(begins[-1])
        run = _Run((int(h1[last]), int(h2[last])), batch.column("key")[last], False, least)
        yield from run.add(batch.slice(last))
    if run is not None:
        yield from run.close(True)


def dropped_lines(documents: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``key``, ``tag``, ``n_lines`` and ``lines``: numbers of lines that documents lose."""
    lines = line_hashes(documents, key, text, min_chars).withColumn("tie", F.monotonically_increasing_id())
    order = ["h1", "h2", F.col("key").desc_nulls_last(), "tag", "tie"]
    ranges = lines.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    kind = dict(lines.dtypes)["key"]
    found = keep(ranges.mapInArrow(lambda batches: first_occurrences(batches, min_docs), f"key {kind}, tag long, n_lines long, h1 long, h2 long, lines array<int>, state string"), "lines")
    # two parts for each range at most, so the broadcast is bounded by the number of tasks
    parts = found.where("state = 'part'").groupBy("h1", "h2").agg(F.max("key").alias("top"), F.sum("n_lines").alias("n")).where(F.col("n") >= min_docs)
    other = found.where("state = 'open'").join(F.broadcast(parts.drop("n")), ["h1", "h2"]).where(~F.col("key").eqNullSafe(F.col("top")))
    columns = ["key", "tag", "n_lines", "lines"]
    return found.where("state = 'dropped'").select(*columns).unionByName(other.select(*columns))


def keep_bitmaps(documents: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``key``, ``tag``, ``n_lines``, ``n_dropped`` and ``bitmap`` of every document that loses lines.

    ``bitmap`` is zlib-compressed and has a bit for each line, the first one highest: 1 if it
    stays. A document that isn't listed keeps all lines.
    """
    rows = dropped_lines(documents, key, text, min_chars, min_docs).groupBy("key", "tag").agg(F.max("n_lines").alias("n_lines"), F.flatten(F.collect_list("lines")).alias("lines"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, dropped = [], []
            for n, lines in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                stays = np.ones(n, bool)
                stays[lines.values.to_numpy()] = False
                packed.append(zlib.compress(np.packbits(stays).tobytes()))
                dropped.append(n - int(stays.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(dropped, pa.int64()), pa.array(packed, pa.binary())], ["key", "tag", "n_lines", "n_dropped", "bitmap"])

    return rows.mapInArrow(pack, f"key {dict(rows.dtypes)['key']}, tag long, n_lines long, n_dropped long, bitmap binary").withColumnRenamed("key", key)


def kept_text(text: bytes, bitmap: bytes | None) -> bytes:
    """The lines of ``text`` that ``bitmap`` keeps, joined."""
    if bitmap is None:
        return text
    lines = text.split(b"\n")
    stays = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
    return b"\n".join([lines[i] for i in np.flatnonzero(stays).tolist()])


def drop_lines(documents: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with ``n_lines``, ``n_dropped`` and ``kept``: the text without the lines that ``bitmaps`` leaves out.

    Texts and bitmaps meet in one exchange by (id, hash of the text).
    """
    documents = renamed(documents, "n_lines", "n_dropped", "kept")
    own = documents.select(whole(documents).alias("row"), F.col(key).alias("key"), F.xxhash64(text).alias("tag"), F.col(text).cast("binary").alias("text"))
    marks = bitmaps.select(F.col(key).alias("k"), F.col("tag").alias("t"), "n_dropped", "bitmap").hint("merge")
    met = own.join(marks, F.col("key").eqNullSafe(F.col("k")) & (F.col("tag") == F.col("t")), "left").select("row", "text", "bitmap", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, kept = [], []
            for value, bitmap in zip(batch.column(1), batch.column(2), strict=True):
                content = value.as_py() or b""
                n.append(content.count(b"\n") + 1)
                kept.append(kept_text(content, bitmap.as_py()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(3), pa.array(kept, pa.binary())], ["row", "n_lines", "n_dropped", "kept"])

    done = met.mapInArrow(cut, f"row {dict(met.dtypes)['row']}, n_lines long, n_dropped long, kept binary")
    return done.select("row.*", "n_lines", "n_dropped", F.col("kept").cast("string").alias("kept"))


def document_lines(documents: DataFrame) -> DataFrame:
    """The op12 rows."""
    own = documents.select("doc_id", "text")
    return drop_lines(own, keep_bitmaps(own)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, unnest(lines) AS line, unnest(range(1, CAST(len(lines) + 1 AS BIGINT))) AS i FROM d),
k AS (SELECT rid, doc_id, line, i, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
g AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT rid) >= 5),
m AS (SELECT k.rid, k.doc_id, k.line, k.i, g.key IS NOT NULL AND (k.doc_id IS DISTINCT FROM g.top) AS dropped FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""
