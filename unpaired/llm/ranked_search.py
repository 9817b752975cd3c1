"""Ranked lexical search by NRA (no random access) over impact-sorted postings.

Documents are numbered in shards of at most ``SHARD_DOCS`` where they lie. A posting's impact,
its term's weight times the saturated count, is computed by Spark, which sorts each task's
postings by (block of items, shard, impact descending) and streams them. The search reads
that stream once and in order. For every item and document it holds a lower bound (the impacts
read) and an upper bound (plus, for each term not read yet, the largest impact that its list
can still have, from the term's least and greatest impacts and the last impact read). A document
whose upper bound is under the lower bound in place ``k`` is closed for that item; reading goes on
until no open document has bounds that differ, so that membership, ties and scores are exact. Each
shard gives its first ``k``; a document is whole in one shard, so the first ``k`` of all shards are
the first ``k`` of all documents.

Nothing is exchanged but term counts and the shards' results. Memory of a task: the bounds of
``SHARD_DOCS`` documents for one block of items, and the shard's postings.

Defined results: null, empty and wordless texts have no terms and match nothing; items
without terms give no rows; a row of either table counts by itself, so repeated rows
repeat; equal scores go by ascending id, a null id last; a document without a score above 0 is not
returned; empty tables give no rows; texts of any length are read whole. Other columns aren't
carried, so their names can't clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from unpaired.llm.common import keep

FIRST = 20
SHARD_DOCS = 4096
#: Items searched together, and bytes of items for which documents are read once.
BLOCK_ITEMS = 256
BLOCK_BYTES = 32 << 20
#: First stage of the merge of the shards' results: groups for each item.
SPREAD = 64

_PLAIN = bytes(32 if i < 0x30 or 0x3A <= i <= 0x40 or 0x5B <= i <= 0x60 or 0x7B <= i <= 0x7F else i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text: runs of digits, letters and all that isn't ASCII, A-Z lower-cased."""
    return text.translate(_PLAIN).split() if text else []


class Items:
    """A part of the items: the vocabulary of all, and for each block the items of every term."""

    def __init__(self, texts: list[bytes | None], block_items: int = BLOCK_ITEMS) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.per_block = block_items
        self.n = len(texts)
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i, text in enumerate(texts):
            for term, times in Counter(terms_of(text)).items():
                number = self.vocabulary.setdefault(term, len(self.vocabulary))
                found.setdefault((i // block_items, number), []).append((i % block_items, times))
        self.pairs = sorted(found)
        self.found = found

    def block(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of one block: its terms, where each term's items begin, the items, and how often they have the term."""
        terms = [t for b, t in self.pairs if b == number]
        lists = [self.found[number, t] for t in terms]
        begins = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        flat = np.array([x for y in lists for x in y], np.int64).reshape(-1, 2)
        return np.array(terms, np.int64), begins, flat[:, 0], flat[:, 1]


class Bounds:
    """Score intervals of one block of items over one shard, narrowed as postings are read in order of impact."""

    def __init__(self, items: int, block: tuple, least: np.ndarray, most: np.ndarray, docs: int, first: int) -> None:
        self.terms, self.begins, self.item, self.times = block
        self.items, self.docs, self.first = items, docs, first
        #: The least and greatest impact of each of the block's terms.
        self.least, self.most = least, most
        self.whose = np.repeat(np.arange(len(self.terms)), np.diff(self.begins))
        self.lower = np.zeros(items * docs, np.int64)
        self.read = np.zeros(items * docs, np.int64)  # occurrences read of terms whose lists aren't over
        self.open = np.ones(items * docs, bool)
        self.over = np.zeros(len(self.terms), bool)
        self.places: list[tuple[np.ndarray, np.ndarray]] = []
        self.settled = False

    def _meetings(self, term: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The open (item, document) that postings meet: place, times, posting."""
        count = self.begins[term + 1] - self.begins[term]
        posting = np.repeat(np.arange(len(term)), count)
        entry = self.begins[term][posting] + np.arange(len(posting)) - (np.cumsum(count) - count)[posting]
        place = self.item[entry] * self.docs + slot[posting]
        live = np.flatnonzero(self.open[place])
        return place[live], self.times[entry[live]], posting[live]

    def add(self, term: np.ndarray, slot: np.ndarray, impact: np.ndarray) -> None:
        """Postings in order of impact, behind all that were read."""
        term = np.searchsorted(self.terms, term)
        place, times, posting = self._meetings(term, slot)
        np.add.at(self.lower, place, times * impact[posting])
        np.add.at(self.read, place, times)
        self.places.append((term, slot))
        self._narrow(int(impact[-1]))

    def _narrow(self, last: int) -> None:
        ended = ~self.over & (self.least > last)  # all impacts of these lists are greater: nothing is left of them
        if ended.any():
            for term, slot in self.places:
                own = ended[term]
                place, times, _ = self._meetings(term[own], slot[own])
                np.subtract.at(self.read, place, times)
            self.places = [(t[k], s[k]) for t, s in self.places if (k := ~ended[t]).any()]
            self.over |= ended
        ahead = np.where(self.over, 0, np.minimum(self.most, last))
        unread = np.bincount(self.item, (self.times * ahead[self.whose]).astype(np.float64), self.items)
        unread = np.ceil(unread).astype(np.int64)[:, None]
        lower, open_ = self.lower.reshape(self.items, -1), self.open.reshape(self.items, -1)
        # a term that was read has an impact of ``last`` or more, so it stands in ``unread`` as ``last``
        upper = lower + np.maximum(0, unread - last * self.read.reshape(self.items, -1))
        bar = np.partition(lower, self.docs - self.first, 1)[:, self.docs - self.first] if self.docs > self.first else np.zeros(self.items, np.int64)
        open_ &= (upper >= bar[:, None]) & (upper > 0)
        self.settled = not (open_ & (upper > lower)).any()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, document and score of each item's first documents; all of the stream is read, or no interval is open."""
        place = np.flatnonzero(self.open & (self.lower > 0))
        item, slot, score = place // self.docs, place % self.docs, self.lower[place]
        order = np.lexsort((slot, -score, item))
        item = item[order]
        rank = np.arange(len(order)) - np.searchsorted(item, item)
        order = order[rank < self.first]
        return place[order] // self.docs, slot[order], score[order]


def _blocks(items: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list]:
    """The items in parts of bounded size; one part as a rule."""
    own = items.select(F.col(item).alias("item"), F.col(text).cast("binary").alias("text"))
    total = own.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16), F.lit(0))).first()[0]
    n = -(-total // block_bytes) or 1
    for i in range(n):
        yield (own if n == 1 else own.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)).collect()


def counted_terms(documents: DataFrame, key: str, text: str, items: Items, shard_docs: int) -> DataFrame:
    """A row for each document with terms: ``shard``, ``slot`` (in order of ``key``), ``key``, ``n`` and its items' ``terms`` with ``counts``."""
    shipped = documents.sparkSession.sparkContext.broadcast(items)
    kind = dict(documents.dtypes)[key]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shipped.value.vocabulary
        shard = (TaskContext.get().partitionId() << 32) - 1
        for batch in batches:
            for start in range(0, len(batch), shard_docs):
                part = batch.slice(start, shard_docs)
                shard += 1
                slot = np.empty(len(part), np.int32)
                slot[pc.sort_indices(part.column(0), null_placement="at_end").to_numpy()] = np.arange(len(part))
                sizes, terms, counts = [], [], []
                for value in part.column(1):
                    words = terms_of(value.as_py())
                    sizes.append(len(words))
                    own = [(vocabulary[t], c) for t, c in Counter(words).items() if t in vocabulary]
                    terms.append([t for t, _ in own])
                    counts.append([c for _, c in own])
                rows = pa.RecordBatch.from_arrays([pa.array([shard] * len(part), pa.int64()), pa.array(slot), part.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["shard", "slot", "key", "n", "terms", "counts"])
                yield rows.filter(pc.greater(rows.column(3), 0))

    own = documents.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    return own.mapInArrow(count, f"shard long, slot int, key {kind}, n long, terms array<int>, counts array<long>")


def search(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", first: int = FIRST, shard_docs: int = SHARD_DOCS, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item``, ``rank``, ``key`` and ``score`` of each item's ``first`` best documents."""
    spark, kind = documents.sparkSession, dict(items.dtypes)[item]
    out = None
    for rows in _blocks(items, item, item_text, block_bytes):
        part = Items([r["text"] for r in rows], block_items)
        counted = keep(counted_terms(documents, key, text, part, shard_docs), "terms")
        found = _search(counted, part, first, shard_docs)
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], f"number int, item {kind}")  # a part of bounded size
        found = found.join(F.broadcast(names), "number").select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")
        out = found if out is None else out.unionByName(found)
    return out


def _search(counted: DataFrame, items: Items, first: int, shard_docs: int) -> DataFrame:
    """``number`` (of an item), ``rank``, ``key`` and ``score``."""
    spark = counted.sparkSession
    n, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holders = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = holders.select("term", F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long").alias("w"))
    in_blocks = spark.createDataFrame(pa.table({"term": pa.array([t for _, t in items.pairs], pa.int32()), "block": pa.array([b for b, _ in items.pairs], pa.int32())})) if items.pairs else spark.createDataFrame([], "term int, block int")
    # as many rows as the part of the items has different terms, which its bytes bound
    weights = keep(F.broadcast(in_blocks).join(weights, "term").where("w > 0"), "weights")
    m = f"(75 + (25 * n * {n}L) div {max(total, 1)}L)"
    postings = counted.select("shard", "slot", "key", F.expr(m).alias("m"), F.explode(F.arrays_zip("terms", "counts")).alias("p")).select("shard", "slot", "key", "m", F.col("p.terms").alias("term"), F.col("p.counts").alias("tf"))
    lists = postings.join(F.broadcast(weights), "term").select("block", "shard", F.expr("w * ((1000000000L * tf) div (1000 * tf + 12 * m))").alias("impact"), "term", "slot", "key").where("impact > 0")
    ends = {(r["term"]): (r["least"], r["most"]) for r in lists.groupBy("term").agg(F.min("impact").alias("least"), F.max("impact").alias("most")).collect()}
    shipped = spark.sparkContext.broadcast((items, ends))
    kind = dict(counted.dtypes)["key"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, ends = shipped.value
        blocks: dict[int, tuple] = {}
        state: Bounds | None = None
        now: tuple[int, int] | None = None
        keys: dict[int, object] = {}

        def results() -> Iterator[pa.RecordBatch]:
            if state is not None:
                item, slot, score = state.best()
                yield pa.RecordBatch.from_arrays([pa.array(item + now[0] * items.per_block, pa.int32()), pa.array([keys[s].as_py() for s in slot.tolist()], key_type), pa.array(score)], ["number", "key", "score"])

        for batch in batches:
            key_type = batch.schema.field("key").type
            block, shard = batch.column("block").to_numpy(), batch.column("shard").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((block[1:] != block[:-1]) | (shard[1:] != shard[:-1])) + 1, [len(batch)]]) if len(batch) else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if now != (int(block[a]), int(shard[a])):
                    yield from results()
                    now, keys = (int(block[a]), int(shard[a])), {}
                    if now[0] not in blocks:
                        own = items.block(now[0])
                        edges = np.array([ends.get(t, (0, 0)) for t in own[0].tolist()], np.int64).reshape(-1, 2)
                        blocks = {now[0]: (own, edges[:, 0], edges[:, 1])}
                    state = Bounds(min(items.per_block, items.n - now[0] * items.per_block), *blocks[now[0]], shard_docs, first)
                if state.settled:
                    continue
                part = batch.slice(a, b - a)
                slots = part.column("slot").to_numpy()
                new, where = np.unique(slots, return_index=True)
                for s, i in zip(new.tolist(), where.tolist(), strict=True):
                    if s not in keys:
                        keys[s] = part.column("key")[i]
                state.add(part.column("term").to_numpy().astype(np.int64), slots.astype(np.int64), part.column("impact").to_numpy())
        yield from results()

    ordered = lists.sortWithinPartitions("block", "shard", F.col("impact").desc())
    best = ordered.mapInArrow(merge, f"number int, key {kind}, score long")
    by = [F.col("score").desc(), F.col("key").asc_nulls_last()]
    best = best.withColumn("spread", F.pmod(F.xxhash64("key", "score"), F.lit(SPREAD)))
    best = best.withColumn("rank", F.row_number().over(W.Window.partitionBy("number", "spread").orderBy(*by))).where(F.col("rank") <= first)
    return best.withColumn("rank", F.row_number().over(W.Window.partitionBy("number").orderBy(*by))).where(F.col("rank") <= first).select("number", "rank", "key", "score")


def benchmark_ranking(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The op13 rows."""
    return search(documents, benchmark)


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
b AS (SELECT row_number() OVER () AS bid, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM benchmark),
s AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
wanted AS (SELECT bid, term, count(*) AS times FROM (SELECT bid, unnest(terms) AS term FROM b) GROUP BY bid, term),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM wanted) GROUP BY rid, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * (SELECT docs FROM s) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf GROUP BY term),
m AS (SELECT rid, doc_id, 75 + (25 * CAST(len(terms) AS BIGINT) * docs) // total AS m FROM d, s WHERE len(terms) > 0),
scores AS (SELECT bid, m.rid, m.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
           FROM wanted JOIN w USING (term) JOIN tf USING (term) JOIN m USING (rid) GROUP BY bid, m.rid, m.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY bid ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r JOIN b USING (bid) WHERE rank <= 20
"""
