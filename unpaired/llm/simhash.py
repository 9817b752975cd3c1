"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints within ``DISTANCE`` bits agree on at least one of ``DISTANCE + 1`` bands
of bits, so buckets of equal bands hold every link. A bucket above ``BUCKET`` rows is
dealt out again by bands of its remaining bits, up to ``LEVELS`` times; the last
level fixes 44 bits, which bounds a bucket by 2**20 distinct fingerprints. In a
bucket, fingerprints are sorted by Gray rank; groups of neighbours share a masked
bit pattern that is kept in their upper node, and a search adds up differences on
the way down and drops whole groups once they exceed the distance.

Only links that connect are kept (a bucket yields fewer links than rows), and
components come from alternating large-star and small-star steps on tables in the
shared folder.

:func:`first_of_each` drops near copies: there fingerprints and bands of minima only
propose buckets, and every link is confirmed by exact sets of shingles.

Defined results: null and wordless texts have fingerprint zero and link like any
other; equal texts share a fingerprint and so a component; repeated rows each get
their row; a null ``doc_id`` never names a component unless it has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unpaired.llm.common import drop_kept, keep, only, whole

DISTANCE = 3
SHINGLE = 3
SEED = 42
BUCKET = 4096
LEVELS = 4
FAN = 8
#: Most pairs of a query and a row that a block of a search may hold at once.
BLOCK_PAIRS = 1 << 20

#: Near copies share this part of their sets of 5-word shingles (Jaccard index), as a fraction.
SET_SHINGLE = 5
JACCARD = (4, 5)
#: Candidates agree on one of so many bands of so many minima. A pair at 0.8 is missed with
#: probability (1 - 0.8 ** 6) ** 36, under 2 in 100,000; a pair at 0.9 under 1 in 10 ** 11.
BANDS, BAND_HASHES = 36, 6
#: Shingles of one bucket above which it is dealt out in blocks.
SET_HASHES = 1 << 19

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
_LOWER = bytes(i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ``[^\\x20\\x09-\\x0D]+``, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; one for fewer words, none for none."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1]
    pieces = [joined[a:b] for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)]
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces))


def fold(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each document: bits set in over half of its hashes."""
    n, sizes = len(hashes), np.array([len(x) for x in hashes], np.int64)
    out = np.zeros((n, 8), np.uint8)
    if n and sizes.any():
        cells = np.repeat(np.arange(n) * 256, sizes)
        for i, part in enumerate(np.concatenate(hashes).view(np.uint8).reshape(-1, 8).T):  # votes from counts of byte values
            counts = np.bincount(cells + part, minlength=256 * n).reshape(n, 256)
            out[:, i] = np.packbits(2 * (counts.astype(np.float64) @ _BITS) > sizes[:, None], axis=1, bitorder="little")[:, 0]
    return out.view(np.uint64)[:, 0]


def spread(hashes: np.ndarray, word: int) -> np.ndarray:
    """Another hash of each hash, for number ``word`` of a family."""
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(word + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word: a sum of hashed bytes and their places."""
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)  # no word has a space
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, ends + 1 - starts)
    return np.add.reduceat(spread(data.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)), 11), starts)


def shingle_sets(texts: list[list[bytes]], size: int = SET_SHINGLE) -> list[np.ndarray]:
    """For each list of words, sorted distinct 64-bit hashes of its shingles; of the whole list for fewer words."""
    counts = np.array([len(x) for x in texts], np.int64)
    if not counts.any():
        return [np.empty(0, np.uint64)] * len(texts)
    each = word_hashes(list(chain.from_iterable(texts)))
    begin = np.cumsum(counts) - counts
    joined = spread(each, size)
    for k in range(1, min(size, len(each))):
        joined[:-k] = spread(joined[:-k] ^ each[k:], k)
    out = []
    for a, n in zip(begin.tolist(), counts.tolist(), strict=True):
        if n >= size:
            own = np.sort(joined[a : a + n - size + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif n:
            short = spread(each[a : a + 1], n)
            for k in range(1, n):
                short = spread(short ^ each[a + k : a + k + 1], k)
            out.append(short)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``key`` and the 64-bit ``fp`` (a signed long with the fingerprint's bits)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.empty(0, np.uint64)]
            waiting, size = [], 0
            for i, x in enumerate(batch.column(1)):
                waiting.append(shingle_hashes(words_of(x.as_py()), shingle))
                size += len(waiting[-1])
                if size > 200_000 or len(waiting) == 1000 or i == batch.num_rows - 1:
                    out.append(fold(waiting))
                    waiting, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out).view(np.int64))], [key, "fp"])

    schema = f"`{key}` {dict(documents.dtypes)[key]}, fp long"
    return documents.select(F.col(key), F.col(text)).mapInArrow(scan, schema)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over runs of codes that are sorted by Gray rank.

    Level 0 has the codes; each higher node stands for up to ``FAN`` neighbours of
    one run and keeps the bits that all of them share. ``rest`` of a node are the
    shared bits that its parent doesn't have yet, so differences add up.
    """

    def __init__(self, codes: np.ndarray, run: np.ndarray) -> None:
        self.codes = codes
        self.pattern, self.mask, self.first, self.owner = [codes], [np.full(len(codes), ~np.uint64(0))], [], [run]
        begins = np.searchsorted(run, run)  # where the run of each row begins
        place = np.arange(len(codes)) - begins
        self.top = np.zeros(int(run[-1]) + 1 if len(run) else 0, np.int64)
        while True:
            owner, pattern, mask = self.owner[-1], self.pattern[-1], self.mask[-1]
            sizes = np.bincount(owner, minlength=len(self.top))
            if (sizes <= 1).all():
                break
            self.top[sizes > 1] = len(self.pattern)
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (place[1:] % FAN == 0)
            at = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            differ = np.bitwise_or.reduceat(pattern ^ pattern[at][group], at)
            self.first.append(np.append(at, len(owner)))
            self.pattern.append(pattern[at])
            self.mask.append(np.bitwise_and.reduceat(mask, at) & ~differ)
            self.owner.append(owner[at])
            place = np.arange(len(at)) - np.searchsorted(owner[at], owner[at])
        self.parent_mask = [np.repeat(self.mask[k + 1], np.diff(self.first[k])) for k in range(len(self.first))]
        self.root = [np.searchsorted(o, np.arange(len(self.top))) for o in self.owner]

    def near(self, queries: np.ndarray, run: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query row, later row of its run) within ``distance`` bits."""
        who = node = diff = np.empty(0, np.int64)
        for level in range(len(self.pattern) - 1, -1, -1):
            begin = queries[self.top[run] == level] if level else queries[:0]
            if len(who):  # from the parents to their children
                a, b = self.first[level][node], self.first[level][node + 1]
                n = b - a
                who, diff = np.repeat(who, n), np.repeat(diff, n)
                node = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                rest = self.mask[level][node] & ~self.parent_mask[level][node]
                diff = diff + np.bitwise_count((self.codes[who] ^ self.pattern[level][node]) & rest)
                close = diff <= distance
                who, node, diff = who[close], node[close], diff[close]
            if len(begin):
                root = self.root[level][self.owner[0][begin]]
                away = np.bitwise_count((self.codes[begin] ^ self.pattern[level][root]) & self.mask[level][root]).astype(np.int64)
                close = away <= distance
                who, node, diff = np.concatenate([who, begin[close]]), np.concatenate([node, root[close]]), np.concatenate([diff, away[close]])
        later = node > who
        return who[later], node[later]


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the rows that pairs (a, b) connect the smallest label among them."""
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != (jump := label[label])).any():
            label[:] = jump
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]


def link_runs(codes: np.ndarray, run: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For each row, the first row of its run that links connect it to."""
    label = np.arange(len(codes))
    sizes = np.bincount(run)
    rows = np.flatnonzero(sizes[run] > 1)
    if not len(rows):
        return label
    index = GrayIndex(codes, run)
    load = np.cumsum(sizes[run[rows]])
    for part in np.split(rows, np.searchsorted(load, np.arange(BLOCK_PAIRS, int(load[-1]), BLOCK_PAIRS))):
        if not len(part):
            continue
        a, b = index.near(part, run[part], distance)
        join_labels(label, a, b)
    return label


def _bands(fixed: int, parts: int) -> list[int]:
    """Masks that each fix one of ``parts`` bands of the bits that aren't fixed."""
    free = [i for i in range(64) if not fixed >> i & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [fixed | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def buckets(codes: DataFrame, distance: int = DISTANCE, limit: int = BUCKET, levels: int = LEVELS) -> DataFrame:
    """``fp, mask, value``: each distinct code once for every bucket that it is in."""
    masks, out = _bands(0, distance + 1), None
    rows = codes.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    for level in range(levels):
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        if level == levels - 1:
            break
        hot = keep(rows.groupBy("mask", "value").count().where(F.col("count") > limit).drop("count"), "hot-buckets")
        if hot.isEmpty():
            break
        cold = rows.join(hot, ["mask", "value"], "left_anti")
        out = cold if out is None else out.unionByName(cold)
        below = {m: _bands(m, distance + 1) for m in masks}
        table = F.create_map(*[x for m, subs in below.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(s)) for s in subs]))])
        rows = rows.join(hot, ["mask", "value"], "left_semi").select("fp", F.explode(table[F.col("mask")]).alias("mask"))
        masks = [s for subs in below.values() for s in subs]
    rows = rows.select("fp", "mask", "value")
    return rows if out is None else out.select("fp", "mask", "value").unionByName(rows)


def links(codes: DataFrame, distance: int = DISTANCE, limit: int = BUCKET, levels: int = LEVELS) -> DataFrame:
    """Links ``a, b`` (a != b) that connect all codes within ``distance`` bits of each other."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
            run = np.cumsum(new) - 1
            codes = rows[:, 2].view(np.uint64) if rows.flags.c_contiguous is False else np.ascontiguousarray(rows[:, 2]).view(np.uint64)
            order = np.lexsort((gray_rank(codes & ~np.ascontiguousarray(rows[:, 0]).view(np.uint64)), run))
            codes, run = codes[order], run[order]
            label = link_runs(codes, run, distance)
            at = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(codes[at].view(np.int64)), pa.array(codes[label[at]].view(np.int64))], ["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            waiting.append(rows)
            if sum(map(len, waiting)) < 100_000:
                continue
            rows = np.concatenate(waiting)
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(1))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last run may go on
            if cut:
                yield flush(rows[:cut])
            waiting = [rows[cut:]]
        if waiting and len(rows := np.concatenate(waiting)):
            yield flush(rows)

    placed = buckets(codes, distance, limit, levels).select("mask", "value", "fp")
    return placed.repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b): the smallest node it reaches."""

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = keep(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large-star")
        low2 = keep(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low2, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        after = keep(small.where("a <> b").distinct(), "small-star")
        for old in (now, low, large, low2):
            drop_kept(old)
        now, before, seen = after, seen, mark(after)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def in_blocks(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` (bucket, node, size, seed, label) with ``i, j``: blocks in which every seed of a bucket meets all of its rows.

    A bucket whose sizes sum up to more than ``limit`` is cut by a hash of ``node``: its
    seeds into pieces i, its rows into pieces j. A row goes to all blocks of its piece j,
    a seed also to all blocks of its piece i, where it counts as a seed; few seeds make
    few copies. Other buckets are one block.
    """
    pieces = lambda size: F.greatest(F.lit(1), F.ceil(size / limit)).cast("int")
    load = rows.groupBy("bucket").agg(F.sum("size").alias("_all"), F.sum(F.when(F.col("seed"), F.col("size")).otherwise(0)).alias("_seeds"))
    hot = keep(load.where(F.col("_all") > limit).select("bucket", pieces(F.col("_seeds")).alias("_p"), pieces(F.col("_all")).alias("_q")), "hot-buckets")
    if hot.isEmpty():
        return rows.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    cut = rows.join(hot, "bucket", "left").withColumns({"_p": F.coalesce("_p", F.lit(1)), "_q": F.coalesce("_q", F.lit(1))})
    cut = cut.withColumns({"_i": F.pmod(F.xxhash64("node"), F.col("_p")).cast("int"), "_j": F.pmod(F.xxhash64("node", F.lit(1)), F.col("_q")).cast("int")})
    place = lambda i, j, seed: F.struct(i.alias("i"), j.alias("j"), seed.alias("seed"))
    as_row = F.transform(F.sequence(F.lit(0), F.col("_p") - 1), lambda i: place(i, F.col("_j"), F.col("seed") & (i == F.col("_i"))))
    others = F.filter(F.sequence(F.lit(0), F.col("_q") - 1), lambda j: F.col("seed") & (j != F.col("_j")))
    as_seed = F.transform(others, lambda j: place(F.col("_i"), j, F.lit(True)))
    return cut.withColumn("_at", F.explode(F.concat(as_row, as_seed))).select("bucket", "node", "size", "label", "_at.*")


def whole_runs(batches: Iterator[pa.RecordBatch], rows: int, keys: int = 3) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches put together to ``rows`` rows or more, and the run of each row: those of equal ``keys``. No run is cut."""
    waiting, count = [], 0

    def runs(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        for k in range(keys):
            code = table.column(k).combine_chunks().dictionary_encode()
            code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
            new[1:] |= np.diff(code.indices.to_numpy()) != 0
        return np.cumsum(new)

    for batch in chain(batches, [None]):
        if batch is not None:
            waiting.append(batch)
            count += batch.num_rows
            if count < rows:
                continue
        if not count:
            continue
        table = pa.Table.from_batches(waiting)
        run = runs(table)
        cut = len(run) if batch is None else int(np.searchsorted(run, run[-1]))  # the last run may go on
        if cut:
            yield table.slice(0, cut), run[:cut]
        waiting = table.slice(cut).to_batches()
        count = len(run) - cut
        rows = max(rows, 2 * count) if not cut else rows


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, limit: int = BUCKET) -> DataFrame:
    """``key``, ``fp`` and ``component_id``: the smallest key that links reach."""
    prints = keep(fingerprints(documents, key, text, shingle), "fingerprints")
    first = keep(prints.groupBy("fp").agg(F.min(key).alias("least")), "codes")
    every = component_of(first, links(first.select("fp"), distance, limit), "fp")
    return prints.join(every, F.col("fp") == F.col("_code"), "left").drop("_code")


def component_of(first: DataFrame, edges: DataFrame, code: str) -> DataFrame:
    """``_code`` and ``component_id`` for the codes of ``first`` (code, least key)."""
    own = first.select(F.col(code).alias("_code"), "least")
    member = keep(own.join(components(edges).withColumnRenamed("node", "_code"), "_code"), "members")
    lowest = keep(member.groupBy("root").agg(F.min("least").alias("component_id")), "lowest")
    named = keep(member.join(lowest, "root").select("_code", "component_id"), "named")
    alone = own.withColumnRenamed("least", "component_id").join(named.select("_code"), "_code", "left_anti")
    return keep(alone.unionByName(named), "component-of")


def document_near_duplicates(documents: DataFrame) -> DataFrame:
    """The op5 rows."""
    return near_duplicates(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``BANDS`` keys for each set; no set is empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    halves = [flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)]
    factors = (spread(np.arange(BANDS * BAND_HASHES, dtype=np.uint64), 8) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    out = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = spread(np.full(len(sets), band, np.uint64), 9)
        for i in range(band * BAND_HASHES, (band + 1) * BAND_HASHES):
            key = spread(key ^ np.minimum.reduceat(halves[i % 2] * factors[i], starts), 10)
        out[:, band] = key
    return out.view(np.int64)


def sketches(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, the 64-bit ``fp``, and of the set of 5-word shingles a ``digest``, its ``size`` and band ``keys``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, keys = [np.empty(0, np.uint64)], [np.empty((0, BANDS), np.int64)]
            digests, sizes, waiting, load = [], [], [], 0
            for i, x in enumerate(batch.column(1)):
                waiting.append(words_of(x.as_py()))
                load += len(waiting[-1])
                if load > 200_000 or len(waiting) == 1000 or i == batch.num_rows - 1:
                    prints.append(fold([shingle_hashes(x) for x in waiting]))
                    sets = shingle_sets(waiting)
                    digests += [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                    sizes += map(len, sets)
                    if filled := [x for x in sets if len(x)]:
                        keys.append(band_keys(filled))
                    waiting, load = [], 0
            ends = np.cumsum([0, *(BANDS * bool(n) for n in sizes)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).reshape(-1)))
            columns = [batch.column(0), pa.array(np.concatenate(prints).view(np.int64)), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, [key, "fp", "digest", "size", "keys"])

    schema = f"`{key}` {documents.schema[key].dataType.simpleString()}, fp long, digest binary, size long, keys array<long>"
    return documents.select(F.col(key), F.col(text)).mapInArrow(scan, schema)


def link_sets(sets: list[np.ndarray], seeds: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of ``JACCARD`` or more between the rows ``seeds`` and any others whose label differs.

    Near sets share one of their smallest hashes: a set of m has to give ceil(0.8 m) of
    them, so only the first m - ceil(0.8 m) + 1 are looked up. Every set found so is
    counted in full. Rows that links connect are given one label, and rows of one label
    aren't compared any more.
    """
    p, q = JACCARD
    n, size = len(sets), np.array([len(x) for x in sets], np.int64)
    label = np.unique(label, return_inverse=True)[1]
    start = np.concatenate([[0], np.cumsum(size)])
    ids, flat = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.minimum(size, size - (p * size + q - 1) // q + 1)
    whose = np.repeat(np.arange(n), first)
    what = flat[np.repeat(start[:-1] - np.cumsum(first) + first, first) + np.arange(len(whose))]
    order = np.argsort(what, kind="stable")
    whose, at = whose[order], np.searchsorted(what[order], np.arange(len(ids) + 1))
    mark = np.zeros(len(ids), bool)
    found: list[tuple[int, np.ndarray]] = []
    for seed in seeds.tolist():
        own = flat[start[seed] : start[seed + 1]]
        met = [whose[at[i] : at[i + 1]] for i in own[: first[seed]].tolist() if at[i + 1] - at[i] > 1]
        if not met:
            continue
        met = np.unique(np.concatenate(met))
        met = met[(label[met] != label[seed]) & (q * size[met] >= p * size[seed]) & (q * size[seed] >= p * size[met])]
        if not len(met):
            continue
        mark[own] = True
        begin = np.cumsum(size[met]) - size[met]
        hit = mark[flat[np.repeat(start[met] - begin, size[met]) + np.arange(int(size[met].sum()))]]
        mark[own] = False
        shared = np.add.reduceat(hit, begin, dtype=np.int64)
        met = met[shared * (p + q) >= p * (size[met] + size[seed])]
        if len(met):
            found.append((seed, met[np.unique(label[met], return_index=True)[1]]))
            label[np.isin(label, label[met])] = label[seed]
    ends = [np.empty(0, np.int64), *(b for _, b in found)]
    return np.repeat([a for a, _ in found], [len(b) for _, b in found]).astype(np.int64), np.concatenate(ends)


def hashed_sets(texts: DataFrame) -> DataFrame:
    """``node`` and the sorted ``hashes`` of the 5-word shingles of its ``text``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.tobytes() for y in batch.column(1) for x in shingle_sets([words_of(y.as_py())])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "hashes"])

    return texts.select("node", "text").mapInArrow(scan, "node long, hashes binary")


def confirmed_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` of near copies between the seeds of each bucket and all of its rows; see :func:`in_blocks`."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, run in whole_runs(batches, 1000):
            node, seed, label = (table.column(x).to_numpy() for x in ("node", "seed", "label"))
            sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
            cuts = np.flatnonzero(np.diff(run, prepend=-1, append=-1))
            for a, b in zip(cuts, cuts[1:], strict=False):
                one, two = link_sets(sets[a:b], np.flatnonzero(seed[a:b]), label[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(node[a + one]), pa.array(node[a + two])], ["a", "b"])

    dealt = in_blocks(rows, SET_HASHES).join(sets.hint("merge"), "node").select("bucket", "i", "j", "node", "seed", "label", "hashes")
    return dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(search, "a long, b long")


def proposals(codes: DataFrame) -> DataFrame:
    """Buckets in which every pair of candidates lies: ``bucket, hub, node, size``; the hub is one of its nodes.

    A bucket has the nodes with one band key, or those whose fingerprints links within
    3 bits connect.
    """
    hub = keep(codes.groupBy("fp").agg(F.min("node").alias("hub")), "hubs")
    same = codes.join(hub.hint("merge"), "fp").select(F.col("node").alias("a"), F.col("hub").alias("b")).where("a <> b")
    close = links(hub.select("fp"))
    for end in ("a", "b"):  # from fingerprints to nodes
        close = close.join(hub.select(F.col("fp").alias(end), F.col("hub").alias(f"_{end}")).hint("merge"), end).drop(end)
    near = components(same.unionByName(close.withColumnsRenamed({"_a": "a", "_b": "b"}))).withColumnRenamed("root", "hub")
    near = near.join(codes.select("node", "size").hint("merge"), "node").select((-1 - F.col("hub")).alias("bucket"), "hub", "node", "size")
    keyed = codes.select("node", "size", F.explode("keys").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("_high")).where("hub < _high").drop("_high")
    return near.unionByName(keyed.join(shared.hint("merge"), "bucket").select("bucket", "hub", "node", "size"))


def near_copy_links(codes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect all nodes of ``codes`` (node, row, fp, size, keys) that are near copies.

    ``texts`` has ``row`` and ``text``. First every node is compared with the hub of each
    bucket, which connects most of a group of near copies at a cost in proportion to it.
    Then, in buckets where two unconnected groups are left, all nodes outside of the
    largest group are compared with all nodes, so no link that connects is missed.
    """
    buckets = keep(proposals(codes), "buckets")
    members = codes.select("node", "row").join(buckets.select("node").distinct().hint("merge"), "node")
    sets = keep(hashed_sets(texts.join(members.hint("merge"), "row")), "shingle-sets")
    pairs = buckets.select(F.col("hub").alias("bucket"), "node", "size").distinct()
    first = components(confirmed_links(pairs.select("*", (F.col("node") == F.col("bucket")).alias("seed"), F.col("node").alias("label")), sets))
    first = keep(first, "first-groups")
    rest = buckets.where("node <> hub").join(first.hint("merge"), "node", "left").select("bucket", "node", "size", F.coalesce("root", "node").alias("label"))
    groups = rest.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    main = groups.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("n")).where("n > 1")
    open_ = keep(rest.join(main.select("bucket", "main").hint("merge"), "bucket").select("bucket", "node", "size", (F.col("label") != F.col("main")).alias("seed"), "label"), "open-buckets")
    return first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(confirmed_links(open_, sets))


def first_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies: that of the smallest key, of equal keys the first.

    Near copies are texts whose sets of 5-word shingles have a Jaccard index of 0.8 or more
    (``JACCARD``), and a group is all that such links connect. Columns stay as they were,
    whatever their names.

    Rows are numbered once, in a table that both sides of the last join read. The rows
    that stay grow with the input, so they are never broadcast.
    """
    placed = keep(documents.select(whole(documents).alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    own = placed.select(F.col("doc").getField(key).alias("key"), F.col("doc").getField(text).alias("text"), "row")
    name = F.struct(F.col("key").isNull().alias("unnamed"), "key", "row")
    prints = sketches(own.select(name.alias("name"), "text"), "name", "text")
    first = only(lambda: first_rows(prints, own.select("row", "text")), "first-rows")
    return placed.join(first.hint("merge"), "row", "left_semi").select("doc.*")


def first_rows(prints: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``row`` of the least name of each group of near copies; ``prints`` are :func:`sketches` of (unnamed, key, row)."""
    codes = prints.groupBy("digest").agg(F.min("name").alias("least"), F.min("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    codes = keep(codes.drop("digest").select("*", "least.row", F.monotonically_increasing_id().alias("node")), "codes")
    every = component_of(codes.select("node", "least"), near_copy_links(codes, texts), "node")
    return every.select("component_id.row").distinct()
