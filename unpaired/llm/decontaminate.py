"""Benchmark decontamination with suffix arrays over shards of the training text.

Each task encodes the words of its documents in the test set's vocabulary (other
words become 0, which no test suffix contains), sorts the suffixes of every shard
of about ``SHARD_WORDS`` words, and binary-searches every test suffix in it by its
leading window. The longest match at a place found so is the common prefix with its
neighbours among the sorted test suffixes, found by bisection again; common prefixes
are measured by bisection on sums of two modular polynomials, and the longest match of a document
is compared word by word. No pair of places is ever listed, so memory and time grow with
the words of a shard, repetitive texts included. A document lies in one shard whole, so
nothing is shuffled.

Defined results: null or wordless texts have no words and are never contaminated;
items without words or without an id are skipped; repeated items count once by id;
an empty test set or an empty table gives no hits. Repeated documents are judged
row by row. Equally long matches go by their place, then by the item that sorts first.
All columns of ``documents`` are carried. Texts of any length are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unpaired.llm.common import renamed, whole

WINDOW = 13
SHARD_WORDS = 1_000_000
#: Test sets above this many bytes of text are searched block by block.
BLOCK_BYTES = 32 << 20

_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())), ("longest", pa.struct([("n_words", pa.int64()), ("start", pa.int64()), ("item", pa.string())]))])
FOUND = "struct<n_words:long,spans:array<struct<start:long,end:long>>,items:array<string>,longest:struct<n_words:long,start:long,item:string>>"
_PLAIN = bytes(32 if i < 0x30 or 0x3A <= i <= 0x40 or 0x5B <= i <= 0x60 or 0x7B <= i <= 0x7F else i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split() if text else []


# Two primes under 2^31, and a base for each.
_PRIMES = (2147483647, 2147483629)
_BASES = (1000000007, 999999937)


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * pow(base, done, prime) % prime
        done += more
    return out


class Text:
    """Words as numbers, 0 between texts, with what it takes to compare stretches of them."""

    def __init__(self, tokens: np.ndarray) -> None:
        self.tokens = np.append(tokens, 0)
        ends = np.where(self.tokens == 0, np.arange(len(self.tokens)), len(self.tokens))
        self.reach = np.minimum.accumulate(ends[::-1])[::-1] - np.arange(len(self.tokens))
        self.sums = [np.append(0, np.cumsum(self.tokens * _powers(b, p, len(self.tokens)) % p) % p) for b, p in zip(_BASES, _PRIMES, strict=True)]


class Prefixes:
    """Common prefixes of suffixes of two texts."""

    def __init__(self, a: Text, b: Text) -> None:
        self.a, self.b = a, b
        self.powers = [_powers(base, p, max(len(a.tokens), len(b.tokens)) + 1) for base, p in zip(_BASES, _PRIMES, strict=True)]

    def same(self, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for prime, power, s, t in zip(_PRIMES, self.powers, self.a.sums, self.b.sums, strict=True):
            left = (s[x + size] - s[x]) % prime * power[y] % prime
            out &= left == (t[y + size] - t[y]) % prime * power[x] % prime
        return out

    def length(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words the suffixes at ``x`` and ``y`` have in common."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.a.reach[x], self.b.reach[y])
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) >> 1
            good = self.same(x[open_], y[open_], middle)
            low[open_] = np.where(good, middle, low[open_])
            high[open_] = np.where(good, high[open_], middle - 1)
        return low

    def locate(self, x: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``order`` (suffixes of the second text, sorted), from low to high, each ``x`` belongs, and its longest common prefix there."""
        begin, end, low, high = low, high, low.copy(), high.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) >> 1
            y = order[middle]
            size = self.length(x[open_], y)
            after = self.b.tokens[y + size] < self.a.tokens[x[open_] + size]
            low[open_] = np.where(after, middle + 1, low[open_])
            high[open_] = np.where(after, high[open_], middle)
        best = np.zeros(len(x), np.int64)
        for at in (low - 1, low):
            has = np.flatnonzero((at >= begin) & (at < end))
            best[has] = np.maximum(best[has], self.length(x[has], order[at[has]]))
        return low, best

    def sharing(self, x: np.ndarray, size: np.ndarray, at: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From where to where in ``order``, around ``at``, suffixes share ``size`` words with ``x``."""

        def edge(inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
            # ``inner`` is the last place known to share, or beside ``at``; ``outer`` doesn't share
            inner, outer = inner.copy(), outer.copy()
            while (open_ := np.flatnonzero(np.abs(outer - inner) > 1)).size:
                middle = (inner[open_] + outer[open_]) >> 1
                good = self.same_at_least(x[open_], order[middle], size[open_])
                inner[open_] = np.where(good, middle, inner[open_])
                outer[open_] = np.where(good, outer[open_], middle)
            return inner

        return edge(at, low - 1), edge(at - 1, high) + 1

    def same_at_least(self, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        fits = np.minimum(self.a.reach[x], self.b.reach[y]) >= size
        return fits & self.same(x, y, np.where(fits, size, 0))


def _least(ranks: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``ranks`` in each non-empty range, by minima of stretches of powers of two."""
    size = np.frexp((high - low).astype(np.float64))[1] - 1  # 2^size words at most
    out = np.empty(len(low), ranks.dtype)
    table, level = ranks, 0
    for k in range(int(size.max(initial=0)) + 1):
        while level < k:
            step = 1 << level
            table = np.minimum(table[:-step], table[step:]) if len(table) > step else table
            level += 1
        own = np.flatnonzero(size == k)
        out[own] = np.minimum(table[low[own]], table[high[own] - (1 << k)])
    return out


class TestSet:
    """A block of the test set: its vocabulary, suffixes and distinct windows."""

    __test__ = False

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[str] = []
        self.tokens: list[list[int]] = []
        windows: dict[tuple[int, ...], set[str]] = {}
        places: dict[tuple[int, ...], int] = {}
        suffixes: list[tuple[int, int, int]] = []
        for key, text in items:
            words = words_of(text)
            if key is None or not words:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            self.ids.append(str(key))
            self.tokens.append(ids)
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1):
                own = tuple(ids[i : i + size])
                windows.setdefault(own, set()).add(str(key))
                suffixes.append((len(self.tokens) - 1, i, places.setdefault(own, len(places))))
        self.longest = max(map(len, self.tokens), default=0)
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.packed = max(1, min(62 // self.bits, window))
        self.windows = np.zeros((len(windows), window), np.int64)
        self.sizes = np.array([len(x) for x in windows], np.int64)
        for i, x in enumerate(windows):
            self.windows[i, : len(x)] = x
        self.items = [sorted(x) for x in windows.values()]
        #: Of every test suffix of a window or more: its item, its place in it, and its window.
        self.item, self.pos, self.window = np.array(suffixes, np.int64).reshape(-1, 3).T
        lengths = np.array([len(x) for x in self.tokens], np.int64)
        self.flat = np.concatenate([np.empty(0, np.int64), *(np.array(x, np.int64) for x in self.tokens)])
        self.at = (np.cumsum(lengths) - lengths)[self.item] + self.pos
        self.left = lengths[self.item] - self.pos
        self.names, self.name_rank = np.unique(np.array(self.ids, object), return_inverse=True)
        self._sort_suffixes(lengths, window)

    def _sort_suffixes(self, lengths: np.ndarray, window: int) -> None:
        """Orders the suffixes of ``window`` words or more, among which places of documents are located."""
        begins = np.cumsum(lengths + 1) - lengths - 1 if len(lengths) else lengths
        text = np.zeros(int(lengths.sum()) + len(lengths) + 1, np.int64)
        text[np.delete(np.arange(len(text)), np.append(begins + lengths, len(text) - 1))] = self.flat
        self.text = Text(text)
        order = SuffixArray(text, self.bits, self.packed, self.longest).order
        number = np.full(len(text), -1, np.int64)  # which test suffix begins at a place
        number[begins[self.item] + self.pos] = np.arange(len(self.item))
        number[begins[self.item[self.left < window]] + self.pos[self.left < window]] = -1
        order = order[number[order] >= 0]
        self.sorted = order
        self.sorted_suffix = number[order]
        self.sorted_name = self.name_rank[self.item[self.sorted_suffix]]
        # suffixes of one leading window lie together
        own = self.window[self.sorted_suffix]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        self.window_low, self.window_high = np.zeros((2, len(self.sizes)), np.int64)
        self.window_low[own[first]], self.window_high[own[first]] = first, np.append(first[1:], len(own))


class SuffixArray:
    """Suffixes of ``tokens`` (0 separates documents) in order of their first ``depth`` words."""

    def __init__(self, tokens: np.ndarray, bits: int, packed: int, depth: int) -> None:
        self.packed, self.bits = packed, bits
        self.tokens = tokens = np.concatenate([tokens, np.zeros(2 * max(depth, packed) + 1, tokens.dtype)])
        starts = np.flatnonzero(tokens)
        key = np.zeros(len(starts), np.int64)
        for j in range(packed):
            key = (key << bits) | tokens[starts + j]
        order = np.argsort(key)
        self.order, self.keys = starts[order], key[order]
        n = len(starts)
        first = np.ones(n, bool)
        first[1:] = self.keys[1:] != self.keys[:-1]
        rank = np.zeros(len(tokens), np.int64)
        rank[self.order] = np.maximum.accumulate(np.where(first, np.arange(n), 0)) + 1
        reach = packed
        while reach < depth:  # double the length that ranks tell apart, where ties are left
            tied = ~first
            tied[:-1] |= ~first[1:]
            where = np.flatnonzero(tied)
            if not len(where):
                break
            at = self.order[where]
            key = rank[at] * (n + 2) + rank[at + reach]
            by = np.argsort(key)
            self.order[where], key = at[by], key[by]
            new = np.ones(len(where), bool)
            new[1:] = key[1:] != key[:-1]
            first[where] = new
            rank[self.order[where]] = where[np.maximum.accumulate(np.where(new, np.arange(len(where)), 0))] + 1
            reach *= 2

    def ranges(self, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window, where the suffixes that begin with it start and end."""
        low = np.zeros(len(windows), np.int64)
        for j in range(self.packed):
            low = (low << self.bits) | (windows[:, j] if j < windows.shape[1] else 0)
        short = np.maximum(0, self.packed - sizes) * self.bits
        left, right = np.searchsorted(self.keys, low), np.searchsorted(self.keys, low + (np.int64(1) << short) - 1, "right")
        more = np.flatnonzero((sizes > self.packed) & (right > left))
        if len(more):
            rest, tail = windows[more], sizes[more]
            left[more], right[more] = (self._bound(rest, tail, left[more], right[more], past) for past in (False, True))
        return left, right

    def _bound(self, windows: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, past: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        last = len(self.order) - 1
        columns = np.arange(self.packed, windows.shape[1])
        inside = columns[None, :] < sizes[:, None]
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            at = self.order[np.minimum(middle, last)]
            sign = np.sign(self.tokens[at[:, None] + columns] - windows[:, self.packed :]) * inside
            differs = sign != 0
            sign = np.where(differs.any(1), sign[np.arange(len(sign)), differs.argmax(1)], 0)
            after = sign <= 0 if past else sign < 0
            low, high = np.where(open_ & after, middle + 1, low), np.where(open_ & ~after, middle, high)
        return low


def shard_tokens(texts: list[list[bytes]], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The words of a shard as ids with a 0 before each document, and where documents begin."""
    sizes = np.array([len(x) for x in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    tokens = np.zeros(int(begins[-1]) + 1, np.int64)
    for i, words in enumerate(texts):
        tokens[begins[i] + 1 : begins[i] + 1 + len(words)] = np.fromiter(map(vocabulary.get, words, repeat(0)), np.int64, len(words))
    return tokens, begins


def _expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each low to its high, and the place of the pair that each is from."""
    count = high - low
    whose = np.repeat(np.arange(len(low)), count)
    return low[whose] + np.arange(len(whose)) - (np.cumsum(count) - count)[whose], whose


def search_shard(texts: list[list[bytes]], test: TestSet) -> list[tuple[list[tuple[int, int]], list[str], tuple[int, int, str] | None]]:
    """For each document: its hit spans of words (merged), the ids of the items found, and its longest match.

    A longest match is (words, first word, item); ties take the first place, then the
    item that sorts first.
    """
    found: list = [([], [], None) for _ in texts]
    if not len(test.windows):
        return found
    tokens, begins = shard_tokens(texts, test.vocabulary)
    suffixes = SuffixArray(tokens, test.bits, test.packed, test.longest)
    left, right = suffixes.ranges(test.windows, test.sizes)
    count = right - left
    hit = np.flatnonzero(count > 0)
    if not len(hit):
        return found
    place, whose = _expanded(left[hit], right[hit])
    window, start = hit[whose], suffixes.order[place]
    n = len(tokens) + 1
    edge = np.bincount(start, minlength=n) - np.bincount(start + test.sizes[window], minlength=n)
    covered = np.cumsum(edge) > 0
    change = np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))
    opened, closed = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    place = np.searchsorted(begins, opened, "right") - 1
    for d, a, b in zip(place.tolist(), (opened - begins[place] - 1).tolist(), (closed - begins[place] - 1).tolist(), strict=True):
        found[d][0].append((a, b))
    doc = np.searchsorted(begins, start, "right") - 1
    pairs = np.unique(doc * len(test.windows) + window)
    docs, windows = pairs // len(test.windows), pairs % len(test.windows)
    listed: dict[bytes, list[str]] = {}
    cuts = np.flatnonzero(np.diff(docs)) + 1
    for d, own in zip(docs[np.concatenate([[0], cuts])].tolist(), np.split(windows, cuts), strict=True):
        names = listed.get(own.tobytes())
        if names is None:
            names = listed[own.tobytes()] = sorted({x for w in own.tolist() for x in test.items[w]})
        found[d][1].extend(names)
    for d, match in _longest_of_documents(tokens, begins, test, start, window):
        found[d] = (*found[d][:2], match)
    return found


def _longest_of_documents(tokens: np.ndarray, begins: np.ndarray, test: TestSet, start: np.ndarray, window: np.ndarray) -> Iterator[tuple[int, tuple[int, int, str]]]:
    """The longest match of each document, from the places where test windows ``start``."""
    size = test.sizes[window]  # of a short item; a full window may go on
    full = np.flatnonzero(test.window_high[window] > test.window_low[window])
    prefixes = Prefixes(Text(tokens), test.text)
    low, high = test.window_low[window[full]], test.window_high[window[full]]
    at = np.zeros(len(start), np.int64)
    at[full], size[full] = prefixes.locate(start[full], test.sorted, low, high)
    doc = np.searchsorted(begins, start, "right") - 1
    order = np.lexsort((start, -size, doc))
    best = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
    long = np.isin(best, full)
    own = best[long]
    name = np.zeros(len(best), np.int64)
    low, high = prefixes.sharing(start[own], size[own], at[own], test.sorted, test.window_low[window[own]], test.window_high[window[own]])
    name[long] = _least(test.sorted_name, low, high)
    like = iter(test.sorted[low].tolist())
    for i, is_long, rank in zip(best.tolist(), long.tolist(), name.tolist(), strict=True):
        n, place = int(size[i]), int(start[i])
        if is_long:
            other = next(like)
            if not np.array_equal(tokens[place : place + n], test.text.tokens[other : other + n]):
                raise RuntimeError("two stretches of words have equal sums but differ")
        yield int(doc[i]), (n, int(place - begins[doc[i]] - 1), test.names[rank] if is_long else test.items[window[i]][0])


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list]:
    """The test set in blocks of bounded size; one block as a rule."""
    own = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where("item is not null and text is not null")
    total = own.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
    n = -(-total // block_bytes) or 1
    for i in range(n):
        part = own if n == 1 else own.where(F.pmod(F.xxhash64("item"), F.lit(n)) == i)
        yield [tuple(r) for r in part.collect()]


def _merged(a: list[dict], b: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for s, e in sorted([(x["start"], x["end"]) for x in a] + b):
        if out and s <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], e)
        else:
            out.append({"start": s, "end": e})
    return out


def find(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "found", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` with ``out``: number of words, hit spans of words, items found, and the longest match with its place.

    A column named ``out`` stays under another name (:func:`unpaired.llm.common.renamed`).
    """
    at = documents.columns.index(text)
    documents = renamed(documents, out)
    done = documents.withColumn(out, F.lit(None).cast(FOUND))
    for block in _blocks(benchmark, item, item_text, block_bytes):
        test = documents.sparkSession.sparkContext.broadcast(TestSet(block, window))

        def search(batches: Iterator[pa.RecordBatch], test=test) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                before = batch.column(batch.num_columns - 1).to_pylist()
                rows: list[dict] = []
                shard: list[list[bytes]] = []
                size = 0
                texts = batch.column(at)
                for i in range(len(texts)):
                    words = words_of(texts[i].as_py())
                    shard.append(words)
                    size += len(words)
                    if size >= shard_words or i == len(texts) - 1:
                        for words, (spans, items, longest) in zip(shard, search_shard(shard, test.value), strict=True):
                            old = before[len(rows)] or {"spans": [], "items": [], "longest": None}
                            best = [x for x in (old["longest"], longest and dict(zip(("n_words", "start", "item"), longest, strict=True))) if x]
                            best = min(best, key=lambda x: (-x["n_words"], x["start"], x["item"]), default=None)
                            rows.append({"n_words": len(words), "spans": _merged(old["spans"], spans), "items": sorted({*old["items"], *items}), "longest": best})
                        shard, size = [], 0
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, _FOUND)], batch.schema.names)

        done = done.mapInArrow(search, done.schema)
    return done


def summary(found: str = "found") -> dict[str, Column]:
    """Columns that say how far a document is contaminated."""
    words, items = F.col(f"{found}.n_words"), F.col(f"{found}.items")
    hit = F.aggregate(f"{found}.spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return {
        "n_words": words,
        "n_hit": hit,
        "n_items": F.size(items).cast("long"),
        "items_sha256": F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256),
        "contaminated": (hit > 0) & (20 * hit >= words),
        "longest": F.coalesce(f"{found}.longest.n_words", F.lit(0).cast("long")),
        "longest_start": F.col(f"{found}.longest.start"),
        "longest_item": F.col(f"{found}.longest.item"),
    }


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` without the contaminated ones, all columns as they were."""
    found = find(documents.select(whole(documents).alias("doc"), F.col(text).alias("text")), benchmark, "text")
    return found.where(~summary()["contaminated"]).select("doc.*")


def longest_matches(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every test suffix, its longest verbatim match over all shards.

    ``item``, ``item_pos``, ``n_words`` and one place of it (``key``, ``doc_pos``);
    matches under ``least`` words are left out. Ties take the smallest key and place.
    """
    kinds = dict(documents.dtypes)
    name = dict(benchmark.dtypes)[item]
    out = None
    for block in _blocks(benchmark, item, item_text, block_bytes):
        test = documents.sparkSession.sparkContext.broadcast(TestSet(block, least))

        def search(batches: Iterator[pa.RecordBatch], test=test) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [words_of(x.as_py()) for x in batch.column(1)]
                start = 0
                while start < len(texts):
                    stop, size = start, 0
                    while stop < len(texts) and size < shard_words:
                        size += len(texts[stop])
                        stop += 1
                    own = batch.column(0).slice(start, stop - start)
                    rank = np.empty(len(own), np.int64)
                    rank[pc.sort_indices(own, null_placement="at_start").to_numpy()] = np.arange(len(own))
                    item, pos, size, doc, at = _longest(texts[start:stop], test.value, rank)
                    names = pa.array(test.value.ids, pa.string()).take(pa.array(item))
                    yield pa.RecordBatch.from_arrays([names, pa.array(pos), pa.array(size), own.take(pa.array(doc)), pa.array(at)], ["item", "item_pos", "n_words", "key", "doc_pos"])
                    start = stop

        found = documents.select(F.col(key), F.col(text)).mapInArrow(search, f"item string, item_pos long, n_words long, key {kinds[key]}, doc_pos long")
        out = found if out is None else out.union(found)
    best = out.groupBy("item", "item_pos").agg(F.min(F.struct((-F.col("n_words")).alias("n"), "key", "doc_pos")).alias("b"))
    return best.select(F.col("item").cast(name).alias(item), "item_pos", (-F.col("b.n")).alias("n_words"), F.col("b.key").alias(key), F.col("b.doc_pos").alias("doc_pos"))


def _longest(texts: list[list[bytes]], test: TestSet, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(item, item_pos, n_words, document, doc_pos) of one shard for each test suffix; ties take the document of the least ``rank``."""
    empty = (np.empty(0, np.int64),) * 5
    if not len(test.windows):
        return empty
    tokens, begins = shard_tokens(texts, test.vocabulary)
    suffixes = SuffixArray(tokens, test.bits, test.packed, test.longest)
    left, right = suffixes.ranges(test.windows, test.sizes)
    suffix = np.flatnonzero(right[test.window] > left[test.window])
    if not len(suffix):
        return empty
    low, high, size = left[test.window[suffix]], right[test.window[suffix]], test.sizes[test.window[suffix]]
    full = np.flatnonzero(test.window_high[test.window[suffix]] > test.window_low[test.window[suffix]])
    place = np.zeros(len(test.item), np.int64)
    place[test.sorted_suffix] = test.sorted
    x = place[suffix[full]]
    prefixes = Prefixes(test.text, Text(tokens))
    at, size[full] = prefixes.locate(x, suffixes.order, low[full], high[full])
    low[full], high[full] = prefixes.sharing(x, size[full], at, suffixes.order, low[full], high[full])
    doc = np.searchsorted(begins, suffixes.order, "right") - 1
    best = np.lexsort((suffixes.order, rank[doc]))
    ranks = np.empty(len(best), np.int32)
    ranks[best] = np.arange(len(best))
    start = suffixes.order[best[_least(ranks, low, high)]]
    doc = np.searchsorted(begins, start, "right") - 1
    return test.item[suffix], test.pos[suffix], size, doc, start - begins[doc] - 1


def document_contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The op2 rows."""
    own = documents.select("doc_id", "text")
    found = find(own, benchmark)
    return found.select("doc_id", *(c.alias(n) for n, c in summary().items()))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS bid, CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT bid, item, w, least(13, len(w)) AS n, unnest(range(1, CAST(len(w) - least(13, len(w)) + 2 AS BIGINT))) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT rid, n, w, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d, sizes WHERE len(w) >= n),
occ AS (SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM dw),
hits AS (SELECT rid, item, occ.n, i FROM occ JOIN win ON occ.n = win.n AND occ.win = win.win),
posn AS (SELECT bid, item, n, i AS place, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM bw),
pairs AS (SELECT rid, bid, item, occ.n, occ.i, occ.i - place AS diagonal FROM occ JOIN posn ON occ.n = posn.n AND occ.win = posn.win),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY rid, bid, diagonal ORDER BY i) AS run FROM pairs),
matches AS (SELECT rid, item, any_value(n) + count(*) - 1 AS words, min(i) - 1 AS start FROM runs GROUP BY rid, bid, item, diagonal, run),
best AS (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY rid ORDER BY words DESC, start, item) = 1),
hw AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, n, i FROM hits)) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       CAST(coalesce(best.words, 0) AS BIGINT) AS longest, CAST(best.start AS BIGINT) AS longest_start, best.item AS longest_item
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid) LEFT JOIN best USING (rid)
"""
