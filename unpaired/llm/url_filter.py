"""URL filters with a sorted digest array.

Rules are kept as sorted 64-bit XXH64 keys beside their full strings in one file,
which Spark broadcasts and each Python worker memory-maps. A url's candidates (its
host and parent domains with path prefixes, of the lengths that rules have) are
hashed, probed by vectorised binary search, and confirmed against the stored string,
so a collision of digests decides nothing.

Defined results: a null url, or one without ``://``, has empty host and path and no
rule; of equal rules the blocking one counts; the longest rule wins, of equally long
ones that with the longer host; without a rule the verdict is ``DEFAULT``. Repeated
rows repeat their result. An empty table gives no rows. A url of any length costs no more than
its own bytes and one probe for each pair of lengths. Other columns of ``pages`` aren't
carried, so their names can't clash.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT = "allow"
#: Rules for each broadcast file; longer lists make several, probed one after another.
BLOCK_RULES = 2_000_000
#: Fixed values of the op6 contract.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return host, tail[:stop]


def pack_rules(rules: list[tuple[str, str, str]]) -> bytes:
    """The array file: count, keys, host lengths, verdicts, string ends, strings."""
    merged: dict[tuple[bytes, int], bool] = {}
    for host, prefix, verdict in rules:
        h = host.encode()
        key = (h + prefix.encode(), len(h))
        merged[key] = merged.get(key, False) or verdict == "block"
    keys = np.array([xxhash.xxh64_intdigest(k[0]) for k in merged], np.uint64)
    order = np.argsort(keys, kind="stable")
    listed = list(merged.items())
    items = [listed[i] for i in order.tolist()]
    columns = (keys[order], *(np.array(x, np.int64) for x in ([k[1] for k, _ in items], [v for _, v in items], np.cumsum([len(k[0]) for k, _ in items]))))
    return b"".join([np.array([len(items)], np.int64).tobytes(), *(c.tobytes() for c in columns), *(k[0] for k, _ in items)])


class RuleFile:
    """An array file that Spark broadcasts; a worker maps it from a file of its own once."""

    def __init__(self, content: bytes) -> None:
        self.content: bytes | None = content
        self.mapped: DigestArray | None = None

    def array(self) -> DigestArray:
        if self.mapped is None:
            with tempfile.NamedTemporaryFile() as f:  # its name goes at once, its pages with the worker
                f.write(self.content)
                f.flush()
                self.mapped = DigestArray(f.name)
            self.content = None
        return self.mapped


class DigestArray:
    """A memory-mapped array file."""

    def __init__(self, path: str) -> None:
        (n,) = np.fromfile(path, np.int64, 1)
        part = lambda i, kind: np.memmap(path, kind, "r", 8 + 8 * n * i, (int(n),)) if n else np.empty(0, kind)
        self.keys, self.hosts, self.blocks, self.ends = part(0, np.uint64), part(1, np.int64), part(2, np.int64), part(3, np.int64)
        start = 8 + 32 * int(n)
        self.strings = np.memmap(path, np.uint8, "r", start) if n and os.path.getsize(path) > start else np.empty(0, np.uint8)

    def find(self, candidates: list[tuple[bytes, int]]) -> np.ndarray:
        """For each (string, host length) its place in the array, else -1."""
        out = np.full(len(candidates), -1, np.int64)
        if not len(self.keys) or not candidates:
            return out
        probes = np.fromiter((xxhash.xxh64_intdigest(c[0]) for c in candidates), np.uint64, len(candidates))
        left, right = np.searchsorted(self.keys, probes), np.searchsorted(self.keys, probes, "right")
        for i in np.flatnonzero(right > left).tolist():
            text, host = candidates[i]
            for at in range(int(left[i]), int(right[i])):  # equal digests lie together
                begin = int(self.ends[at - 1]) if at else 0
                if int(self.hosts[at]) == host and self.strings[begin : int(self.ends[at])].tobytes() == text:
                    out[i] = at
        return out


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = DEFAULT, block_rules: int = BLOCK_RULES) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule`` and ``verdict`` of every url.

    ``rules`` has ``host``, ``path`` and ``verdict`` (``block`` or ``allow``).
    """
    context = pages.sparkSession.sparkContext
    own = rules.select("host", "path", "verdict").where("host is not null and path is not null")
    parts = -(-own.count() // block_rules) or 1
    # the pairs of lengths that rules have: few, however many rules there are
    sizes = sorted((r[0], r[1]) for r in own.select(F.octet_length("host"), F.octet_length("path")).distinct().collect())
    files = []
    for i in range(parts):
        part = own if parts == 1 else own.where(F.pmod(F.xxhash64("host", "path"), F.lit(parts)) == i)
        files.append(context.broadcast(RuleFile(pack_rules([tuple(r) for r in part.collect()]))))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [f.value.array() for f in files]
        for batch in batches:
            urls = [split_url(x.as_py()) for x in batch.column(1)]
            candidates, owner = [], []
            for i, (host, path) in enumerate(urls):
                name, raw = host.encode("utf-8", "surrogatepass"), path.encode("utf-8", "surrogatepass")
                for size, n in sizes:  # only domains and path prefixes as long as some rule's
                    if 0 < size <= len(name) and n <= len(raw) and (size == len(name) or name[-size - 1] == 46):
                        candidates.append((name[-size:] + raw[:n], size))
                        owner.append(i)
            best: dict[int, tuple[int, int, bytes, bool]] = {}
            for array in arrays:
                for j in np.flatnonzero((at := array.find(candidates)) >= 0).tolist():
                    text, host = candidates[j]
                    found = (len(text), host, text, bool(array.blocks[at[j]]))
                    if found > best.get(owner[j], (-1,)):
                        best[owner[j]] = found
            hits = [best.get(i) for i in range(len(urls))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([h for h, _ in urls], pa.string()), pa.array([p for _, p in urls], pa.string()),
                    pa.array([h and h[2].decode("utf-8", "surrogatepass") for h in hits], pa.string()),
                    pa.array([default if h is None else "block" if h[3] else "allow" for h in hits], pa.string()),
                ],
                [key, "host", "path", "rule", "verdict"],
            )

    return pages.select(F.col(key), F.col(url)).mapInArrow(judge, f"`{key}` {dict(pages.dtypes)[key]}, host string, path string, rule string, verdict string")


def page_verdicts(pages: DataFrame) -> DataFrame:
    """The op6 rows."""
    rules = pages.sparkSession.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge_urls(pages, rules)


ORACLE = """
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
      FROM (SELECT DISTINCT page_id, host, path FROM s), rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id, host, path)
SELECT s.page_id, s.host, s.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM s LEFT JOIN m USING (page_id)
"""
