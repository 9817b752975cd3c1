"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed for all documents in one Arrow pass. Trees are grown on the
driver from a bounded sample (``FIT_ROWS`` labelled documents of the smallest hash of
the id), with quantile bins and the logistic loss, and flattened into arrays of
feature, threshold and children that a few numpy steps traverse for all rows and
trees at once.

Defined results: null and empty texts have statistics of zero and are scored like any
other; rows without a label are scored, not learned from; of several labels of one
document the lowest counts; with nothing to learn from every score is 0.5; one label
only gives that label's score throughout. Repeated rows repeat their result.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unpaired.llm.common import bounded_sample

FIT_ROWS = 20_000
TREES = 60
DEPTH = 4
BINS = 64
SHRINK = 0.15
RIDGE = 1.0
LEAST_WEIGHT = 1.0
THRESHOLD = 0.3

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".?", "pause": b",;:", "bang": b"!",
    "bar": b"|", "symbol": b"#$%&*+<=>@\\^_`~{}[]", "quote": b"\"'()-/", "space": b" \t\r\x0b\x0c", "line": b"\n", "beyond": bytes(range(128, 256)),
}
_CLASS_OF = np.zeros((256, len(_CLASSES)))
for _i, _members in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_members), _i] = 1
STATISTICS = ("log_bytes", "log_words", "mean_word", "longest_word", "distinct_words", "repeated_words", "distinct_pairs", "log_lines", "distinct_lines", "mean_line", "upper_words", *(f"share_{k}" for k in _CLASSES))


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "surrogatepass")
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS_OF / len(raw)
    words, lines = raw.split(), raw.split(b"\n")
    n = len(words) or 1
    rest = words[1:]
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), sum(map(len, words)) / n, float(max(map(len, words), default=0)), len(set(words)) / n, sum(map(eq, words, rest)) / n,
        len(set(zip(words, rest, strict=False))) / n, float(np.log1p(len(lines))), len(set(lines)) / len(lines), len(raw) / len(lines), sum(map(bytes.isupper, words)) / n, *shares.tolist(),
    ]


def document_statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with ``stats`` in place of the text."""
    at = documents.columns.index(text)
    names = [c for c in documents.columns if c != text]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(stats, pa.list_(pa.float64()))], [*names, "stats"])

    schema = documents.drop(text).withColumn("stats", F.array(F.lit(0.0))).schema
    return documents.mapInArrow(measure, schema)


class Trees:
    """Boosted trees as flat arrays; a leaf points to itself."""

    def __init__(self, base: float) -> None:
        self.base = base
        self.roots = np.zeros(0, np.int64)
        self.feature = self.left = self.right = np.zeros(0, np.int64)
        self.threshold = self.value = np.zeros(0)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row; all rows and trees go down together."""
        at = np.tile(self.roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Histogram boosting with second-order gains."""
    rate = float(y.mean()) if len(y) else 0.5
    made = Trees(float(np.clip(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9)), -20, 20)))
    if rate in (0.0, 1.0) or not len(y):
        return made
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], 1)  # bin b: up to edges[b]
    flat: list[list] = []  # feature, threshold, left, right, value
    roots, margin = [], np.full(len(y), made.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = p - y, p * (1 - p)
        roots.append(len(flat))
        flat.append([0, np.inf, len(flat), len(flat), 0.0])
        node = np.full(len(y), roots[-1])
        open_ = [roots[-1]]
        for depth in range(DEPTH + 1):
            number = {k: i for i, k in enumerate(open_)}
            inside = np.flatnonzero(np.isin(node, open_))
            own = np.array([number[k] for k in node[inside].tolist()], np.int64)
            g, h = np.bincount(own, slope[inside], len(open_)), np.bincount(own, bend[inside], len(open_))
            for k, i in number.items():
                flat[k][4] = -SHRINK * g[i] / (h[i] + RIDGE)
            if depth == DEPTH:
                break
            best = [(1e-6, -1, 0)] * len(open_)
            for f in range(x.shape[1]):
                width = len(edges[f]) + 1
                if width < 2:
                    continue
                cell = own * width + binned[inside, f]
                gl = np.bincount(cell, slope[inside], len(open_) * width).reshape(-1, width).cumsum(1)[:, :-1]
                hl = np.bincount(cell, bend[inside], len(open_) * width).reshape(-1, width).cumsum(1)[:, :-1]
                gr, hr = g[:, None] - gl, h[:, None] - hl
                gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - (g**2 / (h + RIDGE))[:, None]
                gain[(hl < LEAST_WEIGHT) | (hr < LEAST_WEIGHT)] = 0
                cut = gain.argmax(1)
                for i in range(len(open_)):
                    if gain[i, cut[i]] > best[i][0]:
                        best[i] = (float(gain[i, cut[i]]), f, int(cut[i]))
            nexts = []
            for k, i in number.items():
                _, f, cut = best[i]
                if f < 0:
                    continue
                a, b = len(flat), len(flat) + 1
                flat += [[0, np.inf, a, a, 0.0], [0, np.inf, b, b, 0.0]]
                flat[k][:4] = [f, float(edges[f][cut]), a, b]
                rows = inside[own == i]
                node[rows] = np.where(binned[rows, f] <= cut, a, b)
                nexts += [a, b]
            open_ = nexts
            if not open_:
                break
        margin += np.array([r[4] for r in flat])[node]
    made.roots = np.array(roots, np.int64)
    made.feature, made.left, made.right = (np.array([r[i] for r in flat], np.int64) for i in (0, 2, 3))
    made.threshold, made.value = (np.array([r[i] for r in flat], np.float64) for i in (1, 4))
    return made


def fit_quality(documents: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Trees | None:
    """Trees fitted on at most ``rows`` labelled documents for which ``learn`` (of ``key``) holds."""
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).alias("_label"))
    marked = marked.withColumnRenamed("_key", key).where(learn).groupBy(key).agg(F.min("_label").alias("_label"))
    sample = bounded_sample(marked, rows)
    if not sample:
        return None
    chosen = documents.sparkSession.createDataFrame(sample, marked.schema).withColumnRenamed(key, "_key")
    # at most FIT_ROWS rows of two numbers: a bounded broadcast
    texts = documents.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("_key")).select("_id", "_label", "_text")
    measured = document_statistics(texts, "_text").groupBy("_id").agg(F.min(F.struct("stats", "_label")).alias("r")).orderBy("_id").select("r.*").collect()
    if not measured:
        return None
    return grow(np.array([r["stats"] for r in measured]), np.array([float(r["_label"] == 1) for r in measured]))


def score_quality(documents: DataFrame, trees: Trees | None, text: str = "text") -> DataFrame:
    """``documents`` without their text, with ``score`` and ``predicted``."""
    shipped = documents.sparkSession.sparkContext.broadcast(trees)
    measured = document_statistics(documents, text)
    names = [c for c in measured.columns if c != "stats"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(batch.num_columns - 1).to_pylist(), np.float64).reshape(-1, len(STATISTICS))
            found = shipped.value.score(x) if shipped.value else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], [*names, "score"])

    schema = measured.drop("stats").withColumn("score", F.lit(0.0)).schema
    return measured.mapInArrow(score, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out(key: str = "doc_id") -> Column:
    """Documents whose labels aren't learned: crc32(id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def document_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The op10 rows."""
    trees = fit_quality(documents, labels, ~held_out())
    return score_quality(documents.select("doc_id", held_out().alias("held_out"), "text"), trees).select("doc_id", "held_out", "score", "predicted")
