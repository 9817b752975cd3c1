"""Language identification by a linear-chain conditional random field over words.

Words are labelled in their context, so code-switched texts get a label for each
word. A word's score for a label is the sum of weights of its features: prefixes and
suffixes of one to three letters, inner n-grams of two to four bytes, and lexicon
features (the word itself, hashed). Learned transitions join neighbouring words;
forward-backward gives each word's label probabilities. A text is one chain however
long it is: it is worked on in pieces of ``PIECE`` words, all pieces side by side, and
the messages of a piece are exact, as the products of the pieces before and behind it
(matrices of labels by labels) are carried into it.

The weights are fitted on a bounded sample: at most ``FIT_ROWS`` labelled documents of
at most ``FIT_BYTES`` bytes, those of the smallest hash of the row, so no order of rows
matters. Half of them are spliced in pairs, stretch by stretch, so the transitions are
learned from sequences that change their language. Prediction uses nothing but the text.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and
so is every text when there is nothing to learn from. Ties go to the label that sorts
first. Repeated rows repeat their result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unpaired.llm.common import bounded_sample, renamed, whole

UNKNOWN = "und"
PIECE = 64
BUCKETS = 1 << 16
#: Labelled documents that the weights are fitted on, their greatest size, and rounds over them.
FIT_ROWS = 1_500
FIT_BYTES = 1 << 16
ROUNDS = 3
FIT_CHAINS = 512
#: Mean number of words between two splices of a training sequence.
STRETCH = 15
RATE = 0.5
#: The pipeline rejects texts whose mean probability is below this.
REJECT_BELOW = 0.4

_LETTER = re.compile(r"[^\W\d_]")
#: 1 where a byte is part of a word: letters, and all bytes of other characters.
_INSIDE = np.array([0x61 <= i <= 0x7A or i >= 0x80 for i in range(256)], bool)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(*parts: np.ndarray | int) -> np.ndarray:
    """One bucket number for each row of the parts."""
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p, np.uint64)) * _MIX
            h = h ^ (h >> np.uint64(29))
    return (h >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1)


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts: bytes, where each begins and ends, and its text's number."""
    raw = [(x.lower() if x else "").encode("utf-8", "surrogatepass") for x in texts]
    data = np.frombuffer(b"\0" + b"\0".join(raw) + b"\0\0\0\0\0", np.uint8)
    inside = _INSIDE[data]
    edge = np.diff(inside.view(np.int8))
    begin, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])]) + 1
    return data, begin, end, np.searchsorted(starts, begin, "right") - 1


def word_hashes(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a sum of hashed bytes and their places."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    body = np.flatnonzero(_INSIDE[data])
    whose = np.cumsum(np.diff(body, prepend=-2) > 1) - 1
    with np.errstate(over="ignore"):
        mixed = (data[body].astype(np.uint64) + np.uint64(257) * (body - begin[whose]).astype(np.uint64) + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.add.reduceat(mixed, np.searchsorted(body, begin))


def features(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' features, and where each word's features begin.

    N-grams count the word's edges: one byte that marks the edge on either side.
    """
    size = end - begin
    n = len(begin)
    at = lambda i: data[i].astype(np.uint64)
    fixed = []
    for k in (1, 2, 3):  # affixes; a shorter word is its own affix
        head, tail = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for j in range(k):
            head = head * np.uint64(256) + np.where(j < size, at(np.minimum(begin + j, end - 1)), 0).astype(np.uint64)
            tail = tail * np.uint64(256) + np.where(j < size, at(np.maximum(end - 1 - j, begin)), 0).astype(np.uint64)
        fixed += [_hash(head, 10 + k), _hash(tail, 20 + k)]
    inside = np.append(_INSIDE[data], False)
    fixed.append(_hash(word_hashes(data, begin), 31))  # the lexicon feature
    flat, owner = [np.concatenate(fixed)], [np.tile(np.arange(n), len(fixed))]
    body = np.flatnonzero(inside[:-1])
    whose = np.searchsorted(begin, body, "right") - 1
    code = at(body)
    for k in (2, 3, 4):
        nxt = np.minimum(body + k - 1, len(data) - 1)
        code = code * np.uint64(256) + at(nxt)
        fits = body + k <= end[whose]
        flat.append(_hash(code[fits], 40 + k))
        owner.append(whose[fits])
    flat, owner = np.concatenate(flat), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return flat[order], np.searchsorted(owner[order], np.arange(n))


def places(text: np.ndarray) -> np.ndarray:
    """Each word's place in its text."""
    new = np.ones(len(text), bool)
    new[1:] = text[1:] != text[:-1]
    first = np.flatnonzero(new)
    return np.arange(len(text)) - first[np.cumsum(new) - 1]


def spliced(text: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """An order of the words in which the texts of one half alternate in pairs, stretch by stretch.

    Every word occurs once; a pair of texts becomes one sequence that changes between
    them at random places until one of them has no words left.
    """
    firsts = np.append(np.flatnonzero(np.diff(text, prepend=-1)), len(text))
    own = draw.permutation(len(firsts) - 1)
    half = len(own) // 4 * 2
    out = [np.arange(firsts[i], firsts[i + 1]) for i in own[half:]]
    for a, b in zip(own[:half:2].tolist(), own[1:half:2].tolist(), strict=True):
        left = [np.arange(firsts[i], firsts[i + 1]) for i in (a, b)]
        while len(left[0]) or len(left[1]):
            n = int(draw.geometric(1 / STRETCH)) if len(left[1]) else len(left[0])
            out.append(left[0][:n])
            left = [left[1], left[0][n:]]
    return np.concatenate(out)


class Crf:
    """Weights of a linear-chain CRF; labels are the sorted languages."""

    def __init__(self, labels: list[str]) -> None:
        self.labels = labels
        self.weights = np.zeros((BUCKETS, len(labels)), np.float32)
        self.moves = np.zeros((len(labels), len(labels)), np.float64)

    def emissions(self, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.weights[flat], first, axis=0).astype(np.float64) if len(first) else np.zeros((0, len(self.labels)))

    def marginals(self, emit: np.ndarray, place: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of every word by forward-backward, all pieces of all texts side by side.

        A text begins wherever ``place`` is 0.
        """
        n, k = emit.shape
        if not n:
            return emit, np.zeros((k, k))
        begins = np.flatnonzero(place % PIECE == 0)
        sizes = np.diff(np.append(begins, n))
        by = np.argsort(-sizes, kind="stable")  # pieces that are still open come first
        score = np.exp(emit - emit.max(1, keepdims=True))
        move = np.exp(self.moves - self.moves.max())
        before, behind = self._carried(score, move, begins, sizes, by, place[begins] == 0)
        begins, sizes = begins[by], sizes[by]
        forward, backward = np.empty((n, k)), np.empty((n, k))
        open_ = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), "right")  # pieces longer than t
        now = before[by] * score[begins]
        forward[begins] = now = now / now.sum(1, keepdims=True)
        for t in range(1, len(open_)):
            at = begins[: open_[t]] + t
            now = (now[: len(at)] @ move) * score[at]
            forward[at] = now = now / now.sum(1, keepdims=True)
        backward[begins + sizes - 1] = behind[by]
        both = np.zeros((k, k))
        for t in range(len(open_) - 1, 0, -1):
            at = begins[: open_[t]] + t
            ahead = score[at] * backward[at]
            before = ahead @ move.T
            if pairs:
                joint = forward[at - 1][:, :, None] * move[None] * ahead[:, None, :]
                both += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            backward[at - 1] = before / before.sum(1, keepdims=True)
        if pairs:  # from the last word of a piece to the first of the next
            at = begins[place[begins] > 0]
            joint = forward[at - 1][:, :, None] * move[None] * (score[at] * backward[at])[:, None, :]
            both += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        out = forward * backward
        return out / out.sum(1, keepdims=True), both

    @staticmethod
    def _carried(score: np.ndarray, move: np.ndarray, begins: np.ndarray, sizes: np.ndarray, by: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What reaches the first word of each piece from before it, and its last word from behind it.

        ``by`` sorts the pieces by falling size; ``fresh`` ones begin a text.
        """
        n, k = len(begins), score.shape[1]
        before, behind = np.ones((n, k)), np.ones((n, k))
        if fresh.all():
            return before, behind
        product = np.empty((n, k, k))
        starts, lengths = begins[by], sizes[by]
        now = np.where(fresh[by][:, None, None], np.eye(k), move) * score[starts][:, None, :]
        for t in range(int(lengths[0])):
            if t:
                at = starts[: int(np.searchsorted(-lengths, -t, "left"))] + t
                product[by[len(at) : len(now)]] = now[len(at) :]
                now = (now[: len(at)] @ move) * score[at][:, None, :]
            now = now / now.sum((1, 2), keepdims=True)
        product[by[: len(now)]] = now
        nth = places(np.cumsum(fresh))
        steps = [np.flatnonzero(nth == i) for i in range(1, int(nth.max()) + 1)]
        carried = before.copy()  # what leaves a piece
        for at in [np.flatnonzero(nth == 0), *steps]:
            if nth[at[0]]:
                own = carried[at - 1]
                arrived = own @ move
                before[at] = arrived / arrived.sum(1, keepdims=True)
            else:
                own = np.ones((len(at), k))
            gone = np.einsum("ni,nij->nj", own, product[at])
            carried[at] = gone / gone.sum(1, keepdims=True)
        for at in reversed(steps):
            back = np.einsum("nij,nj->ni", product[at], behind[at])
            behind[at - 1] = back / back.sum(1, keepdims=True)
        return before, behind

    def fit(self, texts: list[str], langs: list[str], rounds: int = ROUNDS, rate: float = RATE) -> Crf:
        """Adagrad on the conditional likelihood; every word has its text's label.

        Half of the texts are spliced into sequences of two. Sequences are cut into
        pieces of ``PIECE`` words for the fit alone.
        """
        data, begin, end, text = words(texts)
        draw = np.random.default_rng(0)
        by = spliced(text, draw)
        begin, end, text = begin[by], end[by], text[by]
        truth = np.array([self.labels.index(x) for x in langs], np.int64)
        place = np.arange(len(text)) % PIECE
        firsts = np.append(np.flatnonzero(place == 0), len(place))
        order = draw.permutation(len(firsts) - 1)
        seen, seen_moves = np.full(self.weights.shape, 1e-6, np.float32), np.full(self.moves.shape, 1e-6)
        for _ in range(rounds):
            for i in range(0, len(order), FIT_CHAINS):
                picked = np.concatenate([np.arange(firsts[c], firsts[c + 1]) for c in order[i : i + FIT_CHAINS]])
                flat, first = self._features(data, begin, end, picked)
                label, own = truth[text[picked]], place[picked]
                got, both = self.marginals(self.emissions(flat, first), own, pairs=True)
                got[np.arange(len(label)), label] -= 1
                sizes = np.diff(np.append(first, len(flat)))
                slope = np.repeat((got / len(label)).astype(np.float32), sizes, axis=0)
                used, back = np.unique(flat, return_inverse=True)
                grad = np.stack([np.bincount(back, slope[:, j], len(used)) for j in range(slope.shape[1])], 1).astype(np.float32)
                seen[used] += grad**2
                self.weights[used] -= rate * grad / np.sqrt(seen[used])
                joined = own[1:] > 0
                np.add.at(both, (label[:-1][joined], label[1:][joined]), -1)
                both /= len(label)
                seen_moves += both**2
                self.moves -= rate * 0.1 * both / np.sqrt(seen_moves)
        return self

    @staticmethod
    def _features(data: np.ndarray, begin: np.ndarray, end: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of some words: their bytes are copied together first."""
        b, e = begin[picked], end[picked]
        size = e - b
        starts = np.cumsum(size + 1) - size
        out = np.zeros(int(starts[-1] + size[-1]) + 6, np.uint8)
        where = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out[where] = data[np.repeat(b - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        return features(out, starts, starts + size)

    def predict(self, texts: list[str | None], block: int = 2_000_000) -> list[tuple[str, float, int]]:
        """Language, mean probability and number of runs of one language of each text; see the module for ``und``."""
        out: list[tuple[str, float, int]] = []
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < block):
                size += len(texts[j] or "")
                j += 1
            out += self._predict(texts[i:j])
            i = j
        return out

    def label_words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, begin, end and text number of every word, and its label probabilities."""
        data, begin, end, text = words(texts)
        # a word's score depends on the word alone: each distinct one is scored once
        _, picked, back = np.unique(word_hashes(data, begin), return_index=True, return_inverse=True)
        emit = self.emissions(*self._features(data, begin, end, picked)) if len(picked) else np.zeros((0, len(self.labels)))
        return data, begin, end, text, self.marginals(emit[back], places(text))[0]

    def _predict(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        text, shares = self.label_words(texts)[3:]
        labels = shares.argmax(1)
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (labels[1:] != labels[:-1])
        runs = np.bincount(text[new], minlength=len(texts)).tolist()
        counts = np.bincount(text, minlength=len(texts))
        sums = np.stack([np.bincount(text, shares[:, j], len(texts)) for j in range(len(self.labels))], 1)
        best = sums.argmax(1)
        return [(self.labels[b], min(1.0, float(sums[i, b] / counts[i])), runs[i]) if counts[i] and _LETTER.search(x or "") else (UNKNOWN, 0.0, 0) for i, (x, b) in enumerate(zip(texts, best.tolist(), strict=True))]


def fit_language_model(documents: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> Crf | None:
    """A model fitted on at most ``rows`` documents for which ``learn`` holds."""
    usable = documents.where(learn & F.col(lang).isNotNull() & (F.octet_length(text) <= FIT_BYTES)).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sample = [r for r in bounded_sample(usable, rows) if _LETTER.search(r["text"])]
    if not sample:
        return None
    return Crf(sorted({r["lang"] for r in sample})).fit([r["text"] for r in sample], [r["lang"] for r in sample])


def predict_language(documents: DataFrame, model: Crf | None, text: str = "text") -> DataFrame:
    """``documents`` with ``lang_pred``, ``score`` and ``n_runs``, the number of runs of words of one language.

    See :func:`unpaired.llm.common.renamed` for columns of these names.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(model)
    kept = renamed(documents, "lang_pred", "score", "n_runs")
    at = kept.columns.index(text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = shipped.value.predict(texts) if shipped.value else [(UNKNOWN, 0.0, 0)] * len(texts)
            names = [*batch.schema.names, "lang_pred", "score", "n_runs"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.int64())))], names)

    schema = kept.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_runs")).schema
    return kept.mapInArrow(predict, schema)


def language_spans(documents: DataFrame, model: Crf, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of words with one language: ``key``, ``first_word``, ``n_words``, ``lang``."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, shares = shipped.value.label_words(batch.column(1).to_pylist())[3:]
            best = shares.argmax(1)
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (best[1:] != best[:-1])
            at = np.flatnonzero(new)
            first = np.searchsorted(own, own[at])
            size = np.diff(np.append(at, len(own)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own[at])), pa.array(at - first), pa.array(size), pa.array([shipped.value.labels[i] for i in best[at]], pa.string())], [key, "first_word", "n_words", "lang"])

    return documents.select(F.col(key), F.col(text)).mapInArrow(label, f"`{key}` {dict(documents.dtypes)[key]}, first_word long, n_words long, lang string")


def held_out(key: str = "doc_id") -> Column:
    """Documents that nothing is learned from: crc32(id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def document_languages(documents: DataFrame) -> DataFrame:
    """The op8 rows."""
    own = documents.select("doc_id", "text", "lang")
    model = fit_language_model(own, ~held_out())
    named = predict_language(own.select("doc_id", held_out().alias("held_out"), "text"), model)
    return named.select("doc_id", "held_out", "lang_pred", "score", "n_runs")


def identified(documents: DataFrame, least: float = REJECT_BELOW) -> DataFrame:
    """``documents`` whose language is known with a mean probability of ``least``, columns as they were."""
    model = fit_language_model(documents, ~held_out())
    named = predict_language(documents.select(whole(documents).alias("doc"), "text"), model)
    return named.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("doc.*")
