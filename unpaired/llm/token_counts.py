"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; dynamic
programming carries, for each end, the best score and the number of pieces of the
path that has it. Nothing is traced back, as only counts are wanted.

Rules, those of the ``Unigram`` model of the ``tokenizers`` library behind a
``Metaspace`` split (a word begins with U+2581): scores are added as 64-bit floats
from left to right; a later start replaces an earlier one only with a greater score;
a character without a piece of its own costs the least score minus 10; unknown
characters count their UTF-8 bytes where the vocabulary has all byte pieces, else
one for each unbroken run.

Defined results: null and empty texts have no tokens and score zero. Rows are
independent: repeated rows repeat their result. Extra columns aren't carried. Texts and words
of any length are counted whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
NEVER = float("-inf")
#: Distinct words that a Python worker remembers before it starts afresh, and the longest
#: of them (in characters): together they bound its memory.
REMEMBERED = 400_000
REMEMBERED_CHARS = 64
#: Words from this length on keep their scores in packed arrays, 16 bytes a character.
LONG_WORD = 4096
#: A vocabulary is shipped to every executor; a larger one is refused.
VOCABULARY_ROWS = 2_000_000
VOCABULARY_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def load_vocabulary(path: str = VOCABULARY_FILE) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Vocabulary:
    """A vocabulary that Spark ships; a worker's tasks share the counter made of it."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        self.pieces = pieces
        self.made: Counter | None = None

    def counter(self) -> Counter:
        if self.made is None:
            self.made = Counter(self.pieces)
        return self.made


class Counter:
    """Counts the pieces of words; remembers the words it has seen."""

    def __init__(self, vocabulary: list[tuple[str, float]], remembered: int = REMEMBERED) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece and piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        pieces = {p for p, _ in vocabulary}
        self.single = {p for p in pieces if len(p) == 1}
        self.by_bytes = all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.seen: dict[str, tuple[int, float]] = {}
        self.remembered = remembered

    def word(self, word: str) -> tuple[int, float]:
        """Pieces and score of one word by dynamic programming."""
        n = len(word)
        best, count = ([0.0] + [NEVER] * n, [0] * (n + 1)) if n < LONG_WORD else (array("d", [0.0]) + array("d", [NEVER]) * n, array("q", [0]) * (n + 1))
        if not self.single.issuperset(word):
            return self._with_unknown(word, best, count)
        for last, (length, score) in self.automaton.iter(word):  # at one end, longest first
            start, end = last + 1 - length, last + 1
            score += best[start]
            if score > best[end]:
                best[end], count[end] = score, count[start] + 1
        return count[n], best[n]

    def _with_unknown(self, word: str, best: list[float] | array, count: list[int] | array) -> tuple[int, float]:
        unknown = bytearray(len(best))
        closed = 0

        def close(end: int) -> None:  # the last candidate of an end is its single unknown character
            char = word[end - 1]
            score = best[end - 1] + self.unknown
            if char not in self.single and score > best[end]:
                best[end], unknown[end] = score, True
                count[end] = count[end - 1] + (len(char.encode("utf-8", "surrogatepass")) if self.by_bytes else not unknown[end - 1])

        for last, (length, score) in self.automaton.iter(word):
            while closed < last:
                closed += 1
                close(closed)
            start, end = last + 1 - length, last + 1
            score += best[start]
            if score > best[end]:
                best[end], count[end], unknown[end] = score, count[start] + 1, False
        for end in range(closed + 1, len(best)):
            close(end)
        return count[-1], best[-1]

    def text(self, text: str | None) -> tuple[int, int, float]:
        """Words, pieces and score of a text."""
        if not text:
            return 0, 0, 0.0
        marked = text.replace(" ", SPACE)
        words = marked.split(SPACE)
        if marked[0] == SPACE:
            words = words[1:]
        seen, pieces, total = self.seen, 0, 0.0
        for word in words:
            found = seen.get(word)
            if found is None:
                found = self.word(SPACE + word)
                if len(word) <= REMEMBERED_CHARS:
                    if len(seen) >= self.remembered:
                        seen.clear()
                    seen[word] = found
            pieces += found[0]
            total += found[1]
        return len(words), pieces, total


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY_FILE) -> DataFrame:
    """``key``, ``n_words``, ``n_tokens`` and ``score`` of every whole text."""
    vocabulary = load_vocabulary(path)
    if len(vocabulary) > VOCABULARY_ROWS:
        raise ValueError(f"{path} has {len(vocabulary)} pieces; at most {VOCABULARY_ROWS} are shipped to executors")
    shipped = documents.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shipped.value.counter()
        for batch in batches:
            rows = [counter.text(x.as_py()) for x in batch.column(1)]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "n_words", "n_tokens", "score"])

    return documents.select(F.col(key), F.col(text)).mapInArrow(count, f"`{key}` {dict(documents.dtypes)[key]}, n_words long, n_tokens long, score double")
