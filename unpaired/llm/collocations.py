"""Phrase collocations by best-first branch-and-bound growth.

Counts grow from words to phrases of two, three and four words. For a phrase p with first word
a, no phrase that begins with p can score above ``2f(p) / (f(a) + f(p))``, and no phrase that
ends with p above the same with p's last word: counts fall along prefixes and suffixes, and
every cut bounds the score. Two-word phrases are taken best first, by scores: a wave takes, in
each language, all whose bound reaches the score in place ``2 * first`` (or deeper, in later
waves), and counts their extensions on both sides. Then all phrases of at least that score are
known, with all that may displace them. When ``first`` of them survive, ties of the last
included, no phrase that was left out can get into the list, and the language is settled; otherwise the next
wave goes deeper.

Counting is one pass over the texts for each length, with sums made per task before the
exchange. Which phrases of a text are counted is looked up in bit sets of a fixed size
(``FILTER_BITS``), broadcast: a bit set by chance costs a needless count, it never loses one.

Defined results: null and empty texts have no words; a null language is ``und`` and is the
same as that value; repeated rows count each; equal scores go by count, then by
phrase in UTF-8 byte order; empty tables, and languages without a candidate, give no rows. Long texts are
taken whole; a task holds the words of one text at least. Only the two columns are read, so names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from unpaired.llm.common import keep

FIRST = 2000
LEAST = 30
#: Bits of each set of phrases that is broadcast (4 MB).
FILTER_BITS = 1 << 25
#: Words that a task counts together.
CHUNK_WORDS = 250_000
SCALE = 2_000_000
#: Groups for each language in the first stage of the ranking.
SPREAD = 64

_BREAK = b"\xff"
_PLAIN = bytes(0xFF if chr(i) in ".,;:!?\n\v\f\r" else i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))


def pieces(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, A-Z lower-cased, with ``_BREAK`` between pieces."""
    return text.translate(_PLAIN).replace(_BREAK, b" \xff ").split()


def _hash_of(words: Column, language: str = "lang") -> Column:
    """The hash of a phrase, from the hashes of its words; :class:`Chunk` makes the same."""
    one = lambda w: F.xxhash64(F.col(language), w)
    turned = lambda h: F.shiftleft(h, 17).bitwiseOR(F.shiftrightunsigned(h, 47))
    return F.aggregate(words, F.lit(0).cast("long"), lambda h, w: turned(h).bitwiseXOR(one(w)))


def bit_set(phrases: DataFrame, bits: int) -> np.ndarray:
    """Hashes of ``phrases`` (``lang``, ``phrase``) as a set of ``bits`` bits.

    What reaches the driver is at most ``bits`` / 64 words, whatever the number of phrases.
    """
    places = phrases.select(_hash_of(F.split("phrase", " ")).bitwiseAND(F.lit(bits - 1)).alias("place"))
    words = places.select(F.shiftright("place", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


class Chunk:
    """The words of some texts of one language as numbers."""

    def __init__(self, language: str, words: list[bytes]) -> None:
        coded = pa.array(words, pa.binary()).dictionary_encode()
        self.words = coded.dictionary
        self.ids = coded.indices.to_numpy().astype(np.int64)
        listed = self.words.to_pylist()
        self.stop = listed.index(_BREAK) if _BREAK in listed else -1
        seed = xxhash.xxh64_intdigest(language.encode("utf-8", "surrogatepass"), 42)
        self.hash = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in listed), np.uint64, len(listed))

    def has(self, hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
        place = hashes & np.uint64(len(bits) * 64 - 1)
        return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0

    def grown(self, hashes: np.ndarray, by: int) -> np.ndarray:
        """From hashes of phrases at all places, those of the phrases one word longer."""
        head, tail = hashes[: len(self.ids) - by], self.hash[self.ids[by:]]
        return ((head << np.uint64(17)) | (head >> np.uint64(47))) ^ tail

    def inside(self, size: int) -> np.ndarray:
        """At which places ``size`` words follow without a break."""
        n = max(0, len(self.ids) - size + 1)
        out = np.ones(n, bool)
        for i in range(size):
            out &= self.ids[i : i + n] != self.stop
        return out

    def counts(self, size: int, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The phrases of ``size`` words at the places ``at``, and how often each stands there."""
        code, ways = self.ids[at], []
        for i in range(1, size):  # pairs of (phrase so far, next word), numbered anew for each word
            if i > 1:
                seen, code = np.unique(code, return_inverse=True)
                ways.append(seen)
            code = code * len(self.words) + self.ids[at + i]
        unique, n = np.unique(code, return_counts=True)
        parts = []
        for i in range(size - 1, 0, -1):
            unique, word = np.divmod(unique, len(self.words))
            parts.append(word)
            if i > 1:
                unique = ways.pop()[unique]
        columns = [self.words.take(pa.array(x)) for x in (unique, *reversed(parts))]
        return (pc.binary_join_element_wise(*columns, b" ") if size > 1 else columns[0]).cast(pa.string()), n


#: What a pass counts: from a chunk and the broadcast bit sets, (size, places) of phrases.
Choice = Callable[[Chunk, dict], Iterator[tuple[int, np.ndarray]]]


def _words(chunk: Chunk, sets: dict) -> Iterator[tuple[int, np.ndarray]]:
    yield 1, np.flatnonzero(chunk.inside(1))


def _pairs(chunk: Chunk, sets: dict) -> Iterator[tuple[int, np.ndarray]]:
    often = chunk.has(chunk.hash, sets["words"])[chunk.ids]
    yield 2, np.flatnonzero(chunk.inside(2) & often[:-1] & often[1:])


def _pair_bits(chunk: Chunk, sets: dict) -> tuple[np.ndarray, ...]:
    """Hashes of all two-word phrases, and which are frequent, open to the right, open to the left."""
    pair = chunk.grown(chunk.hash[chunk.ids], 1)
    return (pair, *(chunk.has(pair, sets[k]) for k in ("pairs", "pairs_right", "pairs_left")))


def _triples(chunk: Chunk, sets: dict) -> Iterator[tuple[int, np.ndarray]]:
    _, often, right, left = _pair_bits(chunk, sets)
    yield 3, np.flatnonzero(chunk.inside(3) & often[:-1] & often[1:] & (right[:-1] | left[1:]))


def _quadruples(chunk: Chunk, sets: dict) -> Iterator[tuple[int, np.ndarray]]:
    pair, often, right, left = _pair_bits(chunk, sets)
    triple = chunk.grown(pair, 2)
    frequent, onward, back = (chunk.has(triple, sets[k]) for k in ("triples", "triples_right", "triples_left"))
    possible = ~(right[:-1] | left[1:]) | frequent  # one that was counted must be frequent
    yield 4, np.flatnonzero(chunk.inside(4) & often[:-2] & often[1:-1] & often[2:] & possible[:-1] & possible[1:] & (onward[:-1] | back[1:]))


def count_phrases(texts: DataFrame, choose: Choice, sets: dict[str, np.ndarray], chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """``lang``, ``phrase`` and ``f`` of the phrases that ``choose`` finds in ``texts`` (``lang``, ``text``)."""
    shipped = texts.sparkSession.sparkContext.broadcast(sets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}

        def counted(language: str) -> Iterator[pa.RecordBatch]:
            if len(held[language]) > 4:
                chunk = Chunk(language, held.pop(language))
                for size, at in choose(chunk, shipped.value):
                    phrases, n = chunk.counts(size, at)
                    if len(n):
                        yield pa.RecordBatch.from_arrays([pa.array([language] * len(n), pa.string()), phrases, pa.array(n.astype(np.int64))], ["lang", "phrase", "n"])

        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = text.as_py()
                if content:
                    held.setdefault(language, [_BREAK] * 4).extend([*pieces(content), _BREAK])
                    if len(held[language]) >= chunk_words:
                        yield from counted(language)
            while sum(map(len, held.values())) >= chunk_words:
                yield from counted(max(held, key=lambda x: len(held[x])))
        for language in list(held):
            yield from counted(language)

    return texts.mapInArrow(count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def _bound(count: str, part: str) -> Column:
    """Of what grows from a phrase of ``count``, whose first or last word has ``part``, none scores above this."""
    return F.expr(f"cast(({SCALE}BD * {count}) div (cast({part} as decimal(20)) + {count}) as long)")


def with_bounds(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Adds ``right`` and ``left``: the bounds of phrases that begin and end with ``phrase``."""
    split = phrases.withColumn("_first", F.substring_index("phrase", " ", 1)).withColumn("_last", F.substring_index("phrase", " ", -1))
    first = words.select("lang", F.col("phrase").alias("_first"), F.col("f").alias("_a"))
    last = words.select("lang", F.col("phrase").alias("_last"), F.col("f").alias("_z"))
    met = split.join(first, ["lang", "_first"]).join(last, ["lang", "_last"])
    return met.withColumn("right", _bound("f", "_a")).withColumn("left", _bound("f", "_z")).drop("_first", "_last", "_a", "_z")


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """``phrases`` (``lang``, ``phrase``, ``f``) with ``l``, ``r`` and ``score`` of the lowest cut.

    ``counts`` has ``f`` of all parts; a phrase one of whose parts wasn't counted is left out.
    """
    cuts = phrases.withColumn("n_words", F.size(F.split("phrase", " "))).withColumn("k", F.explode(F.expr("sequence(1, n_words - 1)")))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - n_words)"))
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    met = cuts.join(heads, ["lang", "head"], "left").join(rests, ["lang", "rest"], "left")
    met = met.withColumn("score", F.expr(f"cast(({SCALE}BD * f) div (cast(l as decimal(20)) + r) as long)"))
    best = met.groupBy("lang", "phrase").agg(F.first("f").alias("f"), F.bool_and(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("whole"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.where("whole").select("lang", "phrase", "f", "cut.l", "cut.r", "cut.score")


def survivors(candidates: DataFrame, longer: DataFrame) -> DataFrame:
    """``candidates`` that no phrase of ``longer`` with four fifths of their count contains.

    One word more is enough to look at: a longer phrase holds one that is at least as frequent.
    """
    ends = F.expr("array(substring_index(phrase, ' ', n_words - 1), substring_index(phrase, ' ', 1 - n_words))")
    above = longer.withColumn("n_words", F.size(F.split("phrase", " "))).select("lang", F.explode(ends).alias("phrase"), F.col("f").alias("above")).groupBy("lang", "phrase").agg(F.max("above").alias("above"))
    met = candidates.join(above, ["lang", "phrase"], "left")
    return met.where("above is null or 5BD * above < 4BD * f").drop("above")


def _floors(pairs: DataFrame, depth: int) -> DataFrame:
    """``floor`` of each language: the score in place ``depth`` of its two-word phrases, or 0 where it has fewer.

    Scores are whole numbers up to a million, so counts by score bound what a language's window reads.
    """
    by_score = pairs.groupBy("lang", "score").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(W.Window.partitionBy("lang").orderBy(F.col("score").desc()))
    return by_score.withColumn("so_far", so_far).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("so_far") >= depth, F.col("score"))), F.lit(0)).alias("floor"))


def collocations(documents: DataFrame, text: str = "text", language: str = "lang", first: int = FIRST, least: int = LEAST, filter_bits: int = FILTER_BITS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """The ``first`` best phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score``."""
    texts = documents.select(F.coalesce(F.col(language), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    words = keep(count_phrases(texts, _words, {}, chunk_words), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = words.where(F.col("f") >= least)
    sets = {"words": bit_set(words, filter_bits)}
    pairs = count_phrases(texts, _pairs, sets, chunk_words).where(F.col("f") >= least)
    pairs = keep(with_bounds(scored(pairs, words), words), "pairs")
    sets = {"pairs": bit_set(pairs, filter_bits)}
    out, pending, depth = None, _floors(pairs, 2 * first), 2 * first
    while True:
        floors = keep(pending, "floors")  # a row for each language
        found = keep(_wave(texts, words, pairs, floors, sets, least, filter_bits, chunk_words, out is None), "wave")
        enough = found.groupBy("lang").agg(F.count("*").alias("found"))
        state = floors.join(enough, "lang", "left").withColumn("settled", (F.col("floor") == 0) | (F.coalesce("found", F.lit(0)) >= first))
        state = keep(state, "settled")
        done = found.join(state.where("settled").select("lang"), "lang", "left_semi")
        out = done if out is None else out.unionByName(done)
        if state.where("not settled").isEmpty():
            break
        depth *= 2
        deeper = _floors(pairs, depth).withColumnRenamed("floor", "deeper")
        pending = state.where("not settled").join(deeper, "lang").select("lang", F.least("deeper", F.greatest(F.col("floor") - 1, F.lit(0))).alias("floor"))
    order = [F.col("score").desc(), F.col("f").desc(), F.col("phrase")]
    spread = out.withColumn("spread", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)))  # a language may have any number of ties
    spread = spread.withColumn("rank", F.row_number().over(W.Window.partitionBy("lang", "spread").orderBy(*order))).where(F.col("rank") <= first)
    ranked = spread.withColumn("rank", F.row_number().over(W.Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")


def _wave(texts: DataFrame, words: DataFrame, pairs: DataFrame, floors: DataFrame, sets: dict, least: int, filter_bits: int, chunk_words: int, first_wave: bool) -> DataFrame:
    """Surviving phrases of a score of ``floor`` or more, in the languages of ``floors``."""
    if not first_wave:
        texts = texts.join(floors.select("lang"), "lang", "left_semi")
    sets = sets | _open(pairs, floors, "pairs", filter_bits)
    triples = count_phrases(texts, _triples, sets, chunk_words).where(F.col("f") >= least)
    triples = keep(with_bounds(triples, words), "triples")
    sets = sets | {"triples": bit_set(triples, filter_bits)} | _open(triples, floors, "triples", filter_bits)
    longest = keep(count_phrases(texts, _quadruples, sets, chunk_words).where(F.col("f") >= least), "longest")
    columns = ["lang", "phrase", "f"]
    counts = words.select(*columns).unionByName(pairs.select(*columns)).unionByName(triples.select(*columns))
    longer = triples.select(*columns).unionByName(longest)
    all_scored = pairs.select(*columns, "l", "r", "score").unionByName(scored(longer, counts))
    contenders = all_scored.join(floors, "lang").where("score >= floor").drop("floor")
    return survivors(contenders, longer)


def _open(phrases: DataFrame, floors: DataFrame, name: str, filter_bits: int) -> dict[str, np.ndarray]:
    near = phrases.join(floors, "lang")
    return {f"{name}_{side}": bit_set(near.where(F.col(side) >= F.col("floor")), filter_bits) for side in ("right", "left")}


def document_collocations(documents: DataFrame) -> DataFrame:
    """The op11 rows."""
    return collocations(documents)


ORACLE = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
t AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
s AS (SELECT m, lang, w, unnest(range(1, CAST(len(w) - m + 2 AS BIGINT))) AS i FROM t, (VALUES (1), (2), (3), (4)) v(m) WHERE len(w) >= m),
c AS (SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, count(*) AS f FROM s GROUP BY 1, 2, 3),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE m = 1 GROUP BY lang),
q AS (SELECT *, string_split(phrase, ' ') AS w FROM c WHERE m >= 2 AND f >= 30),
k AS (SELECT lang, phrase, m, f, w, unnest(range(1, CAST(m AS BIGINT))) AS k FROM q),
x AS (SELECT k.lang, k.phrase, k.m, k.f, k.k, a.f AS l, b.f AS r, CAST((2000000::HUGEINT * k.f) // (a.f + b.f) AS BIGINT) AS score
      FROM k JOIN c a ON a.lang = k.lang AND a.phrase = array_to_string(list_slice(w, 1, k.k), ' ') JOIN c b ON b.lang = k.lang AND b.phrase = array_to_string(list_slice(w, k.k + 1, k.m), ' ')),
lowest AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
starts AS (SELECT lang, phrase, m, f, w, unnest(range(1, CAST(m AS BIGINT))) AS i FROM q WHERE m > 2),
parts AS (SELECT lang, f, unnest([array_to_string(list_slice(w, i, i + 1), ' '), CASE WHEN m = 4 AND i < 3 THEN array_to_string(list_slice(w, i, i + 2), ' ') END]) AS phrase FROM starts),
above AS (SELECT lang, phrase, max(f) AS above FROM parts WHERE phrase IS NOT NULL GROUP BY lang, phrase),
kept AS (SELECT lowest.*, row_number() OVER (PARTITION BY lowest.lang ORDER BY score DESC, lowest.f DESC, lowest.phrase) AS rank FROM lowest LEFT JOIN above USING (lang, phrase) WHERE above IS NULL OR 100 * above < 80 * f)
SELECT lang, rank, phrase, f AS a, l, r, n, score FROM kept JOIN n USING (lang) WHERE rank <= 2000
"""
