"""op11, op12 and op13 against brute force on small tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from unpaired.llm import collocations, line_dedup, ranked_search


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- line dedup ---


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def dedup_by_force(docs, chars, least):
    held = defaultdict(list)
    for row, (key, text) in enumerate(docs):
        for k in {lower(x).strip(" \t\n\v\f\r") for x in (text or "").split("\n")}:
            if len(k) >= chars:
                held[k].append((key is not None, key or 0, row))
    top = {k: max(v)[:2] for k, v in held.items() if len(v) >= least}
    out = []
    for key, text in docs:
        lines = (text or "").split("\n")
        drop = [(k := lower(x).strip(" \t\n\v\f\r")) in top and top[k] != (key is not None, key or 0) for x in lines]
        kept = "\n".join(x for x, d in zip(lines, drop, strict=True) if not d)
        out.append((key, len(lines), sum(drop), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def line_docs(seed, n=120):
    rng = random.Random(seed)
    pool = [f"{'é' if i % 3 else 'E'}line number {i} " + "word " * rng.randint(4, 9) for i in range(12)]
    docs = []
    for i in range(n):
        own = ["  " + x.upper() + "\t" if rng.random() < 0.2 else x for x in rng.choices(pool, k=rng.randint(0, 5))]
        own += ["The one line that nearly every document holds, word for word."] * (rng.random() < 0.7)
        own += [f"a line of its own in document {i} that nobody else has at all"]
        rng.shuffle(own)
        docs.append((i, "\n".join(own)))
    return [*docs, (5, None), (None, docs[3][1]), (None, docs[4][1]), (7, docs[7][1]), (200, ""), (201, "\n\n"), (202, docs[0][1] + "\r\n")]


@pytest.mark.parametrize("parts", ["1", "3", "40"])
def test_line_dedup_equals_brute_force(spark, parts):
    docs = line_docs(1)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows(line_dedup.document_lines(spark.createDataFrame(docs, "doc_id long, text string")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == dedup_by_force(docs, 40, 5)


def test_ranges_settle_lines_that_cross_them():
    """However the sorted rows are cut into ranges and batches, the same lines go."""
    import pyarrow as pa

    names = ["key", "tag", "n_lines", "h1", "h2", "lines"]
    table = []
    for h, holders in ((1, [9, 8, 8, 5, 4, 1]), (2, [7]), (3, [6, 5, 4, 3]), (4, list(range(30, 0, -1))), (5, [2, 1])):
        table += [(k, i, 1, h, h, [0]) for i, k in enumerate(holders)]
    wanted = sorted((k, h) for k, _, _, h, _, _ in table if (h == 1 and k != 9) or (h == 4 and k != 30))
    rng = random.Random(3)
    for _ in range(60):
        cuts = sorted(rng.sample(range(1, len(table)), rng.randint(0, 8)))
        dropped, open_, parts = [], [], defaultdict(list)
        for a, b in zip([0, *cuts], [*cuts, len(table)], strict=True):
            own, batches = table[a:b], []
            while own:
                n = rng.randint(1, 6)
                batches.append(pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in own[:n]]))
                own = own[n:]
            for batch in line_dedup.first_occurrences(iter(batches), 5):
                for r in batch.to_pylist():
                    if r["state"] == "part":
                        parts[r["h1"]].append((r["n_lines"], r["key"]))
                    else:
                        (dropped if r["state"] == "dropped" else open_).append((r["key"], r["h1"]))
        for key, h in open_:
            if sum(n for n, _ in parts[h]) >= 5 and key != max(k for _, k in parts[h]):
                dropped.append((key, h))
        assert sorted(dropped) == wanted


def test_line_bitmaps_round_trip_and_names(spark):
    docs = spark.createDataFrame([(i, "x" * 45 + "\nown " + str(i), 1) for i in range(6)], "id long, body string, kept int")
    maps = line_dedup.keep_bitmaps(docs, "id", "body")
    assert [r["n_dropped"] for r in maps.collect()] == [1] * 5
    done = line_dedup.drop_lines(docs, maps, "id", "body")
    assert done.columns == ["id", "body", "kept_", "n_lines", "n_dropped", "kept"]
    assert {r["id"]: r["kept"] for r in done.collect()} == {i: (("x" * 45 + "\n") if i == 5 else "") + f"own {i}" for i in range(6)}
    empty = docs.where("id < 0")
    assert line_dedup.drop_lines(empty, line_dedup.keep_bitmaps(empty, "id", "body"), "id", "body").count() == 0


# --- ranked search ---

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(lower(text or ""))


def rank_by_force(docs, items, first):
    counted = [(k, Counter(terms(t)), len(terms(t))) for k, t in docs]
    counted = [x for x in counted if x[2]]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for key, own, size in counted:
            m, score = 75 + (25 * size * n) // total, 0
            for t in terms(text):
                if t in own:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * own[t]) // (1000 * own[t] + 12 * m))
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, k[3], -k[0]) for i, k in enumerate(sorted(scores)[:first])]
    return sorted(out, key=str)


@pytest.mark.parametrize("first,shard,block", [(20, 4096, 256), (3, 16, 2), (1, 5, 1)])
def test_ranked_search_equals_brute_force(spark, first, shard, block):
    rng = random.Random(first)
    words = [f"w{i}" for i in range(60)] + ["Éa", "THE", "the"] * 20
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(90)]
    docs += [(200 + i, docs[3][1]) for i in range(30)] + [(3, docs[3][1]), (None, docs[3][1]), (300, None), (301, ""), (302, "--- ..."), (303, "w1 " * 3000)]
    items = [(f"i{j}", " ".join(rng.choices(words, k=rng.randint(1, 12)))) for j in range(7)] + [("i0", docs[3][1]), (None, "w1 w1 w2"), ("none", ""), ("null", None), ("other", "nothing here matches")]
    got = ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string"), first=first, shard_docs=shard, block_items=block)
    assert rows(got) == rank_by_force(docs, items, first)


def test_ranked_search_in_parts_and_empty(spark):
    docs = [(i, f"alpha beta w{i % 7} w{i % 3}") for i in range(50)]
    items = [(f"i{j}", f"w{j} alpha") for j in range(9)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert rows(ranked_search.search(d, b, first=4, block_bytes=60)) == rank_by_force(docs, items, 4)
    assert ranked_search.search(d.where("doc_id < 0"), b).count() == 0
    assert ranked_search.search(d, b.where("item_id = 'x'")).count() == 0


def test_bounds_close_documents_before_their_postings_end():
    """Documents that can't get in are closed early, and an item whose intervals have met stops the reading."""
    import numpy as np

    items = ranked_search.Items([b"rare common"])
    rare, common = items.vocabulary[b"rare"], items.vocabulary[b"common"]
    ends = np.array([[900, 1000], [1, 10]] if rare < common else [[1, 10], [900, 1000]])
    state = ranked_search.Bounds(1, items.block(0), ends[:, 0], ends[:, 1], 50, 2)
    state.add(np.array([rare] * 3), np.array([4, 5, 6]), np.array([1000, 950, 900]))
    state.add(np.array([common]), np.array([9]), np.array([10]))
    assert sorted(np.flatnonzero(state.open)) == [4, 5] and not state.settled
    state.add(np.array([common] * 2), np.array([4, 5]), np.array([9, 8]))
    assert state.settled
    assert [x.tolist() for x in state.best()] == [[0, 0], [4, 5], [1009, 958]]


# --- collocations ---


def phrases_by_force(docs, first, least):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    out = defaultdict(list)
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = defaultdict(int)
    for (lang, p), a in candidates.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inside[lang, p[i : i + m]] = max(inside[lang, p[i : i + m]], a)
    for (lang, p), a in candidates.items():
        if 100 * inside[lang, p] >= 80 * a:
            continue
        cut = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-cut[0], -a, " ".join(p).encode(), f[lang, p[: cut[1]]], f[lang, p[cut[1] :]]))
    return sorted(((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:first])), key=str)


def phrase_docs(seed):
    rng = random.Random(seed)
    docs = []
    for _ in range(150):
        words = []
        for _ in range(rng.randint(0, 40)):
            words += rng.choice([["the"], ["of", "the"], ["New", "York"], ["new", "york", "city"], ["a", "b", "c", "d"], ["a", "b", "c"], ["b", "c"], [f"w{rng.randint(0, 9)}"], ["é x"], ["ho", "ho", "ho"], [","], [".\n"], ["x\ty"]])
        docs.append((rng.choice(["en", "en", "fr", None, "und"]), " ".join(words)))
    return [*docs, ("de", "too few words"), ("en", None), ("en", ""), docs[0], docs[0]]


@pytest.mark.parametrize("first,bits,chunk", [(2000, 1 << 20, 1_000_000), (7, 1 << 20, 300), (3, 64, 1000), (1, 1 << 16, 50)])
def test_collocations_equal_brute_force(spark, first, bits, chunk):
    docs = phrase_docs(first)
    table = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    got = collocations.collocations(table, first=first, least=12, filter_bits=bits, chunk_words=chunk)
    assert rows(got) == phrases_by_force(docs, first, 12)


def test_collocations_go_deeper_where_the_best_are_displaced(spark):
    """The best pairs are all parts of longer phrases, so the first waves find too few."""
    text = " . ".join(["a1 a2 a3 a4"] * 40 + ["b1 b2 b3 b4"] * 40 + [f"c{i} d{i} . c{i}" for i in range(12)] * 40)
    docs = [("en", text)]
    got = collocations.collocations(spark.createDataFrame(docs, "lang string, text string"), first=3, filter_bits=1 << 16)
    assert rows(got) == phrases_by_force(docs, 3, 30)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty, filter_bits=1 << 10).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", "few")], "lang string, text string"), filter_bits=1 << 10).count() == 0
