"""Corpus operators on Spark: contracts, brute force, and odd rows."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from unpaired.llm import chat_format, common, decontaminate, langid, media, mixing, quality, sharding, simhash, token_counts, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, size string, shard string"
LONG = "word " * 30_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in each column, empty and long texts, ties, repeats, and clashing extra columns."""
    rows = [(0, None, "en", "a", 1), (1, "", None, None, None), (2, "the cat sat on the mat", "en", "b", 3), (2, "the cat sat on the mat", "en", "b", 3), (3, LONG, "en", "a", 3), (None, "das haus und der hund", "de", None, 3), (4, "the cat sat on the mat", "en", "c", 1), (5, "\t \n", "fr", "", 1), (6, "1 2 3", "en", "a", 1), (7, "é" * 70, "fr", "b", 1)]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def test_media_contract(spark, odd):
    got = media.document_media(odd).collect()
    texts = [r["text"] or "" for r in odd.collect()]
    expected = set()
    for t in texts:
        raw = t.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        expected.add((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert len(got) == len(texts)
    assert {(r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got} == expected
    assert len({r["feature"] for r in got}) == len({r["payload_sha256"] for r in got})
    assert media.document_media(empty(spark)).count() == 0


def test_media_assembly_keeps_positions(spark):
    digest = hashlib.sha256(bytes(64)).hexdigest()
    pages = spark.createDataFrame([(1, f"<p>a</p><img src='sha256:{digest}'><p>b</p>"), (2, None), (3, "<img src='sha256:" + "f" * 64 + "'>")], "id long, html string")
    seq = media.interleave(pages, "id", "html")
    store = media.store_payloads(spark.createDataFrame([(digest, bytes(64)), (digest, bytes(64))], "d string, p binary"), "d", "p")
    out = {r["id"]: r["items"] for r in media.assemble(seq, "id", store).collect()}
    assert [(i["pos"], i["kind"], i["media"] is not None) for i in out[1]] == [(0, "text", False), (1, "media", True), (2, "text", False)]
    assert media.decode_png(bytes(out[1][1]["media"])) == bytes(64)
    assert out[2] is None and out[3][0]["media"] is None


def test_pages_are_taken_apart_and_put_together(spark):
    """Every word and medium of the raw pages, in order, as a plain regular expression finds them."""
    import html
    import re

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    seq = common.keep(media.interleave(pages, "page_id", "html"), "page-items")
    store = media.store_payloads(spark.createDataFrame([("0" * 64, bytes(64))], "d string, p binary"), "d", "p")
    whole = {r["page_id"]: r["items"] for r in media.assemble(seq, "page_id", store).collect()}
    for r in pages.collect():
        raw = re.sub(r"(?is)<(script|style|title|template|noscript)\b.*?</\1\s*>|<!--.*?-->", " ", r["html"] or "")
        words = html.unescape(re.sub(r"<[^>]*>", " ", raw)).split()
        items = whole[r["page_id"]] or []
        shown = [w for i in items for w in (i["text"] if i["kind"] == "text" else "").split()]
        captions = "".join(i["caption"] or "" for i in items if i["kind"] == "media")
        assert "".join(shown) == "".join(words) or captions
        assert [i["pos"] for i in items] == list(range(len(items)))


def test_decontamination_contract(spark, odd):
    bench = spark.createDataFrame([(7, "the cat"), (7, "the cat"), (8, "MAT"), (None, "word"), (9, None), (10, "?")], "item_id long, text string")
    got = decontaminate.document_contamination(odd, bench).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == odd.count()
    assert (by[2]["n_words"], by[2]["n_hit"], by[2]["n_items"], by[2]["contaminated"]) == (6, 3, 2, True)
    assert by[2]["items_sha256"] == hashlib.sha256(b"7,8").hexdigest()
    assert by[0]["n_words"] == 0 and not by[0]["contaminated"] and by[3]["n_hit"] == 0
    kept = decontaminate.decontaminate(odd, bench)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {0, 1, 3, None, 5, 6, 7}
    assert decontaminate.document_contamination(empty(spark), bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.document_contamination(odd, bench.limit(0)).collect())


def test_test_set_in_blocks_gives_the_same(spark):
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    one = decontaminate.find(docs, bench).select("doc_id", "found").collect()
    many = decontaminate.find(docs, bench, block_bytes=1500, shard_words=3000).select("doc_id", "found").collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x a b c d e y"), (2, "a b c d"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "q a b c d e z")], "item_id long, text string")
    got = {r["item_pos"]: (r["n_words"], r["doc_id"], r["doc_pos"]) for r in decontaminate.longest_matches(docs, bench, least=3).collect()}
    assert got == {1: (5, 1, 1), 2: (4, 1, 2), 3: (3, 1, 3)}


@pytest.mark.parametrize("block_bytes", [32 << 20, 60])
def test_longest_matches_equal_brute_force(spark, block_bytes):
    rng = np.random.default_rng(7)
    word = lambda n: " ".join(rng.choice(["a", "b", "c"], n))
    docs = [(int(i), word(int(rng.integers(0, 30)))) for i in rng.permutation(25)] + [(None, word(12)), (3, word(9))]
    items = [(i, word(int(rng.integers(1, 14)))) for i in range(8)]
    items += [(9, docs[4][1]), (10, docs[7][1] + " " + docs[8][1])]
    want = {}
    for item, text in items:
        x = text.split()
        least = min(4, len(x))
        for pos in range(len(x) - least + 1 if x else 0):
            for doc, other in docs:
                w = other.split()
                for i in range(len(w)):
                    n = 0
                    while i + n < len(w) and pos + n < len(x) and w[i + n] == x[pos + n]:
                        n += 1
                    if n >= least:
                        want[item, pos] = min(want.get((item, pos), (0, (True, 0), 0)), (-n, (doc is not None, doc or 0), i))
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.longest_matches(*frames, least=4, shard_words=90, block_bytes=block_bytes).collect()
    assert {(r["item_id"], r["item_pos"]): (-r["n_words"], (r["doc_id"] is not None, r["doc_id"] or 0), r["doc_pos"]) for r in got} == want and len(got) == len(want)


def test_token_counts_on_odd_rows(spark, odd):
    got = token_counts.token_counts(odd).collect()
    counter = token_counts.Counter(token_counts.load_vocabulary())
    assert [(r["n_words"], r["n_tokens"], r["score"]) for r in got] == [counter.text(r["text"]) for r in odd.collect()]
    assert token_counts.token_counts(empty(spark)).count() == 0


def test_preference_prefix_and_spans(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "and?"), (0, 3, "assistant", None), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, None, "x"), (4, 0, "user", "a"), (5, 0, "user", "a"), (None, 0, "user", "b")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    sides = df.where("conv_id is not null").selectExpr("floor(conv_id / 2) as pair_id", "conv_id % 2 = 0 as is_chosen", "turn", "role", "text")
    got = {r["pair_id"]: r for r in chat_format.format_preferences(sides).collect()}
    assert set(got) == {0, 1, 2}
    r = got[0]
    assert r["prompt_turns"] == 1 and r["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    assert [r["chosen"][s["start"] : s["end"]] for s in r["chosen_spans"]] == ["yes<|im_end|>", "<|im_end|>"]
    assert [r["rejected"][s["start"] : s["end"]] for s in r["rejected_spans"]] == ["no<|im_end|>"]
    assert (got[1]["prompt"], got[1]["rejected"], got[1]["chosen_spans"]) == ("", None, [])
    assert (got[2]["prompt_turns"], got[2]["chosen"], got[2]["rejected"]) == (1, "", "")
    assert chat_format.conversation_preferences(df.limit(0)).count() == 0


def test_preferences_of_conversations_share_turns(spark):
    long = "x" * 200_000
    turns = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "one"), (0, 2, "user", "and?"), (0, 3, "assistant", "two"), (0, 4, "user", "bye"),
        (1, 0, "user", long), (1, 1, "assistant", None),
        (2, 0, "user", "tie"), (2, 1, "assistant", "same"), (2, 1, "assistant", "same"), (3, 0, "assistant", "same"),
        (4, 0, "user", "no reply"), (5, None, None, None), (6, 0, "assistant", "no neighbour"), (None, 0, "user", "b"), (-2, 0, "assistant", "p"), (-1, 0, "assistant", "q"),
    ]
    df = spark.createDataFrame([(*t, "a", "b", "c") for t in turns], "conv_id long, turn long, role string, text string, pair_id string, _a string, prompt string")
    got = {r["pair_id"]: r for r in chat_format.conversation_preferences(df).collect()}
    assert set(got) == {-2, -1, 0, 1, 2, 3, 4, 5, 6}
    show = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert (got[0]["prompt_turns"], got[0]["chosen"], got[0]["rejected"]) == (3, show("assistant", "two") + show("user", "bye"), show("assistant", ""))
    assert (got[1]["prompt_turns"], got[1]["prompt"], got[1]["rejected"]) == (1, show("user", long), show("assistant", "two"))
    assert (got[2]["prompt_turns"], got[2]["chosen"], got[2]["rejected"]) == (3, "", "")  # the other reply is the same
    assert (got[3]["prompt_turns"], got[3]["rejected"]) == (1, "")
    assert got[4]["rejected"] is None and got[5]["rejected"] is None and got[6]["rejected"] is None and got[6]["chosen"] == show("assistant", "no neighbour")
    assert (got[-2]["rejected"], got[-1]["rejected"]) == (show("assistant", "q"), show("assistant", "p"))
    real = chat_format.conversation_preferences(spark.read.parquet(f"{DATA}/conversations.parquet")).collect()
    assert sum(r["prompt_turns"] > 0 for r in real) > len(real) / 2


def shingles(text):
    """The set of 5-word shingles, or the one of a shorter text."""
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(prints):
    prints = [(k, f & (2**64 - 1)) for k, f in prints]
    label = [k for k, _ in prints]
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(prints):
            for j, (_, b) in enumerate(prints):
                if bin(a ^ b).count("1") <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


@pytest.mark.parametrize("limit", [4096, 2])
def test_simhash_components_match_brute_force(spark, limit):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    near = docs.selectExpr("doc_id + 1000 as doc_id", "concat(text, ' x') as text", "lang", "source", "n_chars")
    got = simhash.near_duplicates(docs.union(near).union(docs.limit(3)), limit=limit).orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == brute_components([(r["doc_id"], r["fp"]) for r in got])


def test_simhash_on_odd_rows(spark, odd):
    got = simhash.document_near_duplicates(odd).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == odd.count() and by[0]["fingerprint"] == "0" * 16 and by[0]["component_id"] == by[1]["component_id"] == by[5]["component_id"] == 0
    assert by[2]["component_id"] == by[4]["component_id"] == 2
    assert simhash.document_near_duplicates(empty(spark)).count() == 0
    assert sorted(r["doc_id"] for r in simhash.first_of_each(odd.where("doc_id is not null")).collect()) == [0, 2, 3, 6, 7]


def test_one_of_each_group_of_near_copies_stays(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SET_HASHES", 4000)  # a hot bucket is dealt out in blocks
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 9000, 300) for _ in range(30)]
    rows = [(i, " ".join(map(str, b)), "a") for i, b in enumerate(base)]
    for i in range(120):  # near copies: one word in 150 is changed; half of them of one text
        copy = base[0 if i % 2 else i % 30].copy()
        copy[rng.integers(0, 300, 2)] = 9001 + i
        rows.append((1000 + i, " ".join(map(str, copy)), "b"))
    docs = common.keep(spark.createDataFrame(rows, "doc_id long, text string, _x string"), "near-copies")
    got = simhash.first_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(30))


def test_a_member_of_a_group_links_others_to_it(spark):
    rng = np.random.default_rng(3)
    words = rng.integers(0, 9000, 200).astype(str)
    a, c = words.copy(), words.copy()  # b is near both; a and c are apart
    a[:15], c[-15:] = rng.integers(9000, 18000, 15).astype(str), rng.integers(9000, 18000, 15).astype(str)
    docs = [(1, " ".join(a)), (2, " ".join(words)), (3, " ".join(c)), (4, "quite another text of seven words")]
    sets = [shingles(x) for _, x in docs]
    index = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert index(0, 1) >= 0.8 <= index(1, 2) and index(0, 2) < 0.8
    assert sorted(r["doc_id"] for r in simhash.first_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == [1, 4]


def test_blocks_of_a_hot_bucket_cover_all_pairs_with_a_seed(spark):
    rng = np.random.default_rng(4)
    rows = [(b, n, int(rng.integers(1, 9)), bool(rng.random() < share), n) for b, share in ((0, 0.1), (1, 1.0), (2, 0.0)) for n in range(60)] + [(3, 1, 2, True, 1), (3, 2, 2, False, 2)]
    dealt = simhash.in_blocks(spark.createDataFrame(rows, "bucket long, node long, size long, seed boolean, label long"), 40).collect()
    blocks, seen = {}, {}
    for r in dealt:
        blocks.setdefault((r["bucket"], r["i"], r["j"]), []).append(r)
    for (bucket, _, _), own in blocks.items():
        assert sum(r["size"] for r in own) <= 160
        for x in own:
            for y in own:
                if x["seed"] and x["node"] != y["node"]:
                    seen.setdefault(bucket, set()).add((x["node"], y["node"]))
    for bucket in range(4):
        own = [r for r in rows if r[0] == bucket]
        assert seen.get(bucket, set()) == {(x[1], y[1]) for x in own for y in own if x[3] and x[1] != y[1]}


def test_unconnected_groups_of_one_bucket_are_compared(spark, monkeypatch):
    # a chain, in a bucket whose hub is near none but the first: only the second step can connect it
    rng = np.random.default_rng(9)
    words = rng.integers(0, 9000, 400).astype(str)
    texts = []
    for i in range(12):
        words[20 * i : 20 * i + 20] = rng.integers(9000, 10**6, 20).astype(str)
        texts.append(" ".join(words))
    codes = [(i, i, i, len(shingles(t)), [1]) for i, t in enumerate(texts)]
    codes = spark.createDataFrame(codes, "node long, row long, fp long, size long, keys array<long>")
    monkeypatch.setattr(simhash, "links", lambda codes: codes.sparkSession.createDataFrame([], "a long, b long"))
    texts = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    for hashes in (1 << 19, 900):
        monkeypatch.setattr(simhash, "SET_HASHES", hashes)
        got = {r["node"]: r["root"] for r in simhash.components(simhash.near_copy_links(codes, texts)).collect()}
        assert got == dict.fromkeys(range(12), 0)


@pytest.mark.parametrize("hashes", [1 << 19, 3000])
def test_near_copies_are_those_of_the_exact_index(spark, monkeypatch, hashes):
    monkeypatch.setattr(simhash, "SET_HASHES", hashes)  # 3000: groups are dealt out in blocks
    rng = np.random.default_rng(11)
    texts = []
    for base in rng.integers(0, 9000, (6, 150)):
        for i in range(15):  # up to 30 words are changed at one place: indices of 0.6 to 1
            copy, n = base.copy(), int(rng.integers(0, 31))
            at = rng.integers(0, 150 - n)
            copy[at : at + n] = rng.integers(9000, 10**6, n)
            texts.append(" ".join(map(str, copy)))
    texts += ["one line that all of them have " * 60 + " ".join(map(str, rng.integers(0, 9000, 40))) for _ in range(10)]
    sets = [shingles(x) for x in texts]
    near = np.array([[5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets])
    want = np.arange(len(texts))
    for _ in texts:
        want = np.where(near, want[None], len(texts)).min(1)
    docs = common.keep(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "exact-index")
    assert sorted(r["doc_id"] for r in simhash.first_of_each(docs).collect()) == sorted(set(want.tolist()))


def test_tables_on_the_way_are_deleted(spark, tmp_path):
    kept = []

    def make():
        kept.append(common.keep(spark.range(5), "inner"))
        kept.append(common.only(lambda: common.keep(spark.range(3), "deeper"), "middle"))
        return kept[0].join(kept[1], "id")

    out = common.only(make, "outer")
    assert out.count() == 3
    import os

    assert not any(os.path.exists(f.removeprefix("file://")) for x in kept for f in x.inputFiles())


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_url_filter_blocks(spark):
    pages = spark.createDataFrame([(1, "http://a.EXAMPLE.net/en/x"), (2, "http://b.net/x"), (3, None), (4, "http://net"), (5, "http://example.com/de/"), (5, "http://example.com/de/"), (6, "http://x.org/fr"), (7, "http://notexample.com/de/")], "page_id long, url string")
    expected = [(1, "example.net/en/", "allow"), (2, "net/", "block"), (3, None, "allow"), (4, None, "allow"), (5, "example.com/de/", "block"), (5, "example.com/de/", "block"), (6, None, "allow"), (7, None, "allow")]
    rules = spark.createDataFrame(list(url_filter.RULES), "host string, path string, verdict string")
    for size in (100, 1):
        got = url_filter.judge_urls(pages, rules, block_rules=size).orderBy("page_id").collect()
        assert [(r["page_id"], r["rule"], r["verdict"]) for r in got] == expected
    assert url_filter.page_verdicts(pages.limit(0)).count() == 0


def test_shards_are_near_equal_and_gapless(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    many = docs.crossJoin(spark.range(20)).selectExpr("doc_id * 20 + id as doc_id", "if(doc_id < 70, 'same text here', concat(text, id)) as text")
    rows = sharding.document_shards(many).collect()
    sums = {}
    for r in rows:
        sums.setdefault(r["shard"], []).append(r)
    assert sorted(sums) == list(range(8))
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for part in sums.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 8) <= largest + total / 8 * 0.01
    got = sharding.document_shards(odd).collect()
    assert len(got) == odd.count()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got}[0] == (1, 0)
    assert sharding.document_shards(empty(spark)).count() == 0
    assert sharding.shard_documents(odd).columns == ["shard_" if c == "shard" else c for c in odd.columns] + ["shard", "slot"]
    assert sorted(map(str, sharding.shard_documents(odd).select(*[F.col("shard_").alias(c) if c == "shard" else c for c in odd.columns]).collect())) == sorted(map(str, odd.collect()))


def test_mix_meets_targets(spark, odd):
    got = mixing.document_mix(odd).collect()
    assert len(got) == odd.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.document_mix(empty(spark)).count() == 0
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = mixing.document_mix(docs.union(docs.limit(5))).collect()
    largest = max(r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    total = sum({k: k[0] for k in by}.values())
    assert np.isclose(sum(k[1] for k in by), 1.5 * total) and all(t <= 2 * s for s, t in by)
    assert all(abs(sum(v) - k[1]) <= largest for k, v in by.items())
    kept = common.keep(docs, "mix-test")
    assert mixing.mixed_documents(kept).columns == docs.columns


def test_rows_keep_their_numbers_when_splits_change(spark, monkeypatch):
    rows = [(i, f"text {i} " * 30 + f"of {i}", "a") for i in range(60)] + [(100 + i, f"text {i} " * 30 + f"of {i}", "a") for i in range(60)]
    docs = common.keep(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8), "numbered-test")

    def keep_then_split(df, name):
        out = common.keep(df, name)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728" if name in ("fingerprints", "mix-rows") else "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        return out

    def scans(got):
        return got._jdf.queryExecution().analyzed().toString().count("monotonically_increasing_id")

    try:
        monkeypatch.setattr(simhash, "keep", keep_then_split)
        monkeypatch.setattr(mixing, "keep", keep_then_split)
        unique, mixed = simhash.first_of_each(docs), mixing.mixed_documents(docs)
        assert scans(unique) == scans(mixed) == 0  # the last join reads numbers, it doesn't give them
        assert sorted(r["doc_id"] for r in unique.collect()) == list(range(60))
    finally:
        for name in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{name}")


def test_language_of_odd_rows(spark, odd):
    got = langid.document_languages(odd).collect()
    assert len(got) == odd.count()
    assert all((r["lang_pred"] == "und") == (r["score"] == 0.0) for r in got)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} >= {0, 1, 5, 6}
    assert langid.document_languages(empty(spark)).count() == 0
    nothing = langid.document_languages(odd.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_languages_are_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.document_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.95


def test_words_of_switched_texts_are_labelled(spark):
    """Held-out texts of two languages joined stretch by stretch: each word's language is found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and text is not null")
    model = langid.fit_language_model(docs, ~langid.held_out())
    rows = [(r["text"], r["lang"]) for r in docs.where(langid.held_out() & (F.length("text") > 800)).orderBy("doc_id").collect()]
    rng = np.random.default_rng(0)
    texts, truth = [], []
    for i in range(120):
        (a, x), (b, y) = (rows[j] for j in rng.choice(len(rows), 2, replace=False))
        parts, langs = [a.split(), b.split()], [x, y]
        words, own = [], []
        while min(map(len, parts)) and len(words) < 200:
            n = int(rng.integers(8, 25))
            took, parts = parts[0][:n], [parts[1], parts[0][n:]]
            words += took
            own += [langs[0]] * len(langid.words([" ".join(took)])[1])
            langs.reverse()
        texts.append((i, " ".join(words)))
        truth.append(own)
    right = total = 0
    spans = langid.language_spans(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    for r in spans:
        own = truth[r["doc_id"]][r["first_word"] : r["first_word"] + r["n_words"]]
        assert len(own) == r["n_words"]
        right, total = right + own.count(r["lang"]), total + len(own)
    assert total == sum(map(len, truth))
    print(f"words labelled right: {right / total:.4f} of {total}")
    assert right / total > 0.9


def test_quality_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(2, 1, 0), (2, 0, 0), (3, 1, None), (4, None, 0), (None, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.document_quality(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert quality.document_quality(empty(spark), labels).count() == 0
    assert {r["score"] for r in quality.document_quality(odd, labels.limit(0)).collect()} == {0.5}


def test_quality_is_learned(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.document_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.9


CLASHING = "_row row copies _copy score lang_pred _found found shard slot _size size h key _h _pid _idx _at doc name node label digest keys seed".split()


def clashing(spark, n=24):
    """Documents of three sources in which every other column has a name that operators use inside."""
    rng = np.random.default_rng(6)
    docs = []
    for i in range(n):
        text = " ".join(rng.choice(["the", "of", "house", "water", "and", "with", "garden", "river", "small", "light"], 40))
        docs.append((i, None if i == 5 else text, "en", "abc"[i % 3], len(text), *(f"{c}{i}" for c in CLASHING)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))


@pytest.mark.parametrize("stage", ["language", "near", "benchmark", "mix", "shards"])
def test_columns_of_any_name_are_carried(spark, stage):
    docs = common.keep(clashing(spark), "clashing")
    bench = spark.createDataFrame([(1, "zz yy")], "item_id long, text string")
    got = {"language": langid.identified, "near": simhash.first_of_each, "benchmark": lambda d: decontaminate.decontaminate(d, bench), "mix": mixing.mixed_documents, "shards": sharding.shard_documents}[stage](docs)
    given = {tuple(r) for r in docs.collect()}
    if stage == "shards":
        assert got.columns == [f"{c}_" if c in ("shard", "slot") else c for c in docs.columns] + ["shard", "slot"]
        assert {tuple(r)[:-2] for r in got.collect()} == given
    else:
        assert got.columns == docs.columns
        rows = [tuple(r) for r in got.collect()]
        assert set(rows) <= given and len(set(rows)) >= {"language": 23, "near": 24, "benchmark": 24}.get(stage, 10)


def test_clashing_columns_of_predictions_stay_under_another_name(spark):
    docs = clashing(spark)
    got = langid.predict_language(docs, None)
    assert got.columns == [f"{c}_" if c in ("score", "lang_pred") else c for c in docs.columns] + ["lang_pred", "score", "n_runs"]
    assert {r["score_"] for r in got.collect()} == {r["score"] for r in docs.collect()}
    bench = spark.createDataFrame([(1, "zz yy")], "item_id long, text string")
    assert {r["found_"] for r in decontaminate.find(docs, bench).collect()} == {r["found"] for r in docs.collect()}


def test_pipeline(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["language ID", "near duplicates", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = cp.run(spark, DATA)
    assert set(out.columns) == {*docs.columns, "shard", "slot"}
    ids = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert 0 < len(ids) <= docs.count()
    keep = common.keep
    named = keep(cp.identify_language(spark, docs, DATA), "t1")
    unique = keep(cp.drop_near_duplicates(spark, named, DATA), "t2")
    rows = sorted((r["doc_id"], shingles(r["text"])) for r in named.collect())
    near = np.array([[x == y or 5 * len(x & y) >= 4 * len(x | y) for _, y in rows] for _, x in rows])
    label = np.arange(len(rows))
    for _ in label:
        label = np.where(near, label[None], len(rows)).min(1)
    assert {r["doc_id"] for r in unique.collect()} == {rows[i][0] for i in label}
    clean = keep(cp.drop_benchmark_passages(spark, unique, DATA), "t3")
    marked = {r["doc_id"] for r in decontaminate.document_contamination(unique, spark.read.parquet(f"{DATA}/benchmark.parquet")).where("contaminated").collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in unique.collect()} - marked
    mixed = cp.mix_sources(spark, clean, DATA).groupBy("doc_id").count().collect()
    assert {r["count"] for r in mixed} <= {1, 2} and {r["doc_id"] for r in mixed} == ids
