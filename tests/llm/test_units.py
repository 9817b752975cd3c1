"""Helpers of the corpus operators against brute force, without Spark."""

import hashlib
import random

import numpy as np
import pytest

from unpaired.llm import decontaminate as dc
from unpaired.llm import langid, media, quality, simhash, token_counts, url_filter


def test_png_round_trip():
    for n in (64, 128, 6400):
        payload = random.Random(n).randbytes(n)
        assert media.decode_png(media.encode_png(payload)) == payload


def test_damaged_png_is_refused():
    stored = bytearray(media.encode_png(bytes(64)))
    stored[-20] ^= 1
    with pytest.raises(ValueError, match="damaged chunk"):
        media.decode_png(bytes(stored))


def test_items_keep_order_positions_and_captions():
    page = "<h1>a</h1><p>b <b>c</b></p><figure><img src='x.png'><img src='media:sha256-" + "0" * 64 + "'><figcaption>two &amp; more</figcaption></figure>d<script>var t='<p>';</script><img src='y' alt='z'>"
    items = media.parse_items(page)
    assert [i["pos"] for i in items] == list(range(len(items)))
    assert [(i["kind"], i["text"] or i["src"], i["caption"]) for i in items] == [
        ("text", "a", None), ("text", "b c", None), ("media", "x.png", "two & more"), ("media", "media:sha256-" + "0" * 64, "two & more"), ("text", "d", None), ("media", "y", "z"),
    ]
    assert items[3]["digest"] == "0" * 64
    assert media.parse_items(None) == media.parse_items("") == []


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<figure><figcaption>first</figcaption><img src=a></figure>x", [("a", "first"), "x"]),
        ("<figure><img src=a><figcaption>cap</figure>rest <p>of it", [("a", "cap"), "rest", "of it"]),
        ("<figure><img src=a><figcaption>never closed<p>rest", [("a", None), "never closed", "rest"]),
        ("<title>never closed<p>rest", ["never closed", "rest"]),
        ("a<template><img src=x>gone</template>b<template>kept", ["abkept"]),
        ("<noscript><img src=lazy></noscript><img src=real alt=y>", [("real", "y")]),
        ("<figure><figure><img src=in><figcaption>inner</figcaption></figure><img src=out><figcaption>outer</figcaption></figure>", [("in", "inner"), ("out", "outer")]),
        ("<figure><figure><img src=in></figure><figcaption>outer</figcaption></figure>", [("in", "outer")]),
        ("<figure><figcaption>alone</figcaption></figure><figcaption>stray</figcaption>", ["alone", "stray"]),
        ("<picture><source srcset='s1 1x, s2 2x'><img src=i></picture><video poster=p src=v></video><object data=o></object>", [("i", None), ("p", None), ("v", None), ("o", None)]),
        ("<figure><picture><source srcset='s1 1x'><source src=s2></picture><figcaption>cap</figcaption></figure>", [("s1", "cap")]),
        ("<picture><source src=s1>x<p>y", [("s1", None), "x", "y"]),
        ("İ" * 60 + "<title>a</title><p>x <title>not lost <p>more", ["İ" * 60, "x not lost", "more"]),
        ("<p>x <script>var a<p>kept", ["x var a", "kept"]),
        ("a<SCRIPT>gone</Script>b<style>kept", ["abkept"]),
        ("<figcaption>one<p>two</figcaption>", ["one", "two"]),
        ("<figure><img src=a><figcaption>one<br>two</figcaption></figure></figure></p>", [("a", "one two")]),
    ],
)
def test_captions_and_unclosed_elements(page, expected):
    items = media.parse_items(page)
    assert [i["pos"] for i in items] == list(range(len(items)))
    assert [i["text"] if i["kind"] == "text" else (i["src"], i["caption"]) for i in items] == expected


def test_no_word_of_random_markup_is_lost_or_moved():
    tags = "p div figure figcaption b article img br".split()
    for seed in range(200):
        rng = random.Random(seed)
        page = "".join(rng.choice([f"<{t}>" if t not in ("img",) else f"<img src=m{i}>", f"</{t}>", f" w{i} "]) for i, t in enumerate(rng.choices(tags, k=60)))
        items = media.parse_items(page)
        import re as regex

        words = regex.sub(r"<[^>]*>", " ", page).split()
        shown = [w for i in items if i["kind"] == "text" for w in i["text"].split()]
        captions = {w for i in items if i["kind"] == "media" and i["caption"] for w in i["caption"].split()}
        assert sorted({*shown, *captions}) == sorted(words) and len(shown) == len(set(shown))
        assert [i["src"] for i in items if i["kind"] == "media"] == regex.findall(r"src=(\w+)", page)


def brute_hits(texts, items):
    windows = {}
    for key, text in items:
        w = dc.words_of(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(key))
    out = []
    for text in texts:
        w, hit, found = dc.words_of(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= names
        out.append((hit, found))
    return out


def brute_longest(text, items):
    """The longest match (words, first word, item) of a suffix of 13 words or more, or of a whole shorter item."""
    w, out = dc.words_of(text), []
    for key, other in items:
        x = dc.words_of(other)
        if key is None or not x:
            continue
        least = min(13, len(x))
        for i in range(len(w)):
            for j in range(len(x) - least + 1):
                n = 0
                while i + n < len(w) and j + n < len(x) and w[i + n] == x[j + n]:
                    n += 1
                if n >= least:
                    out.append((-n, i, str(key)))
    return (lambda b: (-b[0], b[1], b[2]))(min(out)) if out else None


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_hits_match_brute_force(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd ef é gh".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 12, 13, 14, 40])))) for i in range(6)] + [(1, "zz"), (None, "ab"), (9, None)]
    texts = [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(30)] + [None, "", items[4][1], "!! " + items[5][1].upper() + " x"]
    got = dc.search_shard([dc.words_of(t) for t in texts], dc.TestSet(items))
    for (_, _, longest), text in zip(got, texts, strict=True):
        assert longest == brute_longest(text, items)
    for (spans, names, _), (hit, found) in zip(got, brute_hits(texts, [x for x in items if x[0] is not None and x[1]]), strict=True):
        assert {p for a, b in spans for p in range(a, b)} == hit
        assert set(names) == found


def test_suffixes_are_sorted():
    rng = np.random.default_rng(0)
    tokens = np.concatenate([[0], rng.integers(1, 3, 400), [0], rng.integers(1, 3, 300), [0]])
    made = dc.SuffixArray(tokens, 2, 3, 1024)
    suffix = [tuple(tokens[i:][: int(np.argmax(tokens[i:] == 0))]) for i in made.order]
    assert suffix == sorted(suffix)


def test_shingles_and_fingerprint_bits():
    import xxhash

    text = "The quick\tbrown  fox THE quick brown"
    words = text.lower().split()
    expected = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    hashes = lambda x: simhash.shingle_hashes(simhash.words_of(x))
    got = hashes(text)
    assert got.tolist() == expected
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in expected) > len(expected))
    assert simhash.fold([got, hashes("one two"), hashes(None)]).tolist() == [bits, xxhash.xxh64_intdigest("one two", 42), 0]


@pytest.mark.parametrize("seed", range(4))
def test_gray_index_finds_all_links(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    codes = [base]
    for _ in range(6):
        codes.append(codes[-1] ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)))
    codes = np.unique(np.concatenate(codes))
    run = np.sort(rng.integers(0, 4, len(codes)))
    codes = codes[np.lexsort((simhash.gray_rank(codes), run))]
    near = (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3) & (run[:, None] == run[None, :])
    a, b = simhash.GrayIndex(codes, run).near(np.arange(len(codes)), run, 3)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {tuple(x) for x in np.argwhere(np.triu(near, 1)).tolist()}
    label = np.arange(len(codes))
    while (label != (low := np.where(near, label[None, :], len(codes)).min(1))).any():
        label = low
    assert (simhash.link_runs(codes, run) == label).all()


@pytest.mark.parametrize("seed", range(4))
def test_links_of_sets_match_brute_force(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for base in rng.integers(0, 1 << 62, (5, 60)).astype(np.uint64):
        for _ in range(8):
            copy, n = base.copy(), int(rng.integers(0, 14))
            copy[:n] = rng.integers(0, 1 << 62, n)
            sets.append(np.unique(copy[: int(rng.integers(50, 61))]))
    sets += [np.empty(0, np.uint64), np.array([7], np.uint64), np.array([7], np.uint64)]
    sets = [sets[i] for i in rng.permutation(len(sets))]
    near = np.array([[bool(len(x) and 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y))) for y in sets] for x in sets])
    n = len(sets)

    def groups(linked, label):
        linked = linked | (label[:, None] == label[None])
        for _ in range(n):
            label = np.where(linked, label[None], n).min(1)
        return label

    a, b = simhash.link_sets(sets, np.arange(n), np.arange(n))
    found = np.zeros((n, n), bool)
    found[a, b] = found[b, a] = True
    assert not (found & ~near).any() and (groups(found, np.arange(n)) == groups(near, np.arange(n))).all()
    seeds, label = np.flatnonzero(rng.random(n) < 0.3), rng.integers(0, 9, n)  # some seeds, and rows known to belong together
    wanted = near & (np.isin(np.arange(n), seeds)[:, None] | np.isin(np.arange(n), seeds)[None])
    a, b = simhash.link_sets(sets, seeds, label)
    found[:] = False
    found[a, b] = found[b, a] = True
    assert not (found & ~wanted).any() and (groups(found, label) == groups(wanted, label)).all()


def test_minima_agree_as_often_as_the_index_says():
    rng = np.random.default_rng(2)
    pairs = []
    for _ in range(300):  # index 0.8: 400 of 500 are shared
        pool = rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 500).astype(np.uint64)
        pairs += [np.unique(pool[:450]), np.unique(pool[50:])]
    keys = simhash.band_keys(pairs)
    same = keys[::2] == keys[1::2]
    assert abs(same.mean() - 0.8**6) < 0.02 and same.any(1).all()
    assert (np.stack([simhash.band_keys([x])[0] for x in pairs[:5]]) == keys[:5]).all()
    words = [b"a", b"b", b"c", b"d", b"e", b"f", b"a", b"b", b"c", b"d", b"e"]
    long = [b"%d" % i for i in rng.integers(0, 9, 3000)]
    texts = [words, words[:3], [], words[:3], words[:5], words[1:5], [b"ab", b"c"], [b"a", b"bc"], long]
    sets = simhash.shingle_sets(texts)
    assert [len(x) for x in sets] == [6, 1, 0, 1, 1, 1, 1, 1, len({tuple(long[i : i + 5]) for i in range(2996)})]
    assert len(set(np.concatenate(sets[:5]).tolist())) == 7 and len(set(np.concatenate(sets[4:8]).tolist())) == 4
    assert sets[4][0] in sets[0] and all((x == simhash.shingle_sets([y])[0]).all() for x, y in zip(sets, texts, strict=True))


def test_bands_cover_every_link():
    masks = simhash._bands(0, 4)
    assert sum(bin(m).count("1") for m in masks) == 64 and len(masks) == 4
    deeper = [s for m in masks for s in simhash._bands(m, 4)]
    rng = random.Random(0)
    for _ in range(200):
        flips = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(flips & m == 0 for m in masks)
        for m in masks:
            if flips & m == 0:
                assert any(flips & s == 0 for s in deeper if s & m == m)


def test_token_counts_equal_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    vocabulary = token_counts.load_vocabulary()
    lib = tokenizers.Tokenizer(tokenizers.models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    lib.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="first", split=True)
    texts = ["", " ", "  a  b", "\n\n x", "Hello world, how are you?", "日本語テスト 漢字", "🙂🙂 a🙂b", "<s> x</s>", "a▁b▁▁c", "ñandú " * 3, "x" * 3000, "aé́"]
    counter = token_counts.Counter(vocabulary)
    assert [counter.text(t)[1] for t in texts] == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert counter.text(None) == (0, 0, 0.0)


def test_viterbi_tie_rules_and_unknown_runs():
    tiny = token_counts.Counter([("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0)])
    assert tiny.text("ab") == (1, 2, -3.0)  # '▁a' + 'b' and '▁' + 'ab' tie at the last end with -3, kept: the longer last piece
    assert tiny.text("a??b")[1] == 3  # an unknown run counts once without byte pieces


@pytest.mark.parametrize(
    ("url", "parts"),
    [(None, ("", "")), ("", ("", "")), ("example.com/a", ("", "")), ("http://A.Com", ("a.com", "")), ("x://h?q/://y", ("h", "")), ("http://h/p/q?x#y", ("h", "/p/q")), ("http://h#f", ("h", "")), ("http:///p", ("", "/p"))],
)
def test_split_url(url, parts):
    assert url_filter.split_url(url) == parts


def test_collisions_are_confirmed(tmp_path):
    packed = url_filter.pack_rules([("net", "/", "block"), ("a.net", "/x", "allow"), ("a.net", "/x", "block")])
    (tmp_path / "f").write_bytes(packed)
    array = url_filter.DigestArray(str(tmp_path / "f"))
    assert len(array.keys) == 2 and (np.diff(array.keys.astype(object)) > 0).all()
    at = array.find([(b"net/", 3), (b"net/", 2), (b"a.net/x", 5), (b"zz", 1)])
    assert at[0] >= 0 and at[1] == -1 and at[2] >= 0 and at[3] == -1 and array.blocks[at[2]] == 1
    (tmp_path / "e").write_bytes(url_filter.pack_rules([]))
    assert url_filter.DigestArray(str(tmp_path / "e")).find([(b"net/", 3)]).tolist() == [-1]


@pytest.mark.parametrize("piece", [64, 1, 2, 3])
def test_forward_backward_equals_enumeration(monkeypatch, piece):
    from itertools import product

    monkeypatch.setattr(langid, "PIECE", piece)  # pieces of a chain carry exact messages
    model = langid.Crf(["x", "y", "z"])
    rng = np.random.default_rng(0)
    model.moves = rng.normal(size=(3, 3))
    chains = [range(4), range(4, 10), range(10, 11), range(11, 16)]
    emit, place = rng.normal(size=(16, 3)), np.concatenate([np.arange(len(x)) for x in chains])
    got, both = model.marginals(emit, place, pairs=True)
    expected, expected_both = np.zeros((16, 3)), np.zeros((3, 3))
    for rows in map(list, chains):
        total, mine, pair = 0.0, np.zeros((16, 3)), np.zeros((3, 3))
        for path in product(range(3), repeat=len(rows)):
            p = np.exp(sum(emit[r, k] for r, k in zip(rows, path, strict=True)) + sum(model.moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += p
            for r, k in zip(rows, path, strict=True):
                mine[r, k] += p
            for a, b in zip(path, path[1:], strict=False):
                pair[a, b] += p
        expected += mine / total
        expected_both += pair / total
    assert np.allclose(got, expected) and np.allclose(both, expected_both)


def test_pieces_of_a_long_chain_give_what_one_chain_gives(monkeypatch):
    rng = np.random.default_rng(1)
    model = langid.Crf(["a", "b", "c", "d"])
    model.moves = rng.normal(size=(4, 4)) + 4 * np.eye(4)
    sizes = [1, 64, 65, 128, 3000, 7]
    emit, place = 3 * rng.normal(size=(sum(sizes), 4)), np.concatenate([np.arange(n) for n in sizes])
    in_pieces = model.marginals(emit, place, pairs=True)
    monkeypatch.setattr(langid, "PIECE", 10_000)
    whole = model.marginals(emit, place, pairs=True)
    assert np.allclose(in_pieces[0], whole[0]) and np.allclose(in_pieces[1], whole[1])


def test_training_sequences_change_between_texts():
    text = np.repeat(np.arange(40), 100)
    by = langid.spliced(text, np.random.default_rng(0))
    assert sorted(by.tolist()) == list(range(4000))
    changes = int((np.diff(text[by]) != 0).sum())
    assert 100 < changes < 400  # without splices: 39
    assert langid.spliced(np.zeros(3, np.int64), np.random.default_rng(0)).tolist() == [0, 1, 2]


def test_language_model_labels_switched_text():
    en, de = "the and of with house water " * 20, "der und von mit haus wasser schön " * 20
    model = langid.Crf(["de", "en"]).fit([en, de] * 4, ["en", "de"] * 4)
    assert [x[0] for x in model.predict([en, de, None, "", "123 !!", "—"])] == ["en", "de", "und", "und", "und", "und"]
    own, shares = model.label_words(["the water and the house und wasser von der schön"])[3:]
    assert shares.argmax(1).tolist() == [1] * 5 + [0] * 5
    assert all(0 <= s <= 1 for _, s, _ in model.predict([en, de, "x"]))
    assert [x[2] for x in model.predict(["the water and the house und wasser von der schön", None, en])] == [2, 0, 1]


def test_trees_learn_and_flat_traversal_agrees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    made = quality.grow(x[:2000], y[:2000])
    assert ((made.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95

    def walk(tree, row):
        at = made.roots[tree]
        while made.left[at] != at:
            at = made.left[at] if row[made.feature[at]] <= made.threshold[at] else made.right[at]
        return made.value[at]

    for row in x[:20]:
        assert np.isclose(made.base + sum(walk(t, row) for t in range(len(made.roots))), made.margin(row[None])[0])
    assert (quality.grow(x[:5], np.ones(5)).score(x) > 0.99).all()
    assert quality.statistics(None) == quality.statistics("") == [0.0] * len(quality.STATISTICS)


def test_sha_of_payload():
    assert hashlib.sha256(media.decode_png(media.encode_png(b"ab" + bytes(62)))).hexdigest() == hashlib.sha256(b"ab" + bytes(62)).hexdigest()
