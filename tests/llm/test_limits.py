"""Long and repetitive input: memory and time stay in proportion to it."""

import random
import resource
import time
import tracemalloc

from unpaired.llm import decontaminate, media, token_counts, url_filter


def peak_mb(work):
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_repetitive_text_and_item_take_memory_in_proportion():
    def search():
        test = decontaminate.TestSet([("x", "a " * 20_000), ("y", "b a")])
        return decontaminate.search_shard([decontaminate.words_of("a " * 20_000), decontaminate.words_of("c b a")], test)

    found, mb = peak_mb(search)
    assert found[0][2] == (20_000, 0, "x") and found[0][0] == [(0, 20_000)]
    assert found[1] == ([(1, 3)], ["y"], (2, 1, "y"))
    assert mb < 200


def test_longest_matches_of_few_words_equal_brute_force():
    rng = random.Random(5)

    def brute(words, items, window):
        best = None
        for name, text in items:
            own = decontaminate.words_of(text)
            size = min(window, len(own))
            for i in range(len(words)):
                for j in range(len(own) - size + 1 if own else 0):
                    k = 0
                    while i + k < len(words) and j + k < len(own) and words[i + k] == own[j + k]:
                        k += 1
                    if k >= size:
                        best = min(best or (0, 0, ""), (-k, i, name)) if best else (-k, i, name)
        return best and (-best[0], best[1], best[2])

    for _ in range(150):
        pool = [f"w{i}" for i in range(rng.choice([1, 2, 3, 6]))]
        items = [(f"i{rng.randint(0, 5)}", " ".join(rng.choices(pool, k=rng.randint(0, 14)))) for _ in range(rng.randint(0, 5))]
        shard = [rng.choices([*pool, "zz"], k=rng.randint(0, 25)) for _ in range(rng.randint(1, 5))]
        shard = [[w.encode() for w in x] for x in shard]
        got = decontaminate.search_shard(shard, decontaminate.TestSet(items, 4))
        assert [x[2] for x in got] == [brute(x, items, 4) for x in shard]


def test_long_url(spark):
    host = "a." * 500_000
    urls = [(1, "http://" + host + "net/x"), (2, "http://" + host + "x/" + "y" * 1_000_000), (3, "http://net/" + "?" * 100), (4, "http://.net/"), (5, "http://xnet/")]
    rows = url_filter.page_verdicts(spark.createDataFrame(urls, "page_id long, url string")).drop("host", "path").collect()
    assert {r["page_id"]: r["rule"] for r in rows} == {1: "net/", 2: None, 3: "net/", 4: "net/", 5: None}


def test_url_columns_that_clash(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", "h", "p", "r", "v")], "page_id long, url string, host string, path string, rule string, verdict string")
    assert [tuple(r) for r in url_filter.page_verdicts(pages).collect()] == [(1, "a.net", "/", "net/", "block")]


def test_long_word_counts_as_its_pieces():
    pieces = [("ab", -1.0), ("a", -2.0), ("b", -2.5), (token_counts.SPACE, -3.0)]
    counter = token_counts.Counter(pieces)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert counter.text("ab" * 2_500_000)[:2] == (1, 2_500_001) and not counter.seen
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # KB
    long = counter.text("ab" * 5_000 + "x")
    short = token_counts.Counter(pieces).word(token_counts.SPACE + "abx")
    assert long[1] == 5_000 + short[0] - 1
    for i in range(1_000):
        counter.text("a" * 65 + "b" * i)
    assert all(len(w) <= token_counts.REMEMBERED_CHARS for w in counter.seen)


def test_nested_figures_take_time_in_proportion():
    page = "<figure><img src=a>" * 8_000 + "<figcaption>inner</figcaption>" + "</figure>" * 8_000
    began = time.process_time()
    items = media.parse_items(page)
    assert len(items) == 8_000 and items[-1]["caption"] == "inner" and items[0]["caption"] is None
    assert time.process_time() - began < 3
