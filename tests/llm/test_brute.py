"""Splitters against sorted prefix sums, and grown trees against trying every split."""

import random

import numpy as np
import pytest

from unpaired.llm import quality, sharding


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_splitters_equal_sorted_prefix_sums(spark, seed):
    rng = random.Random(seed)
    hot = rng.randint(-(1 << 63), (1 << 63) - 1)
    table = [(hot if rng.random() < 0.4 * (seed > 1) else rng.randint(-(1 << 63), (1 << 63) - 1), None if rng.random() < 0.02 else i, rng.choice([1, 30, 700])) for i in range(600)]
    bounds = sharding.splitters(spark.createDataFrame(table, "h long, id long, size long"), 8)
    assert len(bounds) == 7 and bounds == sorted(bounds, key=lambda b: (b[0], b[1] is not None, b[1] or 0))
    key = lambda h, i: (h, i is not None, i or 0)
    ordered = sorted(table, key=lambda r: key(*r[:2]))
    sums = np.cumsum([0, *(r[2] for r in ordered)])
    for k, (h, d) in enumerate(bounds, 1):
        below = sum(s for a, b, s in table if key(a, b) < (h, d is not None, d or 0))
        wanted = sums[-1] * k / 8
        nearest = min(abs(sums - wanted))
        assert below in sums and abs(below - wanted) <= max(sharding.TOLERANCE * sums[-1] / 8, nearest)


def test_trees_take_the_best_split_of_all():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, size=(400, 3)).astype(float)
    y = (rng.random(400) < 0.2 + 0.5 * (x[:, 1] > 6) * (x[:, 2] < 4)).astype(float)
    made = quality.grow(x, y, 1)
    p = np.full(400, y.mean())

    def sums(rows):
        return (p - y)[rows].sum(), (p * (1 - p))[rows].sum()

    def check(node, rows, depth):
        g, h = sums(rows)
        if made.left[node] == node:
            assert made.value[node] == pytest.approx(-quality.SHRINK * g / (h + quality.RIDGE))
        found = []
        for f in range(3):
            for t in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])):
                a, b = sums(rows & (x[:, f] <= t)), sums(rows & (x[:, f] > t))
                if min(a[1], b[1]) >= quality.LEAST_WEIGHT:
                    found.append(a[0] ** 2 / (a[1] + quality.RIDGE) + b[0] ** 2 / (b[1] + quality.RIDGE) - g**2 / (h + quality.RIDGE))
        best = max(found, default=0)
        if made.left[node] == node:
            assert depth == quality.DEPTH or best <= 1e-5
            return
        f, t = made.feature[node], made.threshold[node]
        a, b = sums(rows & (x[:, f] <= t)), sums(rows & (x[:, f] > t))
        own = a[0] ** 2 / (a[1] + quality.RIDGE) + b[0] ** 2 / (b[1] + quality.RIDGE) - g**2 / (h + quality.RIDGE)
        assert own == pytest.approx(best)
        check(made.left[node], rows & (x[:, f] <= t), depth + 1)
        check(made.right[node], rows & (x[:, f] > t), depth + 1)

    check(int(made.roots[0]), np.ones(400, bool), 0)
    at = made.margin(x)
    for i in range(0, 400, 37):
        node = int(made.roots[0])
        while made.left[node] != node:
            node = int(made.left[node] if x[i, made.feature[node]] <= made.threshold[node] else made.right[node])
        assert at[i] == pytest.approx(made.base + made.value[node])
