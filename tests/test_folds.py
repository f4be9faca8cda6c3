"""The sequential algorithms against brute force on small inputs."""

import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessaria.operators import folds


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 8), st.integers(1, 9)), max_size=8))
def test_schedule_is_heaviest(items):
    start, end, w = [a for a, _, _ in items], [a + n for a, n, _ in items], [x for _, _, x in items]
    best = 0
    for r in range(len(items) + 1):
        for c in itertools.combinations(range(len(items)), r):
            if all(end[i] <= start[j] or end[j] <= start[i] for i, j in itertools.combinations(c, 2)):
                best = max(best, sum(w[i] for i in c))
    got = folds.schedule(start, end, w)
    assert sum(w[i] for i in got) == best
    assert all(end[i] <= start[j] or end[j] <= start[i] for i, j in itertools.combinations(got, 2))


def test_assignment_is_optimal():
    rng = random.Random(4)
    for _ in range(40):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        w = np.array([[rng.choice([0, 0, 1, 2, 5, 7.5]) for _ in range(m)] for _ in range(n)])
        small, large, t = (n, m, w) if n <= m else (m, n, w.T)
        best = max(sum(t[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        got = folds.assign(w)
        assert abs(sum(w[i, j] for i, j in got) - best) < 1e-9
        assert len({i for i, _ in got}) == len(got) == len({j for _, j in got})


def test_align_monotone_keeps_order_and_total():
    rng = np.random.default_rng(1)
    for _ in range(30):
        s = rng.integers(0, 4, (rng.integers(1, 5), rng.integers(1, 5))).astype(float)
        best = 0.0
        n, m = s.shape
        for r in range(min(n, m) + 1):
            for a in itertools.combinations(range(n), r):
                for b in itertools.combinations(range(m), r):
                    if all(s[i, j] > 0 for i, j in zip(a, b)):
                        best = max(best, sum(s[i, j] for i, j in zip(a, b)))
        got = folds.align_monotone(s)
        assert got == sorted(got) and abs(sum(s[i, j] for i, j in got) - best) < 1e-9


def test_suppression_and_matching():
    boxes = [(0, 0, 10, 10), (1, 1, 9, 9), (20, 0, 30, 10)]
    assert folds.suppress(boxes, [0.9, 0.8, 0.5]) == [0, 2]
    assert folds.suppress(boxes, [0.8, 0.8, 0.5]) == [0, 2]  # ties keep the earlier place
    m = np.array([[0.9, 0.8], [0.85, 0.1]])
    assert folds.match_greedy(m, 0.5) == [(0, 0)]
    assert folds.iou((0, 0, 2, 2), (1, 1, 3, 3)) == 1 / 7


def test_small_searches():
    assert folds.placeable([{1, 2}, {1}, {2, 3}]) and not folds.placeable([{1}, {1}])
    assert folds.cluster_rows([0, 1, 50, 2], [10, 11, 60, 9]) == [0, 0, 1, 0]
    assert folds.cover_ranges([5, 1, 3, 9], 4) == [1, 5, 9]
    assert folds.diverse([{"a"}, {"a"}, {"b"}], [0, 0, 0], 2) == [0, 2]


def test_null_keys_are_one_group(spark):
    from tessaria.operators import folds

    rows = [(k, i, float(9 - i), 0.0, 0.0, 10.0, 1.0) for k in (None, "a") for i in range(4)]
    df = spark.createDataFrame(rows, "k string, id long, score double, x0 double, y0 double, x1 double, y1 double")
    assert sorted(folds.nms(df, ["k"], ["x0", "y0", "x1", "y1"], "score", "id").collect(), key=str) == [("a", 0), (None, 0)]
    numbers = df.withColumn("k", df["id"] * 0 + 7).unionByName(df.withColumn("k", df["id"].cast("string").try_cast("long") + None))
    assert folds.nms(numbers.withColumn("id", numbers["id"] + 1), ["k"], ["x0", "y0", "x1", "y1"], "score", "id").count() == 2


def test_medians_places_and_ranks(spark):
    import statistics

    from pyspark.sql import functions as F

    from tessaria.operators import aggregates, datasets

    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g in "abc" for v in rng.choice([0.0, 1.5, 2.25, -3.0, 1e6, 7.125], int(rng.integers(1, 60)))] + [("d", None), ("e", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.m for r in aggregates.medians(df, "g", "v", "m").collect()}
    assert got == {g: statistics.median([v for h, v in rows if h == g]) for g in "abce"}
    some = spark.range(500).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("k"))
    by = {}
    for r in datasets.round_robin(some, "g", ["k"]).collect():
        by.setdefault(r.g, []).append((r.k, r.turn))
    assert all([t for _, t in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values())
    numbered = aggregates.ranked(some.select("k"), "k", "n").collect()
    assert [r.n for r in sorted(numbered, key=lambda r: r.k)] == list(range(500))


def test_overlaps_of_short_and_very_long_intervals(spark):
    from tessaria.operators import joins

    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(0, 2)), i, float(a), float(a + n)) for i, (a, n) in enumerate(zip(rng.integers(-50, 500, 60), rng.choice([1, 2, 7, 30, 400, 100000], 60)))]
    df = spark.createDataFrame(rows, "p int, i long, a double, b double")
    other = df.selectExpr("p", "i as j", "a as c", "b as d")
    for margin in (0, 5):
        got = sorted((r.i, r.j) for r in joins.interval_overlap(df, other, ["p"], "a", "b", "c", "d", 4, margin).collect())
        assert got == sorted((x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[2] - margin < y[3] and y[2] < x[3] + margin)
    assert joins.interval_overlap(df.limit(0), other, ["p"], "a", "b", "c", "d", 4).count() == 0


@given(st.integers(1, 4), st.integers(1, 5), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_all_rows_are_placed_in_order(n, m, seed):
    score = np.random.default_rng(seed).integers(-5, 9, (n, m)).astype(float)
    got = folds.place_all(score)
    if n > m:
        assert got == []
    else:
        assert [i for i, _ in got] == list(range(n)) and all(a[1] < b[1] for a, b in zip(got, got[1:]))
        assert sum(score[p] for p in got) == max(sum(score[i, j] for i, j in enumerate(c)) for c in itertools.combinations(range(m), n))
