import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from roamer.llm import topk


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 150), st.integers(1, 6), st.sampled_from([1, 3, 40, 10**5]), st.integers(1, 12))
def test_block_search_equals_full_sort(seed, n, d, scale, k):
    rng = np.random.default_rng(seed)
    x = rng.integers(-scale, scale + 1, (n, d))
    ids, asked = np.arange(n), rng.integers(0, n, 5)
    low = x.min(axis=0)
    u, shift = topk.leading(x - low, topk.SLICES)
    q, r, score = topk.search_block(ids, x, topk.bitmaps(u, topk.SLICES), shift, low, asked, x[asked], k, topk.SLICES)
    for i, a in enumerate(asked):
        s = x @ x[a]
        want = [j for j in np.lexsort((ids, -s)) if j != a][:k]
        assert r[q == i].tolist() == want and score[q == i].tolist() == s[want].tolist()


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 50)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(230)]
    rows += [(300, None), (301, []), (400, []), (302, [1.0, None] * 3), (303, [math.nan] * 6), (304, [math.inf] * 6), (None, [1.0] * 6), (500, [1e30] * 6),
             (100, rows[7][1]), (7, rows[7][1]), (8, rows[7][1]), (600, [1.0, 2.0]), (601, [3.0, 4.0])]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    v = topk.quantised(df, "vec_id", "embedding")
    got = sorted(tuple(r) for r in topk.top_k(v.filter("id % 100 = 0"), topk.build_index(v, 50), 10, 2).collect())
    data = [(r["vec_id"], [math.floor(1024 * x) for x in r["embedding"]]) for r in df.collect()
            if r["vec_id"] is not None and r["embedding"] is not None and all(x is not None and math.isfinite(x) and abs(x) < 1e6 for x in r["embedding"])]
    want = {}
    for i, x in {(i, tuple(x)) for i, x in data if i % 100 == 0}:
        want.setdefault(i, []).extend((-sum(a * b for a, b in zip(x, y)), j) for j, y in data if j != i and len(y) == len(x))
    flat = sorted((i, n + 1, j, -s) for i, found in want.items() for n, (s, j) in enumerate(sorted(found)[:10]))
    assert [r for r in got if r[0] != 100] == [r for r in flat if r[0] != 100]
    assert [r[1] for r in got if r[0] == 100] == list(range(1, 11))


def test_large_components_take_part(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([1.0, 300.0, 5e5]) * rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    rows += [(100, [1e-3, -2e-3, 0.0, 1e-3]), (61, [1e7, 1.0, 2.0, 3.0]), (62, [-1e7, 1.0, 2.0, 3.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    data = {i: [math.floor(1024 * x) for x in e] for i, e in rows}
    for k in (3, 80):
        got = sorted(tuple(r) for r in topk.top_k(v.filter("id in (0, 100)"), topk.build_index(v, 20), k, 2).collect())
        want = []
        for i in (0, 100):
            found = sorted((-sum(a * b for a, b in zip(data[i], y)), j) for j, y in data.items() if j != i)
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found[:k])]
        assert got == sorted(want)


def test_large_search_resolves_what_doubles_cannot():
    rows = np.array([[2**40 + 1, 1], [2**40, 2**20], [2**40 + 1, 0], [-(2**40), 0]], np.int64)
    asked = np.array([[2**21, 1]], np.int64)
    assert not topk.fits(rows * 4096, asked)
    q, r, score = topk.search_large(np.arange(4), rows * 4096, np.array([9]), asked, 3)
    exact = [sum(int(a) * int(b) for a, b in zip(row, asked[0])) for row in rows * 4096]
    assert r == sorted(range(4), key=lambda i: (-exact[i], i))[:3] and score == [exact[i] for i in r]


def test_empty_table(spark):
    v = topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert topk.top_k(v, topk.build_index(v)).count() == 0
