import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roamer.llm import neardup as nd


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 70), st.integers(2, 12))
def test_bounds_hold_for_every_pair(seed, d, n):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * rng.choice([1e-200, 1e-3, 1, 1e200], (n, 1))
    u, q, scale, eps = nd.quantise(x)
    about = nd.products(q, q) * scale[:, None] * scale[None, :]
    error = eps[:, None] + (1 + eps[:, None]) * eps[None, :] + 1e-12
    assert (np.abs(u @ u.T - about) <= error).all()


def test_products_are_exact_beyond_a_float():
    rng = np.random.default_rng(1)
    a = rng.integers(-127, 128, (3, 3000)).astype(np.int8)
    a[0] = 127
    assert (nd.products(a, a) == a.astype(np.int64) @ a.astype(np.int64).T).all()


def brute(rows, threshold=nd.THRESHOLD):
    ok = [x is not None and len(x) > 0 and all(v is not None and math.isfinite(v) for v in x) and any(x) for _, x in rows]

    def linked(a, b):
        x, y = rows[a][1], rows[b][1]
        if not (ok[a] and ok[b]) or len(x) != len(y):
            return False
        cos = sum(v * w for v, w in zip(x, y)) / math.sqrt(sum(v * v for v in x)) / math.sqrt(sum(v * v for v in y))
        return a != b and (list(x) == list(y) or cos >= threshold)

    n = len(rows)
    near = [[b for b in range(n) if linked(a, b)] for a in range(n)]
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        known = [rows[b][0] for b in seen if rows[b][0] is not None]
        least = min(known) if known else None
        out.append((rows[a][0], len(near[a]), least, rows[a][0] == least))
    return out


@pytest.mark.parametrize("tile", [7, 40, 1000])
def test_against_brute_force(spark, tile):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(40)]
    rows = [(i, [v + rng.gauss(0, 0.35) for v in rng.choice(centres[:6] if i % 3 else centres)]) for i in range(180)]
    rows += [(300 + i, rows[4][1]) for i in range(30)] + [(4, rows[4][1]), (8, rows[9][1]), (None, rows[11][1])]
    rows += [(500, None), (501, []), (502, [0.0] * 8), (503, [None] * 8), (504, [math.nan] * 8), (505, [math.inf] * 8), (506, [1.0, 2.0]), (507, [2.0, 4.0]),
             (508, [-0.0] * 7 + [1.0]), (509, [0.0] * 7 + [1.0]), (510, [0.0] * 7 + [-1.0]), (None, [9.0, -9.0])]
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id long, embedding array<double>, n_links int, node int")
    got = [tuple(r)[:4] for r in nd.near_duplicates(df, rows=tile).collect()]
    want = brute(rows)
    assert any(0 < n < 30 for _, n, _, _ in want)
    none = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(got, key=none) == sorted(want, key=none)


def test_only_pairs_near_the_threshold_are_worked_out():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 64))
    x[200:] = x[0] + rng.normal(size=(100, 64)) * 0.02
    u, q, scale, eps = nd.quantise(x)
    tile = nd.Tile({"dims": 64, "tile": 0, "nodes": bytes(16 * 300), "sizes": np.ones(300, "<i8").tobytes(), "q": q.tobytes(), "scale": scale.tobytes(), "eps": eps.tobytes(), "units": u.tobytes()})
    count, other, forest, full = nd.compare(tile, tile, True, 0.95, 64)
    assert full == 0 and (count + other)[200:].min() == 100 and (forest.label[200:] == 0).all()


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nd.near_duplicates(df).collect() == []
