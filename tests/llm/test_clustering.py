import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roamer.llm import clustering as cl

SCHEMA = "vec_id long, embedding array<double>, cluster int, distance string"


def brute(rows, start, rounds, dims):
    """Plain rounds with Python's integers; rows: (id, integers)."""
    dist = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    centroids = [list(c) for c in start]
    near = lambda x: min(range(len(centroids)), key=lambda c: (dist(x, centroids[c]), c))
    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, x in rows:
            groups[near(x)].append(x)
        centroids = [[sum(v[j] for v in g) // len(g) for j in range(dims)] if g else c for g, c in zip(groups, centroids)]
    out = [(i, near(x), dist(x, centroids[near(x)])) for i, x in rows]
    of = [sum(d for _, c, d in out if c == k) for k in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, of[c], sum(of), sha[c]) for i, c, d in out]


def starts(rows, k):
    known = sorted((hashlib.sha256(f"{cl.SEED}:{i}".encode()).hexdigest(), x) for i, x in rows if i is not None)
    return [x for _, x in known[:k]]


def run(spark, rows, k=4, rounds=6, dims=5, block=16):
    df = spark.createDataFrame([(i, x, 1, "z") for i, x in rows], SCHEMA)
    p = cl.lattice(df, "vec_id", "embedding", dims)
    return cl.cluster(p, cl.first_centroids(p, k), rounds, dims, block)


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9), st.integers(2, 5), st.floats(0, 5), st.floats(0.01, 20))
def test_loss_bounds_every_point_of_the_sphere(seed, d, radius, far):
    rng = np.random.default_rng(seed)
    old, move = rng.normal(size=d) * far, rng.normal(size=d) * rng.choice([0.01, 1, 10])
    on = rng.normal(size=(400, d))
    points = on / np.linalg.norm(on, axis=1, keepdims=True) * radius * rng.choice([1.0, 0.5], (400, 1))
    lost = np.linalg.norm(points - old, axis=1) - np.linalg.norm(points - (old - move), axis=1)
    bound = cl.loss(old, radius, move)
    assert lost.max() <= bound + 1e-9 * (1 + far) and bound <= np.linalg.norm(move) * (1 + 1e-8)


def test_loss_is_less_than_the_drift_and_can_raise_the_bound():
    centre, move = np.array([10.0, 0.0]), np.array([0.0, 1.0])
    assert cl.loss(centre, 1.0, move) < 0.11  # a move across the line of sight hardly counts
    assert cl.loss(centre, 1.0, np.array([-1.0, 0.0])) < -0.99  # a move away from the sphere
    assert cl.loss(centre, 1.0, np.array([1.0, 0.0])) == pytest.approx(1.0)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(5)] for _ in range(3)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(200, 260)] + [rows[5], rows[5], (7, rows[9][1]), (None, rows[1][1])]
    odd = [(900, None), (901, [1.0] * 4), (902, [1.0] * 6), (903, [None] * 5), (904, [math.nan] * 5), (905, [math.inf] * 5), (906, [])]
    whole = [(i, [math.floor(1024 * v) for v in x]) for i, x in rows]
    got = run(spark, rows + odd)
    want = brute(whole, starts(whole, 4), 6, 5)
    found = [tuple(r)[:6] for r in got.collect()]
    assert sorted(found, key=key) == sorted(want, key=key)
    assert 0 < got.first()["scanned_share"] < 1  # bounds do spare scans


def test_ties_empty_clusters_and_few_vectors(spark):
    same = [(i, [0.5] * 5) for i in range(6)]
    got = [tuple(r)[:3] for r in run(spark, same).collect()]
    assert sorted(got) == [(i, 0, 0) for i in range(6)]  # all centroids are equal: the smallest number wins
    got = run(spark, [(1, [0.0] * 5), (2, [1.0] * 5)]).collect()
    assert {r["distance"] for r in got} == {0} and len({r["cluster"] for r in got}) == 2


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1e-3, 1.0, 2e5]) * rng.uniform(-1, 1) for _ in range(5)]) for i in range(60)]
    whole = [(i, [math.floor(1024 * v) for v in x]) for i, x in rows]
    got = [tuple(r)[:6] for r in run(spark, rows).collect()]
    assert sorted(got) == sorted(brute(whole, starts(whole, 4), 6, 5))
    with pytest.raises(Exception, match="64-bit"):
        run(spark, [*rows, (99, [1e30] * 5)]).collect()


def test_empty_table(spark):
    got = run(spark, [])
    assert got.count() == 0 and got.columns[:6] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
