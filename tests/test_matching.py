"""Catalogue rows dealt over tasks, climate cells, and best matches in blocks, on rows of their own."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roamer.operators import catalog as cat
from roamer.operators import matching as mt
from roamer.sources import tables as tb


def test_one_small_file_is_worked_on_in_many_tasks(spark, tmp_path):
    rows = [(k, f"City {k % 7}", "ECONOMY", 1 + k % 50) for k in range(300)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(n, f"NATION_{n}", 0) for n in range(25)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0, "ASIA")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    raw = tb.catalog_raw(spark, str(tmp_path))
    per_task = raw.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per_task) == 300 and max(r["count"] for r in per_task) < 150


def test_last_of_equal_keys_counts_and_words_are_read(spark):
    cells = [('{"1": 3, "1": 5, "2": 7}', 6.0, 5.0), ('{"1": 3, "2": 7}', 5.0, 3.0), ('{"1": None, "2": 7}', 7.0, None), ("{'1': True}", 1.0, 1.0), (None, None, None), ("{}", None, None)]
    df = spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(cells)], "i int, c string")
    got = cat.parse_climate(df, "c", ["i"]).orderBy("i").collect()
    assert [(r["avg_temp_c"], r["temp_month_1"]) for r in got] == [(m, x) for _, m, x in cells]


def _tables(spark, n_items=41, n_profiles=23):
    rng = random.Random(5)
    value = lambda: rng.choice([None, 0.0, *[float(rng.randint(0, 10))] * 8])
    items = [(f"c{i:02d}", rng.choice(["x", "y"]), rng.choice(["A", "B"]), *[rng.uniform(-60, 60) for _ in range(2)], *[value() for _ in mt.FEATURE_COLUMNS], *[value() for _ in mt.MONTH_COLUMNS])
             for i in range(n_items)]
    numbers = [*mt.FEATURE_COLUMNS, *mt.MONTH_COLUMNS]
    catalog = spark.createDataFrame(items, "city string, country string, region string, latitude double, longitude double, " + ", ".join(f"{c} double" for c in numbers))
    wants = list(mt.PROFILE_FEATURE.values())
    profiles = [(i if i else None, rng.choice(["A", mt.ANYWHERE, None]), rng.choice(["x", mt.ANYWHERE]), "2026-03-05", rng.choice(["2026-03-09", "2026-05-01"]), "USD",
                 rng.choice([tb.METHOD_WEIGHTED, tb.METHOD_COSINE, tb.METHOD_KNN]), *[value() for _ in wants]) for i in range(n_profiles)]
    p = spark.createDataFrame(profiles, "profile_id long, region string, country string, start_date string, end_date string, currency string, method string, " + ", ".join(f"{c} double" for c in wants))
    return p.withColumns({c: F.to_date(c) for c in ("start_date", "end_date")}), catalog


@pytest.mark.parametrize("sizes", [(2048, 4096, 128), (3, 7, 2)])
def test_best_matches_are_those_of_all_pairs(spark, monkeypatch, sizes):
    for name, size in zip(("PROFILES_PER_SALT", "ITEMS_PER_SHARD", "HELD"), sizes):
        monkeypatch.setattr(mt, name, size)
    p, catalog = _tables(spark)
    items = mt.dated_candidates(p, catalog).select(*mt.CTX_KEYS, *mt.ITEM_COLUMNS)
    prof, salts = mt.ranged_profiles(p, items)
    sides = {"weighted": (mt.weighted_pairs, prof, mt._weighted), "cosine": (mt.cosine_pairs, mt._cosine_profile(prof), mt._cosine_score),
             "knn": (mt.knn_pairs, mt._knn_profile(prof), mt._knn_score)}
    out = lambda df: sorted((str(r["profile_id"]), r["rank"], r["city"], str(r["match_score"])) for r in mt.top_n(df, 3).collect())
    for name, (best, left, score) in sides.items():
        kept = best(prof, items, salts, 3)
        pairs = score(left.drop("salts", "shards").join(items, mt.CTX_KEYS))
        assert out(kept) == out(pairs), name
        assert len(out(kept)) > 20
        if sizes[0] == 2048:  # one shard: no more than three pairs a profile
            assert kept.count() <= 3 * prof.count() < pairs.count()


def _block(method, n_users=60, n_items=3000, seed=2):
    """Profiles and items as a block of ``_best_pairs`` holds them, some of both with nulls, huge numbers or equal to others."""
    rng = np.random.default_rng(seed)
    items = {c: rng.integers(0, 11, n_items).astype(float) for c in mt.FEATURE_COLUMNS} | {"cost_per_day_usd": rng.uniform(40, 300, n_items)}
    users = {f"u_{c}": rng.integers(0, 11, n_users).astype(float) for c in mt.FEATURE_COLUMNS} | {"u_cost_per_day_usd": rng.uniform(0, 300, n_users)}
    users["u_cost_per_day_usd"][:2] = 0
    for c in mt.FEATURE_COLUMNS:
        items[c][:20] = items[c][20]
        items[c][40:45] = items[c].min() + (0 if method == "cosine" else 1e12)
        low, high = items[c][50:].min(), items[c][50:].max()
        if method == "cosine":
            low, high = np.minimum(low, users[f"u_{c}"]), np.maximum(high, users[f"u_{c}"])
            users[f"lo_{c}"] = low
        users[f"min_{c}"], users[f"rng_{c}"] = low + np.zeros(n_users), high - low + np.zeros(n_users)
        users[f"b_{c}"] = (users[f"u_{c}"] - low) / (high - low)
        if method == "cosine":
            users[f"b_{c}"][3] = 0
    users["b_norm"] = np.sqrt(sum(users[f"b_{c}"] ** 2 for c in mt.FEATURE_COLUMNS))
    nulls = lambda t, at: pa.table({c: pa.array(x, mask=np.isin(np.arange(len(x)), at)) for c, x in t.items()})
    return mt._Side(nulls(users, [5])), mt._Side(nulls(items, [30, 31])), n_users, n_items


@pytest.mark.parametrize("method", ["weighted", "cosine", "knn"])
@pytest.mark.parametrize("sizes", [(128, 1024, 1 << 19), (7, 64, 1 << 12), (50, 16, 1 << 12)])
def test_rough_scores_leave_out_most_pairs_but_none_of_the_best(monkeypatch, method, sizes):
    for name, size in zip(("HELD", "TILE", "PAIRS"), sizes):
        monkeypatch.setattr(mt, name, size)
    users, places, n_users, n_items = _block(method)
    scores, rough = getattr(mt, f"_{method}_scores"), getattr(mt, f"_{method}_rough")

    def best(pairs):
        out, seen = {}, 0
        for rows, cols in pairs:
            seen += len(rows)
            with np.errstate(all="ignore"):
                x, missing = scores(users.at(rows), places.at(cols))
            order = np.where(missing, np.inf, -np.where(np.isnan(x), np.inf, np.rint(x * 1e9) / 1e9))
            for u in np.unique(rows):
                mine = np.nonzero(rows == u)[0]
                assert u not in out and len(np.unique(cols[mine])) == len(mine)
                out[u] = [(order[i], cols[i]) for i in mine[np.lexsort((cols[mine], order[mine]))[:5]]]
        return out, seen

    with np.errstate(all="ignore"):
        got, seen = best(mt._candidates(rough(users, places), n_users, n_items, 5))
    want, every = best([(np.repeat(np.arange(n_users), n_items), np.tile(np.arange(n_items), n_users))])
    assert got == want and every == n_users * n_items
    assert seen < every / 8
