"""Trip contexts, scoped candidates, scoring (weighted / cosine / k-NN) and top-n.

The catalogue is dated once per month range; a profile's candidates follow from
its range and scope (a *context*). Feature ranges are joined to the profiles, so
profile-side scaling is done once a profile. Blocks of a context's profiles meet
shards of its items; rough scores, by matrix products where the method allows it,
leave out the pairs that cannot be among a profile's n best of a shard, the others
are scored by the full formula, and only those kept become rows. No table of all pairs
is sorted or shuffled, and the context of all wildcards fills every core. Each method
is a branch of its own; the pairs kept are scored by the method's columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from roamer.functions import dates as D
from roamer.functions.numeric import clip, half_even, safe_div
from roamer.operators.catalog import FEATURE_COLUMNS, INTEREST_COLUMNS, MONTH_COLUMNS
from roamer.sources.tables import METHOD_COSINE, METHOD_KNN, spread

ANYWHERE = "anywhere"
TOP = 5
CTX_KEYS = ["m_start", "m_end", "scope_region", "scope_country"]
# Profile value for each feature (the reference's user-vector order).
PROFILE_FEATURE = {
    "cost_per_day_usd": "budget_per_day_usd",
    "avg_temp_c": "preferred_temp_c",
    **{c: c for c in INTEREST_COLUMNS},
    "popularity": "popularity",
    "safety": "safety",
}
# Weighted-score weights.
W_BUDGET, W_TEMP, W_INTEREST, W_SAFETY, W_POPULARITY = 0.30, 0.15, 0.35, 0.10, 0.10


def with_trip(profiles: DataFrame) -> DataFrame:
    """Add the context key (month range and scope) to each profile."""
    return profiles.select(
        "*",
        F.trunc("start_date", "MM").alias("m_start"),
        F.trunc("end_date", "MM").alias("m_end"),
        F.col("region").alias("scope_region"),
        F.col("country").alias("scope_country"),
    )


def trip_contexts(profiles: DataFrame) -> DataFrame:
    """Distinct (month range, scope) contexts with their month list."""
    ctx = with_trip(profiles).select(*CTX_KEYS).distinct()
    return ctx.select("*", D.trip_months("m_start", "m_end").alias("months"))


def scope_keys(catalog: DataFrame) -> DataFrame:
    """Each item under the four scopes that admit it: (*,*), (r,*), (*,c), (r,c)."""
    any_ = F.lit(ANYWHERE)
    scopes = F.array(
        F.struct(any_.alias("r"), any_.alias("c")),
        F.struct(F.col("region").alias("r"), any_.alias("c")),
        F.struct(any_.alias("r"), F.col("country").alias("c")),
        F.struct(F.col("region").alias("r"), F.col("country").alias("c")),
    )
    return catalog.select("*", F.explode(scopes).alias("_s")).select(
        "*", F.col("_s.r").alias("scope_region"), F.col("_s.c").alias("scope_country")).drop("_s")


def month_ranges(profiles: DataFrame) -> Column:
    """All distinct (m_start, m_end, months) as one array: bounded by the calendar, not by the data."""
    ranges = with_trip(profiles).select("m_start", "m_end").distinct()
    listed = ranges.select(F.struct("m_start", "m_end", D.trip_months("m_start", "m_end").alias("months")).alias("r"))
    return listed.agg(F.collect_list("r")).scalar()


def dated_items(profiles: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every item once per month range, dated."""
    pairs = spread(catalog).select("*", F.explode(month_ranges(profiles)).alias("_r"))
    return date_candidates(pairs.select(*catalog.columns, "_r.m_start", "_r.m_end", "_r.months"))


def scoped_candidates(contexts: DataFrame, items: DataFrame) -> DataFrame:
    """Q1-Q3: the dated items each context's wildcards allow, as an equi-join on scope keys."""
    return contexts.select(*CTX_KEYS).join(scope_keys(items), CTX_KEYS)


def dated_candidates(profiles: DataFrame, catalog: DataFrame) -> DataFrame:
    """Dated context x item rows."""
    return scoped_candidates(trip_contexts(profiles), dated_items(profiles, catalog))


def date_candidates(pairs: DataFrame) -> DataFrame:
    """D2-D5 on context x item rows: trip temperature, season, multiplier, seasonal cost."""
    temps = F.array(*MONTH_COLUMNS)
    staged = pairs.select(
        "*",
        D.months_mean(temps, "months").alias("_trip_temp"),
        D.seasonal_multiplier("latitude", "months").alias("seasonal_multiplier"),
        D.season_name("latitude", "months").alias("travel_season"),
    )
    return staged.select(
        *[c for c in staged.columns if c not in ("avg_temp_c", "cost_per_day_usd", "_trip_temp")],
        F.col("avg_temp_c").alias("annual_avg_temp_c"),
        F.coalesce("_trip_temp", "avg_temp_c").alias("avg_temp_c"),
        F.col("cost_per_day_usd").alias("base_cost_per_day_usd"),
        half_even(F.col("cost_per_day_usd") * F.col("seasonal_multiplier")).alias("cost_per_day_usd"),
    )


def context_ranges(dated: DataFrame) -> DataFrame:
    """Per context: min and max of the 11 features over its candidates, and their count."""
    aggs = [F.count(F.lit(1)).alias("n_candidates")]
    for c in FEATURE_COLUMNS:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return dated.groupBy(*CTX_KEYS).agg(*aggs)


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def weighted_score_from_parts() -> Column:
    return (W_BUDGET * F.col("budget_fit") + W_TEMP * F.col("temp_fit")
            + W_INTEREST * F.col("interest_fit") + W_SAFETY * F.col("safety_fit")
            + W_POPULARITY * F.col("popularity_fit"))


#: Profiles and items of a context that meet in one block, at most about; rough scores of so many profiles and items are held at once.
PROFILES_PER_SALT, ITEMS_PER_SHARD, HELD, TILE = 16384, 32768, 128, 1024
#: Pairs scored by the full formula at once, at most about.
PAIRS = 1 << 19
ITEM_COLUMNS = ["city", "country", "region", "latitude", "longitude", "annual_avg_temp_c",
                "base_cost_per_day_usd", "seasonal_multiplier", "travel_season", *FEATURE_COLUMNS]
_U = {c: f"u_{c}" for c in FEATURE_COLUMNS}


def _best_pairs(profiles: DataFrame, items: DataFrame, salts: DataFrame, score, rough, n: int) -> DataFrame:
    """Of all profiles and their context's items, the pairs that are among a profile's n best of a shard of items.

    Blocks of profiles and shards of items meet by (context, salt, shard), dealt to a stated number of partitions. ``score``
    gives scores by the formulas of the columns (see ``_weighted_scores``); ``rough`` gives cheap ones with a bound of their
    error (see ``Rough``), by which most pairs are left out before. Only the pairs kept become rows: nothing sorts or
    shuffles all pairs.
    """
    spark = profiles.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    keys = [*CTX_KEYS, "salt", "shard"]
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = profiles.withColumn("salt", F.pmod(F.xxhash64("profile_id"), F.col("salts"))).withColumn("shard", upto("shards")).drop("salts", "shards")
    right = items.join(salts, CTX_KEYS).withColumn("shard", F.pmod(F.xxhash64("city", "country"), F.col("shards"))).withColumn("salt", upto("salts")).drop("salts", "shards")
    others = [f for f in right.schema if f.name not in keys]
    schema = StructType([f for f in left.schema if f.name not in ("salt", "shard")] + others)

    def best(asked: pa.Table, offered: pa.Table) -> pa.Table:
        place = lambda c: [(x is not None, (x or "").encode()) for x in offered[c].to_pylist()]
        names = list(zip(place("city"), place("country")))
        offered = offered.take(pa.array(sorted(range(len(names)), key=names.__getitem__), pa.int64()))
        users, places = _Side(asked), _Side(offered)
        picked = [np.empty((2, 0), np.int64)]
        take = min(n, len(offered))
        with np.errstate(all="ignore"):
            for rows, cols in _candidates(rough(users, places), len(asked), len(offered), take) if take and len(asked) else ():
                scores, missing = score(users.at(rows), places.at(cols))
                # Descending: NaN comes first and a missing score last; of equal scores the first name.
                order = np.where(missing, np.inf, -np.where(np.isnan(scores), np.inf, np.rint(scores * 1e9) / 1e9))
                by = np.lexsort((cols, order, rows))
                rows, cols = rows[by], cols[by]
                kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < take
                picked.append(np.stack([rows[kept], cols[kept]]))
        rows, cols = np.concatenate(picked, axis=1)
        found = asked.take(pa.array(rows)), offered.take(pa.array(cols))
        return pa.table({f.name: found[f.name in wide][f.name] for f in schema})

    wide = {f.name for f in others}
    meet = left.repartition(parts, *keys).groupBy(*keys).cogroup(right.repartition(parts, *keys).groupBy(*keys))
    return meet.applyInArrow(best, schema)


class _Side:
    """Columns of profiles or items as doubles, with their nulls; ``at`` takes rows of them."""

    def __init__(self, table: pa.Table, rows: np.ndarray | None = None, read: dict | None = None):
        self.table, self.rows, self.read = table, rows, {} if read is None else read

    def at(self, rows: np.ndarray) -> _Side:
        return _Side(self.table, rows, self.read)

    def column(self, c: str) -> tuple[np.ndarray, np.ndarray]:
        if c not in self.read:
            x = self.table[c].combine_chunks().cast(pa.float64())
            self.read[c] = x.fill_null(0.0).to_numpy(zero_copy_only=False), x.is_null().to_numpy(zero_copy_only=False)
        x, null = self.read[c]
        return (x, null) if self.rows is None else (x[self.rows], null[self.rows])

    def columns(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A column of the result for each name, and the rows where all are there and finite."""
        read = [self.column(c) for c in names]
        values = np.stack([x for x, _ in read], axis=1)
        return values, np.isfinite(values).all(axis=1) & ~np.any([null for _, null in read], axis=0)


class Rough:
    """Cheap costs of pairs; a lower cost is a better score.

    ``users`` and ``items`` tell which rows the costs hold for. ``costs(rows, lo, hi)`` gives those of some profiles and of the
    items ``cols[lo:hi]`` (minus infinity: not known), ``cutoff(rows, kth)`` the cost that no pair goes beyond whose score,
    rounded to 9 dp, is as good as that of a pair of cost ``kth``.
    """

    def __init__(self, users: np.ndarray, items: np.ndarray, costs, cutoff):
        self.users, self.cols, self.odd, self.costs, self.cutoff = users, np.nonzero(items)[0], np.nonzero(~items)[0], costs, cutoff


def _near(cheap: Rough, rows: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of some profiles and the items that rough costs hold for, that may be among a profile's ``take`` best."""
    best, hits, owners = np.full((len(rows), take), np.inf), [], np.repeat(np.arange(len(rows)), take)
    for lo in range(0, len(cheap.cols), TILE):
        costs = cheap.costs(rows, lo, min(lo + TILE, len(cheap.cols)))
        sure = lambda x: np.where(np.isneginf(x), np.inf, x)
        first = lo == 0 and costs.shape[1] > 8 * take
        if first:
            best = np.sort(np.partition(sure(costs), take - 1, axis=1)[:, :take], axis=1).astype(float)
        r, c = np.nonzero(costs <= cheap.cutoff(rows, best[:, -1]).astype(costs.dtype)[:, None])
        if len(r):
            hits.append((r, c + lo, costs[r, c]))
            if not first:
                owner, cost = np.concatenate([owners, r]), np.concatenate([best.ravel(), sure(hits[-1][2])])
                by = np.lexsort((cost, owner))
                best = cost[by][np.searchsorted(owner[by], np.arange(len(rows)))[:, None] + np.arange(take)]
    r, c, cost = (np.concatenate(x) for x in zip(*hits))
    near = cost <= cheap.cutoff(rows, best[:, -1])[r]
    return rows[r[near]], cheap.cols[c[near]]


def _candidates(cheap: Rough, n_users: int, n_items: int, take: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that hold each profile's ``take`` best, ``PAIRS`` or little more at a time, a profile's pairs together.

    Profiles and items that rough costs do not hold for meet all of the other side.
    """
    plain = cheap.users if len(cheap.cols) >= take else np.zeros(n_users, bool)
    step = max(1, PAIRS // n_items)
    whole, plain = np.nonzero(~plain)[0], np.nonzero(plain)[0]
    for lo in range(0, len(whole), step):
        rows = whole[lo:lo + step]
        yield np.repeat(rows, n_items), np.tile(np.arange(n_items), len(rows))
    step = max(1, min(HELD, PAIRS // max(1, len(cheap.odd))))
    for lo in range(0, len(plain), step):
        rows = plain[lo:lo + step]
        r, c = _near(cheap, rows, take)
        r, c = np.concatenate([r, np.repeat(rows, len(cheap.odd))]), np.concatenate([c, np.tile(cheap.odd, len(rows))])
        by = np.argsort(r, kind="stable")
        r, c = r[by], c[by]
        at = 0
        while at < len(r):
            end = np.searchsorted(r, r[min(at + PAIRS, len(r)) - 1], side="right")
            yield r[at:end], c[at:end]
            at = end


def _pair_sides(users: _Side, places: _Side):
    """Readers of both sides of pairs, and the nulls among what they have read."""
    missing = np.zeros(len(users.rows), bool)

    def reader(side: _Side):
        def read(c: str) -> np.ndarray:
            x, null = side.column(c)
            np.logical_or(missing, null, out=missing)
            return x
        return read

    return reader(users), reader(places), missing


def _weighted_scores(users: _Side, places: _Side) -> tuple[np.ndarray, np.ndarray]:
    """R1 of pairs: scores, and where they are missing; as ``_weighted``."""
    user, item, missing = _pair_sides(users, places)
    fit = lambda x: np.where(np.isnan(x), 1.0, np.minimum(np.maximum(x, 0.0), 1.0))
    near = lambda c, span: 1 - np.abs(item(c) - user(_U[c])) / span
    cost = user(_U["cost_per_day_usd"])
    np.logical_or(missing, cost == 0, out=missing)
    parts = [fit(1 - np.abs(item("cost_per_day_usd") - cost) / cost), fit(near("avg_temp_c", 30.0)),
             fit(_sum([near(c, 10.0) for c in INTEREST_COLUMNS]) / 7.0), fit(near("safety", 10.0)), fit(near("popularity", 10.0))]
    return _sum([w * x for w, x in zip((W_BUDGET, W_TEMP, W_INTEREST, W_SAFETY, W_POPULARITY), parts)]), missing


def _weighted_rough(users: _Side, places: _Side) -> Rough:
    """What a pair lacks of a full score, in single precision. The error follows from the sizes of the numbers."""
    x, items = places.columns(FEATURE_COLUMNS)
    u, plain = users.columns([_U[c] for c in FEATURE_COLUMNS])
    weight = {"cost_per_day_usd": W_BUDGET, "avg_temp_c": W_TEMP / 30.0, "safety": W_SAFETY / 10.0, "popularity": W_POPULARITY / 10.0}
    per = np.array([weight.get(c, W_INTEREST / 70.0) for c in FEATURE_COLUMNS])
    at, money = FEATURE_COLUMNS.index, FEATURE_COLUMNS.index("cost_per_day_usd")
    plain &= u[:, money] > 0
    items &= (np.abs(x) <= 1e5).all(axis=1)
    x = x[items]
    large = np.abs(x).max(axis=0, initial=0.0)
    scale = np.tile(per, (len(u), 1))
    scale[:, money] /= u[:, money]
    error = 1e-6 * (1.0 + (scale * (np.abs(u) + large)).sum(axis=1))
    plain &= error < 1e-3
    x, v, w = (np.ascontiguousarray(t.T.astype(np.float32)) for t in (x, u, scale))
    interests = [at(c) for c in INTEREST_COLUMNS]

    def costs(rows: np.ndarray, lo: int, hi: int) -> np.ndarray:
        total, gap = (np.zeros((len(rows), hi - lo), np.float32) for _ in range(2))
        away = lambda i: np.abs(np.subtract(x[i, None, lo:hi], v[i, rows, None], out=gap), out=gap)
        for i in interests:
            total += away(i)
        total *= np.float32(W_INTEREST / 70.0)
        np.minimum(total, np.float32(W_INTEREST), out=total)
        for c, top in (("cost_per_day_usd", W_BUDGET), ("avg_temp_c", W_TEMP), ("safety", W_SAFETY), ("popularity", W_POPULARITY)):
            away(at(c))
            np.multiply(gap, w[at(c), rows, None], out=gap)
            total += np.minimum(gap, np.float32(top), out=gap)
        return total

    return Rough(plain, items, costs, lambda rows, kth: kth + 2 * error[rows] + 1e-8)


def _cosine_scores(users: _Side, places: _Side) -> tuple[np.ndarray, np.ndarray]:
    """R4 of pairs; as ``_cosine_score``."""
    user, item, missing = _pair_sides(users, places)
    dot = norm = None
    for c in FEATURE_COLUMNS:
        rng, flat = users.column(f"rng_{c}")
        lo, _ = users.column(f"lo_{c}")
        x, null = places.column(c)
        a = np.where(flat, 0.0, (x - lo) / rng)
        np.logical_or(missing, ~flat & null, out=missing)
        b = user(f"b_{c}")
        dot, norm = (a * b, a * a) if dot is None else (dot + a * b, norm + a * a)
    length = np.sqrt(norm) * user("b_norm")
    return np.where(missing | (length == 0), 0.0, dot / length), np.zeros_like(missing)


def _cosine_rough(users: _Side, places: _Side) -> Rough:
    """Minus the squared cosine, by matrix products. All terms are 0 or more, so nothing cancels out.

    The cost of a pair with a very short item vector is not known.
    """
    x, items = places.columns(FEATURE_COLUMNS)
    b, plain = users.columns([f"b_{c}" for c in FEATURE_COLUMNS])
    lo, known = users.columns([f"lo_{c}" for c in FEATURE_COLUMNS])
    read = [users.column(f"rng_{c}") for c in FEATURE_COLUMNS]
    rng, flat = (np.stack([r[i] for r in read], axis=1) for i in range(2))
    x = x[items]
    least, large = x.min(axis=0, initial=np.inf), np.abs(x).max(axis=0, initial=0.0)
    least = np.where(np.isfinite(least), least, 0.0)
    down = least - lo
    part = np.where(flat, 0.0, 1.0 / np.where(flat, 1.0, rng))
    length = (b * b).sum(axis=1)
    plain &= known & np.isfinite(part).all(axis=1) & (flat | (rng > 0)).all(axis=1) & (flat | (down >= 0)).all(axis=1) & (b >= 0).all(axis=1)
    plain &= (length >= 1e-4) & (((np.abs(lo) + large) * part).max(axis=1, initial=0.0) <= 1e3)
    up = x - least
    lin, square = np.ascontiguousarray(up.T), np.ascontiguousarray(np.concatenate([up, up * up], axis=1).T)
    unit = b / np.sqrt(np.where(length > 0, length, 1.0))[:, None] * part
    sides, base = np.concatenate([2 * down * part * part, part * part], axis=1), (unit * down).sum(axis=1)
    start = (down * part * down * part).sum(axis=1)

    def costs(rows: np.ndarray, lo: int, hi: int) -> np.ndarray:
        dot, norm = unit[rows] @ lin[:, lo:hi], sides[rows] @ square[:, lo:hi]
        dot += base[rows, None]
        norm += start[rows, None]
        dot *= dot
        short = norm < 1e-4
        dot /= norm
        np.negative(dot, out=dot)
        if short.any():
            dot[short] = -np.inf
        return dot

    return Rough(plain, items, costs, lambda rows, kth: kth + 1e-7)


def _knn_scores(users: _Side, places: _Side) -> tuple[np.ndarray, np.ndarray]:
    """R6 of pairs; as ``_knn_score``."""
    user, item, missing = _pair_sides(users, places)
    far = None
    for c in FEATURE_COLUMNS:
        d = (item(c) - user(f"min_{c}")) / user(f"rng_{c}") - user(f"b_{c}")
        far = d * d if far is None else far + d * d
    return 1.0 / (1.0 + np.sqrt(far)), missing


def _knn_rough(users: _Side, places: _Side) -> Rough:
    """Squared distances by matrix products; a context's profiles share ``min`` and ``rng``."""
    x, items = places.columns(FEATURE_COLUMNS)
    b, plain = users.columns([f"b_{c}" for c in FEATURE_COLUMNS])
    scale, known = users.columns([f"{k}_{c}" for k in ("min", "rng") for c in FEATURE_COLUMNS])
    plain &= known & (scale == scale[0]).all(axis=1)
    low, rng = np.split(scale[0], 2)
    a = (x[items] - low) / rng
    length, size = (b * b).sum(axis=1), (a * a).sum(axis=1)
    plain &= length <= 1e6
    good = np.isfinite(size) & (size <= 1e6)
    items = items.copy()
    items[np.nonzero(items)[0][~good]] = False
    turned, size = np.ascontiguousarray(a[good].T), size[good]
    error = 1e-13 * (1.0 + length + size.max(initial=0.0))

    def costs(rows: np.ndarray, lo: int, hi: int) -> np.ndarray:
        far = (-2.0 * b[rows]) @ turned[:, lo:hi]
        far += size[lo:hi]
        far += length[rows, None]
        return far

    def cutoff(rows: np.ndarray, kth: np.ndarray) -> np.ndarray:
        s = np.sqrt(np.maximum(kth + error[rows], 0.0))
        return (s + 4e-9 * (1.0 + s) ** 2) ** 2 + 2 * error[rows]

    return Rough(plain, items, costs, cutoff)


def _weighted_fits() -> list[Column]:
    """R2: the five fits of a pair, each clipped to 0..1."""
    budget = 1 - safe_div(F.abs(F.col("cost_per_day_usd") - F.col("u_cost_per_day_usd")), F.col("u_cost_per_day_usd"))
    temp = 1 - F.abs(F.col("avg_temp_c") - F.col("u_avg_temp_c")) / 30.0
    interest = _sum([1 - F.abs(F.col(c) - F.col(_U[c])) / 10.0 for c in INTEREST_COLUMNS]) / 7.0
    safety = 1 - F.abs(F.col("safety") - F.col("u_safety")) / 10.0
    popularity = 1 - F.abs(F.col("popularity") - F.col("u_popularity")) / 10.0
    parts = {"budget_fit": budget, "temp_fit": temp, "interest_fit": interest, "safety_fit": safety, "popularity_fit": popularity}
    return [clip(x, 0, 1).alias(k) for k, x in parts.items()]


def _cosine_profile(p: DataFrame) -> DataFrame:
    """R3, profile side: per feature the range over candidates and profile, the scaled profile, its norm."""
    for c in FEATURE_COLUMNS:
        p = p.withColumns({f"lo_{c}": F.least(f"min_{c}", _U[c]), f"hi_{c}": F.greatest(f"max_{c}", _U[c])})
    p = p.withColumns({f"rng_{c}": F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0)) for c in FEATURE_COLUMNS})
    p = p.withColumns({f"b_{c}": F.when((F.col(f"hi_{c}") - F.col(f"lo_{c}")).isNotNull(), F.coalesce((F.col(_U[c]) - F.col(f"lo_{c}")) / F.col(f"rng_{c}"), F.lit(0.0)))
                       for c in FEATURE_COLUMNS})
    norm = F.sqrt(_sum([F.col(f"b_{c}") * F.col(f"b_{c}") for c in FEATURE_COLUMNS]))
    return p.withColumn("b_norm", norm).drop(*[f"{x}_{c}" for x in ("hi", "min", "max") for c in FEATURE_COLUMNS])


def _cosine_score(pairs: DataFrame) -> DataFrame:
    """Cosine of the scaled item and profile vectors; a zero vector gives 0."""
    a = {c: _scaled_by(F.col(c), F.col(f"lo_{c}"), F.col(f"rng_{c}")).alias(f"a_{c}") for c in FEATURE_COLUMNS}
    staged = pairs.select("*", *a.values())
    dot = _sum([F.col(f"a_{c}") * F.col(f"b_{c}") for c in FEATURE_COLUMNS])
    norm = F.sqrt(_sum([F.col(f"a_{c}") * F.col(f"a_{c}") for c in FEATURE_COLUMNS]))
    return staged.withColumn("match_score", F.coalesce(F.try_divide(dot, norm * F.col("b_norm")), F.lit(0.0)))


def _scaled_by(x: Column, lo: Column, rng: Column) -> Column:
    return F.when(rng.isNull(), F.lit(0.0)).otherwise((x - lo) / rng)


def _knn_profile(p: DataFrame) -> DataFrame:
    """R5, profile side: per feature the candidates' range (1 where it is empty) and the scaled profile."""
    rng = {f"rng_{c}": F.coalesce(F.nullif(F.col(f"max_{c}") - F.col(f"min_{c}"), F.lit(0.0)), F.lit(1.0)) for c in FEATURE_COLUMNS}
    p = p.withColumns(rng)
    scaled = {f"b_{c}": (F.col(_U[c]) - F.col(f"min_{c}")) / F.col(f"rng_{c}") for c in FEATURE_COLUMNS}
    return p.withColumns(scaled).drop(*[f"max_{c}" for c in FEATURE_COLUMNS])


def _knn_score(pairs: DataFrame) -> DataFrame:
    """1 / (1 + Euclidean distance)."""
    d = [((F.col(c) - F.col(f"min_{c}")) / F.col(f"rng_{c}") - F.col(f"b_{c}")).alias(f"d_{c}") for c in FEATURE_COLUMNS]
    staged = pairs.select("*", *d)
    far = F.sqrt(_sum([F.col(f"d_{c}") * F.col(f"d_{c}") for c in FEATURE_COLUMNS]))
    return staged.withColumn("match_score", 1.0 / (1.0 + far))


def _weighted(pairs: DataFrame) -> DataFrame:
    """Weighted sum of the five fits."""
    return pairs.select("*", *_weighted_fits()).withColumn("match_score", weighted_score_from_parts())


def ranged_profiles(profiles: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles with their own features (u_*), their context's ranges, salts and shards; and the contexts' salts and shards."""
    user = [F.col(p).cast("double").alias(_U[c]) for c, p in PROFILE_FEATURE.items()]
    prof = with_trip(profiles).select("profile_id", "method", "currency", "start_date", "end_date", *user, *CTX_KEYS)
    ranges = context_ranges(items)
    counts = prof.groupBy(*CTX_KEYS).agg(F.count(F.lit(1)).alias("n_profiles"))
    salts = ranges.join(counts, CTX_KEYS).select(*CTX_KEYS, (F.expr(f"n_profiles div {PROFILES_PER_SALT}") + 1).alias("salts"),
                                                        (F.expr(f"n_candidates div {ITEMS_PER_SHARD}") + 1).alias("shards"))
    return prof.join(ranges.drop("n_candidates"), CTX_KEYS).join(salts, CTX_KEYS), salts


def weighted_pairs(prof: DataFrame, items: DataFrame, salts: DataFrame, n: int) -> DataFrame:
    """Pairs that hold each profile's n best by weighted score, scored."""
    prof = prof.drop(*[f"{x}_{c}" for x in ("min", "max") for c in FEATURE_COLUMNS])
    return _weighted(_best_pairs(prof, items, salts, _weighted_scores, _weighted_rough, n))


def cosine_pairs(prof: DataFrame, items: DataFrame, salts: DataFrame, n: int) -> DataFrame:
    """Pairs that hold each profile's n best by cosine, scored."""
    return _cosine_score(_best_pairs(_cosine_profile(prof), items, salts, _cosine_scores, _cosine_rough, n))


def knn_pairs(prof: DataFrame, items: DataFrame, salts: DataFrame, n: int) -> DataFrame:
    """Pairs that hold each profile's n nearest, scored."""
    return _knn_score(_best_pairs(_knn_profile(prof), items, salts, _knn_scores, _knn_rough, n))


def score_best(profiles: DataFrame, catalog: DataFrame, n: int, methods: tuple[str, ...] | None = None) -> DataFrame:
    """Every profile against its candidates; pairs that hold its n best, with ``match_score`` by the profile's method."""
    items = dated_candidates(profiles, catalog).select(*CTX_KEYS, *ITEM_COLUMNS)
    prof, salts = ranged_profiles(profiles, items)
    m = F.col("method")
    branches = {"weighted": (~F.coalesce(m.isin(METHOD_COSINE, METHOD_KNN), F.lit(False)), weighted_pairs),
                METHOD_COSINE: (m == METHOD_COSINE, cosine_pairs), METHOD_KNN: (m == METHOD_KNN, knn_pairs)}
    out = ["profile_id", "method", "currency", "start_date", "end_date", *ITEM_COLUMNS, "match_score"]
    parts = [pairs(prof.where(which), items, salts, n).select(out) for k, (which, pairs) in branches.items() if methods is None or k in methods]
    return reduce(DataFrame.unionByName, parts)


def rank_order() -> list[Column]:
    """Total order: score (rounded to 9 dp so near-ties agree across engines), then key."""
    return [half_even(F.col("match_score"), 9).desc(), F.col("city").asc(), F.col("country").asc()]


def top_n(scored: DataFrame, n: int = TOP, key: str = "profile_id") -> DataFrame:
    """Best n per profile."""
    w = Window.partitionBy(key).orderBy(*rank_order())
    return scored.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= n)


def recommend(profiles: DataFrame, catalog: DataFrame, n: int = TOP, methods: tuple[str, ...] | None = None) -> DataFrame:
    return top_n(score_best(profiles, catalog, n, methods), n)
