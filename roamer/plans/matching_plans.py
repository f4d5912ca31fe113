"""Trip dating (D), filters/facets (Q) and scoring (R) keys with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from roamer.functions import dates as D
from roamer.functions.numeric import boundary
from roamer.operators import catalog as cat
from roamer.operators import matching as mt
from roamer.plans import catalog_plans as cp
from roamer.plans.registry import register
from roamer.plans.sqlgen import heven, r6
from roamer.sources import tables as tb
from roamer.sources.tables import METHOD_COSINE, METHOD_KNN, METHOD_WEIGHTED

INTERESTS = cat.INTEREST_COLUMNS
FEATURES = cat.FEATURE_COLUMNS
PFEAT = mt.PROFILE_FEATURE

# ------------------------------------------------------------------ Spark side cache


def _state(spark, sf):
    """The files that the catalogue is built from, with their sizes and times of change."""
    rows = []
    for name in ("part", "nation", "region"):
        meta = tb.read_table(spark, sf, name).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        rows += [tuple(r) for r in meta.collect()]
    return tuple(sorted(rows))


def catalog(spark, sf):
    """The built catalogue, kept for the session as long as its files stay as they are."""
    cache = getattr(spark, "_roamer_cache", None)
    if cache is None:
        cache = {}
        spark._roamer_cache = cache
    key = ("built", sf, _state(spark, sf))
    if key not in cache:
        cache[key] = cp.built_catalog(spark, sf).checkpoint(eager=True)
    return cache[key]


def profiles(spark, sf, method=None):
    p = tb.profiles(spark, sf)
    return p.withColumn("method", F.lit(method)) if method else p


def ranked(spark, sf, method=None, n=5):
    methods = {None: None, METHOD_COSINE: (METHOD_COSINE,), METHOD_KNN: (METHOD_KNN,)}.get(method, ("weighted",))
    return mt.recommend(profiles(spark, sf, method), catalog(spark, sf), n, methods)


# ------------------------------------------------------------------ DuckDB side

_MONTH_LIST = "[" + ", ".join(f"b.temp_month_{m}" for m in range(1, 13)) + "]"


def _mult_sql(lat: str) -> str:
    return (f"CASE WHEN abs({lat}) < 15 THEN CASE WHEN m IN (12, 1, 2, 3) THEN 1.08::DOUBLE ELSE 1.0::DOUBLE END "
            f"WHEN {lat} >= 0 THEN CASE WHEN m IN (6, 7, 8) THEN 1.18::DOUBLE WHEN m IN (12, 1, 2) THEN 0.92::DOUBLE ELSE 1.05::DOUBLE END "
            f"ELSE CASE WHEN m IN (12, 1, 2) THEN 1.18::DOUBLE WHEN m IN (6, 7, 8) THEN 0.92::DOUBLE ELSE 1.05::DOUBLE END END")


_REP = "months[len(months) // 2 + 1]"
_NORTH = (f"CASE WHEN {_REP} IN (12, 1, 2) THEN 'Winter' WHEN {_REP} IN (3, 4, 5) THEN 'Spring' "
          f"WHEN {_REP} IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END")
_SOUTH = (f"CASE WHEN {_REP} IN (12, 1, 2) THEN 'Summer' WHEN {_REP} IN (3, 4, 5) THEN 'Autumn' "
          f"WHEN {_REP} IN (6, 7, 8) THEN 'Winter' ELSE 'Spring' END")
_SEASON = (f"CASE WHEN len(months) = 0 THEN NULL WHEN abs(b.latitude) < 15 THEN 'Tropical season' "
           f"WHEN b.latitude >= 0 THEN {_NORTH} ELSE {_SOUTH} END")

CTES = dict(cp.CTES)
CTES["pmonths"] = """
  SELECT p.*, date_trunc('month', start_date)::DATE AS m_start, date_trunc('month', end_date)::DATE AS m_end,
         CASE WHEN date_trunc('month', end_date) >= date_trunc('month', start_date)
              THEN list_transform(generate_series(date_trunc('month', start_date), date_trunc('month', end_date),
                                                  INTERVAL 1 MONTH), lambda d: month(d)::INTEGER)
              ELSE []::INTEGER[] END AS months
  FROM profiles p
"""
CTES["ctx"] = "SELECT DISTINCT m_start, m_end, region AS scope_region, country AS scope_country, months FROM pmonths"
_DATED_COLS = f"""
  b.city, b.country, b.region, b.latitude, b.longitude,
  b.avg_temp_c AS annual_avg_temp_c,
  coalesce(list_avg(list_filter(list_transform(months, lambda m: {_MONTH_LIST}[m]), lambda x: x IS NOT NULL)),
           b.avg_temp_c) AS avg_temp_c,
  b.cost_per_day_usd AS base_cost_per_day_usd,
  CASE WHEN len(months) > 0 THEN list_reduce(list_prepend(0.0::DOUBLE, list_transform(months, lambda m: {_mult_sql('b.latitude')})), lambda x, y: x + y) / len(months) END
    AS seasonal_multiplier,
  {_SEASON} AS travel_season,
  {", ".join(f"b.{c}" for c in cat.RATING_COLUMNS)}"""
CTES["ctx_items"] = f"""
  SELECT c.m_start, c.m_end, c.scope_region, c.scope_country, c.months, {_DATED_COLS}
  FROM ctx c JOIN built b
    ON (c.scope_region = 'anywhere' OR c.scope_region = b.region)
   AND (c.scope_country = 'anywhere' OR c.scope_country = b.country)
"""
CTES["ctx_dated"] = f"""
  SELECT * EXCLUDE (months), {heven('base_cost_per_day_usd * seasonal_multiplier')} AS cost_per_day_usd FROM ctx_items
"""
CTES["ctx_rng"] = ("SELECT m_start, m_end, scope_region, scope_country, count(*) AS n_candidates, "
                   + ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in FEATURES)
                   + " FROM ctx_dated GROUP BY ALL")
_P_COLS = ", ".join(f"p.{c} AS p_{c}" for c in ["budget_per_day_usd", "preferred_temp_c", *INTERESTS,
                                                "safety", "popularity"])
CTES["pairs"] = f"""
  SELECT p.profile_id, p.method, p.currency, p.start_date, p.end_date, {_P_COLS}, d.*, r.* EXCLUDE (m_start, m_end, scope_region, scope_country)
  FROM pmonths p
  JOIN ctx_dated d ON d.m_start = p.m_start AND d.m_end = p.m_end AND d.scope_region = p.region AND d.scope_country = p.country
  JOIN ctx_rng r ON r.m_start = p.m_start AND r.m_end = p.m_end AND r.scope_region = p.region AND r.scope_country = p.country
"""


def _fit(expr: str) -> str:
    return f"CASE WHEN ({expr}) IS NULL THEN NULL ELSE least(greatest({expr}, 0.0), 1.0) END"


_BUDGET_FIT = _fit("1 - abs(cost_per_day_usd - p_budget_per_day_usd) / nullif(p_budget_per_day_usd, 0)")
_TEMP_FIT = _fit("1 - abs(avg_temp_c - p_preferred_temp_c) / 30.0")
_INTEREST_FIT = _fit("(" + " + ".join(f"(1 - abs({c} - p_{c}) / 10.0)" for c in INTERESTS) + ") / 7.0")
_SAFETY_FIT = _fit("1 - abs(safety - p_safety) / 10.0")
_POP_FIT = _fit("1 - abs(popularity - p_popularity) / 10.0")
WEIGHTED = (f"(0.3 * ({_BUDGET_FIT}) + 0.15 * ({_TEMP_FIT}) + 0.35 * ({_INTEREST_FIT}) "
            f"+ 0.1 * ({_SAFETY_FIT}) + 0.1 * ({_POP_FIT}))")


def _pv(c: str) -> str:
    return f"CAST(p_{PFEAT[c]} AS DOUBLE)"


def _cos_terms():
    a, b = [], []
    for c in FEATURES:
        lo = f"least(min_{c}, {_pv(c)})"
        hi = f"greatest(max_{c}, {_pv(c)})"
        a.append(f"(CASE WHEN {hi} - {lo} = 0 THEN 0.0 ELSE ({c} - {lo}) / ({hi} - {lo}) END)")
        b.append(f"(CASE WHEN {hi} - {lo} = 0 THEN 0.0 ELSE ({_pv(c)} - {lo}) / ({hi} - {lo}) END)")
    return a, b


_A, _B = _cos_terms()
COSINE = (f"coalesce(({' + '.join(f'{x} * {y}' for x, y in zip(_A, _B))}) / "
          f"nullif(sqrt({' + '.join(f'{x} * {x}' for x in _A)}) * sqrt({' + '.join(f'{y} * {y}' for y in _B)}), 0), 0.0)")


def _knn_term(c):
    div = f"(CASE WHEN max_{c} - min_{c} = 0 THEN 1.0 ELSE max_{c} - min_{c} END)"
    d = f"(({c} - min_{c}) / {div} - ({_pv(c)} - min_{c}) / {div})"
    return f"{d} * {d}"


KNN = f"1.0 / (1.0 + sqrt({' + '.join(_knn_term(c) for c in FEATURES)}))"
DISPATCH = (f"CASE method WHEN '{METHOD_COSINE}' THEN {COSINE} WHEN '{METHOD_KNN}' THEN {KNN} "
            f"ELSE {WEIGHTED} END")


def ranked_cte(score: str) -> str:
    return f"""
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY profile_id
              ORDER BY round_even(match_score * 1000000000.0, 0) / 1000000000.0 DESC, city, country) AS rank
    FROM (SELECT *, {score} AS match_score FROM pairs) s) t
  WHERE rank <= 5
"""


CTES["ranked_dispatch"] = ranked_cte(DISPATCH)
CTES["ranked_weighted"] = ranked_cte(WEIGHTED)
CTES["ranked_cosine"] = ranked_cte(COSINE)
CTES["ranked_knn"] = ranked_cte(KNN)


def reg(key, oracle=None):
    return register(key, oracle, CTES)


def _rank_out(df):
    return df.select("profile_id", "rank", "city", "country", boundary("match_score").alias("match_score"))


RANK_SQL = "SELECT profile_id, rank, city, country, {s} AS match_score FROM {t}"

# ------------------------------------------------------------------ D keys


@reg("trip_months", "SELECT profile_id, array_to_string(months, ',') AS months, len(months) AS n_months FROM pmonths")
def q_trip_months(spark, sf):
    p = tb.profiles(spark, sf)
    m = D.trip_months("start_date", "end_date")
    return p.select("profile_id", F.array_join(m, ",").alias("months"), F.size(m).alias("n_months"))


_CTX_OUT = ("strftime(m_start, '%Y-%m') AS m_start, strftime(m_end, '%Y-%m') AS m_end, "
            "scope_region, scope_country, city, country")


def _ctx_out():
    return [F.date_format("m_start", "yyyy-MM").alias("m_start"), F.date_format("m_end", "yyyy-MM").alias("m_end"),
            "scope_region", "scope_country", "city", "country"]


@reg("trip_climate", f"SELECT {_CTX_OUT}, {r6('annual_avg_temp_c')} AS annual_avg_temp_c, {r6('avg_temp_c')} AS avg_temp_c FROM ctx_dated")
def q_trip_climate(spark, sf):
    d = mt.dated_candidates(profiles(spark, sf), catalog(spark, sf))
    return d.select(*_ctx_out(), boundary("annual_avg_temp_c").alias("annual_avg_temp_c"),
                    boundary("avg_temp_c").alias("avg_temp_c"))


@reg("season_name", f"SELECT {_CTX_OUT}, travel_season FROM ctx_dated")
def q_season_name(spark, sf):
    d = mt.dated_candidates(profiles(spark, sf), catalog(spark, sf))
    return d.select(*_ctx_out(), "travel_season")


@reg("seasonal_multiplier", f"SELECT {_CTX_OUT}, {r6('seasonal_multiplier')} AS seasonal_multiplier FROM ctx_dated")
def q_seasonal_multiplier(spark, sf):
    d = mt.dated_candidates(profiles(spark, sf), catalog(spark, sf))
    return d.select(*_ctx_out(), boundary("seasonal_multiplier").alias("seasonal_multiplier"))


@reg("seasonal_cost", f"SELECT {_CTX_OUT}, base_cost_per_day_usd, cost_per_day_usd FROM ctx_dated")
def q_seasonal_cost(spark, sf):
    d = mt.dated_candidates(profiles(spark, sf), catalog(spark, sf))
    return d.select(*_ctx_out(), "base_cost_per_day_usd", "cost_per_day_usd")


_DATED_OUT = ["annual_avg_temp_c", "avg_temp_c", "base_cost_per_day_usd", "cost_per_day_usd",
              "seasonal_multiplier"]


@reg("apply_travel_dates", f"""SELECT {_CTX_OUT}, travel_season, {", ".join(f"{r6(c)} AS {c}" for c in _DATED_OUT)}
FROM ctx_dated""")
def q_apply_travel_dates(spark, sf):
    d = mt.dated_candidates(profiles(spark, sf), catalog(spark, sf))
    return d.select(*_ctx_out(), "travel_season",
                    *[boundary(c).alias(c) for c in _DATED_OUT])


@reg("trip_length_cost", f"""
SELECT profile_id, CAST(end_date - start_date + 1 AS INTEGER) AS days, cost_per_day_usd,
       cost_per_day_usd * (end_date - start_date + 1) AS trip_cost_usd
FROM ranked_dispatch WHERE rank = 1""")
def q_trip_length_cost(spark, sf):
    best = ranked(spark, sf).where(F.col("rank") == 1)
    days = (F.datediff("end_date", "start_date") + 1).cast("int")
    return best.select("profile_id", days.alias("days"), "cost_per_day_usd",
                       (F.col("cost_per_day_usd") * days).alias("trip_cost_usd"))


@reg("period_label", """
SELECT profile_id,
  CASE WHEN year(start_date) = year(end_date) AND month(start_date) = month(end_date)
         THEN strftime(start_date, '%B ') || day(start_date) || '-' || day(end_date) || ', ' || year(start_date)
       WHEN year(start_date) = year(end_date)
         THEN strftime(start_date, '%B ') || day(start_date) || ' - ' || strftime(end_date, '%B ') || day(end_date) || ', ' || year(start_date)
       ELSE strftime(start_date, '%B %d, %Y') || ' - ' || strftime(end_date, '%B %d, %Y') END AS period
FROM profiles""")
def q_period_label(spark, sf):
    p = tb.profiles(spark, sf)
    return p.select("profile_id", D.period_label("start_date", "end_date").alias("period"))


# ------------------------------------------------------------------ R keys


@reg("match_by_method", RANK_SQL.format(s=r6("match_score"), t="ranked_dispatch"))
def q_match_by_method(spark, sf):
    return _rank_out(ranked(spark, sf))


@reg("weighted_score", RANK_SQL.format(s=r6("match_score"), t="ranked_weighted"))
def q_weighted_score(spark, sf):
    return _rank_out(ranked(spark, sf, METHOD_WEIGHTED))


@reg("cosine_match", RANK_SQL.format(s=r6("match_score"), t="ranked_cosine"))
def q_cosine_match(spark, sf):
    return _rank_out(ranked(spark, sf, METHOD_COSINE))


@reg("knn_match", RANK_SQL.format(s=r6("match_score"), t="ranked_knn"))
def q_knn_match(spark, sf):
    return _rank_out(ranked(spark, sf, METHOD_KNN))
