"""Filters and statistics (Q1-Q3, Q6), score breakdown and ranks (R2, R8, R9), and small
presentation keys (P3, I5) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from roamer.functions.numeric import boundary
from roamer.operators import catalog as cat
from roamer.operators import matching as mt
from roamer.plans import matching_plans as mp
from roamer.plans.registry import register
from roamer.plans.sqlgen import r6
from roamer.sources import tables as tb

CTES = dict(mp.CTES)
CTES["scopes"] = "SELECT DISTINCT region AS scope_region, country AS scope_country FROM profiles"
CTES["scope_items"] = """
  SELECT s.scope_region, s.scope_country, b.city, b.country, b.region FROM scopes s JOIN built b
    ON (s.scope_region = 'anywhere' OR s.scope_region = b.region)
   AND (s.scope_country = 'anywhere' OR s.scope_country = b.country)"""
TOP = 10
CTES["ranked_ten"] = mp.ranked_cte(mp.DISPATCH).replace("rank <= 5", f"rank <= {TOP}")


def reg(key, oracle=None):
    return register(key, oracle, CTES)


def _scope_items(spark, sf):
    """Q3: every distinct scope of the profiles with the items that its wildcards allow."""
    scopes = tb.profiles(spark, sf).select(F.col("region").alias("scope_region"), F.col("country").alias("scope_country")).distinct()
    items = mp.catalog(spark, sf).select("city", "country", "region")
    return mt.scope_keys(items).join(scopes, ["scope_region", "scope_country"])


@reg("filter_region", """
SELECT s.scope_region, b.city, b.country FROM (SELECT DISTINCT scope_region FROM scopes) s
JOIN built b ON s.scope_region = 'anywhere' OR s.scope_region = b.region""")
def q_filter_region(spark, sf):
    wanted = tb.profiles(spark, sf).select(F.col("region").alias("scope_region")).distinct()
    items = mp.catalog(spark, sf).select("city", "country", F.explode(F.array(F.lit(mt.ANYWHERE), F.col("region"))).alias("scope_region"))
    return items.join(wanted, "scope_region").select("scope_region", "city", "country")


@reg("filter_country", "SELECT scope_region, scope_country, city, country FROM scope_items WHERE scope_country <> 'anywhere'")
def q_filter_country(spark, sf):
    return _scope_items(spark, sf).where(F.col("scope_country") != mt.ANYWHERE).select("scope_region", "scope_country", "city", "country")


@reg("scoped_candidates", """
SELECT p.profile_id, s.n AS n_candidates, s.digest FROM profiles p
JOIN (SELECT scope_region, scope_country, count(*) AS n, bit_xor(('0x' || substr(md5(city || '|' || country), 1, 15))::BIGINT) AS digest FROM scope_items GROUP BY ALL) s
  ON s.scope_region = p.region AND s.scope_country = p.country""")
def q_scoped_candidates(spark, sf):
    """Per profile, its candidates: their number, and a digest of them all whatever their order; found once a scope."""
    one = F.conv(F.substring(F.md5(F.concat_ws("|", "city", "country")), 1, 15), 16, 10).cast("long")
    sets = _scope_items(spark, sf).groupBy("scope_region", "scope_country").agg(F.count(F.lit(1)).alias("n_candidates"), F.bit_xor(one).alias("digest"))
    p = tb.profiles(spark, sf).select("profile_id", F.col("region").alias("scope_region"), F.col("country").alias("scope_country"))
    return p.join(sets, ["scope_region", "scope_country"]).select("profile_id", "n_candidates", "digest")


@reg("catalog_stats", """
SELECT s.scope_region, s.scope_country, count(*) AS n_items, count(DISTINCT s.country) AS n_countries,
       max(t.n) AS n_catalog, max(t.c) AS n_catalog_countries
FROM scope_items s CROSS JOIN (SELECT count(*) AS n, count(DISTINCT country) AS c FROM built) t GROUP BY s.scope_region, s.scope_country""")
def q_catalog_stats(spark, sf):
    whole = mp.catalog(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("country").alias("c")).select(F.struct("n", "c")).scalar()
    per = _scope_items(spark, sf).groupBy("scope_region", "scope_country").agg(
        F.count(F.lit(1)).alias("n_items"), F.countDistinct("country").alias("n_countries"))
    return per.withColumn("t", whole).select("scope_region", "scope_country", "n_items", "n_countries",
                                             F.col("t.n").alias("n_catalog"), F.col("t.c").alias("n_catalog_countries"))


_FITS = {"budget_fit": mp._BUDGET_FIT, "temp_fit": mp._TEMP_FIT, "interest_fit": mp._INTEREST_FIT, "safety_fit": mp._SAFETY_FIT, "popularity_fit": mp._POP_FIT}


@reg("score_breakdown", "SELECT profile_id, rank, city, country, " + ", ".join(f"{r6(x)} AS {k}" for k, x in _FITS.items()) + " FROM ranked_weighted")
def q_score_breakdown(spark, sf):
    """R2: the five fits of each profile's best by weighted score."""
    p = mp.profiles(spark, sf)
    items = mt.dated_candidates(p, mp.catalog(spark, sf)).select(*mt.CTX_KEYS, *mt.ITEM_COLUMNS)
    prof, salts = mt.ranged_profiles(p, items)
    best = mt.top_n(mt.weighted_pairs(prof, items, salts, mt.TOP))
    return best.select("profile_id", "rank", "city", "country", *[boundary(k).alias(k) for k in _FITS])


@reg("top_n", f"SELECT profile_id, rank, city, country, {r6('match_score')} AS match_score FROM ranked_ten")
def q_top_n(spark, sf):
    """R8 with another n."""
    return mp._rank_out(mp.ranked(spark, sf, n=TOP))


@reg("best_match", f"""
SELECT profile_id, city, country, {r6('match_score')} AS match_score, cost_per_day_usd, {r6('avg_temp_c')} AS avg_temp_c, travel_season
FROM ranked_dispatch WHERE rank = 1""")
def q_best_match(spark, sf):
    best = mp.ranked(spark, sf, n=1)
    return best.select("profile_id", "city", "country", boundary("match_score").alias("match_score"), "cost_per_day_usd",
                       boundary("avg_temp_c").alias("avg_temp_c"), "travel_season")


@reg("map_points", f"SELECT profile_id, rank, {r6('latitude')} AS lat, {r6('longitude')} AS lon FROM ranked_dispatch")
def q_map_points(spark, sf):
    return mp.ranked(spark, sf).select("profile_id", "rank", boundary("latitude").alias("lat"), boundary("longitude").alias("lon"))


_SUMMARY = ["budget_per_day_usd", "preferred_temp_c", *cat.INTEREST_COLUMNS, "safety", "popularity"]


@reg("preference_summary", "SELECT profile_id, concat_ws(', ', " + ", ".join(f"'{c}=' || {c}::VARCHAR" for c in _SUMMARY) + ") AS summary FROM profiles")
def q_preference_summary(spark, sf):
    parts = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in _SUMMARY]
    return tb.profiles(spark, sf).select("profile_id", F.concat_ws(", ", *parts).alias("summary"))
