"""Stored preferences brought back to values that a search accepts.

Rules come in order, each reading what earlier ones settled: scope against the catalogue's facets, dates against
``today``, the currency against the rate table, and the budget against that currency's bounds.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamer.functions.numeric import half_even
from roamer.operators.currency import budget_limits
from roamer.sources.tables import METHOD_COSINE, METHOD_KNN, METHOD_WEIGHTED

ANYWHERE = "anywhere"
# Method labels with the methods they stand for, and the default of each preference.
METHOD_LABELS = {"Balanced match": METHOD_WEIGHTED, "Similar travel profile": METHOD_COSINE, "Closest destination matches": METHOD_KNN}
DEFAULT_METHOD = "Balanced match"
DEFAULT_CURRENCY = "USD"
DEFAULT_VALUES = {"preferred_temp": 24, "beach": 6, "culture": 8, "nature": 7, "nightlife": 5, "food": 8, "adventure": 6,
                  "relaxation": 7, "safety": 8, "popularity": 7}
LEAD_DAYS, TRIP_DAYS, HORIZON_DAYS = 60, 6, 730


def _day(c: Column) -> Column:
    """An ISO date, else null."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def sanitize(stored: DataFrame, facets: DataFrame, rates: DataFrame, today: date, key: str = "profile_id") -> DataFrame:
    """``stored``: key, preferences (map of texts, null: nothing stored). ``facets``: distinct (region, country) of
    the catalogue. ``rates``: (code, rate)."""
    p = stored.select(key, F.coalesce("preferences", F.expr("map()").cast("map<string,string>")).alias("p"))
    get = lambda name: F.try_element_at("p", F.lit(name))
    named = lambda name: F.map_contains_key("p", name)
    now, lead = F.lit(today), F.date_add(F.lit(today), LEAD_DAYS)
    last = F.date_add(now, HORIZON_DAYS)
    start, end = _day(get("start_date")), _day(get("end_date"))
    start_bad, end_bad = named("start_date") & start.isNull(), named("end_date") & end.isNull()
    # An unreadable start leaves both defaults; an unreadable end only its own.
    step = p.select(key, "p", get("region").alias("region"), get("country").alias("country"), get("currency").alias("currency"), get("method_label").alias("method_label"),
                    F.when(start_bad, lead).otherwise(F.coalesce(start, lead)).alias("start_date"),
                    F.when(start_bad | end_bad, F.date_add(lead, TRIP_DAYS)).otherwise(F.coalesce(end, F.date_add(lead, TRIP_DAYS))).alias("end_date"))
    step = step.withColumn("start_date", F.when((F.col("start_date") < now) | (F.col("start_date") > last), lead).otherwise(F.col("start_date")))
    step = step.withColumn("end_date", F.when(F.col("end_date") < F.col("start_date"), F.date_add("start_date", TRIP_DAYS)).otherwise(F.col("end_date")))
    step = step.withColumn("end_date", F.when(F.col("end_date") > last, F.least(F.date_add("start_date", TRIP_DAYS), last)).otherwise(F.col("end_date")))
    step = step.withColumn("method_label", F.when(F.col("method_label").isin(*METHOD_LABELS), F.col("method_label")).otherwise(F.lit(DEFAULT_METHOD)))
    # Scope: a region of the catalogue; then a country of that region, or of any.
    regions = facets.select(F.col("region").alias("known_region")).where("known_region is not null").distinct()
    step = step.join(regions, step.region == F.col("known_region"), "left").withColumn("region", F.coalesce("known_region", F.lit(ANYWHERE))).drop("known_region")
    inside = facets.where("country is not null").select(F.col("region").alias("in_region"), F.col("country").alias("known_country"))
    scopes = inside.where("in_region is not null").unionByName(inside.withColumn("in_region", F.lit(ANYWHERE))).distinct()
    step = step.join(scopes, (step.region == F.col("in_region")) & (step.country == F.col("known_country")), "left")
    step = step.withColumn("country", F.coalesce("known_country", F.lit(ANYWHERE))).drop("in_region", "known_country")
    # Currency, then the budget in it.
    money = rates.select(F.col("code").alias("known_code"), F.col("rate").alias("known_rate"))
    usd = rates.where(F.col("code") == DEFAULT_CURRENCY).select(F.first("rate")).scalar()
    step = step.join(money, step.currency == F.col("known_code"), "left")
    step = step.withColumn("currency", F.coalesce("known_code", F.lit(DEFAULT_CURRENCY))).withColumn("rate", F.coalesce("known_rate", usd))
    low, high, _ = budget_limits(F.col("rate"))
    step = step.withColumn("low", low).withColumn("high", high)
    budget = F.when(named("budget_display"), get("budget_display").try_cast("double")).otherwise(half_even(120 * F.col("rate")))
    budget = F.coalesce(F.when(budget < 0, F.ceil(budget)).otherwise(F.floor(budget)).cast("double"), half_even(120 * F.col("rate")))
    numbers = [F.coalesce(get(n).try_cast("double"), F.lit(float(v))).cast("int").alias(n) for n, v in DEFAULT_VALUES.items()]
    methods = F.create_map(*[F.lit(x) for kv in METHOD_LABELS.items() for x in kv])
    return step.select(key, "region", "country", "start_date", "end_date", "currency", F.least("high", F.greatest("low", budget)).alias("budget_display"),
                       "method_label", F.element_at(methods, F.col("method_label")).alias("method"), *numbers)
