"""Plans (I1-I4), weather source and images (E2, E4, E5), headline (P2), source mix (Q7), scaled features (R3, R5),
styles (R11, R12), history entries (U11, U13) and catalogue files (S1, S4), with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from roamer.functions import dates as D
from roamer.functions.numeric import boundary, half_even
from roamer.operators import catalog as cat
from roamer.operators import currency as cur
from roamer.operators import enrich as en
from roamer.operators import itinerary as it
from roamer.operators import matching as mt
from roamer.operators import styles as sy
from roamer.operators import userstate as us
from roamer.operators.labels import region_label
from roamer.plans import currency_plans as cu
from roamer.plans import matching_plans as mp
from roamer.plans.registry import register
from roamer.plans.sqlgen import heven, r6
from roamer.session import fresh_folder
from roamer.sources import catalog_files as cf
from roamer.sources import tables as tb

INTERESTS = cat.INTEREST_COLUMNS
FEATURES = cat.FEATURE_COLUMNS
CTES = dict(cu.CTES)
_PERIOD = """CASE WHEN year(start_date) = year(end_date) AND month(start_date) = month(end_date) THEN strftime(start_date, '%B ') || day(start_date) || '-' || day(end_date) || ', ' || year(start_date)
  WHEN year(start_date) = year(end_date) THEN strftime(start_date, '%B ') || day(start_date) || ' - ' || strftime(end_date, '%B ') || day(end_date) || ', ' || year(start_date)
  ELSE strftime(start_date, '%B %d, %Y') || ' - ' || strftime(end_date, '%B %d, %Y') END"""
_RANKED = "list_transform(list_sort([" + ", ".join(f"{{'low': -p.{c}, 'at': {i}, 'name': '{c}'}}" for i, c in enumerate(INTERESTS)) + "]), lambda s: s.name)"


def _sql_text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


CTES["themes"] = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_sql_text, t)) + ")" for t in it.THEMES) + ") t(theme, title, morning, afternoon, evening)"
CTES["trips_best"] = f"""SELECT b.profile_id, b.city, b.country, b.avg_temp_c, p.start_date, p.end_date, p.end_date - p.start_date + 1 AS days, {_RANKED} AS ranked, {_PERIOD.replace('start_date', 'p.start_date').replace('end_date', 'p.end_date')} AS period
  FROM ranked_dispatch b JOIN profiles p ON p.profile_id = b.profile_id WHERE b.rank = 1"""
CTES["trip_days"] = "SELECT *, unnest(generate_series(1, days)) AS day FROM trips_best WHERE days >= 1"
CTES["themed"] = """SELECT *, CASE WHEN day = 1 THEN 'arrival' WHEN day = days THEN 'farewell' WHEN days >= 5 AND day = days - 1 THEN 'slower'
  WHEN days >= 4 AND day = greatest(3, days // 2) THEN 'excursion' WHEN day > 7 AND day % 4 = 0 THEN 'local' ELSE ranked[(day - 2) % 7 + 1] END AS theme FROM trip_days"""
CTES["markdowns"] = f"""SELECT profile_id, '### Your ' || any_value(city) || ' trip' || chr(10) || chr(10) || 'A ' || any_value(days) || '-day plan for ' || any_value(city) || ', ' || any_value(country) || ' during ' || any_value(period)
    || ', built around ' || any_value(array_to_string(ranked[1:3], ', ')) || '. It starts gently and ends with time to spare.' || chr(10) || chr(10)
    || string_agg('## Day ' || day || ' - ' || title || chr(10) || '**Morning:** ' || replace(morning, '{{city}}', city) || '.' || chr(10) || chr(10) || '**Afternoon:** ' || afternoon || '.' || chr(10) || chr(10)
       || '**Evening:** ' || evening || '.' || chr(10) || chr(10), '' ORDER BY day)
    || '{it.NOTES}' || chr(10) || '- Expect about ' || format('{{:.1f}}', any_value({heven('avg_temp_c', 1)})) || ' C on average.' || chr(10) || '- Leave one part of each day open.' || chr(10) || '- Book big outings and dinners early.' AS markdown
  FROM themed JOIN themes USING (theme) GROUP BY profile_id"""
# Stored texts: some without days, some that start with a day, some without notes, some missing.
CTES["stored_plans"] = """SELECT profile_id, CASE profile_id % 10 WHEN 0 THEN 'Only a note' || chr(10) || '## Daylight is long' || chr(10) || 'and ## Day 3 is no heading here'
    WHEN 1 THEN '## Day 1 - Alone' || chr(10) || 'walk' || chr(10) || '## Day 12' WHEN 2 THEN NULL WHEN 3 THEN markdown || chr(10) || '## Day 9 - After the notes' ELSE markdown END AS markdown FROM markdowns"""
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
CTES["plan_pieces"] = f"""SELECT profile_id, unnest(list_zip(pieces, range(0, len(pieces)))) AS z FROM (
  SELECT profile_id, CASE WHEN starts_with(s[1], '## Day ') THEN list_prepend('', s) ELSE s END AS pieces FROM (
    SELECT profile_id, string_split(regexp_replace(split_part(markdown, '{it.NOTES}', 1), '(\\n)(## Day \\d)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS s FROM stored_plans WHERE markdown IS NOT NULL))"""
CTES["near_trips"] = """SELECT o_orderkey AS trip_id, o_custkey % 160 AS place_id, DATE '2024-01-01' + CAST(o_orderkey % 40 AS INTEGER) AS asked_on,
  DATE '2024-01-01' + CAST(o_orderkey % 40 + o_orderkey % 12 AS INTEGER) AS start_date FROM orders"""
CTES["image_rows"] = """SELECT s_suppkey AS place_id, s_name AS city, 'Land ' || (s_suppkey % 7) AS country,
  CASE WHEN s_suppkey % 5 <> 0 THEN s_name || ' ' || (['é/ü', '~x*', 'a+b (c)', 'plain'])[CAST(s_suppkey % 4 AS INTEGER) + 1] END AS title,
  CASE WHEN s_suppkey % 3 <> 0 THEN 'http://p.example/' || s_suppkey END AS page_url, CASE WHEN s_suppkey % 2 <> 0 THEN 'http://u.example/' || s_suppkey END AS photographer_url FROM supplier"""


def reg(key, oracle=None):
    return register(key, oracle, CTES)


# ------------------------------------------------------------------ plans

def _trips(spark, sf):
    """Each profile's best match with its dates and interests."""
    best = mp.ranked(spark, sf, n=1).select("profile_id", "city", "country", "avg_temp_c")
    p = tb.profiles(spark, sf).select("profile_id", "start_date", "end_date", *INTERESTS, D.period_label("start_date", "end_date").alias("period"))
    return best.join(p, "profile_id")


def _themed(spark, sf):
    return it.plan_themes(it.plan_days(_trips(spark, sf)))


@reg("plan_days", "SELECT profile_id, CAST(day AS INTEGER) AS day, CAST(days AS INTEGER) AS days FROM trip_days")
def q_plan_days(spark, sf):
    return it.plan_days(_trips(spark, sf)).select("profile_id", "day", "days")


@reg("plan_themes", "SELECT profile_id, CAST(day AS INTEGER) AS day, theme FROM themed")
def q_plan_themes(spark, sf):
    return _themed(spark, sf).select("profile_id", "day", "theme")


@reg("plan_markdown", "SELECT profile_id, markdown FROM markdowns")
def q_plan_markdown(spark, sf):
    return it.plan_markdown(_themed(spark, sf))


@reg("plan_parse", f"""
SELECT * FROM (SELECT profile_id, 'intro' AS part, 0 AS position, NULL AS title, {_STRIP.format('z[1]')} AS body FROM plan_pieces WHERE z[2] = 0) WHERE body <> ''
UNION ALL SELECT profile_id, 'day', CAST(z[2] AS INTEGER), {_STRIP.format("substr(split_part(z[1], chr(10), 1), 4)")}, {_STRIP.format("substr(z[1], length(split_part(z[1], chr(10), 1)) + 2)")} FROM plan_pieces WHERE z[2] > 0
UNION ALL SELECT profile_id, 'notes', -1, 'Practical notes', {_STRIP.format(f"substr(markdown, strpos(markdown, '{it.NOTES}') + {len(it.NOTES)})")} FROM stored_plans WHERE contains(markdown, '{it.NOTES}')""")
def q_plan_parse(spark, sf):
    """I4 on what I3 writes, and on texts without days, without introduction and without notes."""
    k = F.col("profile_id") % 10
    stored = it.plan_markdown(_themed(spark, sf)).select("profile_id", F.when(k == 0, "Only a note\n## Daylight is long\nand ## Day 3 is no heading here").when(k == 1, "## Day 1 - Alone\nwalk\n## Day 12")
                                                         .when(k == 2, F.lit(None).cast("string")).when(k == 3, F.concat("markdown", F.lit("\n## Day 9 - After the notes"))).otherwise(F.col("markdown")).alias("markdown"))
    return it.plan_parse(stored)


# ------------------------------------------------------------------ weather and images

def _total(c: str) -> str:
    return f"cast(sum(cast({c} AS DECIMAL(24,6))) AS DOUBLE)"


@reg("climate_source", f"""
WITH f AS (SELECT t.trip_id, {heven(_total('high_c') + ' / count(high_c)', 1)} AS avg_high_c, {heven(_total('low_c') + ' / count(low_c)', 1)} AS avg_low_c, {heven(_total('precipitation_mm'), 1)} AS total_precipitation_mm
  FROM near_trips t JOIN daily_weather d ON d.place_id = t.place_id AND d.day BETWEEN t.asked_on AND t.asked_on + 6 WHERE t.start_date - t.asked_on <= 7 GROUP BY t.trip_id),
h AS (SELECT place_id, month(day) AS m, ({_total('high_c')} + {_total('low_c')}) / (count(high_c) + count(low_c)) AS mean_c FROM daily_weather GROUP BY ALL)
SELECT t.trip_id, CASE WHEN t.start_date - t.asked_on > 7 THEN 'historical' WHEN f.avg_high_c IS NOT NULL THEN 'forecast' ELSE 'unavailable' END AS source,
  f.avg_high_c, f.avg_low_c, f.total_precipitation_mm, CASE WHEN t.start_date - t.asked_on > 7 THEN {heven('h.mean_c', 1)} END AS historical_c
FROM near_trips t LEFT JOIN f ON f.trip_id = t.trip_id LEFT JOIN h ON h.place_id = t.place_id AND h.m = month(t.start_date)""".replace("\nWITH f AS", "\nSELECT * FROM (WITH f AS") + ")")
def q_climate_source(spark, sf):
    k = F.col("o_orderkey")
    asked = F.date_add(F.lit("2024-01-01").cast("date"), (k % 40).cast("int"))
    trips = tb.read_table(spark, sf, "orders").select(k.alias("trip_id"), (F.col("o_custkey") % 160).alias("place_id"), asked.alias("asked_on"), F.date_add(asked, (k % 12).cast("int")).alias("start_date"))
    return en.climate_source(trips, tb.daily_weather(spark, sf)).select("trip_id", "source", "avg_high_c", "avg_low_c", "total_precipitation_mm", "historical_c")


@reg("image_queries", """SELECT city, country, CAST(a AS INTEGER) AS attempt, CASE a WHEN 1 THEN city || ' ' || country WHEN 2 THEN city || ' travel' ELSE country || ' travel landscape' END AS query
FROM built, range(1, 4) t(a)""")
def q_image_queries(spark, sf):
    return en.image_queries(mp.catalog(spark, sf))


@reg("image_links", f"""SELECT place_id, coalesce(page_url, '{en.PAGE}' || replace(url_encode(replace(coalesce(title, 'Destination'), ' ', '_')), '%2F', '/')) AS page_url,
  photographer_url || '?utm_source=roamer&utm_medium=referral' AS photographer_url, coalesce(title, city || ', ' || country) AS caption FROM image_rows""")
def q_image_links(spark, sf):
    k = F.col("s_suppkey")
    ends = F.element_at(F.array(*[F.lit(x) for x in ("é/ü", "~x*", "a+b (c)", "plain")]), (k % 4 + 1).cast("int"))
    rows = tb.read_table(spark, sf, "supplier").select(
        k.alias("place_id"), F.col("s_name").alias("city"), F.concat(F.lit("Land "), (k % 7).cast("string")).alias("country"), F.when(k % 5 != 0, F.concat_ws(" ", "s_name", ends)).alias("title"),
        F.when(k % 3 != 0, F.concat(F.lit("http://p.example/"), k.cast("string"))).alias("page_url"), F.when(k % 2 != 0, F.concat(F.lit("http://u.example/"), k.cast("string"))).alias("photographer_url"))
    return en.image_links(rows, "roamer")


# ------------------------------------------------------------------ presentation

_SCOPE = f"CASE WHEN p.country <> 'anywhere' THEN p.country WHEN p.region = 'anywhere' THEN 'Worldwide' ELSE {cu._LABEL.replace('region', 'p.region')} END"


@reg("match_headline", f"""
SELECT b.profile_id, {_SCOPE} AS scope_label, {heven('b.match_score * 100')} AS match_pct,
  {cu._money('b.cost_per_day_usd * (p.end_date - p.start_date + 1) * r.rate', 'p.currency')} AS trip_budget, format('{{:.2f}}', {heven('b.seasonal_multiplier', 2)}) AS multiplier
FROM ranked_dispatch b JOIN profiles p ON p.profile_id = b.profile_id JOIN rates r ON r.code = p.currency WHERE b.rank = 1""")
def q_match_headline(spark, sf):
    best = mp.ranked(spark, sf, n=1).select("profile_id", "cost_per_day_usd", "match_score", "seasonal_multiplier")
    p = tb.profiles(spark, sf).select("profile_id", "region", "country", "start_date", "end_date", "currency")
    rates = F.broadcast(cu.rates(spark, sf).select(F.col("code").alias("currency"), "rate"))
    t = best.join(p, "profile_id").join(rates, "currency")
    scope = F.when(F.col("country") != mt.ANYWHERE, F.col("country")).when(F.col("region") == mt.ANYWHERE, "Worldwide").otherwise(region_label("region"))
    cost = F.col("cost_per_day_usd") * (F.datediff("end_date", "start_date") + 1) * F.col("rate")
    return t.select("profile_id", scope.alias("scope_label"), half_even(F.col("match_score") * 100).alias("match_pct"), cur.format_money(cost, F.col("currency")).alias("trip_budget"),
                    F.format_string("%.2f", half_even("seasonal_multiplier", 2)).alias("multiplier"))


#: Display names of source tags; another tag is shown in title case.
SOURCE_NAMES = {cat.MAIN_SOURCE_TAG: "Worldwide travel cities", "sample_destinations": "Bundled sample destinations"}
SEVERAL_SOURCES = "Worldwide travel cities and custom data"


def source_mix(items, by="region"):
    """Q7: the sources of each group's rows and a name for the mix; a table without the column is the sample."""
    tag = F.col("source_dataset") if "source_dataset" in items.columns else F.lit("sample_destinations")
    tags = items.groupBy(by).agg(F.array_sort(F.collect_set(tag)).alias("tags"))
    names = F.create_map(*[F.lit(x) for kv in SOURCE_NAMES.items() for x in kv])
    one = F.get("tags", F.lit(0))
    name = F.when(F.size("tags") > 1, SEVERAL_SOURCES).otherwise(F.coalesce(F.element_at(names, one), F.initcap(F.replace(one, F.lit("_"), F.lit(" ")))))
    return tags.select(by, F.array_join("tags", ",").alias("sources"), name.alias("dataset_name"))


@reg("source_mix", f"""
SELECT region, coalesce(string_agg(DISTINCT tag, ',' ORDER BY tag), '') AS sources, CASE WHEN count(DISTINCT tag) > 1 THEN '{SEVERAL_SOURCES}' WHEN count(DISTINCT tag) = 0 THEN NULL
  WHEN min(tag) = 'kaggle_worldwide_travel_cities' THEN 'Worldwide travel cities' ELSE 'My List' END AS dataset_name
FROM (SELECT region, CASE WHEN region LIKE 'A%' AND source_dataset IS NULL THEN 'my_list' WHEN region LIKE 'E%' THEN 'my_list' ELSE source_dataset END AS tag FROM built) GROUP BY region""")
def q_source_mix(spark, sf):
    """Q7 by region; curated rows of some regions are given a tag, so that every kind of mix occurs."""
    items = mp.catalog(spark, sf)
    r = F.col("region")
    tagged = items.withColumn("source_dataset", F.when(r.startswith("A") & F.col("source_dataset").isNull(), "my_list").when(r.startswith("E"), "my_list").otherwise(F.col("source_dataset")))
    return source_mix(tagged)


# ------------------------------------------------------------------ scaled features and styles

def _scaled_out(scored, item):
    best = mt.top_n(scored)
    return best.select("profile_id", "rank", "city", "country", *[boundary(item(c)).alias(f"item_{c}") for c in FEATURES], *[boundary(f"b_{c}").alias(f"profile_{c}") for c in FEATURES])


def _scaled_sql(items, profiles, table):
    return ("SELECT profile_id, rank, city, country, " + ", ".join(f"{r6(x)} AS item_{c}" for c, x in zip(FEATURES, items)) + ", "
            + ", ".join(f"{r6(x)} AS profile_{c}" for c, x in zip(FEATURES, profiles)) + f" FROM {table}")


@reg("minmax_with_profile", _scaled_sql(mp._A, mp._B, "ranked_cosine"))
def q_minmax_with_profile(spark, sf):
    """Candidates and profile on one scale that holds both; shown for each profile's five best by cosine."""
    p = mp.profiles(spark, sf, tb.METHOD_COSINE)
    items = mt.dated_candidates(p, mp.catalog(spark, sf)).select(*mt.CTX_KEYS, *mt.ITEM_COLUMNS)
    prof, salts = mt.ranged_profiles(p, items)
    return _scaled_out(mt.cosine_pairs(prof, items, salts, mt.TOP), lambda c: f"a_{c}")


def _div(c: str) -> str:
    return f"(CASE WHEN max_{c} - min_{c} = 0 THEN 1.0 ELSE max_{c} - min_{c} END)"


@reg("minmax_candidates", _scaled_sql([f"({c} - min_{c}) / {_div(c)}" for c in FEATURES], [f"({mp._pv(c)} - min_{c}) / {_div(c)}" for c in FEATURES], "ranked_knn"))
def q_minmax_candidates(spark, sf):
    """The candidates' own scale, on which a profile may lie outside 0..1; shown for the five nearest."""
    p = mp.profiles(spark, sf, tb.METHOD_KNN)
    items = mt.dated_candidates(p, mp.catalog(spark, sf)).select(*mt.CTX_KEYS, *mt.ITEM_COLUMNS)
    prof, salts = mt.ranged_profiles(p, items)
    return _scaled_out(mt.knn_pairs(prof, items, salts, mt.TOP), lambda c: (F.col(c) - F.col(f"min_{c}")) / F.col(f"rng_{c}"))


#: Centres for the oracle, one a style.
CENTRES = [[0.1, 0.9, 0.5, 0.3, 0.6, 0.4, 0.5], [0.9, 0.2, 0.6, 0.5, 0.5, 0.7, 0.8], [0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5], [0.3, 0.1, 0.9, 0.1, 0.4, 0.9, 0.6]]
_SCALED = [f"coalesce((b.{c} - s.lo_{c}) / nullif(s.hi_{c} - s.lo_{c}, 0), 0.0)" for c in INTERESTS]
_FAR = [" + ".join(f"(({x}) - {v}) * (({x}) - {v})" for x, v in zip(_SCALED, centre)) for centre in CENTRES]


@reg("assign_style", f"""SELECT city, country, CAST(j AS INTEGER) AS travel_style_cluster, {r6('d')} AS style_distance FROM (
  SELECT city, country, unnest([{", ".join(f"{{'d': {heven(x, 9)}, 'j': {j}}}" for j, x in enumerate(_FAR))}], recursive := true)
  FROM built b CROSS JOIN (SELECT {", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in INTERESTS)} FROM built) s)
QUALIFY row_number() OVER (PARTITION BY city, country ORDER BY d, j) = 1""")
def q_assign_style(spark, sf):
    """R12 with given centres."""
    points = sy.assign_style(sy.scaled_interests(mp.catalog(spark, sf)), CENTRES)
    return points.select("city", "country", "travel_style_cluster", boundary("style_distance").alias("style_distance"))


@reg("travel_style_clusters")
def q_travel_style_clusters(spark, sf):
    """R11; numbers of styles mean nothing outside one fit, so there is no SQL: tests check the fit."""
    styled, _ = sy.travel_style_clusters(mp.catalog(spark, sf))
    return styled.select("city", "country", "travel_style_cluster")


# ------------------------------------------------------------------ history entries

def _entries(spark, sf):
    top = mp.ranked(spark, sf).select("profile_id", "rank", "city", "country", "region", boundary("match_score").alias("match_score"), "cost_per_day_usd")
    asked = tb.profiles(spark, sf).select("profile_id", "region", "country", "currency", *INTERESTS)
    return us.history_entries(top, asked)


@reg("history_append", f"""SELECT p.profile_id, CAST(to_json(struct_pack(region := p.region, country := p.country, currency := p.currency, {", ".join(f"{c} := p.{c}" for c in INTERESTS)})) AS VARCHAR) AS preferences_json,
  coalesce(r.j, '[]') AS recommendations_json FROM profiles p LEFT JOIN (
  SELECT profile_id, CAST(to_json(list(struct_pack(city := city, country := country, region := region, match_score := {r6('match_score')}, cost_per_day_usd := cost_per_day_usd) ORDER BY rank)) AS VARCHAR) AS j
  FROM ranked_dispatch GROUP BY profile_id) r ON r.profile_id = p.profile_id""")
def q_history_append(spark, sf):
    """Entries are appended to a stored log, which is read back."""
    log = fresh_folder(spark, "history")
    _entries(spark, sf).write.mode("append").parquet(log)
    return spark.read.parquet(log).select("profile_id", "preferences_json", "recommendations_json")


@reg("history_explode", f"SELECT profile_id, CAST(rank AS INTEGER) AS place, city, country, region, round_even({r6('match_score')} * 100, 0) AS match_pct, cost_per_day_usd FROM ranked_dispatch")
def q_history_explode(spark, sf):
    return us.history_explode(_entries(spark, sf))


# ------------------------------------------------------------------ files

@reg("load_catalog", f"""SELECT city, CASE WHEN ordinal % 7 = 0 THEN NULL ELSE country END AS country, CASE WHEN ordinal % 5 = 0 THEN NULL ELSE region END AS region,
  CASE WHEN ordinal % 3 = 0 THEN 'He said "hi", then' || chr(10) || 'left; ' || city END AS description, {r6('latitude')} AS latitude, CASE WHEN ordinal % 11 <> 0 THEN {r6('avg_temp_c')} END AS avg_temp_c FROM built""")
def q_load_catalog(spark, sf):
    """S1 on a CSV with quotes, line breaks and texts that stand for missing values."""
    k = F.col("ordinal")
    rows = mp.catalog(spark, sf).select("city", F.when(k % 7 == 0, "null").otherwise(F.col("country")).alias("country"), F.when(k % 5 == 0, "N/A").otherwise(F.col("region")).alias("region"),
                                        F.when(k % 3 == 0, F.concat(F.lit('He said "hi", then\nleft; '), "city")).alias("description"), "latitude",
                                        F.when(k % 11 == 0, "nan").otherwise(F.col("avg_temp_c").cast("string")).alias("avg_temp_c"))
    path = f"{fresh_folder(spark, 'catalog')}.csv"
    cf.write_catalog(rows, path)
    return cf.load_catalog(spark, path, "nowhere", "nowhere").select("city", "country", "region", "description", boundary("latitude").alias("latitude"), boundary("avg_temp_c").alias("avg_temp_c"))


@reg("write_catalog", f"SELECT city, country, region, {r6('latitude')} AS latitude, {r6('cost_per_day_usd')} AS cost_per_day_usd FROM built")
def q_write_catalog(spark, sf):
    """The table is written over an older one and found again as the processed table."""
    path = f"{fresh_folder(spark, 'processed')}/new/catalog"
    built = mp.catalog(spark, sf)
    cf.write_catalog(built.where("cost_per_day_usd > 100"), path)
    cf.write_catalog(built, path)
    return cf.load_catalog(spark, None, path, "nowhere").select("city", "country", "region", boundary("latitude").alias("latitude"), boundary("cost_per_day_usd").alias("cost_per_day_usd"))
