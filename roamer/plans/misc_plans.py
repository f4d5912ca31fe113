"""Facets (Q4, Q5, Q8), strongest interests (R10), registrations (U1, U2) and
enrichment (E1, E3) keys with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roamer.functions.numeric import half_even
from roamer.operators.catalog import INTEREST_COLUMNS, strip_ws
from roamer.operators import userstate as us
from roamer.operators.labels import INTEREST_LABELS, REGION_LABELS, region_label
from roamer.plans import matching_plans as mp
from roamer.plans.registry import register
from roamer.sources import tables as tb

def reg(key, oracle=None):
    return register(key, oracle, mp.CTES)


@reg("facet_regions", "SELECT DISTINCT region FROM built WHERE region IS NOT NULL")
def q_facet_regions(spark, sf):
    return mp.catalog(spark, sf).select("region").where(F.col("region").isNotNull()).distinct().orderBy("region")


@reg("facet_countries", """
SELECT region, string_agg(DISTINCT country, ',' ORDER BY country) AS countries, count(DISTINCT country) AS n_countries
FROM built WHERE country IS NOT NULL GROUP BY region""")
def q_facet_countries(spark, sf):
    c = mp.catalog(spark, sf).where(F.col("country").isNotNull())
    agg = c.groupBy("region").agg(F.array_sort(F.collect_set("country")).alias("cs"))
    return agg.select("region", F.array_join("cs", ",").alias("countries"), F.size("cs").alias("n_countries"))


_CASE_LABEL = "CASE region " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REGION_LABELS.items())
def title_sql(text: str) -> str:
    """Title case in DuckDB: character by character, by the kind of the one before."""
    return (f"array_to_string(list_transform(generate_series(1, length({text})), lambda i: CASE WHEN i = 1 OR NOT "
            f"regexp_matches(substr({text}, cast(i - 1 AS INTEGER), 1), '\\pL') THEN upper(substr({text}, cast(i AS INTEGER), 1)) "
            f"ELSE lower(substr({text}, cast(i AS INTEGER), 1)) END), '')")


_TITLE = title_sql("replace(region, '_', ' ')")


@reg("region_label", f"SELECT DISTINCT region, {_CASE_LABEL} ELSE {_TITLE} END AS region_label FROM built")
def q_region_label(spark, sf):
    regions = mp.catalog(spark, sf).select("region").distinct()
    return regions.select("region", region_label("region").alias("region_label"))


_INTEREST_ROWS = ", ".join(f"({i}, '{c}', '{INTEREST_LABELS[c]}')" for i, c in enumerate(INTEREST_COLUMNS))


@reg("strongest_interests", f"""
SELECT profile_id, string_agg(label, ', ' ORDER BY rn) AS strongest FROM (
  SELECT p.profile_id, i.label,
         row_number() OVER (PARTITION BY p.profile_id ORDER BY
           CASE i.name {" ".join(f"WHEN '{c}' THEN p.{c}" for c in INTEREST_COLUMNS)} END DESC, i.pos) AS rn
  FROM profiles p CROSS JOIN (VALUES {_INTEREST_ROWS}) i(pos, name, label))
WHERE rn <= 3 GROUP BY profile_id""")
def q_strongest_interests(spark, sf):
    p = tb.profiles(spark, sf)
    items = F.array(*[F.struct((-F.col(c)).alias("neg"), F.lit(i).alias("pos"),
                               F.lit(INTEREST_LABELS[c]).alias("label"))
                      for i, c in enumerate(INTEREST_COLUMNS)])
    top = F.slice(F.array_sort(items), 1, 3)
    return p.select("profile_id", F.array_join(F.transform(top, lambda s: s["label"]), ", ").alias("strongest"))


_EMAIL = "lower(regexp_replace(email, '^\\s+|\\s+$', '', 'g'))"
_NAME = "regexp_replace(display_name, '^\\s+|\\s+$', '', 'g')"
CTES_U = {
    "reg_checked": f"""
  SELECT request_id, {_EMAIL} AS email, {_NAME} AS display_name,
         CASE WHEN email IS NULL OR NOT contains({_EMAIL}, '@') OR NOT contains(regexp_extract({_EMAIL}, '[^@]*$'), '.') THEN 'invalid_email'
              WHEN password_length IS NULL OR password_length < 8 THEN 'short_password'
              WHEN display_name IS NULL OR {_NAME} = '' THEN 'missing_name' END AS reason
  FROM registrations"""}


def _validated(spark, sf):
    r = tb.registrations(spark, sf)
    email = F.lower(strip_ws(F.col("email")))
    name = strip_ws(F.col("display_name"))
    staged = r.select("request_id", email.alias("email"), name.alias("display_name"), "password_length")
    e = F.col("email")
    bad_email = F.coalesce(~e.contains("@") | ~F.substring_index(e, "@", -1).contains("."), F.lit(True))
    reason = (F.when(bad_email, "invalid_email")
              .when(F.coalesce(F.col("password_length"), F.lit(0)) < 8, "short_password")
              .when(F.coalesce(F.col("display_name"), F.lit("")) == "", "missing_name"))
    return staged.select("request_id", "email", "display_name", reason.alias("reason"))


@register("validate_registrations", "SELECT request_id, email, display_name, reason, reason IS NULL AS accepted FROM reg_checked",
          {**mp.CTES, **CTES_U})
def q_validate_registrations(spark, sf):
    v = _validated(spark, sf)
    return v.select("request_id", "email", "display_name", "reason", F.col("reason").isNull().alias("accepted"))


@register("unique_registrations", f"""
SELECT email, min(request_id) AS request_id, arg_min(display_name, request_id) AS display_name
FROM reg_checked c WHERE reason IS NULL AND NOT EXISTS (SELECT 1 FROM accounts a WHERE {_EMAIL.replace('email', 'a.email')} = c.email) GROUP BY email""", {**mp.CTES, **CTES_U})
def q_unique_registrations(spark, sf):
    """An address with an account is refused; of several requests the first is taken."""
    v = _validated(spark, sf).where(F.col("reason").isNull()).select("request_id", "email", "display_name")
    return us.new_accounts(v, tb.accounts(spark, sf)).select("email", "request_id", "display_name")


@reg("forecast_summary", """
SELECT place_id, round_even(avg(high_c) * 10, 0) / 10 AS avg_high_c, round_even(avg(low_c) * 10, 0) / 10 AS avg_low_c,
       round_even(sum(precipitation_mm) * 10, 0) / 10 AS total_precipitation_mm
FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY day) AS d FROM daily_weather) WHERE d <= 7
GROUP BY place_id""")
def q_forecast_summary(spark, sf):
    """Per place, the first 7 daily rows (the forecast horizon)."""
    dw = tb.daily_weather(spark, sf)
    w = Window.partitionBy("place_id").orderBy("day")
    week = dw.select("*", F.row_number().over(w).alias("d")).where(F.col("d") <= 7)
    return week.groupBy("place_id").agg(
        half_even(F.avg("high_c"), 1).alias("avg_high_c"),
        half_even(F.avg("low_c"), 1).alias("avg_low_c"),
        half_even(F.sum("precipitation_mm"), 1).alias("total_precipitation_mm"))


@reg("image_pick", """
SELECT s.s_suppkey AS place_id, c.url, c.title, c.priority
FROM supplier s LEFT JOIN (
  SELECT place_id, arg_min(url, priority) AS url, arg_min(title, priority) AS title, min(priority) AS priority
  FROM image_candidates WHERE url IS NOT NULL GROUP BY place_id) c ON c.place_id = s.s_suppkey""")
def q_image_pick(spark, sf):
    """First usable candidate by priority; places without one keep a null image."""
    cand = tb.image_candidates(spark, sf).where(F.col("url").isNotNull())
    best = cand.groupBy("place_id").agg(F.min_by(F.struct("url", "title", "priority"), F.col("priority")).alias("b"))
    places = tb.read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("place_id"))
    return places.join(best, "place_id", "left").select("place_id", "b.url", "b.title", "b.priority")
