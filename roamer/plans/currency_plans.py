"""Currency (M2-M5) and presentation (P1) keys with DuckDB oracles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from roamer.functions.numeric import boundary, half_even
from roamer.operators import currency as cur
from roamer.operators import preferences as pr
from roamer.operators.labels import REGION_LABELS, region_label
from roamer.plans import matching_plans as mp
from roamer.plans.misc_plans import title_sql
from roamer.plans.registry import register
from roamer.plans.sqlgen import heven, r6
from roamer.sources import tables as tb

_RATES = ", ".join(f"('{k}', {v!r})" for k, v in cur.FALLBACK_USD_RATES.items())
_SYM = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in cur.CURRENCY_SYMBOLS.items()) + " END"
CTES = dict(mp.CTES)
CTES["builtin"] = f"SELECT * FROM (VALUES {_RATES}) r(code, rate)"
# Each month's last quote of a code; months in which every code but USD has a number are live.
CTES["month_rates"] = """
  SELECT q.as_of, q.code, q.rate FROM (SELECT as_of, code, try_cast(arg_max(rate, quote_id) AS DOUBLE) AS rate FROM quotes GROUP BY ALL) q
  JOIN builtin b ON b.code = q.code WHERE q.code <> 'USD' AND q.rate IS NOT NULL"""
CTES["all_rates"] = """
  SELECT as_of, code, rate, false AS is_fallback FROM month_rates m WHERE 7 = (SELECT count(*) FROM month_rates n WHERE n.as_of = m.as_of)
  UNION ALL SELECT as_of, 'USD', 1.0, false FROM month_rates GROUP BY as_of HAVING count(*) = 7
  UNION ALL SELECT d.as_of, b.code, b.rate, true FROM (SELECT DISTINCT as_of FROM quotes WHERE as_of NOT IN (SELECT as_of FROM month_rates GROUP BY as_of HAVING count(*) = 7)) d CROSS JOIN builtin b"""
CTES["rates"] = "SELECT code, rate, is_fallback FROM all_rates WHERE as_of = (SELECT max(as_of) FROM quotes)"


def _money(x: str, code: str = "code") -> str:
    sym = _SYM.replace("CASE code", f"CASE {code}")
    return (f"({sym} || CASE WHEN {code} = 'JPY' OR abs({x}) >= 100 THEN format('{{:,.0f}}', round_even({x}, 0)) "
            f"ELSE format('{{:,.2f}}', round_even(({x}) * 100.0, 0) / 100.0) END)")


def reg(key, oracle=None):
    return register(key, oracle, CTES)


def rates(spark, sf):
    """The rate table in force: at most one row for each built-in code, so it is broadcast."""
    return cur.current_rates(tb.quotes(spark, sf), spark)


@reg("rates_or_fallback", "SELECT CAST(as_of AS VARCHAR) AS as_of, code, rate, is_fallback FROM all_rates")
def q_rates_or_fallback(spark, sf):
    """M1, for every month of quotes."""
    return cur.rates_or_fallback(tb.quotes(spark, sf), spark).select(F.col("as_of").cast("string").alias("as_of"), "code", "rate", "is_fallback")


def _priced(spark, sf):
    table = F.broadcast(rates(spark, sf))
    p = tb.profiles(spark, sf)
    return p.join(table, p.currency == table.code).drop("code")


@reg("from_usd", f"""SELECT profile_id, currency, {r6('budget_per_day_usd * rate')} AS budget_display
FROM profiles p JOIN rates r ON r.code = p.currency""")
def q_from_usd(spark, sf):
    p = _priced(spark, sf)
    return p.select("profile_id", "currency", boundary(cur.from_usd("budget_per_day_usd", "rate")).alias("budget_display"))


@reg("to_usd", f"""SELECT profile_id, currency, {r6(heven('budget_per_day_usd * rate') + ' / rate')} AS budget_usd
FROM profiles p JOIN rates r ON r.code = p.currency""")
def q_to_usd(spark, sf):
    """M3: the whole-unit display budget converted back to USD for matching."""
    p = _priced(spark, sf)
    shown = half_even(cur.from_usd("budget_per_day_usd", "rate"))
    return p.select("profile_id", "currency", boundary(cur.to_usd(shown, F.col("rate"))).alias("budget_usd"))


@reg("format_money", f"""SELECT profile_id, {_money('budget_per_day_usd * rate', 'currency')} AS budget_text
FROM profiles p JOIN rates r ON r.code = p.currency""")
def q_format_money(spark, sf):
    p = _priced(spark, sf)
    return p.select("profile_id", cur.format_money(F.col("budget_per_day_usd") * F.col("rate"), F.col("currency")).alias("budget_text"))


@reg("budget_bounds", f"""
SELECT profile_id, lo AS min_budget, hi AS max_budget, greatest(1.0, {heven('5 * rate')}) AS budget_step,
       least(hi, greatest(lo, coalesce(saved, {heven('120 * rate')}))) AS default_budget
FROM (SELECT *, greatest(lo + 1, {heven('300 * rate')}) AS hi FROM (
  SELECT p.profile_id, r.rate, greatest(1.0, {heven('40 * r.rate')}) AS lo, CAST(json_extract(s.preferences_json, '$.budget_display') AS DOUBLE) AS saved
  FROM profiles p JOIN rates r ON r.code = p.currency LEFT JOIN saved_preferences s ON s.profile_id = p.profile_id))""")
def q_budget_bounds(spark, sf):
    """M5: bounds for each profile; the saved budget, where one is stored, is brought within them."""
    saved = tb.saved_preferences(spark, sf).select("profile_id", F.get_json_object("preferences_json", "$.budget_display").try_cast("double").alias("saved"))
    p = _priced(spark, sf).join(saved, "profile_id", "left")
    return p.select("profile_id", *cur.budget_bounds(F.col("rate"), F.col("saved")))


_DAY = "CASE WHEN regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast({0} AS DATE) END"
_HAS = "coalesce(list_contains(json_keys(j), '{0}'), false)"
_NUMS = ", ".join(f"CAST(coalesce(try_cast(j ->> '{n}' AS DOUBLE), {v}) AS INTEGER) AS {n}" for n, v in pr.DEFAULT_VALUES.items())


@reg("preferences_sanitize", f"""
SELECT profile_id, region, country, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date, currency,
       least(greatest(lo + 1, {heven('300 * rate')}), greatest(lo, coalesce(trunc(saved), {heven('120 * rate')}))) AS budget_display, method_label,
       CASE method_label WHEN 'Balanced match' THEN 'Weighted scoring' WHEN 'Similar travel profile' THEN 'Cosine similarity' ELSE 'K-nearest neighbors' END AS method,
       {", ".join(pr.DEFAULT_VALUES)}
FROM (SELECT x.* REPLACE (CASE WHEN e2 > last THEN least(start_date + 6, last) ELSE e2 END AS e2), CASE WHEN e2 > last THEN least(start_date + 6, last) ELSE e2 END AS end_date, r.rate, greatest(1.0, {heven('40 * r.rate')}) AS lo
  FROM (SELECT *, CASE WHEN e1 < start_date THEN start_date + 6 ELSE e1 END AS e2,
      CASE WHEN EXISTS (SELECT 1 FROM built b WHERE b.country = y.c0 AND (y.region = 'anywhere' OR b.region = y.region)) THEN c0 ELSE 'anywhere' END AS country
    FROM (SELECT *, CASE WHEN s1 < today OR s1 > last THEN today + 60 ELSE s1 END AS start_date,
        CASE WHEN EXISTS (SELECT 1 FROM built b WHERE b.region = z.r0) THEN r0 ELSE 'anywhere' END AS region,
        CASE WHEN EXISTS (SELECT 1 FROM rates r WHERE r.code = z.cur0) THEN cur0 ELSE 'USD' END AS currency
      FROM (SELECT profile_id, today, today + 730 AS last, j ->> 'region' AS r0, j ->> 'country' AS c0, j ->> 'currency' AS cur0, try_cast(j ->> 'budget_display' AS DOUBLE) AS saved,
          CASE WHEN j ->> 'method_label' IN ('Balanced match', 'Similar travel profile', 'Closest destination matches') THEN j ->> 'method_label' ELSE 'Balanced match' END AS method_label,
          coalesce(sd, today + 60) AS s1,
          CASE WHEN ({_HAS.format('start_date')} AND sd IS NULL) OR ed IS NULL THEN today + 66 ELSE ed END AS e1, {_NUMS}
        FROM (SELECT profile_id, preferences_json::JSON AS j, DATE '{tb.TODAY}' AS today, {_DAY.format("(preferences_json::JSON ->> 'start_date')")} AS sd,
            {_DAY.format("(preferences_json::JSON ->> 'end_date')")} AS ed FROM saved_preferences)) z) y) x
  JOIN rates r ON r.code = x.currency)""")
def q_preferences_sanitize(spark, sf):
    """U6 over every stored set of preferences."""
    stored = tb.saved_preferences(spark, sf).select("profile_id", F.from_json("preferences_json", "map<string,string>").alias("preferences"))
    facets = mp.catalog(spark, sf).select("region", "country").distinct()
    clean = pr.sanitize(stored, facets, rates(spark, sf).select("code", "rate"), date.fromisoformat(tb.TODAY))
    return clean.withColumn("start_date", F.col("start_date").cast("string")).withColumn("end_date", F.col("end_date").cast("string"))


_LABEL = ("CASE region " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REGION_LABELS.items())
          + f" ELSE {title_sql("replace(region, '_', ' ')")} END")


@reg("alternatives_table", f"""
SELECT profile_id, rank, city, country, {_LABEL} AS region_label,
       {_money('cost_per_day_usd * r.rate', 'currency')} AS daily_cost,
       {heven('avg_temp_c', 1)} AS typical_temp_c, {heven('match_score * 100')} AS match_pct,
       travel_season AS season
FROM ranked_dispatch t JOIN rates r ON r.code = t.currency""")
def q_alternatives_table(spark, sf):
    """The top 5 per profile, money in the profile's currency, labels for display."""
    top = mp.ranked(spark, sf)
    table = F.broadcast(rates(spark, sf))
    t = top.join(table, top.currency == table.code)
    return t.select(
        "profile_id", "rank", "city", "country", region_label("region").alias("region_label"),
        cur.format_money(F.col("cost_per_day_usd") * F.col("rate"), F.col("currency")).alias("daily_cost"),
        half_even("avg_temp_c", 1).alias("typical_temp_c"),
        half_even(F.col("match_score") * 100).alias("match_pct"),
        F.col("travel_season").alias("season"))
