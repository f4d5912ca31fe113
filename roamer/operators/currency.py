"""Currency: rate table choice, conversion and money text.

The rate table is a dimension of at most one row per currency code, so it is
broadcast (size bounded by the code list, not by the data).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roamer.functions.numeric import col_of, half_even, to_double

# Built-in USD rates, currency symbols (reference order).
FALLBACK_USD_RATES = {"USD": 1.0, "EUR": 0.88, "GBP": 0.75, "ILS": 3.45, "CAD": 1.37,
                      "AUD": 1.52, "JPY": 157.0, "CHF": 0.80}
CURRENCY_SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£", "ILS": "₪", "CAD": "C$",
                    "AUD": "A$", "JPY": "¥", "CHF": "CHF "}


def fallback_rates(spark: SparkSession) -> DataFrame:
    rows = [(k, float(v)) for k, v in FALLBACK_USD_RATES.items()]
    return spark.createDataFrame(rows, "code string, rate double")


def rates_or_fallback(quotes: DataFrame, spark: SparkSession) -> DataFrame:
    """M1: for every day of quotes (as_of, quote_id, code, rate as text), USD = 1 and the day's quotes; if any
    built-in code is missing or malformed on a day, that day has the whole built-in table, flagged.

    Of repeated quotes the last (by quote_id) counts, even where it is malformed.
    """
    codes = F.broadcast(fallback_rates(spark).select("code"))
    last = quotes.groupBy("as_of", "code").agg(F.max_by("rate", "quote_id").alias("rate"))
    # Text that is no number spoils its day; a code that is asked for by nobody does not.
    last = last.select("as_of", "code", to_double("rate").alias("rate")).join(codes, "code", "left_semi").where((F.col("code") != "USD") & F.col("rate").isNotNull())
    days = quotes.select("as_of").distinct()
    whole = last.groupBy("as_of").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(FALLBACK_USD_RATES) - 1).select("as_of")
    live = last.join(whole, "as_of", "left_semi").unionByName(whole.select("as_of", F.lit("USD").alias("code"), F.lit(1.0).alias("rate")))
    missing = days.join(whole, "as_of", "left_anti").select("as_of", F.explode(_builtin_map()).alias("code", "rate"))
    return live.withColumn("is_fallback", F.lit(False)).unionByName(missing.withColumn("is_fallback", F.lit(True)))


def _builtin_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in FALLBACK_USD_RATES.items() for x in (kv[0], float(kv[1]))])


def current_rates(quotes: DataFrame, spark: SparkSession) -> DataFrame:
    """(code, rate, is_fallback) of the last day; without quotes the built-in table. At most one row a code."""
    last = quotes.select(F.max("as_of")).scalar()
    day = rates_or_fallback(quotes.where(F.col("as_of") == last), spark).select("code", "rate", "is_fallback")
    none = fallback_rates(spark).where(last.isNull()).withColumn("is_fallback", F.lit(True))
    return day.unionByName(none)


def from_usd(amount, rate) -> Column:
    return col_of(amount) * col_of(rate)


def to_usd(amount, rate) -> Column:
    return col_of(amount) / col_of(rate)


def format_money(amount, code) -> Column:
    """M4: symbol + thousands separators; 0 decimals for JPY or |amount| >= 100, else 2."""
    a, c = col_of(amount), col_of(code)
    symbols = F.create_map(*[x for k, v in CURRENCY_SYMBOLS.items() for x in (F.lit(k), F.lit(v))])
    whole = (c == "JPY") | (F.abs(a) >= 100)
    text = F.when(whole, F.format_number(half_even(a, 0), 0)).otherwise(F.format_number(half_even(a, 2), 2))
    return F.concat(F.element_at(symbols, c), text)


def budget_limits(rate) -> list[Column]:
    """Least and largest daily budget in the display currency, and its step (half-even rounding)."""
    r = col_of(rate)
    lo = F.greatest(F.lit(1.0), half_even(40 * r))
    return [lo, F.greatest(lo + 1, half_even(300 * r)), F.greatest(F.lit(1.0), half_even(5 * r))]


def budget_bounds(rate, saved=None) -> list[Column]:
    """M5: slider bounds in the display currency; the saved budget, or 120 USD without one, lies within them."""
    r = col_of(rate)
    lo, hi, step = budget_limits(r)
    start = half_even(120 * r) if saved is None else F.coalesce(col_of(saved), half_even(120 * r))
    return [lo.alias("min_budget"), hi.alias("max_budget"), step.alias("budget_step"),
            F.least(hi, F.greatest(lo, start)).alias("default_budget")]
