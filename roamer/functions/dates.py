"""Trip dating expressions: month lists, seasons, seasonal cost multipliers, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roamer.functions.numeric import col_of

# Northern-hemisphere seasons by month, and the southern swap.
NORTH_SEASONS = {12: "Winter", 1: "Winter", 2: "Winter", 3: "Spring", 4: "Spring", 5: "Spring",
                 6: "Summer", 7: "Summer", 8: "Summer", 9: "Autumn", 10: "Autumn", 11: "Autumn"}
SOUTH_SWAP = {"Winter": "Summer", "Spring": "Autumn", "Summer": "Winter", "Autumn": "Spring"}
TROPICAL = "Tropical season"
TROPIC_LAT = 15.0
# Seasonal cost multipliers.
TROPIC_PEAK, TROPIC_BASE = 1.08, 1.0
SUMMER, WINTER, SHOULDER = 1.18, 0.92, 1.05


def trip_months(start, end) -> Column:
    """Month numbers from start's month to end's month inclusive; empty if end < start."""
    s = F.trunc(col_of(start), "MM")
    e = F.trunc(col_of(end), "MM")
    seq = F.sequence(s, e, F.expr("interval 1 month"))
    return F.when(e >= s, F.transform(seq, lambda d: F.month(d))).otherwise(
        F.array().cast("array<int>"))


def season_name(lat, months) -> Column:
    lat, months = col_of(lat), col_of(months)
    rep = F.element_at(months, (F.floor(F.size(months) / 2) + 1).cast("int"))
    north = F.lit(None).cast("string")
    south = F.lit(None).cast("string")
    for m, name in NORTH_SEASONS.items():
        north = F.when(rep == m, F.lit(name)).otherwise(north)
        south = F.when(rep == m, F.lit(SOUTH_SWAP[name])).otherwise(south)
    return (F.when(F.size(months) == 0, F.lit(None))
            .when(F.abs(lat) < TROPIC_LAT, F.lit(TROPICAL))
            .when(lat >= 0, north).otherwise(south))


def _month_multiplier(lat: Column, m: Column) -> Column:
    tropic = F.when(m.isin(12, 1, 2, 3), TROPIC_PEAK).otherwise(TROPIC_BASE)
    north_summer = m.isin(6, 7, 8)
    north_winter = m.isin(12, 1, 2)
    north = F.when(north_summer, SUMMER).when(north_winter, WINTER).otherwise(SHOULDER)
    south = F.when(north_winter, SUMMER).when(north_summer, WINTER).otherwise(SHOULDER)
    return F.when(F.abs(lat) < TROPIC_LAT, tropic).when(lat >= 0, north).otherwise(south)


def seasonal_multiplier(lat, months) -> Column:
    """Mean per-month multiplier, summed in list order; null for an empty month list."""
    lat, months = col_of(lat), col_of(months)
    total = F.aggregate(months, F.lit(0.0), lambda acc, m: acc + _month_multiplier(lat, m))
    return F.when(F.size(months) > 0, total / F.size(months))


def months_mean(temps, months) -> Column:
    """Mean of the listed month temperatures (repeats weighted), skipping nulls."""
    temps, months = col_of(temps), col_of(months)
    picked = F.filter(F.transform(months, lambda m: F.element_at(temps, m)), lambda x: x.isNotNull())
    total = F.aggregate(picked, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(picked) > 0, total / F.size(picked))


def period_label(start, end) -> Column:
    """'March 5-9, 2026' / 'March 5 - April 2, 2026' / 'December 28, 2026 - January 03, 2027'."""
    s, e = col_of(start), col_of(end)
    same_year = F.year(s) == F.year(e)
    same_month = same_year & (F.month(s) == F.month(e))
    return (F.when(same_month, F.concat(F.date_format(s, "MMMM d"), F.lit("-"), F.date_format(e, "d, yyyy")))
            .when(same_year, F.concat(F.date_format(s, "MMMM d"), F.lit(" - "), F.date_format(e, "MMMM d, yyyy")))
            .otherwise(F.concat(F.date_format(s, "MMMM dd, yyyy"), F.lit(" - "), F.date_format(e, "MMMM dd, yyyy"))))
