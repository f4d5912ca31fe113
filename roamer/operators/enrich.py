"""Weather source of a trip, image searches and image links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamer.functions.numeric import col_of, half_even

# How far ahead a forecast reaches, its days, and the page address before a title.
NEAR_DAYS, FORECAST_DAYS = 7, 7
PAGE = "https://en.wikipedia.org/wiki/"
FORECAST, HISTORICAL, UNAVAILABLE = "forecast", "historical", "unavailable"


def climate_source(trips: DataFrame, daily: DataFrame) -> DataFrame:
    """Where a trip's weather comes from, and the values.

    trips: trip_id, place_id, asked_on, start_date. A trip that starts within ``NEAR_DAYS`` of the day it was asked on has the
    forecast of the ``FORECAST_DAYS`` from then on, or a warning if there is none; a later one the place's mean over that month of all years.
    The range of days is turned into one row a day, so that the join is one on equal (place, day) and days of one place lie apart.
    """
    near = F.datediff("start_date", "asked_on") <= NEAR_DAYS
    flagged = trips.withColumn("near", F.coalesce(near, F.lit(False)))
    days = flagged.where("near").select("trip_id", "place_id", F.explode(F.sequence(F.col("asked_on"), F.date_add("asked_on", FORECAST_DAYS - 1))).alias("day"))
    # Sums are of decimals: their order does not matter, so neither does how rows are dealt.
    total = lambda c: F.sum(F.col(c).cast("decimal(24,6)")).cast("double")
    forecast = days.join(daily, ["place_id", "day"]).groupBy("trip_id").agg(
        half_even(total("high_c") / F.count("high_c"), 1).alias("avg_high_c"), half_even(total("low_c") / F.count("low_c"), 1).alias("avg_low_c"), half_even(total("precipitation_mm"), 1).alias("total_precipitation_mm"))
    months = daily.groupBy("place_id", F.month("day").alias("month")).agg(((total("high_c") + total("low_c")) / (F.count("high_c") + F.count("low_c"))).alias("mean_c"))
    out = flagged.withColumn("month", F.month("start_date")).join(forecast, "trip_id", "left").join(months, ["place_id", "month"], "left")
    source = F.when(~F.col("near"), HISTORICAL).when(F.col("avg_high_c").isNotNull(), FORECAST).otherwise(UNAVAILABLE)
    return out.withColumn("source", source).withColumn("historical_c", F.when(F.col("source") == HISTORICAL, half_even("mean_c", 1))).drop("near", "month", "mean_c")


def image_queries(places: DataFrame) -> DataFrame:
    """The searches for a place's picture, in the order in which they are tried."""
    tries = F.array(F.concat_ws(" ", "city", "country"), F.concat("city", F.lit(" travel")), F.concat("country", F.lit(" travel landscape")))
    rows = places.select("city", "country", F.posexplode(tries).alias("at", "query"))
    return rows.select("city", "country", (F.col("at") + 1).alias("attempt"), "query")


def quoted(title) -> Column:
    """A page title in an address: underscores for spaces, percent escapes, slashes as they are."""
    c = F.url_encode(F.replace(col_of(title), F.lit(" "), F.lit("_")))
    for was, becomes in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        c = F.replace(c, F.lit(was), F.lit(becomes))
    return c


def image_links(images: DataFrame, referrer: str) -> DataFrame:
    """E5: page address (from the title where none is given), photographer's address with the referral, and the caption.

    images: place_id, city, country, title, page_url, photographer_url (each of the last three may be null)."""
    title = F.coalesce("title", F.lit("Destination"))
    referral = f"?utm_source={referrer}&utm_medium=referral"
    return images.select("place_id", F.coalesce("page_url", F.concat(F.lit(PAGE), quoted(title))).alias("page_url"),
                         F.concat("photographer_url", F.lit(referral)).alias("photographer_url"),
                         F.coalesce("title", F.concat_ws(", ", "city", "country")).alias("caption"))
