"""Driver tables and the reference-shaped views derived from them.

Every view is a lazy DataFrame over the parquet tables, so its size grows
with the data. Only the fixed TPC-H dimensions ``nation`` (25 rows) and
``region`` (5 rows) are broadcast; their size is bounded by definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# The reference's method names, in its order.
METHOD_WEIGHTED = "Weighted scoring"
METHOD_COSINE = "Cosine similarity"
METHOD_KNN = "K-nearest neighbors"

# Currency codes in the reference's order.
CURRENCIES = ["USD", "EUR", "GBP", "ILS", "CAD", "AUD", "JPY", "CHF"]

PROFILE_INTERESTS = ["beach", "culture", "nature", "nightlife", "food",
                     "adventure", "relaxation", "safety", "popularity"]

TODAY = "2026-06-01"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the cores: one small file may hold rows that are much work each."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def _nation_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    return F.broadcast(
        nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
        .select("n_nationkey", "n_name", "r_name")
    )


def _part_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spread(read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size"))
    nr = _nation_region(spark, sf_dir)
    return part.join(nr, (part.p_partkey % 25) == nr.n_nationkey)


def _lat(k):
    return ((k * 37) % 1400 - 700) / F.lit(10.0)


def _lng(k):
    return ((k * 53) % 3600 - 1800) / F.lit(10.0)


# (raw header, multiplier p, null modulus q) — fixed fixture parameters.
RAW_RATINGS = [("beaches", 3, 59), ("culture", 5, 61), ("nature", 7, 67),
               ("nightlife", 11, 71), ("cuisine", 13, 73), ("adventure", 17, 53),
               ("wellness", 19, 47), ("urban", 23, 43)]


def catalog_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy raw city table: padded names, aliased headers, JSON climate, 0-5 ratings."""
    df = _part_places(spark, sf_dir)
    k = F.col("p_partkey")
    z = F.col("p_size")
    months = [
        F.concat(F.lit(f'"{m}": {{"avg": '), ((k * 7 + 13 * m * m) % 42 - 7).cast("string"), F.lit("}"))
        for m in range(1, 13)
    ]
    climate = F.concat(F.lit("{"), F.concat_ws(", ", *months), F.lit("}"))
    budget = (F.when(F.col("p_type") == "ECONOMY", "Budget")
              .when(F.col("p_type") == "STANDARD", "mid-range")
              .when(F.col("p_type") == "MEDIUM", "mid range")
              .when(F.col("p_type") == "PROMO", " LUXURY ")
              .when(F.col("p_type") == "LARGE", "luxury")
              .otherwise("unknown"))
    cols = [
        k.alias("item_id"),
        F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")).alias("city_name"),
        F.col("n_name").alias("country_name"),
        F.when(k % 97 != 0, F.col("r_name")).alias("continent"),
        F.when(k % 101 != 0, _lat(k)).alias("lat"),
        F.when(k % 101 != 0, _lng(k)).alias("lng"),
        budget.alias("budget_level"),
        (F.when(k % 89 == 0, F.lit(None).cast("string"))
         .when(k % 83 == 0, F.lit("17.5"))
         .when(k % 79 == 0, F.lit("garbage"))
         .otherwise(climate)).alias("avg_temp_monthly"),
    ]
    for name, p, q in RAW_RATINGS:
        cols.append(F.when(k % q != 0, (z * p + k) % 6).alias(name))
    return df.select(*cols)


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-curated rows (every 40th part): reference column names, some columns absent."""
    df = _part_places(spark, sf_dir).where(F.col("p_partkey") % 40 == 0)
    k = F.col("p_partkey")
    z = F.col("p_size")
    return df.select(
        k.alias("item_id"),
        F.col("p_name").alias("city"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("region"),
        _lat(k).alias("latitude"),
        _lng(k).alias("longitude"),
        (100 + k % 50).cast("double").alias("cost_per_day_usd"),
        (k % 30).cast("double").alias("avg_temp_c"),
        ((z * 3) % 11).cast("double").alias("beach"),
        ((z * 5) % 11).cast("double").alias("culture"),
        (k % 13).cast("double").alias("nature"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One preference profile per customer, with trip dates, scope and method."""
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nr = _nation_region(spark, sf_dir)
    df = cust.join(nr, cust.c_nationkey == nr.n_nationkey)
    c = F.col("c_custkey")
    offset = ((c * 11) % 700).cast("int")
    length = F.when(c % 50 == 0, F.lit(399)).otherwise((c * 5) % 21).cast("int")
    start = F.date_add(F.lit("2026-01-01").cast("date"), offset)
    currency = F.element_at(F.array(*[F.lit(x) for x in CURRENCIES]), (c % 8 + 1).cast("int"))
    method = (F.when(c % 5 <= 1, METHOD_WEIGHTED)
              .when(c % 5 <= 3, METHOD_COSINE)
              .otherwise(METHOD_KNN))
    cols = [
        c.alias("profile_id"),
        (40 + (c * 7) % 261).cast("double").alias("budget_per_day_usd"),
        (c % 36).cast("double").alias("preferred_temp_c"),
    ]
    for j, name in enumerate(PROFILE_INTERESTS):
        cols.append(((c * (j + 1) + j) % 11).cast("int").alias(name))
    cols += [
        (F.when(c % 113 == 0, "NOWHERE").when(c % 3 == 0, F.col("r_name"))
         .otherwise("anywhere")).alias("region"),
        F.when(c % 7 == 0, F.col("n_name")).otherwise("anywhere").alias("country"),
        start.alias("start_date"),
        F.date_add(start, length).alias("end_date"),
        currency.alias("currency"),
        method.alias("method"),
    ]
    return df.select(*cols)


# Event type -> account action.
EVENT_ACTIONS = {
    "signup": "register",
    "view": "save_preferences",
    "click": "add_favorite",
    "error": "remove_favorite",
    "purchase": "save_search",
}


def account_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    action = F.lit(None).cast("string")
    for src, dst in reversed(list(EVENT_ACTIONS.items())):
        action = F.when(F.col("event_type") == src, dst).otherwise(action)
    return ev.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        action.alias("action"),
        F.get_json_object("props", "$.k").cast("int").alias("item_id"),
        "value",
    )


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    c = F.col("c_custkey")
    email = (F.when(c % 37 == 0, F.lit(None).cast("string")).when(c % 13 == 0, "no-at-sign.com")
             .when(c % 17 == 0, "a@nodot")
             .otherwise(F.concat(F.lit(" User"), F.expr("c_custkey div 4").cast("string"), F.lit("@Example.COM "))))
    name = F.when(c % 41 == 0, F.lit(None).cast("string")).when(c % 29 == 0, F.lit("   ")).otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")))
    return cust.select(
        c.alias("request_id"),
        email.alias("email"),
        F.when(c % 43 != 0, (5 + c % 10).cast("int")).alias("password_length"),
        name.alias("display_name"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.expr("o_custkey div 10").alias("user_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_totalprice").alias("amount"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user for ten customers; every 13th number is nobody's."""
    cust = read_table(spark, sf_dir, "customer").select(F.expr("c_custkey div 10").alias("user_id")).distinct()
    uid = F.col("user_id").cast("string")
    return cust.where(F.col("user_id") % 13 != 0).select("user_id", F.concat(F.lit("user"), uid, F.lit("@example.com")).alias("email"), F.concat(F.lit("Name "), uid).alias("display_name"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that have an account already, as typed."""
    cust = read_table(spark, sf_dir, "customer").select("c_custkey").where(F.col("c_custkey") % 9 == 0)
    return cust.select(F.concat(F.lit(" USER"), F.expr("c_custkey div 4").cast("string"), F.lit("@example.com")).alias("email"))


def deleted_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(F.expr("c_custkey div 10").alias("user_id")).distinct().where(F.col("user_id") % 17 == 0)


def preference_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved preferences as a log: one save an order."""
    k = F.col("o_orderkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    region = F.element_at(F.array(F.lit("ASIA"), F.lit("EUROPE"), F.lit("anywhere")), (k % 3 + 1).cast("int"))
    body = text('{"region": "', region, '", "budget_display": ', 40 + k % 261, ', "preferred_temp": ', k % 36,
                ', "beach": ', k % 11, ', "culture": ', k * 3 % 11, "}")
    return read_table(spark, sf_dir, "orders").select(
        k.alias("save_id"), F.expr("o_custkey div 10").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("saved_at"), body.alias("preferences_json"))


def saved_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored preferences of every profile, with unknown codes, unreadable and impossible dates, missing fields."""
    p = profiles(spark, sf_dir)
    c = F.col("profile_id")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    start = (F.when(c % 23 == 0, F.lit('"soon"')).when(c % 41 == 0, F.lit('"2030-01-01"')).when(c % 53 == 0, F.lit("null"))
             .otherwise(quoted(F.date_format("start_date", "yyyy-MM-dd"))))
    end = (F.when(c % 31 == 0, F.lit('"2026-13-45"')).when(c % 43 == 0, F.lit('"2031-01-01"')).when(c % 47 == 0, F.lit('"2026-01-01"'))
           .otherwise(quoted(F.date_format("end_date", "yyyy-MM-dd"))))
    label = F.element_at(F.array(*[F.lit(x) for x in ("Balanced match", "Similar travel profile", "Closest destination matches", "Unknown")]), (c % 4 + 1).cast("int"))
    fields = [("region", quoted(F.col("region")), None), ("country", quoted(F.col("country")), None), ("start_date", start, c % 59 == 0), ("end_date", end, c % 61 == 0),
              ("currency", quoted(F.when(c % 19 == 0, "XXX").otherwise(F.col("currency"))), None), ("budget_display", (c * 97 % 60000).cast("string"), c % 29 == 0),
              ("method_label", quoted(label), None), ("preferred_temp", F.col("preferred_temp_c").cast("int").cast("string"), c % 11 == 5)]
    fields += [(n, F.col(n).cast("string"), c % 7 == 3 if n == "beach" else None) for n in PROFILE_INTERESTS]
    parts = [F.when(~absent if absent is not None else F.lit(True), F.concat(F.lit(f'"{n}": '), v)) for n, v, absent in fields]
    return p.select("profile_id", F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("preferences_json"))


def itineraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = read_table(spark, sf_dir, "orders").where(k % 3 == 0)
    day = F.to_date("o_orderdate")
    return o.select(k.alias("id"), F.expr("o_custkey div 10").alias("user_id"), F.concat(F.lit("City "), (k % 64).cast("string")).alias("city"),
                    F.concat(F.lit("Country "), (k % 25).cast("string")).alias("country"), day.alias("start_date"),
                    F.date_add(day, (k % 9).cast("int")).alias("end_date"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


def delete_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to delete itineraries; every other one names another user as the owner."""
    k = F.col("o_orderkey")
    o = read_table(spark, sf_dir, "orders").where(k % 5 == 0)
    return o.select(k.alias("id"), (F.expr("o_custkey div 10") + F.when(k % 10 == 0, 1).otherwise(0)).alias("user_id"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate quotes of every month, some malformed, some codes missing in some months."""
    k = F.col("o_orderkey")
    cents = 50 + k % 300
    rate = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return read_table(spark, sf_dir, "orders").select(
        F.trunc("o_orderdate", "month").alias("as_of"), k.alias("quote_id"), F.element_at(F.array(*[F.lit(x) for x in CURRENCIES]), (k % 8 + 1).cast("int")).alias("code"),
        F.when(k % 97 == 0, F.lit("n/a")).otherwise(rate).alias("rate"))


def daily_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roamer.functions.numeric import half_even
    ev = read_table(spark, sf_dir, "events")
    return (ev.groupBy(F.col("user_id").alias("place_id"), F.to_date("ts").alias("day"))
            .agg(F.max("value").alias("high_c"), F.min("value").alias("low_c"),
                 half_even(F.sum("value"), 2).alias("precipitation_mm")))


def image_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    sup = sup.where(F.col("s_suppkey") % 10 != 9)
    pri = F.explode(F.sequence(F.lit(1), F.lit(5))).alias("priority")
    df = sup.select("s_suppkey", "s_name", pri)
    key = F.col("s_suppkey")
    url = F.when((key + F.col("priority")) % 3 != 0,
                 F.concat(F.lit("http://img.example/"), key.cast("string"), F.lit("/"),
                          F.col("priority").cast("string")))
    return df.select(
        key.alias("place_id"), "priority", url.alias("url"),
        F.concat(F.lit("place "), F.col("s_name")).alias("title"),
    )
