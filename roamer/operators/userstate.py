"""User-state tables as jobs over an append-only action log.

Row-at-a-time upserts and deletes become aggregates: every operator here is a
``groupBy`` (map-side combined, so a hot key never lands whole in one task)
or a ranked window bounded by its limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamer.functions.numeric import col_of, half_even
from roamer.operators.catalog import strip_ws

ADD, REMOVE = "add_favorite", "remove_favorite"


def favorites_current(events: DataFrame, key=("user_id", "item_id")) -> DataFrame:
    """U8: adds minus removes; the last action per key decides.

    ``created_at`` is the first add after the last remove. Two aggregates:
    the last remove per key, then the first add beyond it.
    """
    order = F.struct("ts", "event_id")
    fav = events.where(F.col("action").isin(ADD, REMOVE)).select(*key, "action", "ts", "event_id")
    last_rm = (fav.where(F.col("action") == REMOVE)
               .groupBy(*key).agg(F.max(order).alias("last_rm")))
    adds = fav.where(F.col("action") == ADD).join(last_rm, list(key), "left")
    live = adds.where(F.col("last_rm").isNull() | (order > F.col("last_rm")))
    return live.groupBy(*key).agg(F.min(order).alias("first")).select(
        *key, F.col("first.ts").alias("created_at"))


def recent(rows: DataFrame, limit: int = 20, user: str = "user_id",
           ts: str = "created_at", tie: str = "id") -> DataFrame:
    """Latest ``limit`` rows per user, newest first (ties: larger id first)."""
    w = Window.partitionBy(user).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return rows.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= limit)


def normal_email(c) -> Column:
    """Lower case, without surrounding white space."""
    return F.lower(strip_ws(col_of(c)))


def new_accounts(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """Of valid requests (request_id, email, ...), the first of each address that has no account yet."""
    rest = [c for c in requests.columns if c != "email"]
    first = requests.groupBy("email").agg(F.min_by(F.struct(*rest), F.col("request_id")).alias("r"))
    return first.join(accounts.select(normal_email("email").alias("email")), "email", "left_anti").select("email", "r.*")


def lookup_by_email(asked: DataFrame, users: DataFrame) -> DataFrame:
    """The account of each asked address, or nulls. ``asked``: email as typed, and other columns."""
    known = users.select(normal_email("email").alias("__email"), "user_id", "display_name")
    return asked.withColumn("__email", normal_email("email")).join(known, "__email", "left").drop("__email")


def preferences_latest(saves: DataFrame) -> DataFrame:
    """U4: the last save of each user by (saved_at, save_id)."""
    last = F.max_by(F.struct("save_id", "saved_at", "preferences_json"), F.struct("saved_at", "save_id")).alias("s")
    return saves.groupBy("user_id").agg(last).select("user_id", "s.*")


def preferences_load(users: DataFrame, latest: DataFrame) -> DataFrame:
    """Users with their stored preferences as a map of texts; null where none are stored."""
    stored = latest.select("user_id", F.from_json("preferences_json", "map<string,string>").alias("preferences"))
    return users.join(stored, "user_id", "left")


def favorites_add(events: DataFrame, key=("user_id", "item_id"), chunk: str = "day") -> DataFrame:
    """For every add, whether it inserted a row, and the time of the row that is there afterwards.

    A (user, item) is a state machine: an add inserts if the action before it was a remove or none; a
    repeated add keeps the row of the run's first. A key's actions are cut into spans of time, so that no
    window holds a key whole; what one span hands to the next are two values, found over the spans.
    """
    order = F.struct("ts", "event_id")
    acts = events.where(F.col("action").isin(ADD, REMOVE)).select(*key, F.date_trunc(chunk, "ts").alias("span"), "ts", "event_id", "action")
    inside = Window.partitionBy(*key, "span").orderBy("ts", "event_id")
    acts = acts.withColumn("before", F.lag("action").over(inside))
    spans = Window.partitionBy(*key).orderBy("span")
    ends = acts.groupBy(*key, "span").agg(F.max_by("action", order).alias("end"))
    ends = ends.select(*key, "span", F.lag("end").over(spans).alias("carried"))
    acts = _per_span(acts, ends, key).withColumn("before", F.coalesce("before", "carried"))
    inserted = (F.col("action") == ADD) & (F.coalesce("before", F.lit(REMOVE)) == REMOVE)
    acts = acts.withColumn("inserted", inserted).withColumn("start", F.when(F.col("inserted"), F.col("ts"))).drop("carried")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    acts = acts.withColumn("start", F.last("start", True).over(so_far))
    starts = acts.groupBy(*key, "span").agg(F.max("start").alias("s"))
    earlier = spans.rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*key, "span", F.last("s", True).over(earlier).alias("carried"))
    out = _per_span(acts.where(F.col("action") == ADD), starts, key)
    return out.select(*key, "event_id", "ts", "inserted", F.coalesce("start", "carried").alias("created_at"))


def _per_span(rows: DataFrame, values: DataFrame, key) -> DataFrame:
    """Rows with the values of their span; null keys meet null keys."""
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*key, "span")]
    carried = [c for c in values.columns if c not in (*key, "span")]
    return rows.alias("l").join(values.alias("r"), on, "left").select("l.*", *[f"r.{c}" for c in carried])


def listed(rows: DataFrame, user: str = "user_id", ts: str = "created_at", tie: str = "id") -> DataFrame:
    """Every row with its place in its user's list, newest first (ties: larger tie column first)."""
    w = Window.partitionBy(user).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return rows.withColumn("place", F.row_number().over(w))


def history_entries(ranked: DataFrame, preferences: DataFrame, keys=("profile_id",)) -> DataFrame:
    """A search with its preferences and its ranked results, each as JSON text, ready to append."""
    one = F.struct("rank", "city", "country", "region", "match_score", "cost_per_day_usd")
    results = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("r"))
    results = results.select(*keys, F.to_json(F.transform("r", lambda x: x.dropFields("rank"))).alias("recommendations_json"))
    fields = [c for c in preferences.columns if c not in keys]
    asked = preferences.select(*keys, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("preferences_json"))
    return asked.join(results, list(keys), "left").withColumn("recommendations_json", F.coalesce("recommendations_json", F.lit("[]")))


RESULT = "array<struct<city: string, country: string, region: string, match_score: double, cost_per_day_usd: double>>"


def history_explode(entries: DataFrame, keys=("profile_id",)) -> DataFrame:
    """One row for each stored result; the score as a whole percentage, rounded half to even."""
    rows = entries.select(*keys, F.posexplode(F.from_json("recommendations_json", RESULT)).alias("pos", "r"))
    return rows.select(*keys, (F.col("pos") + 1).alias("place"), "r.city", "r.country", "r.region",
                       half_even(F.col("r.match_score") * 100).alias("match_pct"), "r.cost_per_day_usd")


def delete_own(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows less those whose id and owner a request names; requests of others have no effect."""
    return rows.join(requests.select("id", "user_id").distinct(), ["id", "user_id"], "left_anti")


def without_users(children: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """U16: every child table without the rows of deleted users."""
    gone = deleted.select("user_id").distinct()
    return {name: rows.join(gone, "user_id", "left_anti") for name, rows in children.items()}


def orphans(children: dict[str, DataFrame], users: DataFrame) -> dict[str, DataFrame]:
    """Rows of child tables that have no user."""
    known = users.select("user_id").distinct()
    return {name: rows.join(known, "user_id", "left_anti") for name, rows in children.items()}


def serialized(columns) -> Column:
    """A row as JSON text; missing values stay as nulls under their key."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
