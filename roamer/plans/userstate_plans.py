"""User-state keys (U) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from roamer.operators import userstate as us
from roamer.plans.registry import register
from roamer.sources import tables as tb

_TS = "%Y-%m-%d %H:%M:%S.%f"


def _ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@register("favorites_current", f"""
SELECT user_id, item_id, strftime(created_at, '{_TS}') AS created_at FROM (
  SELECT a.user_id, a.item_id, min(a.ts ORDER BY a.ts, a.event_id) AS created_at
  FROM account_events a
  WHERE a.action = 'add_favorite'
    AND NOT EXISTS (SELECT 1 FROM account_events r
                    WHERE r.action = 'remove_favorite' AND r.user_id = a.user_id AND r.item_id = a.item_id
                      AND (r.ts > a.ts OR (r.ts = a.ts AND r.event_id > a.event_id)))
  GROUP BY a.user_id, a.item_id)""")
def q_favorites_current(spark, sf):
    fav = us.favorites_current(tb.account_events(spark, sf))
    return fav.select("user_id", "item_id", _ts("created_at").alias("created_at"))


@register("history_recent", f"""
SELECT user_id, id, rank, strftime(created_at, '{_TS}') AS created_at, amount FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rank FROM history)
WHERE rank <= 20""")
def q_history_recent(spark, sf):
    r = us.recent(tb.history(spark, sf))
    return r.select("user_id", "id", "rank", _ts("created_at").alias("created_at"), "amount")


@register("is_favorite", f"""
SELECT DISTINCT e.user_id, e.item_id,
       EXISTS (SELECT 1 FROM account_events a
               WHERE a.action = 'add_favorite' AND a.user_id = e.user_id AND a.item_id = e.item_id
                 AND NOT EXISTS (SELECT 1 FROM account_events r
                                 WHERE r.action = 'remove_favorite' AND r.user_id = a.user_id AND r.item_id = a.item_id
                                   AND (r.ts > a.ts OR (r.ts = a.ts AND r.event_id > a.event_id)))) AS is_favorite
FROM account_events e""")
def q_is_favorite(spark, sf):
    """Existence flag for every (user, item) pair seen in the log."""
    ev = tb.account_events(spark, sf)
    pairs = ev.select("user_id", "item_id").distinct()
    fav = us.favorites_current(ev).select("user_id", "item_id", F.lit(True).alias("f"))
    return pairs.join(fav, ["user_id", "item_id"], "left").select(
        "user_id", "item_id", F.coalesce("f", F.lit(False)).alias("is_favorite"))


_FAVORITES = """SELECT a.user_id, a.item_id, min(a.ts) AS created_at FROM account_events a
  WHERE a.action = 'add_favorite' AND NOT EXISTS (SELECT 1 FROM account_events r WHERE r.action = 'remove_favorite' AND r.user_id = a.user_id AND r.item_id = a.item_id
    AND (r.ts > a.ts OR (r.ts = a.ts AND r.event_id > a.event_id))) GROUP BY a.user_id, a.item_id"""
_LATEST = "SELECT * FROM preference_saves QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY saved_at DESC, save_id DESC) = 1"
CTES = {
    "favorites": _FAVORITES,
    "latest_preferences": _LATEST,
    # The four child tables of users, a row as (child, row_key, user_id).
    "children": """SELECT 'preferences' AS child, CAST(save_id AS VARCHAR) AS row_key, user_id FROM latest_preferences
      UNION ALL SELECT 'favorites', CAST(item_id AS VARCHAR), user_id FROM favorites
      UNION ALL SELECT 'history', CAST(id AS VARCHAR), user_id FROM history
      UNION ALL SELECT 'itineraries', CAST(id AS VARCHAR), user_id FROM itineraries""",
}


def reg(key, oracle=None):
    return register(key, oracle, CTES)


def _children(spark, sf):
    return {"preferences": us.preferences_latest(tb.preference_saves(spark, sf)).select(F.col("save_id").alias("id"), "user_id"),
            "favorites": us.favorites_current(tb.account_events(spark, sf)).select(F.col("item_id").alias("id"), "user_id"),
            "history": tb.history(spark, sf).select("id", "user_id"),
            "itineraries": tb.itineraries(spark, sf).select("id", "user_id")}


def _one_table(children):
    parts = [rows.select(F.lit(name).alias("child"), F.col("id").cast("string").alias("row_key"), F.col("user_id").cast("long").alias("user_id")) for name, rows in children.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@reg("cascade_delete", "SELECT * FROM children WHERE user_id NOT IN (SELECT user_id FROM deleted_users)")
def q_cascade_delete(spark, sf):
    """U16: what is left in the four child tables once the users are removed."""
    return _one_table(us.without_users(_children(spark, sf), tb.deleted_users(spark, sf)))


@reg("orphan_check", "SELECT * FROM children c WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.user_id = c.user_id)")
def q_orphan_check(spark, sf):
    """Rows of the four child tables without a user."""
    return _one_table(us.orphans(_children(spark, sf), tb.users(spark, sf)))


_EMAIL = "lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g'))"


@reg("lookup_by_email", f"""SELECT r.request_id, {_EMAIL.format('r.email')} AS email, u.user_id, u.display_name
FROM registrations r LEFT JOIN users u ON {_EMAIL.format('u.email')} = {_EMAIL.format('r.email')}""")
def q_lookup_by_email(spark, sf):
    asked = tb.registrations(spark, sf).select("request_id", "email")
    found = us.lookup_by_email(asked, tb.users(spark, sf))
    return found.select("request_id", us.normal_email("email").alias("email"), "user_id", "display_name")


@reg("preferences_latest", f"SELECT user_id, save_id, strftime(saved_at, '{_TS}') AS saved_at, preferences_json FROM latest_preferences")
def q_preferences_latest(spark, sf):
    latest = us.preferences_latest(tb.preference_saves(spark, sf))
    return latest.select("user_id", "save_id", _ts("saved_at").alias("saved_at"), "preferences_json")


@reg("preferences_load", """SELECT u.user_id, json_extract_string(p.preferences_json, '$.region') AS region,
  CAST(json_extract(p.preferences_json, '$.budget_display') AS INTEGER) AS budget_display, CAST(json_extract(p.preferences_json, '$.preferred_temp') AS INTEGER) AS preferred_temp,
  CAST(json_extract(p.preferences_json, '$.beach') AS INTEGER) AS beach, p.preferences_json IS NOT NULL AS stored
FROM users u LEFT JOIN (SELECT * FROM latest_preferences WHERE user_id % 5 <> 0) p ON p.user_id = u.user_id""")
def q_preferences_load(spark, sf):
    """U5, with every fifth user's preferences missing from the store."""
    latest = us.preferences_latest(tb.preference_saves(spark, sf)).where(F.col("user_id") % 5 != 0)
    loaded = us.preferences_load(tb.users(spark, sf).select("user_id"), latest)
    get = lambda n: F.try_element_at("preferences", F.lit(n))
    return loaded.select("user_id", get("region").alias("region"), *[get(n).cast("int").alias(n) for n in ("budget_display", "preferred_temp", "beach")],
                         F.col("preferences").isNotNull().alias("stored"))


@reg("favorites_add", f"""WITH acts AS (SELECT *, lag(action) OVER (PARTITION BY user_id, item_id ORDER BY ts, event_id) AS before
  FROM account_events WHERE action IN ('add_favorite', 'remove_favorite')),
flagged AS (SELECT *, action = 'add_favorite' AND coalesce(before, 'remove_favorite') = 'remove_favorite' AS inserted FROM acts),
runs AS (SELECT *, sum(inserted::INT) OVER (PARTITION BY user_id, item_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM flagged),
starts AS (SELECT user_id, item_id, run, ts AS created_at FROM runs WHERE inserted)
SELECT r.user_id, r.item_id, r.event_id, r.inserted, strftime(s.created_at, '{_TS}') AS created_at FROM runs r
JOIN starts s ON s.user_id = r.user_id AND s.item_id = r.item_id AND s.run = r.run WHERE r.action = 'add_favorite'""".replace("WITH acts", "SELECT * FROM (WITH acts") + ")")
def q_favorites_add(spark, sf):
    added = us.favorites_add(tb.account_events(spark, sf))
    return added.select("user_id", "item_id", "event_id", "inserted", _ts("created_at").alias("created_at"))


@reg("favorites_list", f"""SELECT user_id, item_id, strftime(created_at, '{_TS}') AS created_at,
  row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, item_id DESC) AS place FROM favorites""")
def q_favorites_list(spark, sf):
    fav = us.listed(us.favorites_current(tb.account_events(spark, sf)), tie="item_id")
    return fav.select("user_id", "item_id", _ts("created_at").alias("created_at"), "place")


@reg("itineraries_list", f"""SELECT user_id, id, city, country, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date, strftime(created_at, '{_TS}') AS created_at,
  row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS place FROM itineraries""")
def q_itineraries_list(spark, sf):
    it = us.listed(tb.itineraries(spark, sf))
    return it.select("user_id", "id", "city", "country", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"),
                     _ts("created_at").alias("created_at"), "place")


@reg("itineraries_delete", "SELECT id, user_id, city, country FROM itineraries i WHERE NOT EXISTS (SELECT 1 FROM delete_requests d WHERE d.id = i.id AND d.user_id = i.user_id)")
def q_itineraries_delete(spark, sf):
    return us.delete_own(tb.itineraries(spark, sf), tb.delete_requests(spark, sf)).select("id", "user_id", "city", "country")


@reg("serialize_records", """SELECT place_id, '{"place_id":' || place_id || ',"priority":' || priority || ',"url":' || CASE WHEN url IS NULL THEN 'null' ELSE '"' || url || '"' END || ',"title":"' || title || '"}' AS record
FROM image_candidates""")
def q_serialize_records(spark, sf):
    return tb.image_candidates(spark, sf).select("place_id", us.serialized(["place_id", "priority", "url", "title"]).alias("record"))
