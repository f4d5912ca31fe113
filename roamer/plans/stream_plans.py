"""Streaming keys (X1-X3): the given tables, written as files that arrive a few at a time; DuckDB oracles are those of
the batch keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamer.operators import index as ix
from roamer.plans import index_plans as ip
from roamer.plans import matching_plans as mp
from roamer.plans import userstate_plans as up
from roamer.plans.registry import ORACLES, register
from roamer.session import fresh_folder
from roamer.sources import tables as tb
from roamer.streaming import streams as st

BATCHES = 4


def arriving(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` as a stream of ``BATCHES`` micro-batches or more, cut by ``order``."""
    spark = rows.sparkSession
    files = max(BATCHES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = fresh_folder(spark, "arriving")
    rows.repartitionByRange(files, order).write.parquet(folder)
    return st.files(spark, folder, rows.schema, -(-files // BATCHES))


@register("stream_preferences_latest", f"SELECT user_id, preferences_json, save_id, strftime(saved_at, '{up._TS}') AS saved_at FROM latest_preferences", up.CTES)
def q_stream_preferences_latest(spark, sf):
    table = st.preferences_table(spark, fresh_folder(spark, "preferences"))
    st.preferences_stream(arriving(tb.preference_saves(spark, sf), "save_id"), table, fresh_folder(spark, "checkpoint"))
    return table.read().select("user_id", "preferences_json", F.col("saved.id").alias("save_id"), up._ts("saved.at").alias("saved_at"))


@register("stream_favorites", None)
def q_stream_favorites(spark, sf):
    table = st.favorites_table(spark, fresh_folder(spark, "favorites"))
    # Files are cut by a hash-like order, so that events arrive out of time's order.
    events = tb.account_events(spark, sf).withColumn("arrival", F.pmod(F.xxhash64("event_id"), F.lit(1 << 20)))
    st.favorites_stream(arriving(events, "arrival"), table, fresh_folder(spark, "checkpoint"))
    return table.read().where("created_at is not null").select("user_id", "item_id", up._ts("created_at").alias("created_at"))


ORACLES["stream_favorites"] = ORACLES["favorites_current"]


@register("stream_index_upsert", f"{ip._INDEX_SQL} FROM upserted", ip.CTES)
def q_stream_index_upsert(spark, sf):
    built = mp.catalog(spark, sf)
    twice = built.withColumn("n", F.lit(1)).unionByName(ip._updates(built).withColumn("n", F.lit(2)))
    table = ix.index_table(spark, fresh_folder(spark, "index"))
    st.index_stream(arriving(twice, "city"), table, fresh_folder(spark, "checkpoint"), ip.FIRST, "n")
    return ip._index_out(table.read())
