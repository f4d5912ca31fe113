"""Streaming forms of the user tables and of the index: same rows as their batch keys.

Sources are folders of Parquet files that Spark lists a few at a time. Results go to a ``KeyedTable`` through
``foreachBatch``; the number of a batch is kept there, so a batch that is sent again after a restart changes nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from roamer.operators.index import index_rows
from roamer.operators.userstate import ADD, REMOVE
from roamer.session import ensure_checkpoint_dir
from roamer.sources.versioned import KeyedTable

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

PREFERENCES = "user_id long, preferences_json string, saved struct<at: timestamp, id: long>"
FAVORITES = "user_id long, item_id int, created_at timestamp, batch long"


def files(spark: SparkSession, folder: str, schema: StructType, per_batch: int = 1) -> DataFrame:
    """The files of a folder as a stream, ``per_batch`` of them at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> None:
    """Run a stream over all there is, from where its checkpoint left off.

    A batch is worked out once and whole, also where ``write`` has taken it before: its state is committed with it.
    """
    ensure_checkpoint_dir(stream.sparkSession)

    def take(rows: DataFrame, n: int) -> None:
        write(rows.checkpoint(eager=True), n)

    query = stream.writeStream.foreachBatch(take).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


# ------------------------------------------------------------------ X1

def preferences_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, PREFERENCES, ["user_id"], "saved")


def preferences_stream(saves: DataFrame, table: KeyedTable, checkpoint: str) -> None:
    """The last save of each user. The aggregate's state is one row a user; only users of a batch are written."""
    last = saves.groupBy("user_id").agg(
        F.max_by("preferences_json", F.struct("saved_at", "save_id")).alias("preferences_json"),
        F.max(F.struct(F.col("saved_at").alias("at"), F.col("save_id").alias("id"))).alias("saved"))
    drain(last, lambda rows, n: table.merge(rows, "preferences", n), checkpoint, "update")


# ------------------------------------------------------------------ X2

class Favourites(StatefulProcessor):
    """State of a user: of each item the last remove and every add beyond it, by (time, event).

    A remove that arrives late may fall between adds that came before it, so all adds beyond the last
    remove are kept; adds that a remove covers go from the state. The state is one value a user, read
    and written once a batch, as each call to the state store costs more than the work on a few actions.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        times = "array<struct<item_id: int, at: long, id: long>>"
        self.items = handle.getValueState("items", f"removed {times}, adds {times}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        removed, adds = self.items.get() if self.items.exists() else ((), ())
        last = {item: (at, event) for item, at, event in removed}
        live = defaultdict(set)
        for item, at, event in adds:
            live[item].add((at, event))
        touched = set()
        for row in rows:
            when = int(row["at"]), int(row["event_id"])
            item = row["item_id"]
            touched.add(item)
            if row["action"] != REMOVE:
                live[item].add(when)
            elif item not in last or when > last[item]:
                last[item] = when
        for item in touched & last.keys():
            live[item] = {when for when in live[item] if when > last[item]}
        self.items.update(([(item, *when) for item, when in last.items()], [(item, *when) for item, whens in live.items() for when in whens]))
        for item in touched:
            yield Row(user_id=key[0], item_id=item, at=min(live[item])[0] if live[item] else None)

    def close(self) -> None:
        pass


def favorites_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, FAVORITES, ["user_id", "item_id"], "batch")


def favorites_stream(events: DataFrame, table: KeyedTable, checkpoint: str) -> None:
    """Adds less removes, whatever order they come in; a removed favourite stays as a row without a time."""
    conf = events.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    actions = events.where(F.col("action").isin(ADD, REMOVE) & F.col("user_id").isNotNull() & F.col("item_id").isNotNull())
    state = actions.select("user_id", "item_id", F.unix_micros("ts").alias("at"), "event_id", "action").groupBy("user_id").transformWithState(
        Favourites(), "user_id long, item_id int, at long", "Update", "None")
    state = state.select("user_id", "item_id", F.timestamp_micros("at").alias("created_at"))
    drain(state, lambda rows, n: table.merge(rows.withColumn("batch", F.lit(n).cast("long")), "favorites", n), checkpoint, "update")


# ------------------------------------------------------------------ X3

def index_stream(destinations: DataFrame, table: KeyedTable, checkpoint: str, updated_at, ordinal: str) -> None:
    """Arriving destinations become index rows, merged by key; the larger ordinal wins whenever it comes."""
    drain(destinations, lambda rows, n: table.merge(index_rows(rows, updated_at, ordinal), "destinations", n), checkpoint, "append")
