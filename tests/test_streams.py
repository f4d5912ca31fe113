"""Stored tables by version, and streams into them: restarts, replays and late files change nothing."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from roamer.operators import userstate as us
from roamer.session import fresh_folder
from roamer.sources.versioned import KeyedTable
from roamer.streaming import streams as st

T0 = datetime(2026, 1, 1)
EVENTS = "event_id long, ts timestamp, user_id long, action string, item_id int"


def table(spark, buckets=4):
    return KeyedTable(spark, fresh_folder(spark, "t"), "k long, v string, n long", ["k"], "n", buckets)


def rows(df):
    return sorted(map(tuple, df.collect()))


def of(spark, data, schema="k long, v string, n long"):
    return spark.createDataFrame(data, schema)


def test_merge_keeps_untouched_files_and_ignores_replays(spark):
    t = table(spark)
    assert rows(t.read()) == [] and t.state() == (0, {}, {})
    t.replace(of(spark, [(i, f"a{i}", 1) for i in range(40)]))
    before = t.state()[1]
    t.merge(of(spark, [(3, "b", 2), (3, "c", 1), (99, "new", 0)]), "s", 0)
    version, after, _ = t.state()
    want = {i: (f"a{i}", 1) for i in range(40)} | {3: ("b", 2), 99: ("new", 0)}
    assert rows(t.read()) == sorted((k, *v) for k, v in want.items())
    kept = [b for b in before if after[b] == before[b]]
    assert 2 <= len(kept) < 4  # two keys touch two buckets at most
    t.merge(of(spark, [(3, "again", 9)]), "s", 0)
    assert t.state()[0] == version
    t.merge(of(spark, [(3, "other source", 9)]), "r", 0)
    assert dict((r[0], r[1]) for r in rows(t.read()))[3] == "other source"


def test_older_rows_do_not_win_and_equal_ones_give_way_to_the_later_change(spark):
    t = table(spark)
    t.merge(of(spark, [(1, "x", 5)]))
    t.merge(of(spark, [(1, "older", 4)]))
    assert rows(t.read()) == [(1, "x", 5)]
    t.merge(of(spark, [(1, "same", 5)]))
    assert rows(t.read()) == [(1, "same", 5)]


def test_a_failed_change_leaves_the_table(spark):
    t = table(spark)
    t.replace(of(spark, [(1, "x", 1)]))
    state = t.state()
    broken = of(spark, [(2, "y", 1)]).withColumn("v", F.raise_error(F.lit("no")))
    for change in (t.replace, t.merge):
        with pytest.raises(Exception, match="no"):
            change(broken.select("k", F.col("v").cast("string").alias("v"), "n"))
    assert t.state() == state and rows(t.read()) == [(1, "x", 1)]
    t.replace(of(spark, []))
    assert rows(t.read()) == []


def events(seed, n=240):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        action = rng.choice([us.ADD, us.ADD, us.REMOVE, "register"])
        out.append((i, T0 + timedelta(hours=rng.randrange(60)), rng.randrange(4), action, rng.randrange(5)))
    return out


def write_files(spark, folder, data, cuts):
    for part in cuts:
        spark.createDataFrame([data[i] for i in part], EVENTS).coalesce(1).write.mode("append").parquet(folder)


def favorites(df):
    return rows(df.where("created_at is not null").select("user_id", "item_id", "created_at"))


def test_favorites_in_any_order_of_arrival_and_after_a_restart(spark):
    data = events(1)
    want = rows(us.favorites_current(spark.createDataFrame(data, EVENTS)).select("user_id", "item_id", "created_at"))
    order = list(range(len(data)))
    random.Random(2).shuffle(order)
    folder, checkpoint = fresh_folder(spark, "in"), fresh_folder(spark, "checkpoint")
    table_ = st.favorites_table(spark, fresh_folder(spark, "fav"))
    schema = spark.createDataFrame([], EVENTS).schema
    write_files(spark, folder, data, [order[:80], order[80:120], order[120:150]])
    st.favorites_stream(st.files(spark, folder, schema), table_, checkpoint)
    some = rows(us.favorites_current(spark.createDataFrame([data[i] for i in order[:150]], EVENTS)).select("user_id", "item_id", "created_at"))
    assert favorites(table_.read()) == some and table_.state()[2]["favorites"] >= 2
    write_files(spark, folder, data, [order[150:]])  # the rest comes after a restart from the checkpoint
    st.favorites_stream(st.files(spark, folder, schema), table_, checkpoint)
    assert favorites(table_.read()) == want != some
    version = table_.state()[0]
    st.favorites_stream(st.files(spark, folder, schema), table_, checkpoint)  # nothing new
    assert table_.state()[0] == version


def test_preferences_replayed_batch_changes_nothing(spark):
    rng = random.Random(3)
    saves = [(i, rng.randrange(6), T0 + timedelta(hours=rng.randrange(20)), f'{{"beach": {i}}}') for i in range(60)]
    schema = "save_id long, user_id long, saved_at timestamp, preferences_json string"
    df = spark.createDataFrame(saves, schema)
    want = rows(us.preferences_latest(df).select("user_id", "preferences_json"))
    folder, checkpoint = fresh_folder(spark, "in"), fresh_folder(spark, "checkpoint")
    t = st.preferences_table(spark, fresh_folder(spark, "pref"))
    df.repartition(3).write.parquet(folder)
    st.preferences_stream(st.files(spark, folder, df.schema), t, checkpoint)
    assert rows(t.read().select("user_id", "preferences_json")) == want
    state = t.state()
    # A second run without its checkpoint sends the same batches again.
    st.preferences_stream(st.files(spark, folder, df.schema), t, fresh_folder(spark, "checkpoint"))
    assert t.state() == state and rows(t.read().select("user_id", "preferences_json")) == want


def test_favorites_add_is_a_state_machine_across_spans(spark):
    a, r = us.ADD, us.REMOVE
    acts = [a, a, r, a, r, r, a, a]
    data = [(i, T0 + timedelta(hours=11 * i), 1, x, 7) for i, x in enumerate(acts)] + [(50, T0, 2, r, 7), (51, T0, 2, a, 7), (52, T0, None, a, 7)]
    got = rows(us.favorites_add(spark.createDataFrame(data, EVENTS)).select("event_id", "inserted", "created_at"))
    at = lambda i: T0 + timedelta(hours=11 * i)
    assert got == [(0, True, at(0)), (1, False, at(0)), (3, True, at(3)), (6, True, at(6)), (7, False, at(6)), (51, True, T0), (52, True, T0)]


class _Handle:
    """A state store that counts its calls."""

    def __init__(self):
        self.kept, self.calls = None, 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.kept is not None

    def get(self):
        self.calls += 1
        return self.kept

    def update(self, value):
        self.calls += 1
        self.kept = value


def test_a_users_actions_cost_two_calls_of_the_state_store_a_batch():
    rng = random.Random(4)
    acts = [Row(user_id=7, item_id=rng.randrange(6), at=rng.randrange(50), event_id=i, action=rng.choice([us.ADD, us.ADD, us.REMOVE])) for i in range(200)]
    store, work, got = _Handle(), st.Favourites(), {}
    work.init(store)
    for n, lo in enumerate(range(0, 200, 40)):
        got.update({r["item_id"]: r["at"] for r in work.handleInputRows((7,), iter(acts[lo:lo + 40]), None)})
        seen = acts[:lo + 40]
        for item, at in got.items():
            last = max(((r["at"], r["event_id"]) for r in seen if r["item_id"] == item and r["action"] == us.REMOVE), default=(-1, -1))
            live = [r["at"] for r in seen if r["item_id"] == item and r["action"] == us.ADD and (r["at"], r["event_id"]) > last]
            assert at == min(live, default=None)
        assert store.calls <= 2 * (n + 1)
    covered = {(i, at, e) for i, at, e in store.kept[1] for j, a, x in store.kept[0] if i == j and (at, e) < (a, x)}
    assert len(got) == 6 and not covered
