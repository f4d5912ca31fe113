"""Hand goldens for the semantic traps (half-even, null-safe clip, trip months, seasons)."""

import datetime as dt

from pyspark.sql import functions as F

from roamer.functions import dates as D
from roamer.functions.numeric import clip, half_even, row_mean, to_double


def test_half_even_and_clip(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (None,), (-3.0,)], "x double")
    rows = df.select(half_even("x").alias("r"), clip("x", 0, 1).alias("c")).collect()
    assert [r.r for r in rows] == [0.0, 2.0, 2.0, None, -3.0]
    assert [r.c for r in rows] == [0.5, 1.0, 1.0, None, 0.0]


def test_to_double_and_row_mean(spark):
    df = spark.createDataFrame([(" 12 ", "NaN", None), ("x", "inf", "4")], "a string, b string, c string")
    rows = df.select(to_double("a").alias("a"), to_double("b").alias("b"),
                     row_mean([to_double("a"), to_double("c")]).alias("m")).collect()
    assert rows[0].a == 12.0 and rows[0].b is None and rows[0].m == 12.0
    assert rows[1].a is None and rows[1].b == float("inf") and rows[1].m == 4.0


def test_trip_months_repeat_and_reverse(spark):
    df = spark.createDataFrame([(dt.date(2026, 11, 15), dt.date(2028, 1, 2)),
                                (dt.date(2026, 5, 1), dt.date(2026, 4, 1))], "s date, e date")
    rows = df.select(D.trip_months("s", "e").alias("m")).collect()
    assert rows[0].m == [11, 12] + list(range(1, 13)) + [1]
    assert rows[1].m == []


def test_season_and_multiplier(spark):
    df = spark.createDataFrame([(-15.0, [6, 7, 8]), (14.9, [1]), (0.0, [6]), (45.0, [12, 1, 2])],
                               "lat double, m array<int>")
    rows = df.select(D.season_name("lat", "m").alias("s"), D.seasonal_multiplier("lat", "m").alias("x")).collect()
    assert [r.s for r in rows] == ["Winter", "Tropical season", "Tropical season", "Winter"]
    assert [r.x for r in rows] == [0.92, 1.08, 1.0, 0.92]


def test_period_label(spark):
    df = spark.createDataFrame([(dt.date(2026, 3, 5), dt.date(2026, 3, 9)),
                                (dt.date(2026, 3, 5), dt.date(2026, 4, 2)),
                                (dt.date(2026, 12, 28), dt.date(2027, 1, 3))], "s date, e date")
    got = [r.p for r in df.select(D.period_label("s", "e").alias("p")).collect()]
    assert got == ["March 5-9, 2026", "March 5 - April 2, 2026", "December 28, 2026 - January 03, 2027"]


def test_climate_cells_in_literal_notation(spark):
    """JSON first, then literals, then plain numbers; the last of equal keys counts."""
    from roamer.operators import catalog as cat

    cells = [("{'1': {'avg': 3.5}, '2': {'avg': None}}", 3.5, 3.5), ("[10, None]", 10.0, None), ("{'1': {'avg': 3.5,}}", 3.5, 3.5),
             ('{"1": 3, "1": 4}', 4.0, 4.0), ("007", 7.0, None), ("7", None, None), ("[1, 3,]", 2.0, None), (None, None, None), ("nonsense", None, None)]
    df = spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(cells)], "i int, c string")
    staged = df.select("i", *cat.climate_parsed(F.col("c")))
    got = staged.select("i", cat.climate_mean().alias("m"), cat.climate_months()[0]).orderBy("i").collect()
    assert [(r["m"], r["temp_month_1"]) for r in got] == [(m, x) for _, m, x in cells]


def test_title_case(spark):
    from roamer.functions.text import title_case

    df = spark.createDataFrame([("asia-pacific",), ("MIDDLE EAST",), ("o'neil 3rd",), ("",)], "t string")
    assert [r[0] for r in df.select(title_case("t")).collect()] == ["Asia-Pacific", "Middle East", "O'Neil 3Rd", ""]
