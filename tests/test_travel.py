"""Hand-made cases of the catalogue, styles, files, preferences, weather and plans."""

import random
import statistics
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from roamer.operators import catalog as cat
from roamer.operators import currency as cur
from roamer.operators import enrich as en
from roamer.operators import itinerary as it
from roamer.operators import preferences as pr
from roamer.operators import styles as sy
from roamer.session import fresh_folder
from roamer.sources import catalog_files as cf

INTERESTS = cat.INTEREST_COLUMNS


def test_climate_cells_hold_one_value_and_nothing_else(spark):
    cells = [("[1, 2] x", None, None), ('{"1": 3} trailing', None, None), ("[True, 2]", 1.5, None), ("{'1': 5 # c\n}", 5.0, 5.0), ("1_000", None, None),
             ('{"1": "None", "2": 4}', 4.0, None), ('{"1": "# 7", "2": 4}', 4.0, None), ("{'1': {'avg': True}}", 1.0, 1.0), ("[1, [2]", None, None), ("{'1': 2}]", None, None),
             ("[4, '#', 8]", 6.0, None), ("{'a]': 3}", 3.0, None)]
    df = spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(cells)], "i int, c string")
    got = df.select("i", *cat.climate_parsed(F.col("c"))).select("i", cat.climate_mean().alias("m"), cat.climate_months()[0]).orderBy("i").collect()
    assert [(r["m"], r["temp_month_1"]) for r in got] == [(m, x) for _, m, x in cells]


@pytest.mark.parametrize("parts", [1, 7])
def test_exact_medians_in_many_ranges(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([None, 3.0, 3.0, rng.uniform(-5, 5)]), None, float(i % 4), 1.0 if i < 1 else None) for i in range(501)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(parts)
    got = cat.exact_medians(df, ["a", "b", "c", "d"])
    assert got == {"a": pytest.approx(statistics.median([r[0] for r in rows if r[0] is not None])), "b": None, "c": statistics.median([r[2] for r in rows]), "d": 1.0}


def test_headers_first_alias_then_last_header(spark):
    assert cat.pick_header(["Name", " City ", "city"], ["city", "name"]) == "city"
    assert cat.pick_header(["City Name", "NAME"], ["city", "city_name", "name"]) == "City Name"
    with pytest.raises(ValueError, match="latitude, longitude"):
        cat.resolve_aliases(["city", "country"])


def test_ratings_above_five_are_not_doubled(spark):
    df = spark.createDataFrame([("5", "5.1", None), ("x", "1", None), ("12", "-3", None)][:2], "a string, b string, c string")
    got = [tuple(r) for r in cat.rescale_ratings(df, ["a", "b", "c"]).orderBy("b").collect()]
    assert got == [(None, 1.0, None), (10.0, 5.1, None)]


def items(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{c} double" for c in INTERESTS))


def test_styles_are_nearest_centres_of_a_good_fit(spark):
    rng = random.Random(1)
    centres = [[rng.uniform(0, 10) for _ in INTERESTS] for _ in range(4)]
    rows = [[v + rng.gauss(0, 0.3) for v in rng.choice(centres)] for _ in range(200)]
    for r in rows:
        r[3] = 7.0  # a constant feature
    styled, found = sy.travel_style_clusters(items(spark, rows))
    out = styled.collect()
    dist = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    assert len(found) == 4 and {r["travel_style_cluster"] for r in out} == {0, 1, 2, 3}
    assert all(r["travel_style_cluster"] == min(range(4), key=lambda j: (round(dist(r["scaled"], found[j]), 9), j)) for r in out)
    assert all(r["scaled"][3] == 0.0 and 0 <= min(r["scaled"]) and max(r["scaled"]) <= 1 for r in out)
    inertia = sum(dist(r["scaled"], found[r["travel_style_cluster"]]) for r in out)
    mean = [sum(r["scaled"][i] for r in out) / len(out) for i in range(7)]
    assert inertia < 0.05 * sum(dist(r["scaled"], mean) for r in out)
    # Assignment by an independent engine gives the same inertia.
    import duckdb

    far = ", ".join("(" + " + ".join(f"power(s[{i + 1}] - {v!r}, 2)" for i, v in enumerate(c)) + ")" for c in found)
    con = duckdb.connect()
    con.execute("CREATE TABLE p (s DOUBLE[])")
    con.executemany("INSERT INTO p VALUES (?)", [(r["scaled"],) for r in out])
    assert con.execute(f"SELECT sum(least({far})) FROM p").fetchone()[0] == pytest.approx(inertia, rel=0.01)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_styles_of_few_items(spark, n):
    styled, centres = sy.travel_style_clusters(items(spark, [[i * 2.0] * 7 for i in range(n)]))
    assert len(centres) == n and len({r["travel_style_cluster"] for r in styled.collect()}) == n


def test_catalogue_files(spark):
    sample, processed = f"{fresh_folder(spark, 's')}.csv", fresh_folder(spark, "p")
    rows = spark.createDataFrame([('a "b", c', "x\ny", 1.5), ("NA", "nan", None), ("", "None", 2.0)], "city string, country string, latitude double")
    cf.write_catalog(rows, sample)
    assert cf.choose_path(spark, None, processed, sample) == sample and cf.choose_path(spark, "q", processed, sample) == "q"
    got = sorted(map(tuple, cf.load_catalog(spark, None, processed, sample).collect()), key=str)
    assert got == sorted([('a "b", c', "x\ny", 1.5), (None, None, None), (None, None, 2.0)], key=str)
    cf.write_catalog(rows.limit(1), processed)
    cf.write_catalog(rows, processed)
    assert cf.load_catalog(spark, None, processed, sample).count() == 3
    spark.createDataFrame([("a,b",), ("1,2",), ("1,2,3",)], "value string").coalesce(1).write.text(t := f"{fresh_folder(spark, 'bad')}.csv")
    assert sorted(((r["a"], r["_bad"]) for r in cf.read_csv(spark, t).collect()), key=str) == sorted([("1", None), ("1", "1,2,3")], key=str)


TODAY = date(2026, 6, 1)


@pytest.mark.parametrize("given,want", [
    ({}, ("anywhere", "anywhere", 60, 66, "USD", 120.0, "Weighted scoring", 6)),
    ({"region": "R1", "country": "C2", "start_date": "2026-06-01", "end_date": "2026-06-01", "currency": "EUR", "budget_display": "1", "beach": "3"}, ("R1", "anywhere", 0, 0, "EUR", 20.0, "Weighted scoring", 3)),
    ({"region": "R9", "country": "C2", "start_date": "2026-05-31", "end_date": "2026-07-01", "currency": "ZZZ", "budget_display": "99999"}, ("anywhere", "C2", 60, 66, "USD", 300.0, "Weighted scoring", 6)),
    ({"start_date": "soon", "end_date": "2026-06-05"}, ("anywhere", "anywhere", 60, 66, "USD", 120.0, "Weighted scoring", 6)),
    ({"start_date": "2026-06-11", "end_date": "2026-02-30"}, ("anywhere", "anywhere", 10, 66, "USD", 120.0, "Weighted scoring", 6)),
    ({"start_date": None, "end_date": "2026-06-05"}, ("anywhere", "anywhere", 60, 66, "USD", 120.0, "Weighted scoring", 6)),
    ({"start_date": "2028-05-31", "end_date": "2028-06-03", "method_label": "Closest destination matches"}, ("anywhere", "anywhere", 730, 730, "USD", 120.0, "K-nearest neighbors", 6)),
    ({"start_date": "2028-06-01", "end_date": "2028-06-03", "method_label": "?"}, ("anywhere", "anywhere", 60, 66, "USD", 120.0, "Weighted scoring", 6)),
])
def test_preferences_rules_in_order(spark, given, want):
    stored = spark.createDataFrame([(1, given)], "profile_id long, preferences map<string,string>")
    facets = spark.createDataFrame([("R1", "C1"), ("R2", "C2"), (None, "C3")], "region string, country string")
    rates = spark.createDataFrame([("USD", 1.0), ("EUR", 0.5)], "code string, rate double")
    r = pr.sanitize(stored, facets, rates, TODAY).first()
    days = lambda d: (d - TODAY).days
    assert (r["region"], r["country"], days(r["start_date"]), days(r["end_date"]), r["currency"], r["budget_display"], r["method"], r["beach"]) == want


def test_rates_of_a_day_are_whole_or_built_in(spark):
    codes = [c for c in cur.FALLBACK_USD_RATES if c != "USD"]
    rows = [(d, i, c, "2.0") for d in ("a", "b", "c") for i, c in enumerate(codes) if (d, c) != ("b", "CHF")] + [("c", 99, "EUR", "x"), ("a", 99, "EUR", "3.5"), ("a", 100, "XXX", "1")]
    got = cur.rates_or_fallback(spark.createDataFrame(rows, "as_of string, quote_id int, code string, rate string"), spark).collect()
    by = {(r["as_of"], r["code"]): (r["rate"], r["is_fallback"]) for r in got}
    assert len(got) == len(by) == 24
    assert by["a", "EUR"] == (3.5, False) and by["a", "USD"] == (1.0, False) and by["b", "EUR"] == by["c", "EUR"] == (0.88, True)
    none = cur.current_rates(spark.createDataFrame([], "as_of string, quote_id int, code string, rate string"), spark).collect()
    assert len(none) == 8 and all(r["is_fallback"] for r in none)


def test_weather_source_by_days_ahead(spark):
    day = date(2024, 1, 5)
    daily = spark.createDataFrame([(1, day + timedelta(d), 10.0 + d, 0.0, 0.1) for d in range(9)], "place_id int, day date, high_c double, low_c double, precipitation_mm double")
    trips = spark.createDataFrame([(i, p, day, day + timedelta(d)) for i, (p, d) in enumerate([(1, 0), (1, 7), (1, 8), (2, 0), (2, 9)])], "trip_id int, place_id int, asked_on date, start_date date")
    out = en.climate_source(trips, daily)
    got = [(r["source"], r["avg_high_c"], r["total_precipitation_mm"], r["historical_c"]) for r in out.orderBy("trip_id").collect()]
    assert got == [("forecast", 13.0, 0.7, None)] * 2 + [("historical", None, None, 7.0), ("unavailable", None, None, None), ("historical", None, None, None)]
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()


def test_plans_by_number_of_days(spark):
    rows = [(n, date(2026, 1, 1), date(2026, 1, 1) + timedelta(n - 1), *range(7, 0, -1)) for n in (0, 1, 2, 4, 9)]
    trips = spark.createDataFrame(rows, "profile_id int, start_date date, end_date date, " + ", ".join(f"{c} int" for c in INTERESTS))
    got = {}
    for r in it.plan_themes(it.plan_days(trips)).orderBy("day").collect():
        got.setdefault(r["profile_id"], []).append(r["theme"])
    assert got == {1: ["arrival"], 2: ["arrival", "farewell"], 4: ["arrival", "beach", "excursion", "farewell"],
                   9: ["arrival", "beach", "culture", "excursion", "nightlife", "food", "adventure", "slower", "farewell"]}
