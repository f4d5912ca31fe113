import itertools
import zlib

from roamer.llm import sharding


def test_curve_visits_every_cell_by_unit_steps(spark):
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = list(itertools.product(range(1 << bits), repeat=dims))
        names = [f"c{i}" for i in range(dims)]
        df = sharding.hilbert_steps(spark.createDataFrame(cells, [*names]), names, bits, "h")
        order = sorted((r["h"], tuple(r[n] for n in names)) for r in df.collect())
        assert [h for h, _ in order] == list(range(len(cells)))
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for (_, p), (_, q) in zip(order, order[1:]))


def _check(rows, got, shards=16):
    assert sorted(map(str, ((r["doc_id"], r["size"], r["text_crc32"]) for r in got))) == sorted(
        map(str, ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)))
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)


def test_rows_law(spark, docs_of):
    rows = [(i, None if i % 7 == 0 else "é" * (i % 50)) for i in range(337)] + [(3, "same")] * 40 + [(None, ""), (None, None)]
    _check(rows, sharding.hilbert_shards(docs_of(rows).repartition(5)).collect())
    _check(rows[:5], sharding.hilbert_shards(docs_of(rows[:5])).collect())
    assert sharding.hilbert_shards(docs_of([])).count() == 0


def test_null_names(spark):
    docs = spark.createDataFrame([(1, "a", None, None), (2, "b", "en", None)], "doc_id long, text string, lang string, source string")
    assert sharding.hilbert_shards(docs).count() == 2


def test_files_prune(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('x', cast(id % 90 as int) * 7) as text",
                                        "element_at(array('en','de','fr'), cast(id % 3 as int) + 1) as lang", "concat('s', id % 11) as source")
    ranges = sharding.write_shards(docs, str(tmp_path / "out"))
    hit = [r["shard"] for r in sharding.shards_for(ranges, size=(600, 700)).collect()]
    assert 0 < len(hit) < 16
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 4000
    wide = back.filter("octet_length(text) + 1 between 600 and 700")
    assert wide.count() == wide.filter(wide["shard"].isin(hit)).count() > 0
