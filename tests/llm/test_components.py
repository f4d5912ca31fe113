import random

import pytest

from roamer.llm import components


def least(links):
    root = {k: k for e in links for k in e}

    def find(a):
        while root[a] != a:
            root[a] = a = root[root[a]]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {k: find(k) for e in links if e[0] != e[1] for k in e}


@pytest.mark.parametrize("part", [40, 250_000])
def test_against_union_find(spark, monkeypatch, part):
    monkeypatch.setattr(components, "PART_LINKS", part)
    rng = random.Random(1)
    links = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(500 + k, 501 + k) for k in range(0, 30)] + [(7, 7), (901, 900), (901, 900)]
    rows = components.components(spark.createDataFrame(links, "a long, b long").repartition(9)).collect()
    assert len(rows) == len({r["node"] for r in rows}) and {r["node"]: r["label"] for r in rows} == least(links)


def test_small_tables_need_no_rounds(spark, monkeypatch):
    """Every round leaves files a partition, which add up where partitions are many."""
    cuts, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: cuts.append(1) or cut(df))
    names = [b"%03d" % k for k in range(200)]
    random.Random(2).shuffle(names)
    rows = components.components(spark.createDataFrame(list(zip(names, names[1:])), "a binary, b binary").repartition(9)).collect()
    assert {bytes(r["node"]) for r in rows} == set(names) and {bytes(r["label"]) for r in rows} == {b"000"}
    assert len(cuts) <= 2
    assert components.components(spark.createDataFrame([], "a binary, b binary")).count() == 0
