"""Each registered key against its DuckDB oracle on sf0.001 (row count + values)."""

import math

import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

def _keys():
    from roamer.plans.registry import ORACLES, load_all

    load_all()
    return sorted(ORACLES)


def _rows(df):
    cols = sorted(df.columns)

    def norm(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "<null>"
        if isinstance(v, float):
            return repr(round(v, 6) + 0.0)
        return str(v)

    return sorted(tuple(norm(r[c]) for c in cols) for r in df.to_dict("records"))


def _same(sdf, duck, key):
    spd = pd.DataFrame([r.asDict() for r in sdf.collect()], columns=sdf.columns, dtype=object)  # no floats for integers with nulls
    opd = duck.execute(entry.oracle_sql()[key]).df()
    opd = opd.astype(object).where(pd.notna(opd), None)
    assert sorted(spd.columns) == sorted(opd.columns)
    assert len(spd) == len(opd) > 0
    assert _rows(spd) == _rows(opd)


@pytest.mark.parametrize("key", _keys())
def test_key_matches_oracle(spark, duck, key):
    _same(entry.queries()[key](spark, SF), duck, key)


def test_entry_matches_oracle(spark, duck):
    _same(entry.entry(spark), duck, "alternatives_table")


def test_dense_search_in_many_blocks(spark):
    """The result does not depend on how queries and corpus are cut into blocks."""
    from roamer.operators import retrieval as rv

    rows = [(i, [float((i * k) % 17 - 8) for k in (1, 3, 5, 7)]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, vec array<double>")
    q = df.selectExpr("doc_id as qid", "vec as qvec")
    whole = sorted(map(tuple, rv.dense_topk(q, df).select("qid", "rank", "doc_id").collect()))
    cut = sorted(map(tuple, rv.dense_topk(q, df, query_block=7, corpus_shard=11).select("qid", "rank", "doc_id").collect()))
    assert len(whole) == 300 and whole == cut
