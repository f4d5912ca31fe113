"""Every query with SQL against DuckDB over the whole sf0.001 tables; every other one runs."""

import pandas as pd
import pytest

from roamer.llm import queries
from tests.conftest import SF


def _norm(v):
    return "<null>" if v is None or v != v else repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("key", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, duck, key):
    got = queries.queries()[key](spark, SF)
    rows = [r.asDict() for r in got.collect()]
    want = duck.execute(queries.oracle_sql()[key]).df()
    want = want.astype(object).where(pd.notna(want), None)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    norm = lambda rs: sorted(tuple(_norm(r[c]) for c in cols) for r in rs)
    assert norm(rows) == norm(want.to_dict("records"))
