"""Every catalogue query against its DuckDB oracle (on the smallest scale
factor, so the suite stays fast; the driver repeats this at sf0.01)."""

import pytest

from opinia.plans.registry import load_all
from tools.oracle_check import rows_of

from .conftest import SF_SMALL

QUERIES = load_all()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    q = QUERIES[name]
    df = q.build(spark, SF_SMALL)
    rows = df.collect()
    if not q.sql:
        assert len(df.columns) > 0
        return
    res = duck.execute(q.sql)
    dcols = [d[0] for d in res.description]
    sc, sv = rows_of(df.columns, rows)
    dc, dv = rows_of(dcols, res.fetchall())
    assert sc == dc
    assert sv == dv
