"""The queries with SQL twins on the smallest tables."""

import pytest
from compare import rows_of
from conftest import SF

from gridspark.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_equals_sql(spark, con, key):
    df = QUERIES[key](spark, SF)
    cur = con.execute(SQL[key])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())
