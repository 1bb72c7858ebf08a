"""Every query against its SQL on the smallest tables."""

import pytest
from compare import SMALL, duck_rows, spark_rows

from sievecast.plans import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    if name not in queries.SQL:
        assert df.limit(1).count() == 1
        return
    columns = sorted(df.columns)
    assert spark_rows(df, columns) == duck_rows(duck, queries.SQL[name], columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1500
    assert set(entry.oracle_sql()) <= set(entry.queries())
