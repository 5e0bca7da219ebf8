"""Every registered query of the library runs; those with SQL agree with DuckDB."""

import pytest

from tenderline import plans

from .compare import same

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        same(df, SQL[name], sf_dir)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert 0 < df.count() <= 22
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
