"""Every contract query against its SQL."""

import pytest

from glyphflow.plans import kernel_queries  # noqa: F401 (registers its queries)
from glyphflow.plans.contract import QUERIES, SQL

from .conftest import DATA


def rows(df):
    columns = sorted(df.columns)
    return sorted(map(tuple, df[columns].astype(str).values.tolist())), columns


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(SQL[name]).df())


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as e

    found = e.entry(spark)
    assert found.columns == ["page", "box_idx", "id", "x1", "y1", "x2", "y2"] and found.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
