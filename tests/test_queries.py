"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__
from corpusloom.plans import catalogue
from tests.rows import compare


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    if name in catalogue.ORACLE:
        compare(df, duck, catalogue.ORACLE[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["item_id", "doc_id", "score", "rank"]
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
