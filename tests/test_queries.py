"""Every query of the library against its SQL; those without SQL are tested against other code."""

from difflib import SequenceMatcher

import pytest

from talkloom.plans import catalog

from .oracle import SF, same_rows

SQL = catalog.oracle_sql()


def ratios(spark):
    asked = "that and the thing in there"
    rows = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    return sorted((r.item_id, round(SequenceMatcher(None, asked, r.text.lower()).ratio(), 6)) for r in rows)


WITHOUT_SQL = {"fn32_fuzzy_ratio": ratios}


def test_others_have_a_test():
    assert set(catalog.queries()) - set(SQL) == set(WITHOUT_SQL)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, SF)
    if name in SQL:
        same_rows(df, SQL[name])
    else:
        assert sorted(map(tuple, df.collect())) == WITHOUT_SQL[name](spark)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
