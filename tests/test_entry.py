import pytest

import __spark_entry__ as entry
from peakloom.plans import catalog

SMALL = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_runs(spark, name):
    out = catalog.QUERIES[name](spark, SMALL)
    assert len(set(out.columns)) == len(out.columns)
    out.write.format("noop").mode("overwrite").save()
