"""Every query of the engine proper against its SQL, over whole tables."""

import pytest
from conftest import duck_rows, rows_of

from lorekeep.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(name, spark, sf, duck):
    assert repr(rows_of(catalog.QUERIES[name](spark, sf))) == repr(duck_rows(duck, catalog.ORACLES[name]))


def test_entry_and_registries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
