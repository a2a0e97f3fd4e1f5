"""Every registered query against its SQL in DuckDB, over whole tables."""

import pytest
from compare import check, duck, folder_of

from kerbline.plans import registry

registry.load_all()
FOLDER = folder_of("0.001")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    same, n, _, _, note = check(spark, con, FOLDER, name)
    assert same is not False, note
    assert n >= 0


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
