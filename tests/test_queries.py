import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import oracle  # noqa: E402

from docloom.plans import catalog  # noqa: E402

SMALL = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    assert oracle.rows_of(catalog.queries()[name](spark, SMALL)) == oracle.rows_of_sql(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = catalog.queries()[name](spark, SMALL)
    assert df.columns and df.count() > 0


def test_entry_module_lists_the_same_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert catalog.FLAGSHIP in entry.queries()


def test_recall_of_cells(spark):
    from docloom.operators import vectors as V
    from docloom.plans.tables import vectors

    found, exact = ({(r.query_id, r.vec_id) for r in catalog.queries()[n](spark, SMALL).collect()} for n in ("v2_cells", "v1_search"))
    assert len(found & exact) >= 0.9 * len(exact)
    assert V.sampled(vectors(spark, SMALL).where("vec_id >= 16"), 16).count() == 16
