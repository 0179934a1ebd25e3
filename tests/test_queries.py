"""Every query of the core library against its SQL, or its rows where there is none."""
import pytest

from probity import catalogue
from tests.conftest import DATA

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(agree, name):
    agree(catalogue.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_query_runs(spark, name):
    assert catalogue.queries()[name](spark, str(DATA)).columns
