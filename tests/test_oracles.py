"""Every registered query with an oracle matches DuckDB at sf0.001."""
import pytest

import __spark_entry__ as E
from segstate.plans import catalog as C
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare, duck_connection

SQL = {n: q for n, q in E.oracle_sql().items() if n in C.QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, con, name):
    r = compare(spark, name, E.queries()[name], SQL[name], SF_SMALL, con)
    assert r["rows"][0] == r["rows"][1] and r["cols_match"] and r["hash_match"], r


def test_every_key_has_sql():
    assert set(SQL) == set(C.QUERIES) <= set(E.queries())
