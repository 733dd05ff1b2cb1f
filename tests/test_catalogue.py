import pytest
from oracle import actual, expected

from ledgerloom.plans import flows, ingest, kpis, named, search, views  # noqa: F401  add their queries
from ledgerloom.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = actual(QUERIES[name](spark, SF))
    if name in ORACLE_SQL:
        want = expected(SF, ORACLE_SQL[name])
        assert got == want
        assert want[1], "no rows show nothing"
