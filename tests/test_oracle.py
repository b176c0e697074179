import pytest

from tessera.queries import ORACLE, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    ours, theirs, differ = compare(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLE[name])
    assert ours == theirs and ours and not differ, differ


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count()
