import pytest

from tessera.llm.registry import ORACLE, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    ours, theirs, differ = compare(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLE[name])
    assert ours == theirs and not differ, differ
