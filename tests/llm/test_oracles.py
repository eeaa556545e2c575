"""Each query that SQL can express against its SQL, on whole tables."""

import pytest

from pitwise.llm.queries import ORACLES, QUERIES
from pitwise.testing import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    res = compare(QUERIES[name](spark, SF), duck(ORACLES[name], SF))
    assert res["ok"], res


def test_all_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
