"""Queries that SQL can express, at the smallest scale."""

import pytest

from tarn.llm.oracles import ORACLES
from tarn.llm.queries import QUERIES
from tests.helpers import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(name, spark, sf, duck):
    same(QUERIES[name](spark, sf), duck, ORACLES[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
