"""Every registered query against its SQL, at the smallest scale."""

import pytest

from tarn.plans.registry import ORACLES, QUERIES
from tests.helpers import same

PLAIN = sorted(set(QUERIES) - set(ORACLES))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(name, spark, sf, duck):
    same(QUERIES[name](spark, sf), duck, ORACLES[name])


def test_all_have_sql_but_these():
    assert PLAIN == ["ann_recall", "chunk_markdown", "graph_recall", "graph_topk"]


def test_entry_is_bm25(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]


def test_ann_recall(spark, sf):
    rows = QUERIES["ann_recall"](spark, sf).collect()
    assert sum(r["recall"] for r in rows) / len(rows) >= 0.9
