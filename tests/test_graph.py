"""Neighbour graphs: exactness with a whole beam, recall and work, copies, parts, the engine's use of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.api import Engine, Settings
from tarn.operators import graph, vector
from tarn.plans.retrieval import graph_recall, graph_whole_beam
from tests.helpers import same


def frame(spark, x):
    return spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")


def asked(df, every=20):
    return df.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def ranks(df):
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.select("query_id", "rank", "vec_id", "score").collect()}


def test_whole_beam_is_exact(spark, sf, duck):
    from tarn.plans.base import ORACLES

    same(graph_whole_beam(spark, sf), duck, ORACLES["graph_whole_beam"])


@pytest.mark.parametrize("shard_rows", [64, 8192])
def test_copies_and_far_parts(spark, shard_rows):
    """Two far groups and three hundred copies of one vector: everything is reached, copies by id."""
    rng = np.random.default_rng(0)
    one, two = rng.normal(size=(150, 8)) * 0.01 + np.eye(8)[0], rng.normal(size=(150, 8)) * 0.01 - np.eye(8)[0]
    df = frame(spark, [*one, *two, *[np.eye(8)[3]] * 300])
    graphs = graph.build(df, graph.GraphConfig(m=4, ef_construct=8, shard_rows=shard_rows))
    assert ranks(graph.top_k(asked(df), graphs, 10, 10_000)) == ranks(vector.cosine_top_k(asked(df), df, 10))
    copies = graph.top_k(asked(df).where("query_id = 400"), graphs, 5, 8)
    assert [r["vec_id"] for r in copies.orderBy("rank").collect()] == [300, 301, 302, 303, 304]


def _one_graph(n=600, m=2):
    x = np.random.default_rng(4).normal(size=(n, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x, graph.Graph(graph._built(0, list(range(n)), x, graph.GraphConfig(m=m, ef_construct=4)))


def test_thinning_leaves_every_node_within_reach():
    _, own = _one_graph()
    bottom = own.layers[0]
    turned = {j: [k for k in bottom if j in bottom[k]] for j in bottom}
    for links in (bottom, turned):
        seen, todo = {0}, [0]
        while todo:
            new = set(links[todo.pop()]) - seen
            seen |= new
            todo += new
        assert len(seen) == 600


def test_a_whole_beam_is_not_walked(monkeypatch):
    """A beam that holds the graph is a product of matrices, with the hits and the count of a walk."""
    x, own = _one_graph()
    want = [own.search(q, 7, 600) for q in x[:50]]
    monkeypatch.setattr(graph.Graph, "search", lambda *a: 1 / 0)
    assert [(list(zip(s, i, strict=True)), n) for s, i, n in own.search_all(x[:50], 7, 600)] == want


def test_recall_and_work(spark):
    """A beam of 48 over 6,000 rows in 32 dimensions: recall over 0.9, under a tenth of the rows scored."""
    x = np.random.default_rng(1).normal(size=(6000, 16))
    df = frame(spark, x)
    graphs = graph.build(df).persist()
    hits = graph.top_k(asked(df), graphs, 10, 40)
    right = vector.cosine_top_k(asked(df), df, 10).join(hits, ["query_id", "vec_id"], "left_semi").count()
    scored = hits.groupBy("query_id").agg(F.max("n_scored").alias("n")).agg(F.avg("n")).first()[0]
    assert right >= 0.9 * 300 * 10 and scored < 600


def test_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    graphs = graph.build(df)
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0])], "query_id long, query_vector array<double>")
    assert ranks(graph.top_k(queries, graphs, 3)) == {(0, 1, 1, 1.0)}
    assert graph.build(df.limit(0)).count() == 0
    assert graph.top_k(queries.limit(0), graphs, 3).count() == 0
    with pytest.raises(ValueError):
        graph.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(ValueError):
        graph.GraphConfig(m=1)
    with pytest.raises(ValueError):
        graph.top_k(queries, graphs, 0)


def test_recall_query(spark, sf):
    rows = graph_recall(spark, sf).orderBy("m").collect()
    assert [r["m"] for r in rows] == [8, 16] and all(r["recall"] >= 0.9 for r in rows)
    assert rows[0]["share_scored"] < rows[1]["share_scored"] <= 1


def test_engine_uses_stored_graphs(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    for k in range(12):
        (notes / f"n{k}.md").write_text(f"# Note {k}\n\nText number {k} about {'apples' if k % 2 else 'pears'}.")

    def embed(texts):
        return [[1.0 + t.count("apples"), 1.0 + t.count("pears"), len(t) % 7 + 0.5, sum(map(ord, t)) % 11 + 0.25] for t in texts]

    plain = Engine(spark, str(notes), str(tmp_path / "a"), embed)
    plain.index()
    with pytest.raises(ValueError, match="no neighbour graphs"):
        plain.search("apples", "semantic", ef_search=8)
    engine = Engine(spark, str(notes), str(tmp_path / "b"), embed, settings=Settings(neighbours=graph.GraphConfig(m=2, ef_construct=4)))
    assert engine.index()["graph"] == {"m": 2, "ef_construct": 4}
    assert engine.index()["reused"]
    near, whole = (engine.search("apples", "semantic", top_k=5, ef_search=e).select("chunk_id", "rank", "score").collect() for e in (100, None))
    assert near == whole and len(near) == 5
    assert engine.search("apples", "hybrid", top_k=3, ef_search=100).count() == 3
    assert engine.search("apples", "semantic", source="n1.md", ef_search=4).count() == 1
