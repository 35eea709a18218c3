"""The corpus pipeline, stage by stage, against brute force."""

import math

from pyspark.sql import functions as F

import corpus_pipeline
from tarn.llm import quality_cnn
from tests.llm.test_dedup import brute_lines, brute_substrings, by_text
from tests.llm.test_near import brute_similar

COLUMNS = {"doc_id", "text", "lang", "source", "n_chars"}


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert set(out.columns) == COLUMNS
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append([r.asDict() for r in docs.collect()])
    first, lines, near, cut, packed = kept

    source = spark.read.parquet(f"{sf}/documents.parquet")
    net = quality_cnn.fit(source, spark.read.parquet(f"{sf}/labels.parquet"))
    assert {r["doc_id"] for r in first} == {r["doc_id"] for r in source.collect() if net.score(r["text"].encode()) >= 0.3}
    pairs = lambda rows: [(r["doc_id"], r["text"]) for r in rows]
    assert by_text(pairs(lines)) == by_text([(i, t) for i, _, _, t in brute_lines(pairs(first))])
    rows = sorted(pairs(lines))
    assert {r["doc_id"] for r in near} == {rows[r][0] for r in brute_similar([t for _, t in rows])}
    assert by_text(pairs(cut)) == by_text([(i, t) for i, _, _, t in brute_substrings(pairs(near), 35)])
    assert all(r["n_chars"] == len(r["text"]) for r in [*lines, *cut])
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in cut}
    n = sum(r["length"] for r in packed)
    assert len({r["sequence_id"] for r in packed}) <= math.ceil(n / 2048) + 1


def test_run_is_the_stages_in_order(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.agg(F.count("*")).first()[0] > 100
    assert corpus_pipeline.ORACLE_SQL is None


def _edges(spark, rows):
    return spark.createDataFrame(
        [(i, t, None, "s", None, 7, "x") for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, score int, _key string",
    )


def test_every_stage_takes_nulls_repeats_and_clashing_columns(spark, sf):
    good = "\n".join(f"The committee met on day {k} and agreed that the report was complete." for k in range(12))
    rows = [(1, good), (2, None), (None, good), (3, ""), (3, ""), (4, good + " More was said."), (None, None), (5, "word " * 30_000), (5, "word " * 30_000)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for given in (rows, []):
            out = stage(spark, _edges(spark, given), sf)
            got = out.collect()
            if k < 4:
                assert set(out.columns) == COLUMNS
                assert {r["doc_id"] for r in got} <= {i for i, _ in given}
            if k in (1, 3):
                assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(i) for i, _ in given)
                assert all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in got)
            if k == 2 and given:
                assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "5"]
            if k == 4:
                assert sum(r["start"] == 0 for r in got) == len(given)
