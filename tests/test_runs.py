"""Runs, deadlines, generated answers and judgments."""

import json
import time

import pytest

from tarn.operators import context, generation, runs
from tarn.operators.generation import GenerationError, Reply
from tarn.operators.vector import EmbeddingSpec


def test_cases_rotate_and_failures_stay(spark):
    seen = []
    methods = {"a": lambda c: seen.append("a") or [{"rank": 1}], "b": lambda c: seen.append("b") or 1 / 0}
    rows = runs.run_cases([{"case_id": 1}, {"case_id": 2}], methods, spark.range(3))
    assert seen == ["a", "b", "b", "a"] and [r["error"] is None for r in rows] == [True, False, False, True]


def test_drift(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    change = lambda c: spark.range(4).write.mode("append").parquet(path) or []
    frame = spark.read.schema("id long").parquet(path)

    class Fresh:
        columns = ["id"]

        def agg(self, *a):
            return spark.read.schema("id long").parquet(path).agg(*a)

    assert frame.count() == 3
    with pytest.raises(runs.Drift):
        runs.run_cases([{"case_id": 1}], {"a": change}, Fresh())


def test_deadline(spark):
    from pyspark.sql import functions as F

    @F.udf("long")
    def slow(x):
        time.sleep(3)
        return x

    with pytest.raises(TimeoutError), runs.deadline(spark, 0.5):
        spark.range(8).select(slow("id")).collect()
    with runs.deadline(spark, 30):
        assert spark.range(3).count() == 3


def answer(claims, missing=()):
    return json.dumps({"status": "partial" if missing else "answered", "claims": claims, "missing_information": list(missing)})


def test_cited_answer(spark):
    sources = {"S1": "one two two", "S2": "three"}
    ask = lambda text, stop="stop", **more: generation.cited_answer(spark, "q?", sources, lambda m, s: Reply(text, stop), "p", **more)
    good = answer([{"text": "c", "source_ids": ["S2", "S1"], "quotes": [{"source_id": "S1", "text": "one"}]}])
    assert ask(good).used == ["S2", "S1"]
    assert generation.cited_answer(spark, "q?", {}, None, "p").answer["status"] == "insufficient_evidence"
    cases = {"truncated": (good, "length"), "structure": ("{}", "stop"), "references": (answer([{"text": "c", "source_ids": ["S9"]}]), "stop")}
    for code, (text, stop) in cases.items():
        with pytest.raises(GenerationError) as found:
            ask(text, stop)
        assert found.value.code == code
    with pytest.raises(GenerationError, match="budget"):
        ask(good, budget=context.Budget(20, 5, 5), tokens=len)
    bad = json.loads(answer([{"text": "see https://x", "source_ids": ["S1"], "quotes": [{"source_id": "S1", "text": "two"}]}], ["[S1]"]))
    assert {p[0] for p in generation.checked(spark, bad, sources, True)} == {"inline_reference", "ambiguous_quote", "inline_reference_in_missing_information"}


def test_judgments():
    facts = {"facts": [{"index": 0, "correct": True, "rationale": "r"}], "complete": True, "task_fulfilled": True, "rationale": "r"}
    assert generation.fact_judgment(json.dumps(facts), 1) == facts
    claim = {"claim": "c", "supported": True, "evidence_ids": ["E0"], "quote": "words", "rationale": "r"}
    support = {"claims": [claim], "claims_complete": True, "citations_complete": True, "rationale": "r"}
    assert generation.support_judgment(json.dumps(support), {"E0": "the words"}) == support
    doubled = json.dumps(facts).replace('"complete": true', '"complete": true, "complete": true')
    odd = [doubled, json.dumps(facts).replace("0", "NaN"), json.dumps(facts | {"more": 1}), json.dumps(facts | {"complete": 1}), json.dumps(facts | {"rationale": " "}), "no"]
    for raw, n in [(json.dumps(facts), 2), *((x, 1) for x in odd)]:
        with pytest.raises(context.AnswerError):
            generation.fact_judgment(raw, n)
    for evidence in ({"E0": "other"}, {}):
        with pytest.raises(context.AnswerError):
            generation.support_judgment(json.dumps(support), evidence)
    shown = json.loads(generation.judge_material("q", "a", {"E0": "x"}, ["f"]))
    assert shown["facts"] == [{"index": 0, "fact": "f"}] and shown["evidence"][0]["evidence_id"] == "E0"


def test_answers_go_with_their_status():
    claim = [{"text": "c", "source_ids": ["S1"]}]
    good = [("answered", claim, []), ("partial", claim, ["m"]), ("insufficient_evidence", [], ["m"])]
    for status in context.STATUSES:
        for _, claims, missing in [*good, (None, [], [])]:
            raw = json.dumps({"status": status, "claims": claims, "missing_information": missing})
            if (status, claims, missing) in good:
                assert context.parse_answer(raw)["status"] == status
            else:
                with pytest.raises(context.AnswerError, match="go with"):
                    context.parse_answer(raw)
    twice = json.dumps({"status": "answered", "claims": [{"text": "c", "source_ids": ["S1", "S1"]}], "missing_information": []})
    with pytest.raises(context.AnswerError, match="twice"):
        context.parse_answer(twice)
    schema = context.answer_schema(["S1"], quotes=True)["properties"]["claims"]["items"]["properties"]
    assert schema["source_ids"]["uniqueItems"] and schema["quotes"]["minItems"] == 1
    with pytest.raises(ValueError):
        context.answer_schema([])


def test_specs():
    a, b = EmbeddingSpec("m", 3), EmbeddingSpec("m", 4)
    a.require(EmbeddingSpec("m", 3))
    with pytest.raises(ValueError):
        a.require(b)
    with pytest.raises(ValueError):
        EmbeddingSpec("m", 0)


def test_only_stored_records_are_cited(spark):
    schema = "index_version string, chunk_id string, doc_id long, document_revision string, start_char int, end_char int, content string"
    records = spark.createDataFrame([("v", "c", 1, "r", 0, 3, "abc")], schema)
    assert context.verified(records, records).count() == 1
    with pytest.raises(ValueError):
        context.verified(records.withColumn("content", records["chunk_id"]), records)
