"""Personal data: the contract's spans by brute force, trees and thresholds, added spans, edges."""

import random
import re

import pytest

from tarn.llm.pii import KINDS, Model, TrainingBound, _thresholds, _tree, fit, personal_data, redacted
from tarn.llm.queries import op12_personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    d = [int(c) for c in re.sub("[^0-9]", "", value)]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "a@b.co_m@x.y z@q", "😀 x@y.z 1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.4 0.0.0.0", "4111 1111 1111 1111 and 4111-1111-1111-1112", "12345678901234567890 5",
             "+1 (017) 555-7713)( +12 +1234567890123456", "\u0001a@b.c\u0001d@e.f\u0001", "x@" + "a." * 3000, "1 " * 3000, "+1" + "(" * 2000, "a" * 50000, "1.2.3.4 " * 1500]
    parts = ["1", "2", "255", ".", "@", "a", "b-", "é", " ", "-", "+", "(", ")", "4111111111111111", "x@y.z", "\n"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(500)]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_email int, spans string")
    got = {r["doc_id"]: r for r in personal_data(docs, Model()).collect()}
    for k, t in enumerate(texts):
        assert got[k]["base"] == got[k]["spans"] == brute(t), t
        assert [got[k][f"n_{x}"] for x in KINDS] == [sum(s.startswith(x) for s in brute(t)) for x in KINDS]


@pytest.fixture(scope="module")
def fitted(spark):
    """A model of a made corpus: true data of all kinds, numbers that fail their check, other numbers."""
    rng = random.Random(8)
    rows = []
    for k in range(400):
        card = [rng.randint(0, 9) for _ in range(15)]
        number = next(n for n in ("".join(map(str, [*card, c])) for c in range(10)) if passes("card", n))
        kinds = [f"ann.{k}@mail{k % 7}.example.com", ".".join(str(rng.randint(1, 255)) for _ in range(4)), number, f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}",
                 "".join(rng.choice("123456789") for _ in range(15)) + "0", "version 4.0.", "page 12 of 340", f"2021-0{k % 9 + 1}-11"]
        rows.append((k, " ".join(w for x in rng.sample(kinds, 5) for w in ("some words", x, "and more."))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, fit(docs, TrainingBound(sample_rows=400))


def test_every_row_is_learnt_from(spark):
    """What stands in more rows than the sample once held is counted whole, alike examples as one with a weight."""
    from pyspark.sql import functions as F

    from tarn.llm.pii import _training_rows

    docs = spark.range(7000).select(F.col("id").alias("doc_id"), F.lit("mail ann@example.com now").alias("text"))
    rows = _training_rows(docs, TrainingBound())
    found = rows.agg(F.max("n").alias("most"), F.count("*").alias("n")).first()
    assert found["most"] >= 7000 and found["n"] < 50


def test_added_spans(spark, fitted):
    _, model = fitted
    assert set(model.thresholds) == set(KINDS) and len(model.trees) == TrainingBound().trees
    texts = {
        1: ("write to anna.34 [at] mail7 [dot] example [dot] com today", "anna.34 [at] mail7 [dot] example [dot] com"),
        2: ("some words 97[.]51[.]17[.]173 and", "97[.]51[.]17[.]173"),
        3: ("some words 4111.1111.1111.1111 and", "4111.1111.1111.1111"),
        4: ("some words (017) 555-7713 and", "(017) 555-7713"),
        5: ("look at this. And more, at 4.0. No 12 here", None),
        6: ("some words 4111.1111.1111.1112 and", None),
        7: ("some words 9807915762804490 and", None),
    }
    docs = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string")
    for r in personal_data(docs, model).collect():
        text, want = texts[r["doc_id"]]
        assert [text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in r["spans"]] == ([want] if want else []), text
        assert r["base"] == []


def test_added_spans_keep_clear_of_others(spark, fitted):
    """Base spans all stay; what is added overlaps neither them nor another of its kind."""
    docs, model = fitted
    rng = random.Random(4)
    parts = ["(017) 555-7713", "+1 (017) 555-7713", "4111.1111.1111.1111", "4111 1111 1111 1111", "1.2.3.4", "1[.]2[.]3[.]4", "a@b.cd", "é@b.cd", "x [at] y [dot] com", " ", " and ", ".", "77"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))) for k in range(300)]
    more = 0
    for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        spans = [(s.split(":")[0], *map(int, s.split(":")[1:])) for s in r["spans"]]
        base = [(s.split(":")[0], *map(int, s.split(":")[1:])) for s in r["base"]]
        assert r["base"] == brute(rows[r["doc_id"]][1]) and set(base) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))
        added = [s for s in spans if s not in base]
        more += len(added)
        for k, (kind, start, end) in enumerate(added):
            assert all(start >= e or end <= b for _, b, e in base)
            assert all(kind != x or start >= e or end <= b for x, b, e in added[:k])
    assert more > 50


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a@b.cd"), (1, None), (1, "a@b.cd"), (1, "a@b.cd")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_email"], r["spans"]) for r in personal_data(docs).collect())
    assert got == [("1", 0, []), ("1", 1, ["email:0:6"]), ("1", 1, ["email:0:6"]), ("None", 1, ["email:0:6"])]
    assert personal_data(docs.limit(0)).collect() == []
    assert fit(docs.limit(0)) == Model() and fit(docs.where("text IS NULL")) == Model()


def test_trees_and_thresholds():
    text = "DecisionTreeRegressionModel: uid=x, depth=1\n  If (feature 4 <= 0.5)\n   Predict: -1.0\n  Else (feature 4 > 0.5)\n   If (feature 0 <= 1.5)\n    Predict: 0.5\n   Else (feature 0 > 1.5)\n    Predict: 1.0E-4\n"
    assert _tree(text) == (4, 0.5, -1.0, (0, 1.5, 0.5, 1e-4))
    steps = [{"kind": "ip", "m": 2.0, "p": 30, "n": 30}, {"kind": "ip", "m": 1.0, "p": 40, "n": 40}, {"kind": "ip", "m": 0.6, "p": 1, "n": 9}, {"kind": "card", "m": 2.0, "p": 5, "n": 5}]
    assert _thresholds(steps, TrainingBound()) == {"ip": 0.8}


def test_redacted(spark):
    row = spark.createDataFrame([("x é@ a@b.cd, 1.2.3.4!", ["email:5:11", "ip:13:20", "card:14:16"])], "t string, s array<string>")
    assert row.select(redacted(row["t"], row["s"])).first()[0] == "x é@ <EMAIL>, <IP>!"


def test_no_python_in_the_plan(spark, sf):
    plan = op12_personal_data(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
