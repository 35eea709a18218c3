"""The rule cascade: features, order, edges."""

from collections import Counter

from pyspark.sql import functions as F

from tarn.llm.common import words_of
from tarn.llm.quality_rules import Estimate, Rule, base_features, cascade, estimate, ordered, quality_rules, with_words


def repeated(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)})


TEXTS = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x x", "one two\none two\nthree", "ä#b <c> 日本\x0bz\x0cq", "w " * 400, "\n\n", "a b c"]


def test_features(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in base_features(with_words(docs)).collect():
        text, words = r["text"] or "", words_of(r["text"])
        lines = [x for x in text.split("\n") if words_of(x)]
        assert r["n_words"] == len(words)
        assert r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>")
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == repeated(words), text


def test_order_is_by_rejection_per_cost():
    rules = [Rule(n, F.lit(True)) for n in "abcd"]
    found = [Estimate("a", 1.0, 0.1), Estimate("b", 0.1, 0.1), Estimate("c", 5.0, 0.9), Estimate("d", 1.0, 0.1)]
    assert [r.name for r in ordered(rules, found)] == ["b", "c", "a", "d"]


def test_later_rules_are_not_tried(spark):
    fail = F.raise_error(F.lit("tried")).cast("boolean")
    df = spark.createDataFrame([(1,), (2,)], "x int")
    out = cascade(df, [Rule("first", F.lit(None).cast("boolean")), Rule("second", fail)])
    assert [r["failed_rule"] for r in out.collect()] == ["first", "first"]


def test_edges_and_clashing_columns(spark):
    good = " ".join(f"word{i} and more{i}." for i in range(40))
    junk = " ".join(f"junk{i}### it{i}$$$" for i in range(40))
    rows = [(1, good), (2, junk), (3, None), (4, ""), (5, good), (5, good), (None, "THE SHOUT " + good.upper())]
    docs = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in rows], "doc_id long, text string, n_words int, kept int, _words string")
    out = {(r["doc_id"], r["kept"], r["base_failed"]) for r in quality_rules(docs).collect()}
    assert out == {(1, True, False), (2, False, False), (3, False, True), (4, False, True), (5, True, False), (None, False, False)}
    assert quality_rules(docs).count() == len(rows)
    assert quality_rules(docs.limit(0)).collect() == []


def test_no_python_in_the_plan(spark, sf):
    plan = quality_rules(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_costs_are_those_of_the_rules(spark, sf):
    """A pattern over every word costs many times a comparison of two numbers, whatever a job takes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rules = [Rule("cheap", F.col("n_words") > 3), Rule("dear", F.size(F.filter("_words", lambda w: w.rlike("^(a+b?)+\\p{L}*$"))) < 0)]
    cheap, dear = estimate(docs, rules, sample_rows=200)
    assert (cheap.rejected, dear.rejected) == (0.0, 1.0)
    assert dear.cost > 10 * cheap.cost and dear.cost > 1e-6
    assert estimate(docs.limit(0), rules) == []
    none_able = estimate(spark.createDataFrame([(1, None), (2, "x")], "doc_id long, text string"), rules)
    assert [e.cost for e in none_able] == [0.0, 0.0]
