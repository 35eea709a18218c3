"""Metrics, intervals, statistics, agents: known answers."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import agent, answers, evidence, irmetrics, stats


def lists(spark, ranking, grades):
    r = spark.createDataFrame([(0, d, i) for i, d in enumerate(ranking, 1)], "query_id long, doc_id string, rank int")
    return r, spark.createDataFrame([(0, d, g) for d, g in grades.items()], "query_id long, doc_id string, grade int")


def test_exponential(spark):
    row = irmetrics.exponential(*lists(spark, "xab", {"a": 3, "b": 1, "c": 1}), k=2).first()
    assert (row["recall"], row["mrr"], row["ndcg"]) == pytest.approx((1 / 3, 0.5, 0.5787641110093001))


def test_linear(spark):
    row = irmetrics.linear(*lists(spark, "xab", {"a": 1, "b": 3}), cutoffs=(1, 3)).first()
    assert row["ndcg_3"] == pytest.approx((1 / math.log2(3) + 3 / 2) / (3 + 1 / math.log2(3))) and row["mrr_1"] == 0


def test_judged_pads_with_zeros(spark):
    row = irmetrics.judged(*lists(spark, "xa", {"a": 2, "b": 1}), k=10).first()
    assert (row["precision"], row["assessed"], row["returned"], row["unassessed"], row["mrr"]) == (0.1, 0.1, 2, 1, 0.5)


def test_nothing_relevant_is_undefined(spark):
    row = irmetrics.exponential(*lists(spark, "ab", {"a": 0}), k=5).first()
    assert row["recall"] is None and row["mrr"] is None and row["ndcg"] is None


def test_aspects(spark):
    supports = spark.createDataFrame([(0, "a", 3.0, "a1"), (0, "a", 3.0, "a2"), (0, "b", 1.0, "b1")], "query_id long, aspect_id string, weight double, doc_id string")
    ranking = lambda ds: spark.createDataFrame([(0, d, i) for i, d in enumerate(ds, 1)], "query_id long, doc_id string, rank int")
    one, two = (irmetrics.aspects(ranking(d), supports, k=2).first() for d in (["a1", "a2"], ["a1", "b1"]))
    assert one["alpha_ndcg"] == pytest.approx(1) and two["alpha_ndcg"] < 1
    assert (one["aspect_recall"], two["aspect_recall"]) == (0.75, 1.0)


def test_coverage(spark):
    anchors = spark.createDataFrame([(1, "s", 0, 12), (2, "s", 20, 30)], "anchor_id long, source string, start_char long, end_char long")
    spans = spark.createDataFrame([("s", 0, 6), ("s", 4, 10), ("t", 0, 99)], "source string, start_char long, end_char long")
    got = {r["anchor_id"]: r["coverage"] for r in evidence.coverage(anchors, spans, ["source"]).collect()}
    assert got == {1: pytest.approx(10 / 12), 2: 0.0}
    groups = spark.createDataFrame([(0, 1, "s"), (0, 1, "z"), (0, 2, "y")], "case_id long, group_id long, source string")
    hits = spark.createDataFrame([(0, "s")], "case_id long, source string")
    assert evidence.group_recall(hits, groups).first()["recall"] == 0.5


def test_two_rules_of_merging(spark):
    spans = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 8, 12)], "k long, start_char long, end_char long")
    strict = sorted((r["start_char"], r["end_char"]) for r in evidence.merged(spans, ["k"], touching=False).collect())
    loose = sorted((r["start_char"], r["end_char"]) for r in evidence.merged(spans, ["k"], touching=True).collect())
    assert strict == [(0, 5), (5, 12)] and loose == [(0, 12)]


def test_merged_evidence_conflict(spark):
    schema = "k long, start_char int, end_char int, content string, rank int"
    good = spark.createDataFrame([(1, 0, 6, "abcdef", 2), (1, 3, 8, "defgh", 1), (1, 4, 5, "e", 3)], schema)
    row = evidence.merged_evidence(good, ["k"]).first()
    assert (row["content"], row["start_char"], row["end_char"], row["rank"], row["conflict"]) == ("abcdefgh", 0, 8, 1, False)
    bad = spark.createDataFrame([(1, 0, 6, "abcdef", 1), (1, 3, 8, "dXfgh", 2)], schema)
    assert evidence.merged_evidence(bad, ["k"]).first()["conflict"]


def test_family_bootstrap(spark):
    rows = [("one", "a", "left", 0.0), ("one", "a", "right", 1.0), ("one", "b", "left", 0.0), ("one", "b", "right", 1.0), ("two", "c", "left", 1.0), ("two", "c", "right", 1.0)]
    families = stats.family_means(spark.createDataFrame(rows, "family_id string, case_id string, arm string, value double"))
    summary = stats.paired_summary(families).first()
    assert (summary["delta"], summary["wins"], summary["ties"]) == (0.5, 1, 1)
    ends = stats.bootstrap(families, 1000).first()
    assert (ends["low"], ends["high"]) == (0.0, 1.0)
    with pytest.raises(ValueError):
        stats.family_means(spark.createDataFrame(rows[:1], "family_id string, case_id string, arm string, value double"))


@pytest.mark.parametrize("most", [0, 2_000_000])
def test_bootstrap_never_broadcasts_its_draws(spark, monkeypatch, most):
    """Resamples look few to the planner, but each of their rows stands for as many draws as there are families."""
    monkeypatch.setattr(stats, "BROADCAST_FAMILIES", most, raising=False)
    families = spark.range(5000).select(F.col("id").alias("family_id"), (F.col("id") % 7).cast("double").alias("delta"))
    plans = stats.bootstrap(families, 1000)._jdf.queryExecution().executedPlan().toString()
    assert ("SortMergeJoin" in plans) == (not most) and ("[family#" in plans) and "BuildLeft" not in plans.split("md5")[0]


def test_kappa(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "first int, second int")
    row = stats.weighted_kappa(pairs([(0, 0), (3, 2)])).first()
    assert (row["exact"], row["kappa"]) == pytest.approx((0.5, 6 / 7))
    assert stats.weighted_kappa(pairs([(1, 1), (1, 1)])).first()["kappa"] is None


def test_calibration(spark):
    rows = [(f"i{k}", f"f{k}", "calibration", k % 2 == 0, k % 4 == 0) for k in range(40)]
    schema = "id string, family_id string, split string, human_pass boolean, judge_pass boolean"
    row = stats.calibration(spark.createDataFrame(rows, schema)).first()
    assert (row["tp"], row["fp"], row["tn"], row["fn"]) == (10, 0, 20, 10) and "too_few_cases" in row["blockers"]
    with pytest.raises(ValueError):
        stats.calibration(spark.createDataFrame([*rows, ("x", "f1", "dev", True, True)], schema))


def test_exact_test_and_power():
    assert [stats.critical_minority(n) for n in (0, 5, 6, 10)] == [-1, -1, 0, 1]
    assert stats.paired_power(50, 0.0, 0.3) < 0.05 < stats.paired_power(200, 0.2, 0.3)
    # all outcomes of six families, each a win, a loss or a draw
    share = {1: 0.45, -1: 0.15, 0: 0.4}
    total = 0.0
    for outcome in itertools.product(share, repeat=6):
        wins, losses = outcome.count(1), outcome.count(-1)
        tail = sum(math.comb(wins + losses, k) for k in range(losses + 1)) / 2 ** (wins + losses)
        if wins > losses and 2 * tail <= 0.05:
            total += math.prod(share[o] for o in outcome)
    assert stats.paired_power(6, 0.3, 0.6) == pytest.approx(total) and stats.paired_power(9, 0, 0) == 0


def test_critical_minorities_of_a_table(spark):
    got = stats.critical_minorities(spark.range(0, 300, 7).withColumnRenamed("id", "discordant")).collect()
    assert [r["critical"] for r in got] == [stats.critical_minority(r["discordant"]) for r in got]


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(5)
    groups = {"even": rng.normal(0, 1, 30_000), "ties": rng.integers(0, 3, 20_000).astype(float), "one": np.array([7.0]), "two": np.array([1.0, 2.0]), "hot": np.r_[np.full(9000, 5.0), rng.normal(5, 1e-6, 9000)]}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("none", None), ("two", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    points = [0.0, 0.01, 0.5, 0.95, 1.0]
    got = {r["g"]: [r[f"p{i}"] for i in range(5)] for r in stats.percentiles(df, "v", points, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert got[g] == pytest.approx(np.percentile(x, [100 * p for p in points]).tolist(), abs=1e-12), g
    assert stats.percentiles(df, "v", [0.5], []).first()["p0"] == pytest.approx(np.median([v for _, v in rows if v is not None]))
    assert stats.percentiles(df.limit(0), "v", [0.5], ["g"]).collect() == []


def test_split_plan(spark):
    groups = spark.createDataFrame([("a", 3, True), ("b", 2, False), ("c", 2, None), ("d", 9, False), ("e", 0, False)], "group string, families long, seen boolean")
    plan = {r["group"]: r["split"] for r in stats.plan_splits(groups.repartition(3), {"dev": 3, "validation": 2, "test": 2}, seed=1).collect()}
    assert plan["a"] == "dev" and plan["d"] is None and {plan["b"], plan["c"]} == {"validation", "test"} and plan["e"]
    assert stats.plan_splits(groups.limit(0), {"dev": 3, "validation": 2, "test": 2}, 1).collect() == []
    with pytest.raises(ValueError):
        stats.plan_splits(groups, {"dev": 1}, 1)


def test_ledger(spark):
    entries, before = [], ""
    for i in range(4):
        e = stats.ledger_entry(before, f"p{i}")
        entries.append((1, i, e["previous"], "changed" if i == 2 else e["payload"], e["sha"]))
        before = e["sha"]
    df = spark.createDataFrame(entries, "ledger_id long, seq long, previous string, payload string, sha string")
    assert [r["seq"] for r in stats.chained(df).where("broken").collect()] == [2]


def test_answers(spark):
    df = spark.createDataFrame([(1, "The  cat, sat!", ["a cat sat", "dog"]), (2, "", [""]), (3, "cat cat", ["cat"])], "id long, prediction string, aliases array<string>")
    got = {r["id"]: (r["f1"], r["em"]) for r in answers.answer_scores(df).collect()}
    assert got[1] == (1.0, 1.0) and got[2] == (1.0, 1.0) and got[3] == (pytest.approx(2 / 3), 0.0)
    raw = ['{"predicted_answer":"x","predicted_answerable":true,"predicted_support_idxs":[1]}', "```json\n{}\n```", None, "no"]
    out = spark.createDataFrame([(r,) for r in raw], "r string").select(answers.parsed_prediction("r").alias("p")).select("p.*").collect()
    assert (out[0]["answer"], out[0]["answerable"], out[0]["support"]) == ("x", True, [1]) and all(r["error"] for r in out[1:])


def test_budgets_withhold_what_goes_over(spark):
    df = spark.createDataFrame([(1, i, 10) for i in range(1, 6)], "run_id long, seq long, tokens long")
    rows = agent.budgeted(df, {"tokens": 25}, {"tokens": F.col("tokens")}).orderBy("seq").collect()
    assert [(r["used_tokens"], r["over"], r["delivered"]) for r in rows] == [(10, False, True), (20, False, True), (30, True, False), (40, True, False), (50, True, False)]


def test_agent_loop():
    replies = iter([{"tool_calls": [{"name": "search", "arguments": {"query": "x"}}, {"name": "nope"}]}, {"content": "done"}])
    run = agent.run_agent("q?", lambda m: next(replies), {"search": lambda query: [{"chunk_id": "c1"}]})
    assert (run.stop_reason, run.answer, [e["error"] for e in run.events]) == ("final", "done", [None, "unknown tool: nope"])
    always = {"tool_calls": [{"name": "search", "arguments": {"query": "x"}}]}
    seen = []
    run = agent.run_agent("q?", lambda m: seen.append(len(m)) or always, {"search": lambda query: []}, max_turns=4)
    assert run.stop_reason == "max_turns" and len(run.events) == 4
    assert agent.run_agent("q?", lambda m: always, {"search": lambda query: []}, caps={"calls": 2}).stop_reason == "budget"
    assert agent.run_agent("q?", lambda m: 1 / 0, {}).stop_reason == "error"


def test_bootstrap_query_takes_the_reference_number_of_resamples(spark, sf):
    from tarn.operators import stats
    from tarn.plans.statistics import _six, _trials, bootstrap_ci

    want = _six(stats.bootstrap(stats.family_means(_trials(spark, sf)), resamples=10_000), "delta", "low", "high")
    assert bootstrap_ci(spark, sf).collect() == want.collect()


def test_coverage_sweep_equals_counting_places(spark):
    """Random spans, small blocks: every place of an anchor is looked at."""
    rng = random.Random(9)
    spans = [(d, a, a + rng.randint(-2, 30)) for d in range(6) for a in (rng.randint(-3, 120) for _ in range(rng.randint(0, 14)))]
    anchors = [(k, d, a, a + rng.randint(1, 40)) for k, (d, a) in enumerate((rng.randint(0, 7), rng.randint(0, 120)) for _ in range(80))]
    i = spark.createDataFrame(spans, "source int, start_char long, end_char long")
    a = spark.createDataFrame(anchors, "anchor_id int, source int, start_char long, end_char long")
    want = {k: sum(any(x <= p < y and x >= 0 for s, x, y in spans if s == d) for p in range(start, end)) for k, d, start, end in anchors}
    for width in (7, 50, 1 << 16):
        got = {r["anchor_id"]: (r["covered"], round(r["coverage"], 9)) for r in evidence.coverage(a, i, ["source"], width=width).collect()}
        assert got == {k: (want[k], round(want[k] / (end - start), 9)) for k, _, start, end in anchors}
    bad = spark.createDataFrame([(1, 1, 5, 5)], "anchor_id int, source int, start_char long, end_char long")
    with pytest.raises(Exception, match="0 <= start < end"):
        evidence.coverage(bad, i, ["source"]).collect()
    assert evidence.coverage(a.limit(0), i, ["source"]).count() == 0


def test_coverage_of_one_crowded_key(spark):
    """100,000 spans and 20,000 anchors of one source: no pair of them is formed."""
    i = spark.range(100_000).selectExpr("'s' AS source", "id * 7 AS start_char", "id * 7 + 3 AS end_char")
    a = spark.range(20_000).selectExpr("id AS anchor_id", "'s' AS source", "id * 35 AS start_char", "id * 35 + 35 AS end_char")
    out = evidence.coverage(a, i, ["source"])
    assert out.where("covered = 15").count() == 20_000
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString().split("Union")[-1]


def test_first_full_rank_equals_trying_every_depth(spark):
    rng = random.Random(3)
    hits = [(q, r + 1, rng.randint(0, 2), a, a + rng.randint(0, 25)) for q in range(20) for r, a in enumerate(rng.randint(0, 40) for _ in range(12))]
    anchors = [(q, k, rng.randint(0, 2), a, a + rng.randint(1, 18)) for q in range(22) for k, a in enumerate(rng.randint(2, 40) for _ in range(2))]
    h = spark.createDataFrame(hits, "query_id int, rank int, source int, start_char long, end_char long")
    a = spark.createDataFrame(anchors, "query_id int, anchor_id int, source int, start_char long, end_char long")
    want = {}
    for q in range(22):
        own = [(s, p) for x, _, s, b, e in anchors if x == q for p in range(b, e)]
        full = [d for d in range(1, 13) if all(any(x == q and r <= d and t == s and b <= p < e for x, r, t, b, e in hits) for s, p in own)]
        want[q] = min(full, default=None)
    assert {r["query_id"]: r["rank"] for r in evidence.first_full_rank(h, a, ["source"]).collect()} == want
    assert any(v for v in want.values())


def test_fingerprints_fold_fully(spark):
    from tarn.functions.text import query_fingerprint

    df = spark.createDataFrame([("Straße  \u3000NO",), (" STRASSE\tno\n",), ("strase no",), (None,), ("",)], "q string")
    a, b, c, none, empty = (r[0] for r in df.select(query_fingerprint(F.col("q"))).collect())
    assert a == b != c and none is None and empty is not None


def test_a_matrix_must_be_whole(spark):
    queries = spark.range(3).withColumnRenamed("id", "query_id")
    rows = [("a", 0, 0.0), ("a", 1, 1.0), ("a", 2, None), ("b", 0, 1.0), ("b", 1, 1.0), ("b", 2, 1.0), ("c", 0, 1.0)]
    df = lambda r: spark.createDataFrame(r, "arm string, query_id long, value double")
    out = stats.query_bootstrap(df(rows), queries, "a", "b", resamples=1000).first()
    assert (out["families"], out["delta"], out["wins"], out["ties"], out["losses"]) == (2, 0.5, 1, 1, 0) and 0 <= out["low"] <= out["high"] <= 1
    for bad in (rows[1:], [*rows, rows[0]], [*rows, ("a", 9, 1.0)]):
        with pytest.raises(ValueError, match="not whole"):
            stats.query_bootstrap(df(bad), queries, "a", "b", resamples=1000)


def test_titles_and_origins_of_merged_evidence(spark):
    schema = "k long, start_char int, end_char int, content string, rank int, chunk_id string, title string"
    rows = [(1, 4, 8, "efgh", 1, "c2", "t"), (1, 0, 6, "abcdef", 2, "c1", "t"), (1, 8, 9, "i", 3, "c3", "t")]
    got = sorted((r["start_char"], r["origins"], r["conflict"]) for r in evidence.merged_evidence(spark.createDataFrame(rows, schema), ["k"]).collect())
    assert got == [(0, ["c1", "c2"], False), (8, ["c3"], False)]
    for title in ("u", None):
        odd = [(*rows[0][:-1], title), *rows[1:]]
        assert [r["conflict"] for r in evidence.merged_evidence(spark.createDataFrame(odd, schema), ["k"]).orderBy("start_char").collect()] == [True, False]


def test_shortfalls(spark):
    from tarn.operators import runs

    rows = spark.createDataFrame([(1, "m", "ok", 0.5), (2, "m", "ok", 1.0), (3, "m", "error", None), (4, "m", "ok", None)], "case_id long, method string, status string, coverage double")
    facets = spark.createDataFrame([(1, "m", "b", False), (1, "m", "a", None), (1, "m", "c", True), (2, "m", "a", True)], "case_id long, method string, facet string, satisfied boolean")
    got = {r["case_id"]: r["missing_facets"] for r in runs.shortfalls(rows, facets).collect()}
    assert got == {1: ["a", "b"], 3: []}
