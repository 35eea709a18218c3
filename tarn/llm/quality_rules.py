"""Quality rules (operator 1): a short-circuit cascade, in DataFrame functions only.

Each rule is a boolean column over measured features. On a bounded sample each
rule's cost (seconds to evaluate it alone) and selectivity (share it rejects) are
estimated; rules are then tried in the order of rejection per cost, and a row
that one rule rejects is not tried by the next (``CASE WHEN`` evaluates lazily).
The order changes the time, never the verdict.

A rule's cost is its own: the sample's rows are repeated until the rule takes
many times as long as the same job without a rule, and that job's time is taken off.
Features that every row is measured for anyway cost a rule nothing.

Everything runs in the JVM within one narrow pass: a text's words are an array,
its repeated windows are neighbours after a sort of that row's windows.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = "[ \\t\\n\\u000B\\f\\r]+"
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A row passes if ``passes`` is true; null counts as a rejection."""

    name: str
    passes: Column


@dataclass(frozen=True)
class Estimate:
    """Seconds a row and share of rows rejected, as the sample has them."""

    name: str
    cost: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.cost, 1e-9)


def with_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``_words`` and ``_lines`` (those with a word); a null text has none."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.withColumns(
        {
            "_text": text,
            "_words": F.filter(F.split(text, _SPACE), lambda w: w != ""),
            "_lines": F.filter(F.split(text, "\n"), lambda x: F.translate(x, _SPACES, "") != ""),
        }
    )


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once, wherever the optimiser moves it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more, the first included."""

    def windows(w):
        text = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        made = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(text(i).alias("t"), i.alias("i")))
        return F.when(F.size(w) >= 3, F.sort_array(made))

    def places(s):
        again = lambda x, k: (F.get(s, k - 1)["t"] == x["t"]) | (F.get(s, k + 1)["t"] == x["t"])
        return F.sort_array(F.transform(F.filter(s, again), lambda x: x["i"]))

    def covered(p):
        n = F.size(p) - 1
        gaps = F.zip_with(F.slice(p, F.lit(2), n), F.slice(p, F.lit(1), n), lambda b, a: F.least(b - a, F.lit(3)))
        return F.when(n >= 0, F.aggregate(gaps, F.lit(3), lambda total, x: total + x)).otherwise(0)

    return F.coalesce(_let(words, lambda w: _let(windows(w), lambda s: _let(places(s), covered))), F.lit(0))


def base_features(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long).

    ``df`` comes from :func:`with_words`. Sizes are in code points.
    """
    length = F.length("_text")
    return df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.translate("_text", _SPACES, "")).cast("long"),
            "n_symbols": (length - F.length(F.translate("_text", _SYMBOLS, ""))).cast("long"),
            "n_dup_lines": _let(F.col("_lines"), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_words")).cast("long"),
        }
    )


def base_failed() -> Column:
    """Too few words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Rules of the cascade. The shares are of words or of lines with a word."""
    n = F.col("n_words")

    def share(test):
        return F.size(F.filter("_words", test)).cast("long")

    return [
        Rule("symbols", 10 * F.col("n_symbols") <= n),
        Rule("word_length", (F.col("word_chars") >= 2 * n) & (F.col("word_chars") <= 20 * n)),
        Rule("duplicate_lines", 2 * F.col("n_dup_lines") <= F.size("_lines")),
        Rule("shouting", 10 * share(lambda w: (w == F.upper(w)) & (w != F.lower(w))) <= 3 * n),
        Rule("letters", 10 * share(lambda w: w.rlike("\\p{L}")) >= 8 * n),
    ]


def estimate(docs: DataFrame, rules: list[Rule], sample_rows: int = 500, sample_chars: int = 16_384) -> list[Estimate]:
    """Cost and selectivity of each rule on rows that pass the base.

    ``docs``: columns ``doc_id, text``. The sample is the first ``sample_rows``
    rows that a scan meets, of each text ``sample_chars`` characters at most, so its
    size is bounded and only the first files are read. It steers the order of the
    rules and nothing else.
    """
    rows = docs.select(F.left("text", F.lit(sample_chars)).alias("text")).limit(sample_rows).collect()
    if not rows:
        return []
    local = docs.sparkSession.createDataFrame([(r[0],) for r in rows], "text string")
    able = base_features(with_words(local)).where(~base_failed()).coalesce(1).persist()
    try:
        total = able.count()
        shares = able.agg(*[F.count_if(F.coalesce(r.passes, F.lit(False))).alias(f"r{k}") for k, r in enumerate(rules)]).first()
        return [Estimate(r.name, _cost(able, r, total), 1 - shares[k] / max(total, 1)) for k, r in enumerate(rules)]
    finally:
        able.unpersist()


def _cost(rows: DataFrame, rule: Rule, total: int, least: float = 0.05, most: int = 4096) -> float:
    """Seconds a row of one rule, job overhead taken off; zero if it can't be told from it."""
    if not total:
        return 0.0
    times = 1
    while True:
        many = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
        # the copy's number enters both, so neither job can do a row once for all its copies
        own = F.coalesce(rule.passes, F.lit(False)) & (F.col("_copy") > 0)
        with_rule, without = (min(_seconds(many.agg(F.count_if(c))) for _ in range(2)) for c in (own, F.col("_copy") > 0))
        if with_rule - without >= max(least, without / 2) or times >= most:
            return max(0.0, with_rule - without) / (total * times)
        times *= 8


def _seconds(job: DataFrame) -> float:
    began = time.perf_counter()
    job.collect()
    return time.perf_counter() - began


def ordered(rules: list[Rule], estimates: list[Estimate]) -> list[Rule]:
    """Rules by rejection per cost, the most first; equal ones by name."""
    worth = {e.name: e.worth for e in estimates}
    return sorted(rules, key=lambda r: (-worth[r.name], r.name))


def cascade(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``failed_rule``: the first rule, in this order, that rejects; null if none."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(~F.coalesce(rule.passes, F.lit(False)), F.lit(rule.name)).otherwise(verdict)
    return df.withColumn("failed_rule", verdict)


def quality_rules(
    docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 500
) -> DataFrame:
    """Features and verdict of every document, one row per input row.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, failed_rule, kept``. Rows that fail the base
    don't enter the cascade. Null and empty texts have no words and so fail the
    base; whole texts are measured, however long; repeated rows stay repeated; rules
    that are worth the same are tried by name; extra columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    rules = default_rules() if rules is None else rules
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    measured = base_features(with_words(own)).withColumn("base_failed", base_failed())
    found = estimate(own, rules, sample_rows) if len(rules) > 1 else []
    rules = ordered(rules, found) if found else rules
    judged = cascade(measured, [Rule("base", ~F.col("base_failed")), *rules])
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select("doc_id", *columns, "failed_rule", F.col("failed_rule").isNull().alias("kept"))
