"""Patterns in linear time, and the trigrams that keep them from other texts."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.operators import exact, trigrams
from tarn.operators.trigrams import TrigramIndex, codes, formula

TEXTS = [(1, "the ERR_RESET came"), (2, "err_reset"), (3, ""), (4, None), (5, "Straße STRASSE"), (6, "ab" * 50_000), (7, "ERR_RE SET"), (7, "ERR_RESET"), (None, "ERR_RESET"), (9, "\u212aKelvin \ufdd0 x")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def test_patterns_end(spark):
    text = spark.createDataFrame([(1, "a" * 200_000 + "b")], "doc_id long, text string")
    start = time.time()
    assert exact.pattern_matches(text, "(a+)+$").count() == 0 and exact.pattern_documents(text, "(a+)+$").count() == 0
    assert time.time() - start < 20


def test_one_dialect(spark, docs):
    for bad in ("(", "(?=x)", r"(x)\1", "a)(b"):
        with pytest.raises(re.error):
            exact.pattern_matches(docs, bad)
        with pytest.raises(re.error):
            exact.pattern_documents(docs, bad)
    spans = lambda p, **k: sorted((r["start_char"], r["end_char"]) for r in exact.pattern_matches(docs.where("doc_id = 9"), p, **k).collect())
    assert spans("x") == [(10, 11)] and spans("k", ignore_case=True) == [(0, 1), (1, 2)]
    assert spans("\ufdd0") == [(8, 9)] and spans("x*") == [(i, i) for i in range(10)] + [(10, 11)]


@pytest.mark.parametrize("pattern", ["ERR_(RESET|LOST)", "(?i)err_reset", "Straße", "(ab){3,}$", "x?", "R.S", "[[:upper:]]_R", r"\QERR_R\E", "E{,5}", "(?i:stra)(ss|ß)e", "ſtrasse"])
@pytest.mark.parametrize("fold", [False, True])
def test_index_equals_a_scan(spark, docs, tmp_path, pattern, fold):
    index = TrigramIndex(spark, str(tmp_path / "index"))
    index.add(docs.where("doc_id < 5 OR doc_id IS NULL"))
    index.add(docs.where("doc_id >= 5"))
    known = docs.where("doc_id IS NOT NULL")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(index.documents(known, pattern, fold).select("doc_id")) == rows(exact.pattern_documents(known, pattern, ignore_case=fold).select("doc_id"))
    assert rows(index.matches(known, pattern, fold)) == rows(exact.pattern_matches(known, pattern, ignore_case=fold))


def test_few_are_opened(spark, docs, tmp_path):
    index = TrigramIndex(spark, str(tmp_path / "index"))
    index.add(docs)
    assert sorted(r[0] for r in index.narrowed(docs, "ERR_RESET").select("doc_id").collect()) == [1, 2, 7, 7]
    assert index.narrowed(docs, "zzz").count() == 0 and index.narrowed(docs, "a|bcd").count() == len(TEXTS)


def test_no_documents(spark, docs, tmp_path):
    index = TrigramIndex(spark, str(tmp_path / "index"))
    index.add(docs.limit(0))
    assert index.documents(docs.limit(0), "abc").count() == 0


def test_formulas_are_bounded():
    many = "|".join(f"{n:03d}word" for n in range(200))
    assert formula(many) is None
    assert 0 < len(trigrams.trigrams_of(formula(f"abc({many})def"))) <= trigrams.MOST
    assert len(trigrams.trigrams_of(formula("".join(map(chr, range(192, 591)))))) <= trigrams.MOST
    assert formula("a.b") is None and formula("[[:alpha:]]abc") is None and formula("(abc)*") is None and formula("(abc)+") is not None


@settings(max_examples=200, deadline=None)
@given(st.text("abcABCßsS", max_size=30), st.text("abcABCßsS", min_size=1, max_size=6))
def test_literals_ask_only_for_what_they_hold(text, word):
    asked = trigrams.trigrams_of(formula(word))
    assert set(asked) <= set(codes(text + word + text))
