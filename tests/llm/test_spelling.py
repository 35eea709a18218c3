"""Spelling variants: automata, one error, halves that many words share, contract rows."""

import random
import re
import zlib
from collections import Counter

import pytest

from tarn.llm.spelling import Automaton, spelling_variants, variants


def near(w, v):
    """Exactly one code point inserted, deleted or replaced."""
    if len(w) == len(v):
        return sum(a != b for a, b in zip(w, v, strict=True)) == 1
    short, long = sorted((w, v), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(n):
    out = {}
    for w in n:
        close = [v for v in n if near(w, v)]
        top = max((n[v] for v in close), default=0)
        form = min(v for v in close if n[v] == top) if close and top >= 2 * n[w] else None
        out[w] = (n[w], len(close), form, top if form else None)
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w] += (root,)
    return out


def test_automaton_numbers_words():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(400)})
    made = Automaton(words)
    for k, w in enumerate(words):
        state, number = made.walk(w, made.start, 0)
        assert made.final[state] and number == k
    assert made.walk("d", made.start, 0) is None
    assert len(made.edges) < sum(map(len, words)) / 2  # equal tails share states
    for w in words[:60] + ["", "abcabcabcabc"]:
        assert {words[i] for i in made.one_error(w, 0) if words[i] != w} >= {v for v in words if near(w, v)}
    assert list(Automaton([]).one_error("abc", 1)) == []


@pytest.mark.parametrize("most", [20_000, 60, 10])
def test_equals_brute_force(spark, most):
    """Two thirds of the words share their first half; with small bounds its other half is cut again and again."""
    rng = random.Random(11)
    n = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 7))): rng.randint(3, 99) for _ in range(150)}
    n |= {"abcabcabcabc" + "".join(rng.choice("abcd") for _ in range(rng.randint(3, 6))): rng.randint(3, 60) for _ in range(300)}
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in variants(spark.createDataFrame(list(n.items()), "word string, n long"), most=most, share=200).collect()}
    assert got == brute(n)


def test_contract_rows(spark):
    rng = random.Random(2)
    letters = ["color", "colour", "colours", "Straße", "STRASSE", "naïve", "naive", "×÷words", "ÀÉÎÕÜ", "tiny", "aaaaab", "aaaaaa", "aaaaa"]
    rows = [(k if k % 7 else None, " ".join(rng.choice(letters) + rng.choice(["", ",", "1", "\n"]) for _ in range(60))) for k in range(40)]
    rows += [(1, None), (2, ""), (3, "日本語 - 12"), (5, "colour"), (5, "colour")]
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    want = brute({w: n for w, n in counts.items() if n >= 3 and len(w) >= 5})
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling_variants(docs).collect()}
    assert got == want and len(want) > 8
    assert spelling_variants(docs.limit(0)).collect() == []
