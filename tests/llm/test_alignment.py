"""Cross-tokenizer alignment against a plain reading of both libraries' tokens."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tarn.llm.alignment import align, byte_letters, group_numbers, overlaps

TEXTS = [
    (1, "The quick brown fox, jumped over naïve Überläufer."), (2, None), (3, ""), (4, "a▁b"), (5, "  x  y\n\n z <s> <|endoftext|>  "),
    (6, "日本語テキスト 😀😀 \x00\x01 a"), (7, " "), (None, "the the"), (8, "x" * 5000 + " \t y\x1c z ﬁ é é"), (1, "The quick brown fox, jumped over naïve Überläufer."),
    (9, "the the the"), (10, "\n\nmixed\nlines \n of text's"),
]


@pytest.fixture(scope="module")
def files():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows, files):
    """Rows of the contract from whole texts: every pair of tokens is compared."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(files[0]), sentencepiece.SentencePieceProcessor(model_file=files[1])
    a.encode_special_tokens = True
    back = {c: i for i, c in byte_letters().items()}
    made, count = [], Counter()
    for doc_id, text in rows:
        links, groups = [], []
        found = a.encode(" " + (text or ""), add_special_tokens=False)
        a_ids, a_bytes = found.ids, [bytes(back[c] for c in t) for t in found.tokens]
        b_ids = b.encode(text or "")
        b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b_ids, map(b.id_to_piece, b_ids), strict=True)]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            made.append((doc_id, 0, 0, 0, [], ""))
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        at = 0
        for cut in sorted(set(a_ends) & set(b_ends)):
            inside = [[k for k, e in enumerate(ends) if at < e <= cut] for ends in (a_ends, b_ends)]
            groups.append("|".join(",".join(str(ids[k]) for k in x) for x, ids in zip(inside, (a_ids, b_ids), strict=True)))
            links += [(a_ids[i], b_ids[j]) for i in inside[0] for j in inside[1] if a_ends[i] - len(a_bytes[i]) < b_ends[j] and b_ends[j] - len(b_bytes[j]) < a_ends[i]]
            at = cut
        count.update(set(links))
        made.append((doc_id, len(a_ids), len(b_ids), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = defaultdict(int)
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    return [(d, na, nb, ng, len(x), sum(count[p] == top[p[0]] for p in x), sum(count[p] for p in x), sha) for d, na, nb, ng, x, sha in made]


@pytest.mark.parametrize("chunk_chars", [4_000_000, 50])
def test_equals_brute_force(spark, sf, files, chunk_chars):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id < 25")
    docs = docs.unionByName(spark.createDataFrame(TEXTS, "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    named = docs.selectExpr("*", "1 AS chunk", "'x' AS pairs", "2 AS n_a")
    got = [tuple(r) for r in align(named, *files, chunk_chars=chunk_chars).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows, files), key=key)


def test_empty_table(spark, files):
    assert align(spark.createDataFrame([], "doc_id long, text string"), *files).collect() == []


def test_intervals_and_gaps():
    """A: [0,2) [2,5) [5,6); B: [0,1) [1,3) [3,5) [5,6)."""
    first, last = overlaps(np.array([2, 5, 6]), np.array([1, 3, 5, 6]))
    assert (first.tolist(), last.tolist()) == ([0, 1, 3], [1, 2, 3])
    of_a, of_b = group_numbers(first, last, 4)
    assert (of_a.tolist(), of_b.tolist()) == ([0, 0, 1], [0, 0, 0, 1])
