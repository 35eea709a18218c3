"""Encoding, decoding and counting against the tokenizer library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tarn.llm.bpe import LEAF_CHARS, LEAF_WORD, Bounded, ByteLevelCounter, WordEndCodec
from tarn.llm.bpe_codec import decode, encode
from tarn.llm.token_count import count_tokens

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
PARTS = "'s ' ll 'll a B é ß 1 ! é ж 日 語 😀 <|endoftext|> the 've e abcabcabc ΑΣ Σ İ !! <|".split() + [" ", "\n", "\u0085", "\x1c", " ", " "]


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


def mixed(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("leaf_chars, leaf_word", [(LEAF_CHARS, LEAF_WORD), (8, 4), (16, 6), (64, 5)])
def test_joins_are_exact(word, leaf_chars, leaf_word):
    codec = WordEndCodec(WORD, leaf_chars, leaf_word)
    for text in mixed(1500, leaf_chars):
        assert ids(codec, text) == word.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("text", ["ab" * 3000, "a" * 5000, "日本語" * 900, "!?" * 2000, "x'll" * 500, "é" * 1999])
def test_long_unsplit_text(word, text):
    codec = WordEndCodec(WORD, 32, 4)
    assert ids(codec, text) == word.encode(text, add_special_tokens=False).ids


def test_every_character(word, byte):
    codec, counter = WordEndCodec(WORD), ByteLevelCounter(BYTE)
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (i < 0x3000 or i % 97 == 0)]
    texts = [f"a{chr(i)}b {chr(i)}1" for i in points]
    for text, w, b in zip(texts, word.encode_batch(texts, add_special_tokens=False), byte.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids(codec, text) == w.ids, repr(text)
        assert counter.count(text) == len(b.ids), repr(text)


def test_counts(byte):
    counter = ByteLevelCounter(BYTE)
    texts = [*mixed(2000, 3), "a" * 4000, "ab" * 2000, "the " * 500, " \n \n  x", "<|endoftext|>" * 3]
    for text, b in zip(texts, byte.encode_batch(texts, add_special_tokens=False), strict=True):
        assert counter.count(text) == len(b.ids), repr(text)


def test_bounded_cache_keeps_frequent_keys():
    made = []
    cache = Bounded(lambda k: made.append(k) or k.upper(), 3)
    for key in ["a", "b", "c", "d", "a", "e", "f", "a", "x" * 99]:
        assert cache[key] == key.upper()
    assert made.count("a") == 1 and len(cache) <= 3


def test_tables(spark, word, byte):
    rows = [(1, "Hello world's end"), (None, "no id"), (3, None), (4, ""), (5, "same"), (5, "same"), (6, "long " * 20_000)]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, ids string, n_tokens int")
    coded = encode(docs, WORD, decoded=True)
    want = sorted((str(i), np.array(e.ids, "<u4").tobytes(), word.decode(e.ids, skip_special_tokens=False)) for (i, t), e in zip(rows, (word.encode(t or "", add_special_tokens=False) for _, t in rows), strict=True))
    assert sorted((str(r[0]), bytes(r[1]), r[2]) for r in coded.collect()) == want
    again = decode(coded.select("doc_id", "ids"), WORD)
    assert sorted((str(r[0]), r[1]) for r in again.collect()) == sorted((a, c) for a, _, c in want)
    counted = count_tokens(docs, BYTE).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in counted) == sorted((str(i), len((t or "").encode()), len(byte.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert encode(docs.limit(0), WORD).collect() == [] and count_tokens(docs.limit(0), BYTE).collect() == []


def test_queries_on_the_fixture(spark, sf, word, byte):
    from tarn.llm.queries import QUERIES

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op3_bpe_codec"](spark, sf).collect():
        e = word.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        text = word.decode(e, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    for r in QUERIES["op5_token_count"](spark, sf).collect():
        n = len(byte.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 1024)


def test_fixture_texts_are_joined_by_tree(spark, word):
    """Under the query's own leaves, joins of texts and of words are common, and exact."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    codec = WordEndCodec(WORD)
    long, joined = 0, 0
    for r in rows:
        before = codec.text_joins
        codec.encode(r["text"])
        long += len(r["text"]) > LEAF_CHARS
        joined += codec.text_joins > before
    assert long > len(rows) / 3 and joined >= long and codec.text_joins > 1000 and codec.word_joins > 100
    texts = sorted((r["text"] for r in rows), key=len)[-60:]
    for t, e in zip(texts, word.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids(codec, t) == e.ids
