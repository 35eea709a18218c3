"""Notes, chunks, context, citations, snapshots, the engine and its command line."""

import io
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn import cli
from tarn.api import Engine
from tarn.operators import chunking, context, vector
from tarn.operators.vector import EmbeddingSpec
from tarn.sources import datasets, notes


def chunks(text, size, overlap=0, count=len):
    return [(r[4], r[5], r[6]) for r in chunking.chunk_note("a.md", "t", text, count, size, overlap)]


def test_known_chunks():
    assert chunks("abcdefghij", 4, 1) == [("abcd", 0, 4), ("defg", 3, 7), ("ghij", 6, 10)]
    assert [c for c, _, _ in chunks("aa\n\nbbbb\n\ncc", 8)] == ["aa\n\n", "bbbb\n\ncc"]
    assert chunks("", 8) == [("", 0, 0)]


def test_sections():
    text = "intro\n# A\nx\n## B\ny\n```\n# not a heading\n```\nTitle\n===\nz\n## B\n- one\n    # no\n"
    rows = chunking.chunk_note("a.md", "t", text, len, 500, 0)
    assert [tuple(r[7]) for r in rows] == [(), ("A",), ("A", "B"), ("Title",), ("Title", "B")]
    assert "".join(r[4] for r in rows) == text
    front = chunking.sections("---\na: b\n---\ntext\n# H\n", "o")
    assert [s.path for s in front] == [(), ("H",)] and front[0].blocks[0].kind == "metadata"


def test_identities():
    a = chunking.chunk_note("a.md", "t", "# A\nx\n# B\ny\n# B\ny\n", len, 50, 0)
    b = chunking.chunk_note("a.md", "t", "# A\nedited\n# B\ny\n# B\ny\n", len, 50, 0)
    assert [r[8] for r in a] == [r[8] for r in b] and len({r[8] for r in a}) == 3
    assert a[0][8] != chunking.chunk_note("b.md", "t", "# A\nx\n", len, 50, 0)[0][8]


MARKUP = st.sampled_from(["#", "##", " ", "  ", "    ", "\t", "-", "1.", "*", "```", "~~~", "---", "===", "...", ".", "?!", "|", "\n", "\r\n", "\n\n", "a", "bc", "é", "😀", "日"])


@settings(max_examples=300, deadline=None)
@given(st.lists(MARKUP, max_size=60).map("".join), st.integers(1, 30), st.data())
def test_chunks_cover_any_note(text, size, data):
    """Whatever the text: slices of it, in order, without gaps, within the budget and the overlap."""
    overlap = data.draw(st.integers(0, size - 1))
    found = chunks(text, size, overlap)
    starts, ends = [a for _, a, _ in found], [b for _, _, b in found]
    assert [text[a:b] for _, a, b in found] == [c for c, _, _ in found]
    assert starts[0] == 0 and ends[-1] == len(text) and all(len(c) <= size for c, _, _ in found)
    assert all(a <= before and before - a <= overlap and b > before for a, b, before in zip(starts[1:], ends[1:], ends, strict=False))
    spans = chunking.blocks(text)
    assert [b.start for b in spans[1:]] == [b.end for b in spans[:-1]] and "".join(text[b.start : b.end] for b in spans) == text
    assert all(text[b.start - 1] in "\r\n" for b in spans[1:])


def test_blocks_by_kind():
    text = "---\nk: v\n---\n\npara\nmore\n# H1 #\n- a\n\n  b\n- c\n\nout\n```x\n# no\n``\n````\n\n    ind\n\n\tind\ntext\nover\n--\n"
    assert [(b.kind, b.level, b.heading, text[b.start : b.end]) for b in chunking.blocks(text)] == [
        ("metadata", 0, "", "---\nk: v\n---\n\n"),
        ("paragraph", 0, "", "para\nmore\n"),
        ("heading", 1, "H1", "# H1 #\n"),
        ("list", 0, "", "- a\n\n  b\n- c\n\n"),
        ("paragraph", 0, "", "out\n"),
        ("code", 0, "", "```x\n# no\n``\n````\n\n"),
        ("code", 0, "", "    ind\n\n\tind\n"),
        ("heading", 2, "text over", "text\nover\n--\n"),
    ]
    assert [b.kind for b in chunking.blocks("---\nnever closed\n")] == ["paragraph"]
    assert [b.kind for b in chunking.blocks("\n\n# x\n~~~\nopen")] == ["paragraph", "heading", "code"]


def test_cuts_are_the_coarsest_there_are():
    assert [c for c, _, _ in chunks("one two. three\nfour\n\nfive", 10)] == ["one two. ", "three\n", "four\n\nfive"]
    assert [c for c, _, _ in chunks("- aa\n  bb\n- cc\n- dd\n", 10)] == ["- aa\n  bb\n", "- cc\n- dd\n"]
    assert [c for c, _, _ in chunks("```\na b c\n\nd\n```\n", 8)] == ["```\n", "a b c\n\n", "d\n```\n"]


def test_budgets():
    for bad in ((0, 0), (5, 5), (5, -1), (True, 0)):
        with pytest.raises(ValueError):
            chunking.check_budget(*bad)
    with pytest.raises(ValueError):
        chunks("ab", 1, count=lambda t: 2 * len(t))
    assert chunking.batches([5, 5, 5, 9], 2, 10) == [[0, 1], [2], [3]]


def test_packing(spark):
    schema = "query_id long, index_version string, doc_id long, document_revision string, chunk_id string, start_char int, end_char int, content string, rank int"
    text = "abcdefghijklmnopqrstuvwxyz"
    rows = [(0, "v", 1, "r", "a", 0, 10, text[:10], 1), (0, "v", 2, "r", "b", 0, 20, text[:20], 2), (0, "v", 1, "r", "c", 5, 12, text[5:12], 3), (0, "v", 1, "r", "c", 5, 12, text[5:12], 4), (0, "v", 3, "r", "d", 0, 3, "  \n", 5)]
    hits = context.prepared(spark.createDataFrame(rows, schema))
    assert [r["action"] for r in hits.orderBy("rank").collect()] == ["kept", "kept", "kept", "duplicate", "empty"]
    got = context.pack(hits.where("action = 'kept'"), 15)
    assert [(r["rank"], r["action"]) for r in got.orderBy("rank").collect()] == [(1, "selected"), (2, "budget"), (3, "selected")]
    assert context.status(got).first()["status"] == "ready" and context.Budget().input == 7040
    with pytest.raises(ValueError):
        context.Budget(1000, 900, 100)


def test_overlaps_that_disagree_raise(spark):
    schema = "query_id long, index_version string, doc_id long, document_revision string, start_char int, end_char int, content string, rank int"
    rows = [(0, "v", 1, "r", 0, 6, "abcdef", 1), (0, "v", 1, "r", 4, 8, "efgh", 2)]
    assert [(r["content"], r["parts"]) for r in context.merged(spark.createDataFrame(rows, schema)).collect()] == [("abcdefgh", 2)]
    odd = spark.createDataFrame([rows[0], (0, "v", 1, "r", 4, 8, "xfgh", 2)], schema)
    with pytest.raises(Exception, match="conflicting overlap"):
        context.merged(odd).collect()


def test_answers_are_strict(spark):
    good = '{"status":"answered","claims":[{"text":"c","source_ids":["S1"]}],"missing_information":[]}'
    bad = ['{"status":"a","status":"b","claims":[],"missing_information":[]}', "```json\n{}\n```", good.replace('"c"', "NaN"), good[:-1] + ',"x":1}', "[]", ""]
    assert context.parse_answer(good)["claims"][0]["source_ids"] == ["S1"]
    for text in bad:
        with pytest.raises(context.AnswerError):
            context.parse_answer(text)
    out = spark.createDataFrame([(t,) for t in [good, *bad, None]], "t string").select(context.parsed_answer("t").alias("p")).collect()
    assert out[0]["p"]["error"] is None and all(r["p"]["answer"] is None and r["p"]["error"] for r in out[1:-1])


def test_citations(spark):
    source = [(1, "S1", "one two two three", 100)]
    quote = lambda s, t: [{"source_id": s, "text": t}]
    claims = [(1, 0, "ok", ["S1"], quote("S1", "one")), (1, 1, "see [S1]", [], []), (1, 2, "x", ["S9"], quote("S9", "one")), (1, 3, "x", ["S1"], quote("S1", "two")), (1, 4, "x", ["S1"], quote("S1", "four")), (1, 5, "x", ["S1"], quote("S2", "one"))]
    c = spark.createDataFrame(claims, "answer_id long, claim_index int, text string, source_ids array<string>, quotes array<struct<source_id:string,text:string>>")
    s = spark.createDataFrame(source, "answer_id long, source_id string, content string, start_char int")
    got = {(r["claim_index"], r["code"]) for r in context.issues(c, s, require_quotes=True).collect()}
    assert got == {(1, "missing_reference"), (1, "inline_reference"), (2, "unknown_source"), (3, "ambiguous_quote"), (4, "quote_not_found"), (5, "quote_not_referenced"), (5, "missing_quote")}
    placed = context.quote_places(c, s).where("start_char IS NOT NULL").collect()
    assert [(r["claim_index"], r["start_char"], r["end_char"]) for r in placed] == [(0, 100, 103)]
    assert context.answer_schema(["S1"])["additionalProperties"] is False


def test_citation_statistics(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    answers = df([(1,), (2,), (3,)], "answer_id long")
    claims = df([(1, 0, ["S1"]), (1, 1, ["S1", "S9"]), (1, 2, []), (2, 0, None)], "answer_id long, claim_index int, source_ids array<string>")
    sources = df([(1, "S1"), (1, "S2")], "answer_id long, source_id string")
    kind = "answer_id long, reviewer string, claim_support array<string>, answer_correct boolean, answer_complete boolean"
    of = lambda *reviews: context.citation_statistics(answers, claims, sources, df(list(reviews), kind))
    rows = {r["answer_id"]: tuple(r)[1:] for r in of((1, "me", ["supported", None, "partial"], True, None)).collect()}
    assert rows[1] == (3, 3, 2, False, pytest.approx(2 / 3), pytest.approx(2 / 3), pytest.approx(2 / 3), 0.5, True, None)
    assert rows[2] == (1, 0, 0, False, None, 0.0, None, None, None, None) and rows[3] == (0, 0, 0, True, None, None, None, None, None, None)
    plain = context.citation_statistics(answers, claims, sources)
    assert {r["support_review_coverage"] for r in plain.collect()} == {None}
    means = {r["measure"]: (r["mean"], r["defined_cases"]) for r in context.citation_means(plain).collect()}
    assert means["supported_claim_rate"] == (None, 0) and means["claim_reference_coverage"] == (pytest.approx(1 / 3), 2)
    for bad in ((1, " ", [None] * 3), (1, "me", [None]), (1, "me", None), (1, "me", ["fine", None, None]), (1, "me", [None, "supported", None]), (2, "me", ["supported"])):
        with pytest.raises(Exception, match="needs"):
            of((*bad, None, None)).collect()


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "notes"
    root.mkdir()
    (root / "a.md").write_text("# Álpha\nfirst ERR_RESET line\n\n## Detail\nmore about cats\n", encoding="utf-8")
    (root / "b c+d.md").write_text("dogs and cats\n", encoding="utf-8")
    (root / "empty.md").write_text("", encoding="utf-8")
    (root / "skip.MD").write_text("not a note")
    (root / "sub").mkdir()
    (root / "sub/x.md").write_text("not entered")
    return root


def test_links_that_lead_out_are_no_notes(spark, folder, tmp_path):
    (tmp_path / "secret.md").write_text("not to be read")
    (tmp_path / "blank.md").write_text("")
    (folder / "out.md").symlink_to(tmp_path / "secret.md")
    (folder / "none.md").symlink_to(tmp_path / "blank.md")
    (folder / "again.md").symlink_to(folder / "a.md")
    assert sorted(r["source"] for r in notes.load_notes(spark, str(folder)).collect()) == ["a.md", "again.md", "b c+d.md", "empty.md"]


def test_notes(spark, folder):
    rows = {r["source"]: (r["title"], r["content"]) for r in notes.stable_notes(spark, str(folder)).collect()}
    assert rows == {"a.md": ("Álpha", "first ERR_RESET line\n\n## Detail\nmore about cats"), "b c+d.md": ("b c+d", "dogs and cats"), "empty.md": ("empty", "")}


def lengths(queries, texts):
    return texts.map(len).astype(float)


def reply(messages):
    return {"content": "yes"}


def vectors(texts):
    return [[float(t.count("cat")), float(t.count("dog")), 1.0] for t in texts]


def test_engine(spark, folder, tmp_path):
    engine = Engine(spark, str(folder), str(tmp_path / "store"), vectors, lambda q, t: t.map(len).astype(float))
    first = engine.index()
    assert first["status"] == "ready" and first["changes"] == {"added": 3} and not first["reused"]
    assert engine.index()["reused"] and engine.status()["active"]["version"] == first["version"]
    assert [r["source"] for r in engine.search("err_reset", "bm25").collect()] == ["a.md"]
    best = engine.search("cat", "semantic", top_k=2).collect()
    assert len(best) == 2 and best[0]["rank"] == 1 and best[0]["score"] >= best[1]["score"]
    assert {r["source"] for r in engine.search("cats", "hybrid", top_k=5).collect()} >= {"a.md", "b c+d.md"}
    assert [r["source"] for r in engine.search("cats", "bm25", source="a.md").collect()] == ["a.md"]
    long_first = engine.search("cats", "bm25", rerank=True).collect()
    assert [len(r["content"]) for r in long_first] == sorted((len(r["content"]) for r in long_first), reverse=True)
    assert [(r["source"], r["start_char"], r["content"]) for r in engine.match("cats").collect()] == [("a.md", 43, "cats"), ("b c+d.md", 9, "cats")]
    assert engine.match("c+d", target="source").count() == 1
    assert engine.read("a.md", 6, 15)["content"] == "ERR_RESET"
    for bad in (lambda: engine.read("zz.md"), lambda: engine.read("a.md", 5, 2), lambda: engine.search("x", "other"), lambda: engine.match(" ")):
        with pytest.raises(ValueError):
            bad()
    (folder / "b c+d.md").write_text("dogs only\n")
    (folder / "new.md").write_text("cats again\n")
    (folder / "empty.md").unlink()
    second = engine.index()
    assert second["changes"] == {"added": 1, "modified": 1, "deleted": 1, "unchanged": 1}
    broken = Engine(spark, str(folder), str(tmp_path / "store"), lambda texts: [[float("nan")]] * len(texts))
    (folder / "new.md").write_text("changed\n")
    with pytest.raises(Exception, match="finite"):
        broken.index()
    assert engine.status()["active"]["version"] == second["version"]
    assert engine.store.cleanup() and engine.status()["active"]["version"] == second["version"]
    with engine.store.writer(), pytest.raises(RuntimeError):
        engine.index()
    replies = iter([{"tool_calls": [{"name": "search", "arguments": {"query": "cats", "mode": "bm25"}}]}, {"content": "yes"}])
    run = engine.ask("cats?", lambda m: next(replies))
    assert run.answer == "yes" and run.events[0]["result"]


def test_a_store_takes_over_a_lapsed_lock(spark, tmp_path):
    from tarn.operators.lifecycle import Store

    store = Store(spark, f"file://{tmp_path}/s", lease_s=0.05)
    store.files.create("writer.lock", json.dumps({"token": "dead", "until": 0}).encode())
    with store.writer():
        assert store.files.exists("writer.lock")
    assert not store.files.exists("writer.lock") and store.active() is None
    with pytest.raises(ValueError, match="no ready"):
        store.records()


def _chunks(spark, texts):
    rows = [(f"c{i}", f"d{i}", f"d{i}.md", "r", t, f"k{t}", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, source string, document_revision string, content string, embedding_key string, chunk_index int")


def test_what_is_stored_is_verified(spark, tmp_path):
    from tarn.operators import lifecycle

    store = lifecycle.Store(spark, str(tmp_path / "s"))
    embed = lambda df: df.withColumn("embedding", F.array(F.length("content").cast("double"), F.lit(1.0)))
    first = store.build(_chunks(spark, ["a", "bb", "bb"]), embed, {"size": 1})
    assert store.loaded().count() == 3 and store.vectors().count() == 2
    assert [r["source"] for r in store.scan().collect()] == ["d0.md", "d1.md", "d2.md"]
    assert store.build(_chunks(spark, ["a", "bb", "bb"]), embed, {"size": 1})["reused"]
    for broken in ([0.0, 0.0], [1.0], [float("nan"), 1.0], None):
        bad = lambda df, v=broken: df.withColumn("embedding", F.lit(None).cast("array<double>") if v is None else F.array(*map(F.lit, v)))
        with pytest.raises(ValueError, match="stored vector"):
            store.build(_chunks(spark, ["a", "bb", f"new{broken}"]), bad, {"size": 1})
        assert store.active()["version"] == first["version"]
    spark.createDataFrame([("ka", [9.0, 9.0])], "embedding_key string, embedding array<double>").write.mode("append").parquet(store.files.path("vectors"))
    with pytest.raises(ValueError, match="ambiguous"):
        store.build(_chunks(spark, ["a", "bb", "bb"]), embed, {"size": 1})
    assert len(store.cleanup()) == 4 and {b["status"] for b in store.status()["builds"]} == {"ready"}


def _lengths(df):
    return df.withColumn("embedding", F.array(F.length("content").cast("double"), F.lit(1.0)))


def test_a_lapsed_writer_does_not_publish(spark, tmp_path):
    from tarn.operators.lifecycle import Store

    root = str(tmp_path / "s")
    slow, quick = Store(spark, root, lease_s=0.0), Store(spark, root)
    made = {}

    def taken_over(df):  # the lease is over; another writer builds while this one's model works
        made.update(quick.build(_chunks(spark, ["a", "ccc"]), _lengths, {"size": 2}))
        return _lengths(df)

    with pytest.raises(RuntimeError, match="taken the store over"):
        slow.build(_chunks(spark, ["a", "bb"]), taken_over, {"size": 1})
    assert quick.active()["version"] == made["version"] and sorted(b["status"] for b in quick.status()["builds"]) == ["failed", "ready"]
    assert [r["content"] for r in quick.scan().collect()] == ["a", "ccc"]
    with quick.writer():
        number, last = quick.head()
        with pytest.raises(RuntimeError, match="published meanwhile"):
            quick._commit(number - 1, {"version": "late"})
        assert quick.head() == (number, last)


def test_a_lease_is_renewed(spark, tmp_path):
    from tarn.operators.lifecycle import Store

    store, seen = Store(spark, str(tmp_path / "s")), []
    with store.writer():
        seen.append(store._lock()["until"])
        store._renew()
        assert store._lock()["until"] > seen[0]


def test_vectors_shrink(spark, tmp_path):
    from tarn.operators.lifecycle import Store

    store = Store(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="no ready"):
        store.compact()
    first = store.build(_chunks(spark, ["a", "bb", "ccc"]), _lengths, {})
    second = store.build(_chunks(spark, ["a", "dddd"]), _lengths, {})
    store.compact()
    assert store.vectors().count() == 4 and store.loaded(first["version"]).count() == 3
    assert store.expire() == [first["version"]] and store.expire() == []
    done = store.compact()
    assert sorted(r[0] for r in store.vectors().collect()) == ["ka", "kdddd"] and done["bytes_after"] < done["bytes_before"]
    assert store.cleanup() == [first["version"]] and len(store.files.names("log")) == 1
    assert [f for f in store.files.folders("") if f.startswith("vectors")] == [done["vectors"]]
    assert store.loaded().count() == 2 and store.active()["version"] == second["version"]
    third = store.build(_chunks(spark, ["a", "bb"]), _lengths, {})
    assert not third["reused"] and sorted(r[0] for r in store.vectors().collect()) == ["ka", "kbb", "kdddd"]


def test_live_notes_are_those_of_the_snapshot(spark, folder, tmp_path):
    root, other = str(tmp_path / "store"), tmp_path / "other"
    other.mkdir()
    (other / "x.md").write_text("cats elsewhere\n")
    assert Engine(spark, str(other), root).match("cats").count() == 1  # no index is needed
    with pytest.raises(ValueError, match="none was indexed"):
        Engine(spark, None, root).match("cats")
    Engine(spark, str(folder), root).index()
    saved = Engine(spark, None, root)
    assert saved.match("cats").collect() == Engine(spark, f"file://{folder}/", root).match("cats").collect() != []
    for use in (lambda e: e.match("cats"), lambda e: e.read("x.md")):
        with pytest.raises(ValueError, match="not those of the active"):
            use(Engine(spark, str(other), root))
    Engine(spark, str(other), root).index()
    assert [r["source"] for r in saved.match("cats").collect()] == ["x.md"]


def test_search_reads_the_buckets_of_its_terms(spark, folder, tmp_path):
    engine = Engine(spark, str(folder), str(tmp_path / "store"))
    engine.index()
    plan = engine.store.postings(["cats"])._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [,cats])" in plan
    row = engine.search("cats", "lexical", top_k=1).first()
    assert row["method"] == "bm25" and engine.search("!!", "bm25").collect() == []
    other = Engine(spark, str(folder), str(tmp_path / "store"), vectors, spec=EmbeddingSpec("m", 3))
    with pytest.raises(ValueError, match="another kind"):
        other.search("cats", "semantic")


def test_hits_without_a_record_raise(spark):
    records = spark.createDataFrame([("a", 1)], "chunk_id string, x int")
    hits = spark.createDataFrame([(0, "a", 1), (0, "z", 2)], "query_id long, chunk_id string, rank int")
    assert vector.backed(hits.where("rank = 1"), records, "chunk_id").count() == 1
    for bad in (hits, hits.where("rank = 1").unionByName(hits.where("rank = 1"))):
        with pytest.raises(Exception, match="no record backs hit z|two hits of a"):
            vector.backed(bad, records, "chunk_id").collect()


def test_command_line(spark, folder, tmp_path):
    def call(*args):
        out = io.StringIO()
        return cli.main(["--notes", str(folder), "--root", str(tmp_path / "s"), "--json", *args], spark, out), out.getvalue()

    assert call("search", "cats")[0] == 2  # no snapshot yet
    assert call("index")[0] == 0
    code, out = call("match", "cats", "--top-k", "1")
    assert code == 0 and json.loads(out)["source"] == "a.md"
    assert json.loads(call("search", "dogs")[1])["source"] == "b c+d.md"
    assert json.loads(call("status")[1])["active"]["status"] == "ready"
    assert call("search", "cats", "--mode", "semantic")[0] == 2 and call("ask", "why")[0] == 2
    models = ("--embedder", "tests.test_knowledge:vectors", "--scorer", "tests.test_knowledge:lengths", "--chat", "tests.test_knowledge:reply")
    assert call(*models, "index")[0] == 0
    code, out = call(*models, "search", "cats", "--mode", "hybrid", "--rerank", "--top-k", "2")
    assert code == 0 and [json.loads(x)["method"] for x in out.splitlines()] == ["hybrid+rerank"] * 2
    assert json.loads(call(*models, "ask", "cats?")[1]) == {"answer": "yes", "calls": 0, "stop_reason": "final"}
    assert call("--embedder", "tests.test_knowledge:nothing", "status")[0] == 2


def test_datasets(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"id": 1, "t": "é"}\n\n{"id": 2, "t": null}\n')
    assert [(r["id"], r["t"]) for r in datasets.read_jsonl(spark, str(path), "id long, t string").collect()] == [(1, "é"), (2, None)]
    for bad in ('{"id": 1, "id": 2}', '{"id": NaN}', "[1]"):
        path.write_text(bad + "\n")
        with pytest.raises(ValueError):
            datasets.read_jsonl(spark, str(path), "id long")
    path.write_text('{"id": 1}\n\n{"id": 2}\n{"id": 3, "id": 4}\n')
    with pytest.raises(ValueError, match=r"x\.jsonl:4: a key occurs twice"):
        datasets.read_jsonl(spark, str(path), "id long")
    root = tmp_path / "set"
    datasets.save({"q": spark.range(5), "c": spark.range(3)}, str(root))
    assert datasets.load(spark, str(root))["q"].count() == 5
    with pytest.raises(FileExistsError):
        datasets.save({"q": spark.range(5)}, str(root))
    next(root.rglob("*.parquet")).write_bytes(b"x")
    with pytest.raises(ValueError):
        datasets.load(spark, str(root))
    report = tmp_path / "r.md"
    datasets.write_report(spark.createDataFrame([(1, None), (2, 0.5)], "a int, b double"), str(report), "markdown")
    assert report.read_text() == "| a | b |\n|---|---|\n| 1 | n/a |\n| 2 | 0.5000 |\n"
    with pytest.raises(FileExistsError):
        datasets.write_report(spark.range(1), str(report), "json")
    frozen = datasets.frozen(spark.createDataFrame([(1, "dev")], "query_id long, split string"), spark.createDataFrame([(1, "test")], "query_id long, split string"))
    assert frozen.first()["split"] == "test"


def test_plans_push_down(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from tarn.operators import bm25

    plan = bm25.tokenised(docs.where(F.col("source") == "src1").select("doc_id", "text"), F.col("text")).select("length")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src1)" in plan and "ReadSchema: struct<text:string,source:string>" in plan


def test_external_collections(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "t", "x"), (2, "t", "y")], "doc_id long, title string, text string")
    queries = spark.createDataFrame([(7, "q")], "query_id long, text string")
    good = spark.createDataFrame([(7, 1, 2)], "query_id long, doc_id long, grade int")
    bad = spark.createDataFrame([(7, 1, -1), (8, 1, 1), (7, 9, 1)], "query_id long, doc_id long, grade int")
    found = datasets.import_dataset(corpus.unionByName(corpus.limit(1)), queries.unionByName(queries), bad, str(tmp_path / "bad"))
    assert sorted((r["problem"], r["key"]) for r in found.collect()) == [("bad_grade", "7"), ("document_twice", "1"), ("query_twice", "7"), ("unknown_document", "9"), ("unknown_query", "8")]
    assert not (tmp_path / "bad").exists()
    assert datasets.import_dataset(corpus, queries, good, str(tmp_path / "good")).collect() == []
    assert dict(datasets.load(spark, str(tmp_path / "good"))["qrels"].dtypes)["doc_id"] == "string"
    pairs = datasets.paired_questions(spark.createDataFrame([("2hop__a", True), ("2hop1__a", False), ("3hop__b", True)], "id string, answerable boolean"))
    assert [tuple(r) for r in pairs.select("question_id", "hops", "answerable", "unanswerable").collect()] == [("a", 2, "2hop__a", "2hop1__a")]


def test_a_busy_model_is_asked_again(spark):
    class Busy(Exception):
        def __init__(self, status):
            super().__init__("busy")
            self.status = status

    rows = spark.createDataFrame([("a",), ("bb",)], "content string").coalesce(1)

    def model(status, times):
        left = [times]

        def call(texts):
            left[0] -= 1
            if left[0] >= 0:
                raise Busy(status)
            return [[float(len(t))] for t in texts]

        return call

    for status in (429, 503):
        assert [r["embedding"] for r in chunking.embed(rows, model(status, 2), delay=0.0).collect()] == [[1.0], [2.0]]
    for status, times in ((429, 3), (400, 1)):
        with pytest.raises(Exception, match="busy"):
            chunking.embed(rows, model(status, times), delay=0.0).collect()


def test_rendered_answers(spark):
    claims = [(1, 0, "a *b*", ["S2", "S1"], [("S1", "said <so>")]), (1, 1, "c\x07", ["S2"], []), (2, 0, "bad [S1]", ["S1"], [])]
    c = spark.createDataFrame(claims, "answer_id long, claim_index int, text string, source_ids array<string>, quotes array<struct<source_id:string,text:string>>")
    s = spark.createDataFrame([(a, f"S{i}", "said <so>", 0, f"T{i}", f"f{i}.md") for a in (1, 2) for i in (1, 2)], "answer_id long, source_id string, content string, start_char int, title string, source string")
    answers = spark.createDataFrame([(1, ["when"]), (2, [])], "answer_id long, missing_information array<string>")
    (row,) = context.rendered_answers(answers, c, s.select("answer_id", "source_id", "title", "source"), context.issues(c, s)).collect()
    assert row["answer_id"] == 1
    assert row["markdown"] == "a \\*b\\* [1][2]\n\nc [1]\n\nMissing:\n\n- when\n\nSources:\n\n[1] T2 (f2.md)\n[2] T1 (f1.md)\n   > said &lt;so&gt;"


def test_a_source_filter_opens_one_file(spark, tmp_path):
    """The filter is applied before any file is read, whatever characters a name has."""
    odd = ["plain.md", "a [1] {x}, y*.md", "empty.md", "x+y %41 ü.md", "what?.md"]
    for name in odd:
        (tmp_path / name).write_text("" if name == "empty.md" else f"# T\n\nbody of {name}")
    (tmp_path / "other.txt").write_text("no note")
    (tmp_path / "broken.md").write_bytes(b"\xff\xfe")
    for name in odd:
        found = notes.load_notes(spark, str(tmp_path), name)
        assert [(r["source"], r["content"]) for r in found.collect()] == [(name, "" if name == "empty.md" else f"body of {name}")]
        assert len(notes.note_files(spark, str(tmp_path), name).inputFiles()) == 1
    assert notes.load_notes(spark, str(tmp_path), "other.txt").count() == notes.load_notes(spark, str(tmp_path), "none.md").count() == 0
    engine = Engine(spark, str(tmp_path), str(tmp_path / "store"))
    assert engine.match("body", source="what?.md").count() == 1  # the broken file is not opened
    with pytest.raises(Exception, match="decode"):
        engine.match("body").collect()


def test_lossless_sorts_no_text(spark):
    """A note's text is not carried into the sort of its chunks, and faults are still found."""
    from tarn.operators import chunking

    notes = spark.createDataFrame([("a", "abcdef"), ("b", "abc")], "source string, content string")
    chunks = spark.createDataFrame([("a", 0, 0, 3, "abc"), ("a", 1, 4, 5, "x"), ("b", 0, 0, 3, "abc")], "source string, chunk_index int, start_char int, end_char int, content string")
    out = chunking.lossless(chunks, notes)
    assert sorted(map(tuple, out.collect())) == [("a", 2, 1), ("b", 0, 0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    window = next(line for line in plan.split("\n") if "Window [" in line)
    below = plan.split(window)[1].lstrip("\n").split("\n")[0]
    assert "Project [" in below and "_len" in below and "_body" not in below.split("AS _len")[1]
