"""Evidence for an answer: preparation, merging, packing, citations."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.lazy import pandas_udf
from tarn.operators.evidence import merged_evidence

KEYS = ["query_id", "index_version", "doc_id", "document_revision"]


@dataclass(frozen=True)
class Budget:
    """Tokens of the context window; what is left for input is ``input``."""

    window: int = 8192
    output: int = 1024
    margin: int = 128

    def __post_init__(self):
        if min(self.window, self.output) < 1 or self.margin < 0 or self.input < 1:
            raise ValueError("the budget leaves no room for input")

    @property
    def input(self) -> int:
        return self.window - self.output - self.margin


def prepared(hits: DataFrame) -> DataFrame:
    """Adds ``action``: ``empty`` for blank texts, ``duplicate`` for a chunk seen before, else ``kept``."""
    blank = F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s", " ")) == ""
    order = Window.partitionBy("query_id", "index_version", "chunk_id", blank).orderBy("rank")
    nth = F.row_number().over(order)
    return hits.withColumn("action", F.when(blank, "empty").when(nth > 1, "duplicate").otherwise("kept"))


def verified(hits: DataFrame, records: DataFrame) -> DataFrame:
    """Hits that are snapshot records as stored; any other raises before it can be cited.

    Both: ``index_version, chunk_id, doc_id, document_revision, start_char,
    end_char, content``.
    """
    odd = unverified(hits, records).select("chunk_id").limit(1).collect()
    if odd:
        raise ValueError(f"not a record of the snapshot: {odd[0]['chunk_id']}")
    return hits


def unverified(hits: DataFrame, records: DataFrame) -> DataFrame:
    """Hits that no record equals in all of its facts."""
    facts = ["index_version", "chunk_id", "doc_id", "document_revision", "start_char", "end_char", "content"]
    return hits.join(records.select(*facts).distinct(), facts, "left_anti")


def merged(hits: DataFrame) -> DataFrame:
    """Overlapping spans of one document revision as one; reading one whose parts disagree raises."""
    out = merged_evidence(hits, KEYS)
    odd = F.raise_error(F.concat(F.lit("conflicting overlap in one document revision: "), F.to_json(F.struct(*KEYS))))
    return out.withColumn("content", F.when(F.col("conflict"), odd.cast("string")).otherwise(F.col("content"))).drop("conflict")


def pack(hits: DataFrame, budget: int, tokens: Callable[[str], int] = len, overhead: int = 0) -> DataFrame:
    """``query_id, rank, action``: greedy first fit in rank order, merging before each check.

    What doesn't fit is ``budget`` and doesn't stop later hits. ``hits``: prepared
    and kept. A query's hits are a bounded list (its top-k), so it is one group.
    The tokens of texts add up here; those of one document are counted joined.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: dict[tuple, list] = {}  # what was taken of each document revision, and its tokens
        spent: dict[tuple, int] = {}
        left, rows = budget - overhead, []
        for row in pdf.sort_values("rank").itertuples():
            key = (row.index_version, row.doc_id, row.document_revision)
            trial = [*taken.get(key, []), row]
            cost = sum(tokens(t) for t in _joined(trial))
            ok = cost - spent.get(key, 0) <= left
            if ok:  # only this document's share changes
                left -= cost - spent.get(key, 0)
                taken[key], spent[key] = trial, cost
            rows.append((row.query_id, row.rank, "selected" if ok else "budget"))
        return pd.DataFrame(rows, columns=["query_id", "rank", "action"])

    return hits.groupBy("query_id").applyInPandas(run, "query_id long, rank int, action string")


def _joined(rows) -> list[str]:
    """Texts of hits of one document revision after merging what overlaps."""
    out, reached = [], -1
    for r in sorted(rows, key=lambda r: (r.start_char, r.end_char, r.rank)):
        if out and r.start_char < reached:
            out[-1] += r.content[max(0, reached - r.start_char) :]
        else:
            out.append(r.content)
        reached = max(reached, r.end_char)
    return out


def status(decisions: DataFrame) -> DataFrame:
    """``query_id, status``: ready, budget_exhausted or no_evidence."""
    n = lambda a: F.count_if(F.col("action") == a)
    return decisions.groupBy("query_id").agg(
        F.when(n("selected") > 0, "ready").when(n("budget") > 0, "budget_exhausted").otherwise("no_evidence").alias("status")
    )


def rendered(question: Column, sources: Column, prompt: str) -> Column:
    """Messages as JSON; sources: array of structs (source_id, title, source, content)."""
    user = F.to_json(F.struct(question.alias("question"), sources.alias("notes")))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.to_json(F.array(message("system", F.lit(prompt)), message("user", user)))


def within_budget(messages: Column, tokens: Callable[[Column], Column], budget: Budget) -> Column:
    """Whether the messages, as they are sent, still fit: the last check before a call."""
    return tokens(messages) <= budget.input


def context_id(messages: Column) -> Column:
    return F.sha2(messages, 256)


# citations -------------------------------------------------------------------

#: Fixed value: what prose must not hold, as it would pass for the engine's own references.
INLINE = r"(?i)\[(?:S?[0-9]+|[^\]\n]*\.md)\]|\]\(|\b(?:https?|file|obsidian)://"

ANSWER = "struct<status:string, claims:array<struct<text:string, source_ids:array<string>, quotes:array<struct<source_id:string, text:string>>>>, missing_information:array<string>>"


class AnswerError(ValueError):
    """An answer that isn't exactly the agreed JSON object."""


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float)}


def strict_json(raw: str, schema: dict):
    """A text that is exactly one JSON value of a schema; nothing is repaired.

    Keys that occur twice, NaN and infinities, keys that the schema doesn't name
    and blank strings where it asks for some length are errors.
    """

    def members(pairs):
        if len(found := dict(pairs)) < len(pairs):
            raise AnswerError("a key occurs twice")
        return found

    def constant(name):
        raise AnswerError(f"{name} is not JSON")

    try:
        value = json.loads(raw, object_pairs_hook=members, parse_constant=constant)
    except (json.JSONDecodeError, RecursionError, TypeError) as error:
        raise AnswerError(str(error)) from error
    for where, problem in _faults(value, schema, "$"):
        raise AnswerError(f"{where}: {problem}")
    return value


def _faults(value, schema: dict, where: str):
    """Places of a value that aren't as its schema has them."""
    kind = schema["type"]
    if not isinstance(value, _TYPES[kind]) or (isinstance(value, bool) and kind in ("integer", "number")):
        yield where, f"expected {kind}"
        return
    if kind == "object":
        known = schema["properties"]
        for key in sorted({*schema["required"]} - {*value}):
            yield where, f"lacks {key}"
        for key in value:
            if key in known:
                yield from _faults(value[key], known[key], f"{where}.{key}")
            else:
                yield where, f"has {key}, which isn't known"
    elif kind == "array":
        if len(value) < schema.get("minItems", 0):
            yield where, f"needs {schema['minItems']} items"
        if schema.get("uniqueItems") and len({json.dumps(v, sort_keys=True) for v in value}) < len(value):
            yield where, "has an item twice"
        for k, item in enumerate(value):
            yield from _faults(item, schema["items"], f"{where}[{k}]")
    elif kind == "string":
        if schema.get("minLength") and not value.strip():
            yield where, "is blank"
        if "enum" in schema and value not in schema["enum"]:
            yield where, f"is none of {schema['enum']}"


STATUSES = ["answered", "partial", "insufficient_evidence"]


def _answer_shape(source_ids: list[str] | None, quotes: bool, closed: bool) -> dict:
    """The shape of an answer; ``closed`` adds what holds for these sources."""
    text = {"type": "string", "minLength": 1}
    ids = text | ({"enum": source_ids} if source_ids else {})

    def obj(optional=(), **properties):
        return {"type": "object", "properties": properties, "required": [p for p in properties if p not in optional], "additionalProperties": False}

    some = {"minItems": 1} if closed else {}
    claim = {"text": text, "source_ids": {"type": "array", "items": ids, "uniqueItems": True, **some}}
    if quotes or not closed:
        claim["quotes"] = {"type": "array", "items": obj(source_id=ids, text=text), **(some if quotes else {})}
    return obj(
        status={"type": "string", "enum": STATUSES},
        claims={"type": "array", "items": obj(() if closed else ("quotes",), **claim)},
        missing_information={"type": "array", "items": text},
    )


def answer_schema(source_ids: list[str], quotes: bool = False) -> dict:
    """JSON schema that a model is asked to follow; without sources there is nothing to cite."""
    if not source_ids:
        raise ValueError("an answer needs sources to cite")
    return _answer_shape(source_ids, quotes, True)


def parse_answer(raw: str) -> dict:
    """One strict JSON object, whose status goes with what it holds.

    answered: claims and nothing missing; partial: both; insufficient_evidence:
    something missing and no claims.
    """
    found = strict_json(raw, _answer_shape(None, True, False))
    held = bool(found["claims"]), bool(found["missing_information"])
    if held != {"answered": (True, False), "partial": (True, True), "insufficient_evidence": (False, True)}[found["status"]]:
        raise AnswerError(f"{found['status']} doesn't go with what the answer holds")
    return {**found, "claims": [{"quotes": [], **c} for c in found["claims"]]}


@pandas_udf(f"struct<answer:{ANSWER}, error:string>")
def parsed_answer(raw: pd.Series) -> pd.DataFrame:
    """Answer or error of each raw response; null responses are errors."""
    rows = []
    for text in raw:
        try:
            rows.append((parse_answer(text), None))
        except AnswerError as error:
            rows.append((None, str(error)))
    return pd.DataFrame(rows, columns=["answer", "error"])


def claims_of(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """``answer_id, claim_index, text, source_ids, quotes``."""
    return answers.select("answer_id", F.posexplode(f"{answer_col}.claims").alias("claim_index", "c")).select("answer_id", "claim_index", "c.*")


def issues(claims: DataFrame, sources: DataFrame, require_quotes: bool = False, answers: DataFrame | None = None) -> DataFrame:
    """``answer_id, claim_index, code, source_id``: what is wrong with each claim.

    ``sources``: ``answer_id, source_id, content, start_char``; ``answers``, if given,
    ``answer_id, missing_information``, which must not hold references either (their
    claim_index is -1).
    """
    row = ["answer_id", "claim_index"]
    null = F.lit(None).cast("string")
    known = sources.select("answer_id", "source_id").distinct().withColumn("_known", F.lit(True))
    refs = claims.select(*row, F.explode("source_ids").alias("source_id"))
    unknown = refs.join(known, ["answer_id", "source_id"], "left").where("_known IS NULL")
    out = [
        claims.where(F.size("source_ids") == 0).select(*row, F.lit("missing_reference").alias("code"), null.alias("source_id")),
        unknown.select(*row, F.lit("unknown_source").alias("code"), "source_id"),
        claims.where(F.col("text").rlike(INLINE)).select(*row, F.lit("inline_reference").alias("code"), null.alias("source_id")),
    ]
    if require_quotes:
        quoted = F.transform(F.coalesce("quotes", F.array()), lambda q: q["source_id"])
        lacking = claims.select(*row, F.explode(F.filter("source_ids", lambda s: ~F.array_contains(quoted, s))).alias("source_id"))
        out.append(lacking.select(*row, F.lit("missing_quote").alias("code"), "source_id"))
    placed = quote_places(claims, sources)
    out.append(placed.where("code IS NOT NULL").select(*row, "code", "source_id"))
    if answers is not None:
        told = answers.where(F.exists("missing_information", lambda t: t.rlike(INLINE)))
        out.append(told.select("answer_id", F.lit(-1).alias("claim_index"), F.lit("inline_reference_in_missing_information").alias("code"), null.alias("source_id")))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def quote_places(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """``answer_id, claim_index, source_id, quote, code, start_char, end_char`` of each quote.

    ``code``: quote_not_referenced, quote_not_found, ambiguous_quote (a second
    place, which may overlap the first) or null; only the last has a span.
    """
    quotes = claims.select("answer_id", "claim_index", "source_ids", F.explode("quotes").alias("q"))
    quotes = quotes.select("answer_id", "claim_index", "source_ids", "q.source_id", F.col("q.text").alias("quote"))
    rows = quotes.join(sources.select("answer_id", "source_id", "content", F.col("start_char").alias("_base")), ["answer_id", "source_id"], "left")
    at = F.expr("locate(quote, content)")
    again = F.expr("locate(quote, content, locate(quote, content) + 1)")
    referenced = F.array_contains("source_ids", F.col("source_id"))
    code = (
        F.when(~referenced, "quote_not_referenced")
        .when(F.col("content").isNull(), F.lit(None))
        .when(at == 0, "quote_not_found")
        .when(again > 0, "ambiguous_quote")
    )
    start = F.when(code.isNull() & F.col("content").isNotNull(), F.col("_base") + at - 1)
    return rows.select(
        "answer_id", "claim_index", "source_id", "quote", code.alias("code"), start.alias("start_char"), (start + F.length("quote")).alias("end_char")
    )


def used_sources(claims: DataFrame) -> DataFrame:
    """``answer_id, source_id, number``: sources in the order of first use."""
    refs = claims.select("answer_id", "claim_index", F.posexplode("source_ids").alias("pos", "source_id"))
    first = refs.groupBy("answer_id", "source_id").agg(F.min(F.struct("claim_index", "pos")).alias("at"))
    return first.select("answer_id", "source_id", F.row_number().over(Window.partitionBy("answer_id").orderBy("at")).alias("number"))


#: Fixed value: the characters that would be markup.
MARKUP = r"([\\`*_\[\]()#!|:])"


def inert(text: Column) -> Column:
    """Text as one harmless Markdown line, control characters as blanks."""
    plain = F.trim(F.regexp_replace(text, r"[\s\p{Cc}]+", " "))
    plain = F.replace(F.replace(F.replace(plain, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(plain, MARKUP, r"\\$1")


def rendered_claims(claims: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``answer_id, body``: claims in order, each with the numbers of its sources.

    ``found``: what :func:`issues` has found; answers with any are left out.
    """
    if found is not None:
        claims = claims.join(found.select("answer_id").distinct(), "answer_id", "left_anti")
    numbers = used_sources(claims)
    refs = claims.select("answer_id", "claim_index", F.posexplode_outer("source_ids").alias("pos", "source_id")).join(numbers, ["answer_id", "source_id"], "left")
    marks = refs.groupBy("answer_id", "claim_index").agg(F.sort_array(F.collect_list(F.struct("pos", "number"))).alias("_m"))
    rows = claims.join(marks, ["answer_id", "claim_index"], "left")
    numbers_of = F.filter("_m", lambda m: m["number"].isNotNull())
    mark = F.concat_ws("", F.transform(numbers_of, lambda m: F.format_string("[%d]", m["number"])))
    lines = F.sort_array(F.collect_list(F.struct("claim_index", F.concat(inert(F.col("text")), F.lit(" "), mark).alias("line"))))
    return rows.groupBy("answer_id").agg(F.concat_ws("\n\n", F.transform(lines, lambda x: x["line"])).alias("body"))


def rendered_answers(answers: DataFrame, claims: DataFrame, sources: DataFrame, found: DataFrame) -> DataFrame:
    """``answer_id, markdown``: claims, what is missing, and the sources used with their quotes.

    ``answers``: ``answer_id, missing_information``; ``sources``: ``answer_id,
    source_id, title, source``. Answers that ``found`` has an issue of are left out.
    """
    body = rendered_claims(claims, found)
    quotes = claims.select("answer_id", F.explode("quotes").alias("q")).select("answer_id", "q.source_id", F.col("q.text").alias("quote")).distinct()
    quoted = quotes.groupBy("answer_id", "source_id").agg(F.sort_array(F.collect_list("quote")).alias("quotes"))
    listed = used_sources(claims).join(sources, ["answer_id", "source_id"]).join(quoted, ["answer_id", "source_id"], "left")
    name = F.concat(F.format_string("[%d] ", F.col("number")), inert(F.col("title")), F.lit(" ("), inert(F.col("source")), F.lit(")"))
    said = F.transform(F.coalesce("quotes", F.array().cast("array<string>")), lambda q: F.concat(F.lit("\n   > "), inert(q)))
    lines = listed.select("answer_id", "number", F.concat(name, F.concat_ws("", said)).alias("line"))
    lists = lines.groupBy("answer_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("number", "line"))), lambda x: x["line"]).alias("_s"))
    rows = answers.join(body, "answer_id").join(lists, "answer_id", "left")
    part = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(f"\n\n{title}\n\n"), F.concat_ws("\n", items)))
    missing = F.transform("missing_information", lambda m: F.concat(F.lit("- "), inert(m)))
    whole = F.concat_ws("", "body", part("Missing:", missing), part("Sources:", F.col("_s")))
    return rows.select("answer_id", whole.alias("markdown"))


def single_json_block(text: Column) -> Column:
    """The one fenced JSON block of a text; null if there are none or several."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?[ \t]*\n(.*?)```"), F.lit(1))
    return F.when(F.size(found) == 1, F.regexp_replace(found[0], r"^\s+|\s+$", ""))


def citation_summary(found: DataFrame, claims: DataFrame) -> DataFrame:
    """``answer_id, claims, references_valid, claim_coverage``."""
    bad = found.groupBy("answer_id").agg(F.count("*").alias("issues"))
    own = claims.groupBy("answer_id").agg(F.count("*").alias("claims"), F.count_if(F.size("source_ids") > 0).alias("_cited"))
    out = own.join(bad, "answer_id", "left")
    return out.select("answer_id", "claims", (F.coalesce("issues", F.lit(0)) == 0).alias("references_valid"), F.try_divide("_cited", "claims").alias("claim_coverage"))


#: What a reviewer may say of a claim; null is not reviewed. Fixed values.
SUPPORT = ["supported", "partial", "contradicted", "insufficient"]
_RATES = ["references_valid", "citation_id_validity", "claim_reference_coverage", "support_review_coverage", "supported_claim_rate", "answer_correct", "answer_complete"]


def citation_statistics(answers: DataFrame, claims: DataFrame, sources: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """One row for each answer: counts of claims and references, rates of both, and what its review says.

    ``answers``: ``answer_id`` of parsed answers, so that one without claims has a row;
    ``claims``: ``answer_id, claim_index`` (from 0), ``source_ids``; ``sources``: ``answer_id,
    source_id``; ``reviews``: ``answer_id, reviewer, claim_support`` (a label or null for
    each claim), ``answer_correct, answer_complete``. A rate without a denominator is null,
    and so are the support columns without a review. Labels are shares of reviewed claims,
    beside the share of claims reviewed. A review without a name, with a label too many, too
    few or unknown, or that calls a claim supported whose references don't all exist, raises.
    """
    known = sources.groupBy("answer_id").agg(F.collect_set("source_id").alias("_known"))
    labels = "answer_id, reviewer, claim_support, answer_correct, answer_complete".split(", ")
    if reviews is None:
        nulls = "CAST(NULL AS STRING) AS reviewer", "CAST(NULL AS ARRAY<STRING>) AS claim_support", "CAST(NULL AS BOOLEAN) AS answer_correct", "CAST(NULL AS BOOLEAN) AS answer_complete"
        reviewed = answers.select("answer_id").distinct().selectExpr("answer_id", "false AS _reviewed", *nulls)
    else:
        own = reviews.select(*labels).withColumn("_reviewed", F.lit(True))
        reviewed = answers.select("answer_id").distinct().join(own, "answer_id", "left").withColumn("_reviewed", F.coalesce("_reviewed", F.lit(False)))
    ids, no_ids = F.coalesce("source_ids", F.array().cast("array<string>")), F.array().cast("array<string>")
    cells = claims.select("answer_id", "claim_index", ids.alias("ids")).join(known, "answer_id", "left").join(reviewed.select("answer_id", "claim_support"), "answer_id")
    valid = F.size(F.filter("ids", lambda s: F.array_contains(F.coalesce("_known", no_ids), s)))
    cells = cells.withColumns({"n": F.size("ids"), "valid": valid, "label": F.get("claim_support", F.col("claim_index").cast("int"))})
    blessed = (F.col("label") == "supported") & ((F.col("n") == 0) | (F.col("valid") < F.col("n")))
    sums = cells.groupBy("answer_id").agg(
        F.count("*").alias("claim_count"), F.sum("n").alias("reference_count"), F.sum("valid").alias("valid_reference_count"), F.count_if(F.col("valid") > 0).alias("_covered"),
        F.count("label").alias("_labelled"), F.count_if(F.col("label") == "supported").alias("_supported"), F.count_if(blessed).alias("_blessed"),
        F.count_if((F.col("n") > 0) & (F.col("valid") == F.col("n"))).alias("_whole"),
    )
    counts = ["claim_count", "reference_count", "valid_reference_count", "_covered", "_labelled", "_supported", "_blessed", "_whole"]
    rows = reviewed.join(sums, "answer_id", "left").fillna(0, counts)
    size, strange = F.coalesce(F.size("claim_support"), F.lit(-1)), F.exists("claim_support", lambda x: ~F.coalesce(x.isin(SUPPORT), F.lit(True)))
    wrong = (
        F.when(~F.col("_reviewed"), None)
        .when(F.coalesce(F.trim("reviewer"), F.lit("")) == "", "a review needs a reviewer")
        .when((size != F.col("claim_count")) | strange, "a review needs one known label or null for each claim")
        .when(F.col("_blessed") > 0, "a supported claim needs references that exist")
    )
    share = lambda a, b: F.try_divide(F.col(a), F.col(b))
    review = lambda c: F.when(F.col("_reviewed"), c)
    out = rows.withColumn("claim_count", F.when(wrong.isNull(), F.col("claim_count")).otherwise(F.raise_error(F.concat(wrong, F.lit(": answer "), F.col("answer_id").cast("string")))))
    return out.select(
        "answer_id", "claim_count", "reference_count", "valid_reference_count", (F.col("_whole") == F.col("claim_count")).alias("references_valid"),
        share("valid_reference_count", "reference_count").alias("citation_id_validity"), share("_covered", "claim_count").alias("claim_reference_coverage"),
        review(share("_labelled", "claim_count")).alias("support_review_coverage"), review(share("_supported", "_labelled")).alias("supported_claim_rate"), "answer_correct", "answer_complete",
    )


def citation_means(statistics: DataFrame) -> DataFrame:
    """``measure, mean, defined_cases``: the mean of each rate over the answers where it is defined, and of how many."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in _RATES])).alias("cell")
    return statistics.select(cells).groupBy("cell.measure").agg(F.avg("cell.value").alias("mean"), F.count("cell.value").alias("defined_cases"))
