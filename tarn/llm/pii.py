"""Personal data (operator 12): candidates, boosted trees, calibrated thresholds; DataFrame functions only.

Base patterns find e-mail addresses, network addresses, card numbers and telephone
numbers that pass their format's check. What they find is masked, and wider patterns
propose further, overlapping spans in the rest: disguised signs ("[at]", "[dot]"),
letters beyond ASCII, other separators, IPv6, numbers without a country code. Trees
boosted on format and context score each proposal; a kind's threshold is set so that
held-out proposals above it are right; of overlapping spans that pass, the better stays.

The trees learn from the corpus itself. Of every row, base spans are
positive, and so are their rewritings into the forms that the base cannot see;
negative are all other proposals, numbers that fail their check, and rewritings of
those and of spoilt positives. Format features are taken after disguises are undone,
so what counts is whether the value would hold, not how it is written.

Everything is one narrow pass over arrays of a row's spans: no Python, no shuffle.
"""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed order of kinds in digests.
KINDS = ("email", "ip", "card", "phone")
_MARK, _OTHER = "\u0001", "\u0002"
_SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
_BLOCK = 256

#: The contract's patterns. A run is entered at its start or where the last match ended, and never given back:
#: the same matches in linear time. A look behind comes after the character that calls for it, which most lack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_AT = r"(?: ?@ ?| ?\(at\) ?| ?\[at\] ?| ?\{at\} ?| at )"
_DOT = r"(?:\.| ?\(dot\) ?| ?\[dot\] ?| ?\{dot\} ?| dot )"
#: Wider patterns of each kind; what one kind's patterns find may overlap.
WIDE = {
    "email": (
        rf"(?<![\p{{L}}0-9._%+-])[\p{{L}}0-9._%+-]{{1,64}}+{_AT}[\p{{L}}0-9-]{{1,63}}+(?:{_DOT}[\p{{L}}0-9-]{{1,63}}+){{1,8}}+",
        r"(?<![^\s@<>(),;:\"\x02])[^\s@<>(),;:\"\x02]{1,64}+@[^\s@<>(),;:\"\x02]{1,255}+",
    ),
    "ip": (
        r"[0-9](?<![0-9.][0-9])[0-9]{0,2}+(?: ?(?:\.|\[\.\]|\(\.\)|\[dot\]) ?[0-9]{1,3}+){3}+",
        r"[0-9A-Fa-f](?<![0-9A-Za-z:].)[0-9A-Fa-f]{0,3}+:(?:[0-9A-Fa-f]{1,4}+:){2,6}+:?[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])",
    ),
    "card": (
        r"[0-9](?<![0-9]{2})(?:[ ./_-]{0,2}+[0-9]){12,18}+(?![0-9])",
        r"[0-9](?<![0-9]{2})[0-9]{3}(?:[^\p{L}0-9\s\x02]{1,2}+ ?[0-9]{4}){3}+(?![0-9])",
    ),
    "phone": (
        r"(?<![0-9+])(?:(?:00|\+)?[0-9]{1,3}+[ ./-]?)?\([0-9]{2,5}+\)(?:[ ./-]?[0-9]{2,5}+){2,4}+(?![0-9])",
        r"[+0-9](?<![0-9+.].)[0-9]{0,4}+(?:[ ./-][0-9]{2,5}+){2,5}+(?![0-9.])",
    ),
}


def may_hold(kind: str, text: Column) -> Column:
    """A cheap test that all texts pass in which a kind's wide patterns find anything."""
    has = lambda *x: functools.reduce(lambda a, b: a | b, [F.instr(text, y) > 0 for y in x])
    if kind == "email":
        return has("@", "(at)", "[at]", "{at}") | (has(" at ") & (has(" dot ", "(dot)", "[dot]", "{dot}") | text.rlike(r" at [\p{L}0-9-]{1,63}+\.[\p{L}0-9]")))
    if kind == "ip":
        return text.rlike(r"[0-9] ?(?:\.|\[\.\]|\(\.\)|\[dot\]) ?[0-9]{1,3} ?[.\[(]") | (has(":") & text.rlike(r":[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]"))
    if kind == "card":
        return text.rlike(r"[0-9](?:[ ./_-]{0,2}+[0-9]){12}") | text.rlike(r"[0-9]{4}[^\p{L}0-9\s]{1,2}+ ?[0-9]{4}[^\p{L}0-9\s]")
    return text.rlike(r"[0-9][ ./-][0-9]{2,5}+[ ./-][0-9]") | (has("(") & text.rlike(r"\([0-9]{2,5}+\)[ ./-]?[0-9]"))


#: Words that stand before such data, in four languages; and before other numbers.
_CUES = {
    "email": r"(?i)(?:e-?mail|mail|correo|courriel|contact|write|address)\W{0,6}$",
    "ip": r"(?i)(?:\bip|ipv[46]|host|server|addr(?:ess)?|dirección|adresse|client|from)\W{0,6}$",
    "card": r"(?i)(?:card|credit|visa|mastercard|amex|karte|carte|tarjeta|pan)\W{0,6}(?:n(?:o|r|um\w*|úm\w*)?\W{0,4})?$",
    "phone": r"(?i)(?:tel(?:[eé]\w*|\.)?|phone|call|fax|mobile?|cell|móvil|handy|anruf\w*|appel\w*)\W{0,6}$",
}
_OTHER_CUES = r"(?i)(?:version|licen[cs]e|isbn|issn|order|invoice|id|token|page|section|chapter|v|no|nr)\W{0,6}$"
#: Rewritings that keep a value what it is, and such as spoil it.
_DISGUISES = {
    "email": [("@", " [at] "), ("@", " (at) "), ("@", " at "), ("^([a-z])", "é$1"), ("\\.(?=[^.]*$)", " dot ")],
    "ip": [("\\.", "[.]"), ("\\.", " . "), ("\\.", "(.)")],
    "card": [("(?<=^[0-9 -]{4})[ -]?", "."), ("[ -]", "/"), ("([0-9]{4})(?=[0-9])", "$1. "), ("([0-9]{4})(?=[0-9])", "$1/")],
    "phone": [("^\\+", "00"), ("^\\+[0-9]{1,3} ?(?=\\()", ""), ("[ -]+", "."), ("^\\+([0-9]) ", "$1-")],
}
_SPOILS = {
    "email": [("@.*$", "@"), ("[.][^.]*$", ""), ("\\.(?=[^.]*$)", " . "), ("^.*@", "@")],
    "ip": [("^", "999"), ("\\.[0-9]+$", ""), ("([0-9]+)\\.", "$1999."), ("$", ".1.7")],
    "card": [("[0-4]$", "9"), ("[5-9]$", "0"), ("^[0-4]", "8"), ("^[5-9]", "1")],
    "phone": [("[0-9]{4}$", ""), ("^\\+", ""), ("[ ().-]", ""), ("$", " 1234 5678")],
}


@dataclass(frozen=True)
class TrainingBound:
    """What a fit may read and how far it may go; without ``sample_rows`` it reads every row."""

    sample_rows: int | None = None
    trees: int = 12
    depth: int = 3
    #: Share of held-out examples above a threshold that must be right, and how many at least.
    precision: float = 0.97
    least: int = 20


@dataclass(frozen=True)
class Model:
    """Trees as nested (feature, bound, left, right) or a leaf's number; thresholds of margins by kind."""

    trees: tuple = ()
    weights: tuple[float, ...] = ()
    thresholds: dict[str, float] = field(default_factory=dict)

    def margin(self, features: Column) -> Column:
        def value(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            feature, bound, left, right = tree
            return F.when(F.get(features, F.lit(feature)) <= bound, value(left)).otherwise(value(right))

        parts = [value(t) * w for t, w in zip(self.trees, self.weights, strict=True)]
        return functools.reduce(lambda a, b: a + b, parts, F.lit(0.0))


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def cut_at(text: Column, pattern: str, needs: str | None = None) -> Column:
    """A text in parts: every second one is a match of the pattern (leftmost, non-overlapping).

    ``text`` holds no U+0001. ``needs`` is text without which there is no match.
    """
    marked = F.regexp_replace(text, F.lit(f"({pattern})"), F.lit(f"{_MARK}$1{_MARK}"))
    parts = F.split(marked, _MARK, -1)
    return F.when(F.instr(text, needs) > 0, parts).otherwise(F.array(text)) if needs else parts


def spans_of(parts: Column) -> Column:
    """The matches among parts with their places and surroundings.

    Places are code points, ends exclusive. They add up in blocks, so many matches cost
    little more than few.
    """

    def row(i: Column) -> Column:
        before, value, after = F.get(parts, 2 * i), F.get(parts, 2 * i + 1), F.get(parts, 2 * i + 2)
        around = [F.right(before, F.lit(24)).alias("before"), F.left(after, F.lit(12)).alias("after")]
        return F.struct(F.length(before).alias("gap"), F.length(value).alias("size"), value.alias("value"), *around)

    rows = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), row)
    return F.when(F.size(parts) >= 3, let(rows, _placed)).otherwise(F.array().cast(_SPAN))


def find(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches of a pattern."""
    return let(cut_at(text, pattern), spans_of)


def _placed(rows: Column) -> Column:
    """Spans from gaps and sizes: a fold within each block, and one over the blocks."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / _BLOCK).cast("int")), lambda b: F.slice(rows, b * _BLOCK + 1, F.lit(_BLOCK)))

    def starts(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda s, x: s + x["gap"] + x["size"]))
        return F.aggregate(sums, F.array(F.lit(0)), lambda s, x: F.array_append(s, F.element_at(s, -1) + x))

    def fold(block: Column, start: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            at = state["at"] + x["gap"]
            span = F.struct(at.alias("start"), (at + x["size"]).alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"))
            return F.struct((at + x["size"]).alias("at"), F.array_append(state["spans"], span).alias("spans"))

        first = F.struct(start.alias("at"), F.array().cast(_SPAN).alias("spans"))
        return F.aggregate(block, first, step, lambda s: s["spans"])

    return let(blocks, lambda b: F.flatten(F.zip_with(b, F.slice(starts(b), F.lit(1), F.size(b)), fold)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn's check of a string of at most 19 digits."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The contract's check of a match."""
    n = F.length(digits(value))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        number = lambda p: F.when(p == "", 0).otherwise(F.coalesce(F.left(p, F.lit(4)).try_cast("int"), F.lit(256)))
        return F.forall(F.split(value, "\\."), lambda p: number(F.ltrim(p, F.lit("0"))) <= 255)
    if kind == "card":
        return F.when(n.between(13, 19), let(digits(value), luhn)).otherwise(F.lit(False))
    return n.between(9, 15)


#: Text without which a kind has no base match, where there is such.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}


def base_parts(text: Column, kind: str) -> Column:
    """The parts of a clean text (see :func:`clean`) between and within the matches of a kind's pattern."""
    return cut_at(text, BASE[kind], _NEEDS[kind])


def base_spans(text: Column, kind: str) -> Column:
    """The contract's spans of a kind in a clean text."""
    return F.filter(let(base_parts(text, kind), spans_of), lambda x: valid(kind, x["value"]))


def clean(text: Column) -> Column:
    """The text, null as empty, without the character that marks matches; another one like it takes its places."""
    return F.translate(F.coalesce(text, F.lit("")), _MARK, _OTHER)


def masked(parts: Column, kind: str) -> Column:
    """The text with every base span blotted out, all places as before."""
    blot = lambda x: F.repeat(F.lit(_OTHER), F.length(x))
    return F.array_join(F.transform(parts, lambda x, i: F.when((i % 2 == 1) & valid(kind, x), blot(x)).otherwise(x)), "")


#: Names of the features, in the order of :func:`features`.
FEATURES = (
    "kind", "digits", "letters", "size", "valid", "groups", "longest", "at", "dots", "ending",
    "opens", "before", "after", "cue", "other_cue", "separators", "repeats",
)


def plain(kind: str, value: Column) -> Column:
    """A value with its disguise undone, for the format's check."""
    if kind == "email":
        value = F.regexp_replace(value, r" ?[\(\[\{]at[\)\]\}] ?| at ", "@")
        return F.regexp_replace(value, r" ?[\(\[\{]dot[\)\]\}] ?| dot ", ".")
    if kind == "ip":
        return F.regexp_replace(value, r" ?[\[\(]?(?:\.|dot)[\]\)]? ?", ".")
    return value


def _class(c: Column) -> Column:
    """0 none or space, 1 sentence mark, 2 quote or bracket, 3 other sign, 4 digit, 5 letter."""
    return (
        F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike(r"^\s$"), 0).when(c.rlike(r"^[.,;:!?]$"), 1)
        .when(c.rlike(r"^[\"'()\[\]<>{}]$"), 2).when(c.rlike("^[0-9]$"), 4).when(c.rlike(r"^\p{L}$"), 5).otherwise(3)
    )


def features(kind: str, x: Column) -> Column:
    """Numbers that describe a span's format and surroundings, as doubles."""

    def of(value: Column) -> Column:
        number = digits(value)
        groups = F.filter(F.split(value, "[^0-9]+"), lambda g: g != "")
        longest = F.array_max(F.transform(groups, F.length))
        if kind == "ip":
            good = F.when(value.contains(":"), (F.size(F.split(value, ":")) == 8) | value.contains("::")).otherwise(value.rlike(f"^{BASE['ip']}$") & valid("ip", value))
        elif kind == "email":
            good = value.rlike(r"^[\p{L}0-9._%+-]+@[\p{L}0-9-]+(?:\.[\p{L}0-9-]+)*\.\p{L}{2,}$")
        elif kind == "card":
            good = valid("card", value)
        else:
            good = value.rlike(r"^(?:00|\+)") | value.rlike(r"\([0-9]{2,5}\)") | value.rlike(r"^1-")
            good = good & F.length(number).between(9, 15)
        at = F.when(x["value"].contains("@"), 1).when(x["value"].rlike(r"[\(\[\{]at[\)\]\}]"), 2).when(x["value"].contains(" at "), 3).otherwise(0)
        opens = F.when(x["value"].startswith("+"), 1).when(x["value"].startswith("00"), 2).when(x["value"].startswith("("), 3).when(x["value"].rlike("^[0-9]"), 4).otherwise(0)
        made = [
            F.lit(KINDS.index(kind)), F.least(F.length(number), F.lit(24)), F.least(F.length(F.regexp_replace(value, r"[^\p{L}]", "")), F.lit(40)),
            F.least(F.length(value), F.lit(80)), F.coalesce(good, F.lit(False)).cast("int"), F.least(F.size(groups), F.lit(9)), F.coalesce(F.least(longest, F.lit(24)), F.lit(0)),
            at, F.least(F.length(value) - F.length(F.translate(value, ".", "")), F.lit(9)), F.least(F.length(F.regexp_extract(value, r"\p{L}*$", 0)), F.lit(9)),
            opens, _class(F.right(x["before"], F.lit(1))), _class(F.left(x["after"], F.lit(1))),
            x["before"].rlike(_CUES[kind]).cast("int"), x["before"].rlike(_OTHER_CUES).cast("int"),
            F.least(F.size(F.array_distinct(F.split(F.regexp_replace(value, r"[\p{L}0-9]", ""), ""))), F.lit(9)), (F.size(groups) - F.size(F.array_distinct(groups))),
        ]
        return F.array(*[m.cast("double") for m in made])

    return let(plain(kind, x["value"]), of)


def blotted(text: Column) -> Column:
    """A clean text without the base spans of any kind, all places as before."""
    return functools.reduce(_blot, KINDS, text)


def _blot(text: Column, kind: str) -> Column:
    return let(base_parts(text, kind), lambda parts: masked(parts, kind))


def proposals(text: Column, kind: str) -> Column:
    """Further spans of a kind in a text whose base spans are blotted out; they may overlap."""
    return F.when(may_hold(kind, text), F.concat(*[find(text, p) for p in WIDE[kind]])).otherwise(F.array().cast(_SPAN))


_SCORED = "array<struct<start:int,end:int,score:double>>"


def clear_of(spans: Column, others: Column) -> Column:
    """Those of ``spans`` (start, end, score) that overlap none of ``others`` (start, end): two linear folds."""
    none = F.array().cast(_SCORED)
    row = lambda x, score: F.struct(x["start"].alias("start"), x["end"].alias("end"), score.alias("score"))
    # others have no score and come first of those that start at one place
    both = F.array_sort(F.concat(F.transform(others, lambda x: row(x, F.lit(-math.inf))), F.transform(spans, lambda x: row(x, x["score"]))))
    other = lambda x: x["score"] == -math.inf

    def forth(state: Column, x: Column) -> Column:
        keep = other(x) | (x["start"] >= state["reach"])
        reach = F.when(other(x), F.greatest(state["reach"], x["end"])).otherwise(state["reach"])
        return F.struct(reach.alias("reach"), F.when(keep, F.array_append(state["kept"], x)).otherwise(state["kept"]).alias("kept"))

    def back(state: Column, x: Column) -> Column:
        keep = ~other(x) & (x["end"] <= state["next"])
        following = F.when(other(x), x["start"]).otherwise(state["next"])
        return F.struct(following.alias("next"), F.when(keep, F.array_append(state["kept"], x)).otherwise(state["kept"]).alias("kept"))

    first = F.aggregate(both, F.struct(F.lit(0).alias("reach"), none.alias("kept")), forth, lambda s: s["kept"])
    return F.aggregate(F.reverse(first), F.struct(F.lit(2**31 - 1).alias("next"), none.alias("kept")), back, lambda s: s["kept"])


def selected(model: Model, kind: str, found: Column, base: Column) -> Column:
    """Of proposals over the kind's threshold and clear of ``base`` the better of any two that overlap, by place."""
    none = F.array().cast(_SCORED)
    if kind not in model.thresholds:
        return none
    scored = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), let(features(kind, x), model.margin).alias("score")))
    passed = F.filter(scored, lambda x: x["score"] >= model.thresholds[kind])

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        better = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(x))
        return F.when(x["start"] >= last["end"], F.array_append(kept, x)).when(x["score"] > last["score"], better).otherwise(kept)

    apart = lambda spans: F.aggregate(F.array_sort(clear_of(spans, base)), none, lambda kept, x: F.when(F.size(kept) == 0, F.array(x)).otherwise(step(kept, x)))
    return let(passed, lambda spans: F.when(F.size(spans) > 0, apart(spans)).otherwise(none))


def _training_rows(docs: DataFrame, bound: TrainingBound) -> DataFrame:
    """``kind, features, label, fold`` of all spans of the rows and their rewritings, and how many are alike (``n``)."""
    sample = docs
    if bound.sample_rows is not None:
        key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        chosen = docs.select(key.alias("key")).distinct().orderBy("key").limit(bound.sample_rows)  # at most so many ids
        sample = docs.withColumn("key", key).join(F.broadcast(chosen), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    sample = sample.select(clean(F.col("text")).alias("text"))

    made = "array<struct<kind:string,x:struct<start:int,end:int,value:string,before:string,after:string>,label:double>>"

    def of(kind: str, spans: Column, label) -> Column:
        return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("x"), label(x).alias("label"))).cast(made)

    def every(text: Column) -> Column:
        matched = [of(kind, let(base_parts(text, kind), spans_of), lambda x, kind=kind: valid(kind, x["value"]).cast("double")) for kind in KINDS]
        may = functools.reduce(lambda a, b: a | b, [may_hold(kind, text) for kind in KINDS])
        other = let(blotted(text), lambda rest: F.concat(*[of(kind, proposals(rest, kind), lambda x: F.lit(0.0)) for kind in KINDS]))
        return F.concat(*matched, F.when(may, other).otherwise(F.array().cast(made)))

    def rewritten(kind: str, value: Column, label: Column) -> Column:
        """``value, label`` of the value itself and of its rewritings."""
        spoilt = F.array_except(F.array(*[F.regexp_replace(value, F.lit(a), F.lit(b)) for a, b in _SPOILS[kind]]), F.array(value))
        spoilt = F.when(label == 1, spoilt).otherwise(F.array().cast("array<string>"))
        disguised = lambda v: F.array(*[F.regexp_replace(v, F.lit(a), F.lit(b)) for a, b in _DISGUISES[kind]])
        false = let(spoilt, lambda x: F.concat(x, F.flatten(F.transform(x, disguised))))
        labelled = lambda values, n: F.transform(values, lambda v: F.struct(v.alias("value"), n.cast("double").alias("label")))
        return F.array_distinct(F.concat(F.array(F.struct(value.alias("value"), label.alias("label"))), labelled(disguised(value), label), labelled(false, F.lit(0))))

    held = sample.select(F.explode(let(F.col("text"), every)).alias("s")).select("s.kind", "s.x", "s.label")
    by_kind = lambda make: functools.reduce(lambda c, k: c.when(F.col("kind") == k, make(k)), KINDS[1:], F.when(F.col("kind") == KINDS[0], make(KINDS[0])))
    rows = held.select("kind", "x", F.explode(by_kind(lambda k: rewritten(k, F.col("x.value"), F.col("label")))).alias("w"))
    rows = rows.select("kind", F.col("x").withField("value", F.col("w.value")).alias("x"), "w.label")
    rows = rows.select("kind", by_kind(lambda k: features(k, F.col("x"))).alias("features"), "label", F.pmod(F.xxhash64("x.value"), F.lit(3)).alias("fold"))
    # small whole numbers, so there are far fewer kinds of examples than examples
    return rows.groupBy("kind", "features", "label", "fold").agg(F.count("*").cast("double").alias("n"))


def fit(docs: DataFrame, bound: TrainingBound | None = None) -> Model:
    """Trees and thresholds from every row; examples that are alike are one with a weight.

    With ``sample_rows`` only rows with the least hashed ids are read.

    Without positive or without negative examples, or where no threshold of a kind is
    right often enough on held-out examples, that kind gets no further spans.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    bound = bound or TrainingBound()
    # in one order, so that the same rows give the same trees wherever they are read
    rows = _training_rows(docs, bound).repartition(8, "features", "label", "fold").sortWithinPartitions("features", "label", "fold").persist()
    try:
        n = rows.where("fold > 0").agg(F.sum(F.col("label") * F.col("n")).alias("p"), F.sum("n").alias("n")).first()
        if not n["p"] or n["p"] == n["n"]:
            return Model()
        booster = GBTClassifier(labelCol="label", featuresCol="v", weightCol="n", maxIter=bound.trees, maxDepth=bound.depth, stepSize=0.3, seed=7, checkpointInterval=-1, maxBins=64)
        fitted = booster.fit(rows.where("fold > 0").select("label", "n", array_to_vector("features").alias("v")))
        trees = tuple(_tree(t.toDebugString) for t in fitted.trees)
        model = Model(trees, tuple(fitted.treeWeights))
        held = rows.where("fold = 0").select("kind", "label", "n", F.round(model.margin(F.col("features")), 9).alias("m"))
        steps = held.groupBy("kind", "m").agg(F.sum(F.col("label") * F.col("n")).alias("p"), F.sum("n").alias("n")).collect()  # a leaf's combinations
        return Model(model.trees, model.weights, _thresholds(steps, bound))
    finally:
        rows.unpersist()


def _thresholds(steps: list, bound: TrainingBound, surest: float = 0.5) -> dict[str, float]:
    """Of each kind the least margin above which enough held-out examples are right.

    It lies halfway to the next margin below, but not under ``surest``: a margin m is
    a chance of 1 / (1 + exp(-2 m)).
    """
    out = {}
    for kind in KINDS:
        own = sorted((r for r in steps if r["kind"] == kind), key=lambda r: -r["m"])
        right = total = 0
        for r, lower in zip(own, [*(x["m"] for x in own[1:]), -math.inf], strict=False):
            right, total = right + r["p"], total + r["n"]
            if r["m"] >= surest and right >= bound.least and right >= bound.precision * total:
                out[kind] = max((r["m"] + lower) / 2, surest)
    return out


_NODE = re.compile(r"( *)(?:(If|Else) \(feature (\d+) (<=|>) ([-0-9.E]+)\)|Predict: ([-0-9.E]+))")


def _tree(text: str):
    """A tree as it prints itself, as nested (feature, bound, left, right)."""
    lines = [m for m in map(_NODE.fullmatch, text.rstrip().split("\n")) if m]

    def node(at: int):
        m = lines[at]
        if m[6] is not None:
            return float(m[6]), at + 1
        left, at = node(at + 1)
        right, at = node(at + 1)  # past its Else
        return (int(m[3]), float(m[5]), left, right), at

    return node(0)[0]


def _written(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))


def personal_data(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", bound: TrainingBound | None = None) -> DataFrame:
    """Spans of personal data in every whole text, one row per input row.

    Returns ``doc_id``, the number of base spans of each kind, and two arrays of
    ``kind:start:end`` by kind and start: ``base``, and ``spans``, which holds those
    and the ones that the trees add. Places are code points, ends exclusive. Added spans
    never overlap a base span, nor another one of their kind. Without ``model`` one is
    fitted on the whole table, or as ``bound`` says.

    Null and empty texts have no spans; whole texts are searched, however long; of equal
    scores the earlier span stays; repeated rows stay repeated; a null id stays null;
    extra columns are ignored, whatever their names; an empty table gives an empty result.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    model = fit(own, bound) if model is None else model

    places = lambda spans: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    def of(text: Column) -> Column:
        base = F.struct(*[base_spans(text, kind).alias(kind) for kind in KINDS])
        may = functools.reduce(lambda a, b: a | b, [may_hold(kind, text) for kind in model.thresholds] or [F.lit(False)])

        def add(base: Column) -> Column:
            every = F.concat(*[places(base[kind]) for kind in KINDS])
            chosen = lambda rest: F.struct(*[selected(model, kind, proposals(rest, kind), every).alias(kind) for kind in KINDS])
            return F.struct(base.alias("base"), F.when(may, let(blotted(text), chosen)).alias("added"))

        return let(base, add)

    found = own.select("doc_id", let(clean(F.col("text")), of).alias("x"))
    added = lambda k: F.coalesce(places(F.col(f"x.added.{k}")), F.array().cast("array<struct<start:int,end:int>>"))
    both = lambda k: F.array_sort(F.concat(places(F.col(f"x.base.{k}")), added(k)))
    return found.select(
        "doc_id",
        *[F.size(F.col(f"x.base.{k}")).cast("long").alias(f"n_{k}") for k in KINDS],
        F.concat(*[_written(k, F.col(f"x.base.{k}")) for k in KINDS]).alias("base"),
        F.concat(*[_written(k, both(k)) for k in KINDS]).alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span of ``kind:start:end`` (see ``personal_data``) as ``<KIND>``; of overlapping ones the first."""
    parts = F.transform(spans, lambda s: F.split(s, ":"))
    ordered = F.array_sort(F.transform(parts, lambda p: F.struct(p[1].cast("int").alias("start"), p[2].cast("int").alias("end"), F.upper(p[0]).alias("kind"))))

    def step(state: Column, x: Column) -> Column:
        at = state["at"]
        more = F.concat(state["text"], F.substring(text, at + 1, x["start"] - at), F.lit("<"), x["kind"], F.lit(">"))
        return F.when(x["start"] < at, state).otherwise(F.struct(x["end"].alias("at"), more.alias("text")))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    return F.aggregate(ordered, first, step, lambda s: F.concat(s["text"], F.substring(text, s["at"] + 1, F.length(text))))
