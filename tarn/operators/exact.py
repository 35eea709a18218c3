"""Exact and pattern matching over whole texts, with code-point offsets.

Literals stay in the JVM: a text is split at the literal and the lengths of the
parts before a match give its place. Patterns are run by RE2 on Arrow batches, in one dialect
for documents and places and in linear time; :mod:`tarn.operators.trigrams` keeps them
from texts that can't match.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(literal: str, ignore_case: bool = False) -> str:
    """A Java pattern that matches the literal only."""
    if not literal or "\x00" in literal:
        raise ValueError("a literal must be non-empty text without NUL")
    return ("(?iu)" if ignore_case else "") + "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def literal_count(text: Column, literal: str, ignore_case: bool = False) -> Column:
    """Non-overlapping occurrences."""
    return F.size(F.split(F.coalesce(text, F.lit("")), quoted(literal, ignore_case), -1)) - 1


def literal_matches(docs: DataFrame, literal: str, text_col: str = "text", id_col: str = "doc_id", ignore_case: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``<id>, ordinal, start_char, end_char`` and columns ``keep`` of every non-overlapping occurrence.

    Folding keeps lengths only if no character changes its length with case, so
    under ``ignore_case`` ends are taken from the length of the literal.
    """
    size = len(literal)
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), quoted(literal, ignore_case), -1)
    # a match starts after the parts before it and the matches between them: a fold over
    # the array of one row, so nothing is shuffled
    lengths = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: F.length(x).cast("long"))
    own = keep or []
    hits = docs.select(id_col, *own, F.posexplode(_starts(lengths, size)).alias("ordinal", "start_char"))
    return hits.select(id_col, "ordinal", "start_char", (F.col("start_char") + size).alias("end_char"), *own)


def _starts(lengths: Column, size: int, block: int = 256) -> Column:
    """Running sums of lengths, ``size`` between two; kept in blocks, as a fold copies the array it adds to."""
    long_array = F.array().cast("array<long>")
    start = F.struct(F.array().cast("array<array<long>>").alias("done"), long_array.alias("open"), F.lit(0).cast("long").alias("at"))

    def step(t, n):
        at, full = t["at"] + n, F.size(t["open"]) >= block
        done = F.when(full, F.concat(t["done"], F.array(t["open"]))).otherwise(t["done"])
        open_ = F.when(full, F.array(at)).otherwise(F.concat(t["open"], F.array(at)))
        return F.struct(done.alias("done"), open_.alias("open"), (at + size).alias("at"))

    return F.aggregate(lengths, start, step, lambda t: F.flatten(F.concat(t["done"], F.array(t["open"]))))


def compiled(pattern: str, ignore_case: bool = False) -> str:
    """The pattern as it is run: multi-line, its case folded if asked. An invalid one raises.

    The dialect is RE2's, whose automata take time linear in the text whatever the
    pattern: no look-around, no references back to a group; ``\\w``, ``\\d`` and ``\\b``
    are those of ASCII (``\\pL`` and the like know all letters).
    """
    own = ("(?mi)" if ignore_case else "(?m)") + f"(?:{pattern})"
    try:
        for form in (pattern, own):
            pc.match_substring_regex(pa.array([""]), pattern=form)
    except pa.ArrowInvalid as error:
        raise re.error(str(error), pattern) from None
    return own


def _unused(text: str) -> tuple[str, str]:
    """Two characters that a text doesn't hold, by which places of matches are marked in it."""
    free = (chr(c) for c in itertools.chain(range(0xFDD0, 0xFDF0), range(0xE000, 0xF900), range(0xF0000, 0x110000), range(1, 0xD800)))
    marks = (c for c in free if c not in text)
    return next(marks), next(marks)


def _places(text: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all matches, in code points."""
    first, last = _unused(text)
    marked = pc.replace_substring_regex(pa.array([text], pa.large_string()), pattern=pattern, replacement=f"{first}\\0{last}")[0].as_py()
    codes = np.frombuffer(marked.encode("utf-32-le"), "<u4")
    starts, ends = np.flatnonzero(codes == ord(first)), np.flatnonzero(codes == ord(last))
    return starts - 2 * np.arange(len(starts)), ends - 2 * np.arange(len(ends)) - 1


def pattern_matches(docs: DataFrame, pattern: str, text_col: str = "text", id_col: str = "doc_id", ignore_case: bool = False, keep: list[str] | None = None) -> DataFrame:
    """As :func:`literal_matches` for a pattern (see :func:`compiled`); matches may be empty.

    An invalid pattern fails before any plan is made. An empty match right behind
    another match is none.
    """
    run = compiled(pattern, ignore_case)
    kind = pa.struct([("start_char", pa.int64()), ("end_char", pa.int64())])

    @F.arrow_udf("array<struct<start_char:long,end_char:long>>")
    def spans(texts: pa.Array) -> pa.Array:
        sizes, found = [0], []
        hit = pc.match_substring_regex(texts, pattern=run).to_pylist()
        for text, any_ in zip(texts, hit, strict=True):
            starts, ends = _places(text.as_py(), run) if any_ else ((), ())
            sizes.append(sizes[-1] + len(starts))
            if any_:
                found.append(pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], fields=list(kind)))
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.concat_arrays(found) if found else pa.array([], kind))

    own = keep or []
    cells = docs.select(id_col, *own, F.posexplode(spans(F.coalesce(F.col(text_col), F.lit("")))).alias("ordinal", "span"))
    return cells.select(id_col, "ordinal", "span.start_char", "span.end_char", *own)


def pattern_documents(docs: DataFrame, pattern: str, text_col: str = "text", ignore_case: bool = False) -> DataFrame:
    """Documents that a pattern (see :func:`compiled`) occurs in; a null text has none."""
    run = compiled(pattern, ignore_case)

    @F.arrow_udf("boolean")
    def occurs(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, pattern=run)

    return docs.where(occurs(F.col(text_col)))


def source_matches(docs: DataFrame, query: str, source_col: str = "source") -> DataFrame:
    """Documents whose source name holds the query; each once."""
    return docs.where(F.col(source_col).contains(query))


def first_matches(matches: DataFrame, k: int, source_col: str = "source") -> DataFrame:
    """The first ``k`` matches by source, then place."""
    return matches.orderBy(source_col, "start_char").limit(k)
