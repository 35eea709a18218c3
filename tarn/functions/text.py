"""Text functions: terms, folded text, stable identities."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions.lazy import pandas_udf

#: A term is a run of letters, digits and underscores.
TERM = r"([\p{L}\p{N}_]+)"
TOKENIZER = "nfc-casefold-word-v1"


def terms(text: Column) -> Column:
    """Terms of NFC text in the JVM: lower case, with sharp s folded.

    Equal to :func:`exact_terms` on NFC text whose other letters fold by lower case.
    """
    folded = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))
    return F.regexp_extract_all(folded, F.lit(TERM), F.lit(1))


def python_terms(text: str) -> list[str]:
    """NFC, case folding, then runs of word characters."""
    return re.findall(r"\w+", unicodedata.normalize("NFC", text).casefold())


@pandas_udf("array<string>")
def exact_terms(text: pd.Series) -> pd.Series:
    """Terms of any text, whatever its normal form and its script."""
    return text.fillna("").map(python_terms)


def title_and_body(title: Column, body: Column) -> Column:
    """The text that is indexed: title, an empty line, body."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(body, F.lit("")))


def identity(kind: str, *parts: Column) -> Column:
    """SHA-256 over a kind and its parts; null differs from empty text."""
    payload = F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(F.lit(f"tarn/{kind}/1\n"), payload), 256)


@pandas_udf("string")
def _normal(text: pd.Series) -> pd.Series:
    return text.map(lambda t: " ".join(t.casefold().split()), na_action="ignore")


def query_fingerprint(text: Column) -> Column:
    """Equal for queries that differ in case (by full folding) and white space only; null for null."""
    return F.sha2(_normal(text), 256)
