"""How queries are registered, each with its SQL.

Each takes (spark, sf_dir). Doubles are rounded to six digits on both sides, and
rankings end in an integer key, so that both engines give the same rows.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarn.sources.tables import spread, table  # noqa: F401  for the plans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share; on one machine without one, a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='tarn-')}/tarn-{uuid.uuid4().hex}"
