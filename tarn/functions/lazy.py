"""Pandas UDFs that can be defined before there is a session."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F


def pandas_udf(return_type: str):
    """As ``pyspark.sql.functions.pandas_udf``; the type is parsed at the first use."""

    def wrap(fn):
        @functools.wraps(fn)
        def call(*columns):
            return F.pandas_udf(fn, return_type)(*columns)

        return call

    return wrap
