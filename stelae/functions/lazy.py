"""Pandas UDFs that are made when first used, as their types are parsed by a running session."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F


def pandas_udf(kind: str):
    """Like ``pyspark.sql.functions.pandas_udf``, for modules that are imported before a session exists."""

    def wrap(f):
        @wraps(f)
        def call(*columns):
            return F.pandas_udf(f, kind)(*columns)

        return call

    return wrap
