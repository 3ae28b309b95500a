"""What takes a session or is large: Arrow functions whose types are parsed when they are first used, and kept expressions."""

from __future__ import annotations

from collections.abc import Callable

from functools import wraps

from pyspark import SparkContext
from pyspark.sql import functions as F


def arrow(return_type: str):
    """Like pandas_udf, but modules may define it before there is a session."""

    def add(f):
        @wraps(f)
        def call(*columns):
            return F.pandas_udf(f, return_type)(*columns)

        return call

    return add


def once(build: Callable):
    """`build`, whose large expressions are built once for each Spark context: they name columns, not a plan's."""
    kept: dict = {}

    @wraps(build)
    def built():
        context = SparkContext._active_spark_context
        if not kept or kept["context"] is not context:
            kept.update(context=context, value=build())
        return kept["value"]

    return built
