"""Column profiles of delimited data: inferred type, missing values and statistics of each column.

Cells are unpivoted and aggregated, so that a table of any number of rows is profiled by partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filescope.functions import textual


def cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, value of each cell as text; null is blank."""
    names = columns or df.columns
    values = F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in names))
    return df.select(F.explode(values).alias("x")).select("x.column", "x.value")


def profile(found: DataFrame, *keys: str) -> DataFrame:
    """keys, column, inferred_type, missing, rows, numeric, min, max, avg, distinct of cells (keys, column, value).

    min, max and avg are null unless over 60 % of the cells are numbers; blanks count as 0 there.
    """
    flags = textual.value_flags(F.col("value"))
    own = found.withColumns(flags | {"x": textual.to_number(F.col("value"))})
    full = ~F.col("blank")
    every = lambda c: F.coalesce(F.bool_and(F.when(full, F.col(c))), F.lit(False))
    out = own.groupBy(*keys, "column").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("blank")).alias("missing"),
        *(every(c).alias(f"_{c}") for c in ("integer", "number", "boolean", "date")),
        F.count("x").alias("numeric"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.avg("x").alias("avg"),
        F.countDistinct("value").alias("distinct"),
    )
    kind = F.when(F.col("missing") == F.col("rows"), "empty")
    for c in ("integer", "number", "boolean", "date"):
        kind = kind.when(F.col(f"_{c}"), c)
    much = F.col("numeric") > F.col("rows") * 0.6
    return out.select(*keys, "column", kind.otherwise("text").alias("inferred_type"), "missing", "rows", "numeric", *(F.when(much, F.col(c)).alias(c) for c in ("min", "max", "avg")), "distinct")
