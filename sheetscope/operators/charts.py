"""Data behind a chart: ``agg(y) by x``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetscope.functions.numbers import known, named
from sheetscope.operators.insights import period_start

# The aggregates a chart may ask for.
AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}
PIE_SLICES = 3


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def _aggregate(df: DataFrame, y: str, agg: str) -> Column:
    if agg not in AGGREGATES:
        raise ValueError(f"agg must be one of {sorted(AGGREGATES)}")
    return AGGREGATES[agg](known(y, _types(df)[y])).alias("y")


def chart_data(df: DataFrame, x: str, y: str, agg: str) -> DataFrame:
    """``x, y`` for a bar chart; ``count`` counts the known values of ``y``."""
    return df.groupBy(named(x).alias("x")).agg(_aggregate(df, y, agg))


def chart_extremes(df: DataFrame, x: str, y: str) -> DataFrame:
    """Highest and lowest ``y`` per ``x``, in one pass."""
    value = known(y, _types(df)[y])
    return df.groupBy(named(x).alias("x")).agg(F.max(value).alias("max_y"), F.min(value).alias("min_y"))


def chart_line(df: DataFrame, x: str, y: str, agg: str, unit: str = "month") -> DataFrame:
    """``x, y`` along time, one point per period, in time order."""
    if not isinstance(_types(df)[x], (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError("a line needs a date on x")
    points = df.filter(named(x).isNotNull()).groupBy(period_start(df, x, unit).alias("x")).agg(_aggregate(df, y, agg))
    return points.orderBy("x")


def chart_pie(df: DataFrame, x: str, y: str, agg: str) -> DataFrame:
    """``x, y, share`` for a text ``x`` with at least three values.

    Total and slice count come from a scalar subquery over the grouped rows, so no
    window pulls them into one task.
    """
    if not isinstance(_types(df)[x], T.StringType):
        raise ValueError("a pie needs text on x")
    slices = df.filter(named(x).isNotNull()).groupBy(named(x).alias("x")).agg(_aggregate(df, y, agg))
    whole = slices.agg(F.struct(F.sum("y").alias("total"), F.count(F.lit(1)).alias("n")).alias("w")).scalar()
    return (
        slices.withColumn("_w", whole)
        .filter(F.col("_w.n") >= PIE_SLICES)
        .select("x", "y", F.try_divide("y", "_w.total").alias("share"))
    )
