"""Order-dependent results over a whole table, without one task holding it.

A window with no partition key sends every row to one task. Here the rows are
range-partitioned on the order key, each slice is worked on by itself, and only
one row per slice is carried across.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetscope.functions.numbers import named
from sheetscope.session import cut_lineage


def range_slices(df: DataFrame, order: Sequence[Column], slices: int | None = None) -> DataFrame:
    """``df`` with a ``_slice`` number that grows with ``order``.

    The order must be total; a slice then holds a fair share of the rows whatever
    the key distribution. The result is written out because slice numbers must not
    change when a task is run again.
    """
    count = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *order).withColumn("_slice", F.spark_partition_id())
    return cut_lineage(ranged)


def running_total(df: DataFrame, order: Sequence[Column], amount: str, name: str) -> DataFrame:
    """Add ``name``, the running sum of ``amount`` in ``order``, slice by slice."""
    sliced = range_slices(df, order)
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy("_slice")
        .agg(F.sum(amount).alias("_total"))
        .select("_slice", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    )
    inside = W.partitionBy("_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        sliced.join(offsets, "_slice")
        .withColumn(name, F.col("_before") + F.sum(amount).over(inside))
        .drop("_slice", "_before")
    )


def is_increasing(df: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """Per column, whether it never falls when rows are read in ``order``.

    Returns ``column, increasing``. A null makes the answer false. Rows that share
    an order value have no order among themselves, so they are folded to their
    lowest and highest value first; that also takes the heat out of a hot key.
    """
    folded = df.groupBy(F.col(order).alias("_at")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(named(c)).alias(f"n_{i}") for i, c in enumerate(columns)],
        *[F.min(named(c)).alias(f"lo_{i}") for i, c in enumerate(columns)],
        *[F.max(named(c)).alias(f"hi_{i}") for i, c in enumerate(columns)],
    )
    sliced = range_slices(folded, [F.col("_at")])
    inside = W.partitionBy("_slice").orderBy("_at")
    steps = sliced.select(
        "*",
        *[F.lag(f"hi_{i}").over(inside).alias(f"prev_{i}") for i in range(len(columns))],
    )
    per_slice = steps.groupBy("_slice").agg(
        *[
            F.bool_and(
                (F.col(f"n_{i}") == F.col("_n"))
                & F.coalesce(F.col(f"lo_{i}") >= F.col(f"prev_{i}"), F.lit(True))
            ).alias(f"ok_{i}")
            for i in range(len(columns))
        ],
        *[F.min(f"lo_{i}").alias(f"lo_{i}") for i in range(len(columns))],
        *[F.max(f"hi_{i}").alias(f"hi_{i}") for i in range(len(columns))],
    )
    across = W.orderBy("_slice")
    joined = per_slice.select(
        *[
            (F.col(f"ok_{i}") & F.coalesce(F.col(f"lo_{i}") >= F.lag(f"hi_{i}").over(across), F.lit(True))).alias(f"ok_{i}")
            for i in range(len(columns))
        ]
    )
    verdict = joined.agg(*[F.coalesce(F.bool_and(f"ok_{i}"), F.lit(True)).alias(f"ok_{i}") for i in range(len(columns))])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"ok_{i}").alias("increasing")) for i, c in enumerate(columns)]
    return verdict.select(F.inline(F.array(*rows)))
