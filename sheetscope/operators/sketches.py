"""Profiles that merge: counts, ranges, sums and distinct-count sketches.

A folder that grows is profiled file by file: the profile of the new files is united with
the stored one, and no file is read twice. Counts, ranges and sums stay exact; distinct
counts come from HyperLogLog sketches, whose state is stored and united.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetscope.functions.numbers import INTEGRAL, is_numeric, known_sql, text_literal
from sheetscope.sources.tables import union_all

#: Two to this power are a sketch's registers; its error is about 1.04 over their square root.
LOG_REGISTERS = 13


def profile_sketches(tables: dict[str, DataFrame], log_registers: int = LOG_REGISTERS) -> DataFrame:
    """One mergeable row a column: ``table, position, column, spark_type, is_numeric, n_rows,
    non_null, min, max, total, sketch``. One aggregate a table, one row a task.
    """
    parts = []
    for table, df in tables.items():
        aggregates, rows = ["'n_rows', count(1)"], []
        for i, field in enumerate(df.schema.fields):
            col = known_sql(field.name, field.dataType)
            plain = isinstance(field.dataType, (*INTEGRAL, T.StringType))
            cell = f"cast({col} as bigint)" if isinstance(field.dataType, INTEGRAL) else col
            hashed = cell if plain else f"if({col} is null, null, xxhash64({col}))"
            aggregates.append(f"'c{i}', count({col}), 'h{i}', hll_sketch_agg({hashed}, {log_registers})")
            low = high = total = "cast(null as double)"
            if is_numeric(field.dataType):
                aggregates.append(f"'lo{i}', min({col}), 'hi{i}', max({col}), 's{i}', sum(cast({col} as double))")
                low, high, total = (f"cast(m.{part}{i} as double)" for part in ("lo", "hi", "s"))
            rows.append(
                f"named_struct('table', {text_literal(table)}, 'position', {i}, 'column', {text_literal(field.name)}, "
                f"'spark_type', {text_literal(field.dataType.simpleString())}, 'is_numeric', {str(is_numeric(field.dataType)).lower()}, "
                f"'n_rows', m.n_rows, 'non_null', m.c{i}, 'min', {low}, 'max', {high}, 'total', {total}, 'sketch', m.h{i})"
            )
        parts.append(df.agg(F.expr(f"named_struct({', '.join(aggregates)})").alias("m")).selectExpr(f"inline(array({', '.join(rows)}))"))
    return union_all(parts)


def unite_sketches(*profiles: DataFrame) -> DataFrame:
    """One profile from those of separate rows of the same tables.

    A column that only some of them have counts as null in the others' rows.
    """
    union = union_all(list(profiles))
    sizes = union.select("table", "n_rows", F.struct("position").alias("p")).groupBy("table", "p").agg(F.sum("n_rows").alias("n"))
    whole = sizes.groupBy("table").agg(F.max("n").alias("n_rows"))
    keys = ["table", "column", "spark_type", "is_numeric"]
    merged = union.groupBy(*keys).agg(
        F.min("position").alias("position"), F.sum("non_null").alias("non_null"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.sum("total").alias("total"), F.hll_union_agg("sketch").alias("sketch"),
    )
    return merged.join(whole, "table").select(profiles[0].columns)


def approximate_stats(sketches: DataFrame) -> DataFrame:
    """Statistics of every column; ``n_unique`` is an estimate, at most ``non_null``."""
    return sketches.select(
        "table", "position", "column", "spark_type", "is_numeric", "n_rows", "non_null",
        (F.col("n_rows") - F.col("non_null")).alias("n_null"),
        F.least(F.hll_sketch_estimate("sketch"), F.col("non_null")).alias("n_unique"),
        "min", "max", F.try_divide("total", "non_null").alias("avg"),
    )
