"""Null rules for numbers: NaN is missing, and infinities cannot be stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.MapType, T.StructType)


def is_numeric(data_type: T.DataType) -> bool:
    """Booleans are categories here, not numbers."""
    return isinstance(data_type, NUMERIC)


def quoted(name: str) -> str:
    """A column name as SQL text, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def named(name: str, side: str | None = None) -> Column:
    """A column by its name, whatever characters it holds; ``side`` is a join's alias."""
    return F.col(f"{side}.{quoted(name)}" if side else quoted(name))


def text_literal(value: str) -> str:
    """A string as SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def known_sql(name: str, data_type: T.DataType) -> str:
    """SQL text of the column with NaN read as null.

    Expressions made for every column of a schema are built as text: one parser
    call costs far less on the driver than a tree of function calls.
    """
    return f"nanvl({quoted(name)}, null)" if isinstance(data_type, FLOATING) else quoted(name)


def known(name: str, data_type: T.DataType) -> Column:
    """The column with NaN read as null."""
    return F.expr(known_sql(name, data_type))


def finite(col: Column) -> Column:
    """NaN and both infinities become null."""
    return F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col)


def with_known(df: DataFrame) -> DataFrame:
    """Every floating column of ``df`` with NaN read as null."""
    return df.select([known(f.name, f.dataType).alias(f.name) for f in df.schema.fields])


def filled(df: DataFrame, *names: str) -> DataFrame:
    """Rows where every named column is known.

    The plain null test comes first because a file scan can apply it; NaN is told
    apart afterwards, on floating columns only.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    df = df.filter(" and ".join(f"{quoted(n)} is not null" for n in names))
    floating = [n for n in names if isinstance(types[n], FLOATING)]
    return df.filter(" and ".join(f"not isnan({quoted(n)})" for n in floating)) if floating else df
