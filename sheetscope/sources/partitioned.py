"""Tables stored by partition: edits and summaries that touch only the partitions they concern."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetscope.functions.numbers import named
from sheetscope.session import cut_lineage
from sheetscope.sources.tables import PROFILE_SCHEMAS

SUMMARY_KEYS = ("table", "group_by", "metric")


def save_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Store ``df`` with one folder per value of ``by``, in place of what is there."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Put the partitions that ``df`` has rows of in place of the stored ones; the others keep their files."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def edit_partitions(
    spark: SparkSession, path: str, schema: str | T.StructType, by: Sequence[str], touched: DataFrame, edit: Callable[[DataFrame], DataFrame]
) -> None:
    """Apply ``edit`` to the rows of the ``touched`` partitions and store them again.

    ``touched`` holds the columns ``by`` of the changes (nulls are a partition of their
    own); ``edit`` is any edit of ``store``, given the current rows of those partitions.
    Only their files are read and rewritten. A partition that is left empty is removed.
    An edit that gives rows of another partition is an error, as it would replace that one.

    One row per touched partition reaches the driver, as in any listing of a stored table.
    """
    keys = [named(c) for c in by]
    wanted = touched.select(keys).distinct()
    values = wanted.collect()
    if not values:
        return
    stored = spark.read.schema(schema).parquet(path)
    for i, name in enumerate(by):
        # Over partition columns alone, so the files of other partitions are not listed for reading.
        stored = stored.filter(_any_of(named(name), [row[i] for row in values]))
    same = [named(c, "s").eqNullSafe(named(c, "w")) for c in by]
    current = stored.alias("s").join(wanted.alias("w"), same, "left_semi")
    edited = cut_lineage(edit(current).select(*map(named, stored.columns)))
    strays = edited.select(keys).distinct().alias("s").join(wanted.alias("w"), same, "left_anti")
    if not strays.isEmpty():
        raise ValueError(f"the edit gives rows of partitions that are not touched, such as {strays.first().asDict()}")
    left = edited.select(keys).distinct()
    files = stored.select(*keys, F.col("_metadata.file_path").alias("_file")).distinct().alias("s")
    mine = files.join(wanted.alias("w"), same, "left_semi").alias("s")
    emptied = mine.join(left.alias("w"), same, "left_anti").select("_file").distinct().collect()
    replace_partitions(edited, path, by)
    _remove_folders(spark, {row[0].rpartition("/")[0] for row in emptied})


def _any_of(col: Column, values: list) -> Column:
    known = [v for v in set(values) if v is not None]
    return (col.isin(known) if known else F.lit(False)) | (col.isNull() if None in values else F.lit(False))


def _remove_folders(spark: SparkSession, folders: set[str]) -> None:
    jvm = spark._jvm
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def replace_summaries(crosstab: DataFrame, path: str) -> None:
    """Store the summaries that ``crosstab`` holds; those of other pairs of columns stay as they are."""
    own = crosstab.select(T.StructType.fromDDL(PROFILE_SCHEMAS["crosstab"]).names)
    replace_partitions(own, path, SUMMARY_KEYS)


def read_summaries(
    spark: SparkSession, path: str, table: str | None = None, group_by: str | None = None, metric: str | None = None
) -> DataFrame:
    """Stored summary rows, of one table, category or measure if named; other folders are not read."""
    stored = spark.read.schema(PROFILE_SCHEMAS["crosstab"]).parquet(path)
    for name, value in zip(SUMMARY_KEYS, (table, group_by, metric)):
        if value is not None:
            stored = stored.filter(F.col(name) == value)
    return stored.select(T.StructType.fromDDL(PROFILE_SCHEMAS["crosstab"]).names)
