"""Edits of a stored table: append, update, upsert, delete, filtered read, retype.

Each edit takes the current table and a DataFrame of changes and returns the new
table, to be written by the caller. Keys are unique on both sides of every join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetscope.functions.names import safe_column_names
from sheetscope.functions.numbers import FLOATING, known, named
from sheetscope.functions.types import SPARK_TYPES, canonical_type_name, clean_table, infer_types, to_logical


def project_to(target: DataFrame, records: DataFrame, row_id: str | None = "id") -> DataFrame:
    """``records`` in the columns of ``target``.

    Unknown columns and the row id are dropped, missing ones become null, and
    values that cannot be stored (NaN, infinities) become null.
    """
    incoming = {f.name: f for f in records.schema.fields if f.name != row_id}
    columns = []
    for field in target.schema.fields:
        if field.name in incoming:
            value = known(field.name, incoming[field.name].dataType)
            if isinstance(incoming[field.name].dataType, FLOATING):
                value = F.when(F.abs(value) != float("inf"), value)
            columns.append(value.cast(field.dataType).alias(field.name))
        else:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
    return records.select(columns)


def append_records(target: DataFrame, records: DataFrame, row_id: str | None = "id") -> DataFrame:
    """``target`` followed by the projected ``records``."""
    return target.unionByName(project_to(target, records, row_id))


def append_to(path: str, target: DataFrame, records: DataFrame, row_id: str | None = "id") -> None:
    """Append in place: only the new rows are written."""
    project_to(target, records, row_id).write.mode("append").parquet(path)


def update_records(table: DataFrame, patch: DataFrame, row_id: str, given: Mapping[str, str]) -> DataFrame:
    """Overwrite fields by row id.

    ``given`` maps a field to the boolean column of ``patch`` that says whether
    the row gives it: a field given as null overwrites, one not given does not.
    """
    base, change = table.alias("base"), patch.alias("patch")
    columns = [
        F.when(named(given[name], "patch"), named(name, "patch")).otherwise(named(name, "base")).alias(name)
        if name in given
        else named(name, "base")
        for name in table.columns
    ]
    return base.join(change, named(row_id, "base") == named(row_id, "patch"), "left").select(columns)


def latest_per_key(patch: DataFrame, require: Sequence[str], version: str) -> DataFrame:
    """The change with the highest version of each key, combined in the task first.

    Changes of one version are told apart by their other columns, in order.
    """
    others = [c for c in patch.columns if c not in (*require, version)]
    newest = F.max(F.struct(*map(named, [version, *others]))).alias("_newest")
    keys = [named(c) for c in require]
    return patch.groupBy(*keys).agg(newest).select(*keys, *[F.col("_newest").getField(c).alias(c) for c in others])


def upsert_records(
    table: DataFrame,
    patch: DataFrame,
    require: Sequence[str],
    version: str | None = None,
    given: Mapping[str, str] | None = None,
) -> DataFrame:
    """Update rows whose ``require`` columns match, insert the others.

    Where several changes carry one key, the highest ``version`` wins. A null leaves a
    field as it is, unless ``given`` maps the field to a boolean column of ``patch``
    that says the row gives it; then a null overwrites.
    """
    given = given or {}
    if version is not None:
        patch = latest_per_key(patch, require, version)
    base, change = table.alias("base"), patch.alias("patch")
    same = [named(name, "base") == named(name, "patch") for name in require]
    columns = []
    for name in table.columns:
        if name in require:
            columns.append(F.coalesce(named(name, "base"), named(name, "patch")).alias(name))
        elif name in given:
            columns.append(F.when(named(given[name], "patch"), named(name, "patch")).otherwise(named(name, "base")).alias(name))
        elif name in patch.columns:
            columns.append(F.coalesce(named(name, "patch"), named(name, "base")).alias(name))
        else:
            columns.append(named(name, "base"))
    return base.join(change, same, "full_outer").select(columns)


def delete_records(table: DataFrame, ids: DataFrame, row_id: str) -> DataFrame:
    """Rows whose id is not listed."""
    return table.alias("base").join(ids.select(named(row_id)).distinct().alias("gone"), named(row_id, "base") == named(row_id, "gone"), "left_anti")


def read_records(
    table: DataFrame,
    filter: Mapping[str, Sequence[Any]] | None = None,
    sort: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Rows whose columns hold one of the listed values, sorted and limited.

    A ``-`` before a sort column means descending.
    """
    for name, values in (filter or {}).items():
        table = table.filter(named(name).isin(*values))
    if sort:
        table = table.orderBy(*[named(s[1:]).desc() if s.startswith("-") else named(s).asc() for s in sort])
    return table if limit is None else table.limit(limit)


def alter_columns(
    table: DataFrame,
    add: Mapping[str, str] | None = None,
    retype: Mapping[str, str] | None = None,
    rename: Mapping[str, str] | None = None,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Add empty typed columns, change logical types, rename and drop."""
    kept = []
    for field in table.schema.fields:
        if field.name in drop:
            continue
        col = known(field.name, field.dataType)
        if retype and field.name in retype:
            col = to_logical(col, field.dataType, retype[field.name])
        kept.append(col.alias((rename or {}).get(field.name, field.name)))
    for name, logical in (add or {}).items():
        kept.append(F.lit(None).cast(SPARK_TYPES[canonical_type_name(logical)]).alias(name))
    return table.select(kept)


def create_table(spark: SparkSession, name: str, columns: Mapping[str, str]) -> DataFrame:
    """An empty catalog table with typed columns."""
    empty = spark.createDataFrame([], "placeholder string")
    typed = alter_columns(empty, add=columns, drop=["placeholder"])
    typed.write.mode("errorifexists").saveAsTable(name)
    return spark.table(name)


def drop_table(spark: SparkSession, name: str) -> None:
    """Remove a catalog table; silent when it does not exist."""
    spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", args={"name": name})


def ingest(df: DataFrame, path: str | None = None) -> DataFrame:
    """Load a table: safe names and clean values, optionally written to ``path``."""
    clean = clean_table(df)
    if path is not None:
        clean.write.mode("overwrite").parquet(path)
    return clean


def ingest_typed(df: DataFrame, path: str | None = None) -> DataFrame:
    """Load a table with every column stored under its inferred logical type.

    The inference is one aggregate; its answer, one row per column, decides the
    projection.
    """
    found = {row["column"]: row for row in infer_types(df).collect()}
    names = safe_column_names(df.columns)
    typed = df.select(
        [
            to_logical(known(f.name, f.dataType), f.dataType, found[f.name]["logical_type"], found[f.name]["day_first"]).alias(name)
            for f, name in zip(df.schema.fields, names)
        ]
    )
    if path is not None:
        typed.write.mode("overwrite").parquet(path)
    return typed
