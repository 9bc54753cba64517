"""Derived columns: related counts, existence, buckets, safe means, ages, null flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetscope.functions.numbers import is_numeric, known, named

# Fixed value: a plan holds at most this many derived columns.
MAX_FEATURES = 6


@dataclass(frozen=True)
class RelatedCount:
    """Number of rows of ``child`` whose ``fk`` equals this row's ``pk``."""

    name: str
    child: str
    fk: str
    pk: str


@dataclass(frozen=True)
class RelatedExists:
    """Whether ``child`` has any row for this key."""

    name: str
    child: str
    fk: str
    pk: str


@dataclass(frozen=True)
class RelatedAverage:
    """Sum of ``value`` over the related rows by their number; 0 without rows."""

    name: str
    child: str
    fk: str
    pk: str
    value: str


@dataclass(frozen=True)
class Bucket:
    """First label whose limit lies below the value, else ``rest``."""

    name: str
    column: str
    limits: tuple[tuple[float, str], ...]
    rest: str


@dataclass(frozen=True)
class DaysSince:
    """Whole days from a date to ``as_of``; 0 without a date."""

    name: str
    column: str
    as_of: str


@dataclass(frozen=True)
class NullFlag:
    """True for null, empty text and zero."""

    name: str
    column: str


Related = (RelatedCount, RelatedExists, RelatedAverage)
Feature = RelatedCount | RelatedExists | RelatedAverage | Bucket | DaysSince | NullFlag


def _local_column(df: DataFrame, feature: Feature) -> Column:
    fields = {f.name: f.dataType for f in df.schema.fields}
    if feature.column not in fields:
        raise LookupError(f"no column {feature.column!r}")
    col = known(feature.column, fields[feature.column])
    if isinstance(feature, Bucket):
        label = F
        for limit, text in feature.limits:
            label = label.when(col > limit, text)
        return F.when(col.isNotNull(), label.otherwise(feature.rest))
    if isinstance(feature, DaysSince):
        return F.coalesce(F.datediff(F.lit(feature.as_of).cast("date"), col), F.lit(0))
    if fields[feature.column].simpleString() == "boolean":
        return ~F.coalesce(col, F.lit(False))
    if is_numeric(fields[feature.column]):
        return F.coalesce(col == 0, F.lit(True))
    if fields[feature.column].simpleString() == "string":
        return F.coalesce(col == "", F.lit(True))
    return col.isNull()


def _join_related(df: DataFrame, child: DataFrame, fk: str, pk: str, features: Sequence[Feature]) -> DataFrame:
    """One aggregate and one join for all features over the same child and key.

    The child is reduced to one row per key before the join, so no row of ``df``
    is repeated and a key with very many children costs one row per task.
    """
    if pk not in df.columns:
        raise LookupError(f"no column {pk!r}")
    types = {f.name: f.dataType for f in child.schema.fields}
    aggregates = [F.count(F.lit(1)).alias("_n")]
    for i, feature in enumerate(features):
        if isinstance(feature, RelatedAverage):
            if feature.value not in types:
                raise LookupError(f"no column {feature.value!r}")
            aggregates.append(F.sum(known(feature.value, types[feature.value])).alias(f"_s{i}"))
    per_key = child.groupBy(named(fk).alias("_fk")).agg(*aggregates)
    rows = F.coalesce("_n", F.lit(0).cast("bigint"))
    columns = []
    for i, feature in enumerate(features):
        if isinstance(feature, RelatedCount):
            value = rows
        elif isinstance(feature, RelatedExists):
            value = F.col("_n").isNotNull()
        else:
            value = F.coalesce(F.col(f"_s{i}"), F.lit(0)) / F.greatest(rows, F.lit(1))
        columns.append(value.alias(feature.name))
    joined = df.alias("d").join(per_key, named(pk, "d") == F.col("_fk"), "left")
    return joined.select(*[named(c, "d") for c in df.columns], *columns)


def derive(df: DataFrame, tables: Mapping[str, DataFrame], features: Sequence[Feature]) -> DataFrame:
    """``df`` with every feature as a column, in plan order."""
    kept = list(df.columns)
    groups: dict[tuple[str, str, str], list[Feature]] = {}
    for feature in features:
        if isinstance(feature, Related):
            groups.setdefault((feature.child, feature.fk, feature.pk), []).append(feature)
    result = df
    for (child, fk, pk), members in groups.items():
        if child not in tables:
            raise LookupError(f"no table {child!r}")
        result = _join_related(result, tables[child], fk, pk, members)
    local = {f.name: _local_column(df, f) for f in features if not isinstance(f, Related)}
    return result.withColumns(local).select(*[named(c) for c in [*kept, *[f.name for f in features]]])


def apply_plan(
    df: DataFrame, tables: Mapping[str, DataFrame], features: Sequence[Feature]
) -> tuple[DataFrame, list[str], list[str]]:
    """Apply what can be applied: the table, the applied names, the failed names.

    Each feature is checked by analysing it alone, which needs schemas only; the
    good ones are then applied together.
    """
    if len(features) > MAX_FEATURES:
        raise ValueError(f"a plan holds at most {MAX_FEATURES} derived columns")
    good, failed = [], []
    for feature in features:
        try:
            derive(df, tables, [feature]).schema
            good.append(feature)
        except (AnalysisException, LookupError):
            failed.append(feature.name)
    return derive(df, tables, good), [f.name for f in good], failed
