"""Checks of chart specifications against reports and column catalogs.

``sections`` is flat: one row per section with ``workbook, plan_id, page_no,
section_no, widget, chart_type, table, x, y, title``. A page is gone when its last
section is. Every lookup is an equality join with one row per key on the right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetscope.functions.names import match_key
from sheetscope.operators.insights import reports_by_workbook

# The widgets and chart types of a plan, and the share of dropped
# sections above which it should be composed again.
WIDGET_TYPES = ("chart", "table", "card_list", "card", "form")
CHART_TYPES = ("bar", "line", "pie", "area")
RETRY_ABOVE = 0.5
FALLBACK_COLUMNS = 2


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name) == "", F.lit(True))


def _is_chart() -> Column:
    return F.coalesce(F.col("widget") == "chart", F.lit(False))


def spec_reasons(sections: DataFrame) -> DataFrame:
    """Add ``reason``: why a section is not a valid specification, else null."""
    reason = (
        F.when(~F.coalesce(F.col("widget").isin(*WIDGET_TYPES), F.lit(False)), "unknown widget")
        .when(_is_chart() & _blank("chart_type"), "chart without chart_type")
        .when(~_blank("chart_type") & ~F.col("chart_type").isin(*CHART_TYPES), "unknown chart_type")
        .when(_is_chart() & (F.col("chart_type") == "line") & (_blank("x") | _blank("y")), "line without axis")
    )
    return sections.withColumn("reason", reason)


def valid_specs(sections: DataFrame) -> DataFrame:
    """Sections that pass ``spec_reasons``."""
    return spec_reasons(sections).filter("reason is null").drop("reason")


def justified_specs(sections: DataFrame, reports: DataFrame) -> DataFrame:
    """Charts whose title holds a finding of their workbook or lies within one.

    Other widgets and untitled charts stay. A report holds at most five findings,
    so it joins as one row per workbook and no section is repeated.
    """
    findings = reports_by_workbook(reports).select(
        "workbook", F.transform("entries", lambda e: F.lower(e["finding"])).alias("_findings")
    )
    title = F.lower("title")
    told = F.exists("_findings", lambda f: F.contains(title, f) | F.contains(f, title))
    return (
        sections.join(findings, "workbook", "left")
        .filter(~_is_chart() | _blank("title") | F.coalesce(told, F.lit(False)))
        .select(*sections.columns)
    )


def resolve_tables(sections: DataFrame, roles: DataFrame, tables: DataFrame) -> DataFrame:
    """Add ``table_id``: by role, by role spelled otherwise, then by table name.

    ``roles`` is ``workbook, role, table, position``; ``tables`` is ``workbook,
    table`` with raw, derived and summary tables alike.
    """
    # An exact match is also a match by key, so one lookup per key serves all three
    # rules; the roles under one key are the spellings of a single name.
    by_key = (
        roles.select(
            "workbook", match_key(F.col("role")).alias("_key"), F.struct("position", "role", "table").alias("_role"),
            F.lit(None).cast("string").alias("_named"),
        )
        .unionByName(
            tables.select(
                "workbook", match_key(F.col("table")).alias("_key"),
                F.lit(None).cast("struct<position:int,role:string,table:string>").alias("_role"), F.col("table").alias("_named"),
            )
        )
        .groupBy("workbook", "_key")
        .agg(F.array_sort(F.collect_set("_role")).alias("_roles"), F.min("_named").alias("_named"))
    )
    exact = F.filter("_roles", lambda r: r["role"] == F.col("table"))
    first = lambda entries: F.try_element_at(entries, F.lit(1)).getField("table")
    return (
        sections.withColumn("_key", match_key(F.coalesce("table", F.lit(""))))
        .join(by_key, ["workbook", "_key"], "left")
        .select(*sections.columns, F.coalesce(first(exact), first(F.col("_roles")), "_named").alias("table_id"))
    )


def _by_table(columns: DataFrame) -> DataFrame:
    """One row per workbook and table: its columns' names and match keys, by position."""
    column = F.struct("position", "column", match_key(F.col("column")).alias("key"))
    return (
        columns.groupBy("workbook", F.col("table").alias("table_id"))
        .agg(F.array_sort(F.collect_set(column)).alias("_columns"))
        .select("workbook", "table_id", F.col("_columns.column").alias("_names"), F.col("_columns.key").alias("_keys"))
    )


def _axis(axis: str) -> Column:
    """The column of the joined table that ``axis`` names, exact spelling first."""
    place = F.array_position("_keys", match_key(F.col(axis))).cast("int")
    return F.when(
        ~_blank(axis),
        F.when(F.array_contains("_names", F.col(axis)), F.col(axis)).when(place > 0, F.try_element_at("_names", place)),
    )


def _with_axes(resolved: DataFrame, tables: DataFrame) -> DataFrame:
    """Add ``_x`` and ``_y``, the column each axis names, and what else ``tables`` tells.

    ``tables`` is one row per table, so one join serves both axes.
    """
    return resolved.join(tables, ["workbook", "table_id"], "left").withColumns({"_x": _axis("x"), "_y": _axis("y")})


def check_specs(resolved: DataFrame, columns: DataFrame) -> DataFrame:
    """Add ``reason``: an unknown table, or an axis its table does not have.

    ``columns`` is ``workbook, table, position, column`` and includes derived and
    summary columns. Axes may be missing; only charts are checked for them.
    """
    missing = lambda axis: F.format_string(f"{axis} col '%s' not in %s", F.col(axis), F.col("table_id"))
    reason = (
        F.when(F.col("table_id").isNull(), F.format_string("table '%s' unresolvable", F.coalesce("table", F.lit(""))))
        .when(_is_chart() & ~_blank("x") & F.col("_x").isNull(), missing("x"))
        .when(_is_chart() & ~_blank("y") & F.col("_y").isNull(), missing("y"))
    )
    return _with_axes(resolved, _by_table(columns)).withColumn("reason", reason).select(*resolved.columns, "reason")


def drop_ratios(checked: DataFrame) -> DataFrame:
    """Per plan: sections, dropped sections, their ratio, and whether to retry."""
    ratio = F.col("n_dropped") / F.col("n_sections")
    return (
        checked.groupBy("workbook", "plan_id")
        .agg(F.count(F.lit(1)).alias("n_sections"), F.count("reason").alias("n_dropped"))
        .withColumn("drop_ratio", ratio)
        .withColumn("retry", F.col("drop_ratio") > RETRY_ABOVE)
    )


def chart_axes(resolved: DataFrame, columns: DataFrame) -> DataFrame:
    """Add ``axes``: x and y, x alone when y is absent or the same, else the first
    two columns of the table."""
    # Both groupings are by table, so the catalog is shuffled once.
    by_table = columns.repartition("workbook", "table")
    first = W.partitionBy("workbook", "table").orderBy("position")
    leading = (
        by_table.withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") <= FALLBACK_COLUMNS)
        .groupBy("workbook", F.col("table").alias("table_id"))
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "column"))).alias("_leading"))
    )
    axes = (
        F.when(F.col("_x").isNotNull() & F.col("_y").isNotNull(), F.array_distinct(F.array("_x", "_y")))
        .when(F.col("_x").isNotNull(), F.array("_x"))
        .otherwise(F.transform("_leading", lambda c: c["column"]))
    )
    tables = _by_table(by_table).join(leading, ["workbook", "table_id"])
    return _with_axes(resolved, tables).select(*resolved.columns, axes.alias("axes"))
