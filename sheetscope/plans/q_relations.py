"""Foreign-key queries: by name over many workbooks, by range and by value."""

from __future__ import annotations

from sheetscope.operators import relations as R
from sheetscope.operators.profile import integer_words
from sheetscope.plans import catalogs as C
from sheetscope.plans.base import Tables, each_column, query, rounded, stats_sql
from sheetscope.session import cut_lineage

PREFIX_CTE = """
    prefix_fk AS (
        SELECT c.workbook, c."table" AS from_table, c."column" AS from_column, t."table" AS to_table, 'ID' AS to_column,
               'prefix' AS rule,
               EXISTS (SELECT 1 FROM cols k WHERE k.workbook = c.workbook AND k."table" = t."table" AND k."column" = 'ID') AS target_exists
        FROM cols c JOIN (SELECT DISTINCT workbook, "table" FROM cols) t
          ON t.workbook = c.workbook AND contains(upper(t."table"), substr(upper(c."column"), 4))
        WHERE starts_with(upper(c."column"), 'ID_') AND upper(c."column") <> 'ID_'
    ),
    name_fk AS (
        SELECT a.workbook, a."table" AS from_table, a."column" AS from_column, b."table" AS to_table, b."column" AS to_column,
               'name' AS rule, true AS target_exists
        FROM cols a JOIN cols b ON a.workbook = b.workbook AND a."column" = b."column" AND a."table" <> b."table"
        WHERE upper(a."column") <> 'ID'
    )
"""
WITH = f"WITH {C.COLUMNS_CTE}, {PREFIX_CTE} "


@query("fk_by_prefix", WITH + "SELECT * FROM prefix_fk")
def fk_by_prefix(t: Tables):
    return R.fk_by_prefix(C.stored(t, C.columns), ["workbook"])


@query("fk_by_name", WITH + "SELECT * FROM name_fk")
def fk_by_name(t: Tables):
    return R.fk_by_name(C.stored(t, C.columns), ["workbook"])


@query(
    "fk_shared_columns",
    WITH
    + """SELECT workbook, "column", "table", count(*) OVER (PARTITION BY workbook, "column") AS n_tables FROM cols
         WHERE upper("column") <> 'ID' QUALIFY n_tables > 1""",
)
def fk_shared_columns(t: Tables):
    return R.shared_columns(C.stored(t, C.columns), ["workbook"])


@query(
    "fk_apparent",
    WITH
    + """SELECT workbook, from_table, from_column, to_table, to_column, max(rule) AS rule, bool_or(target_exists) AS target_exists
         FROM (SELECT * FROM prefix_fk UNION ALL SELECT * FROM name_fk) GROUP BY ALL""",
)
def fk_apparent(t: Tables):
    return R.apparent_fk(C.stored(t, C.columns), ["workbook"])


RANGES_CTE = f"""stats AS ({stats_sql()}), whole AS (SELECT * FROM stats WHERE spark_type IN ('int', 'bigint') AND non_null > 0),
    candidates AS (
        SELECT c."table" AS from_table, c."column" AS from_column, p."table" AS to_table, p."column" AS to_column,
               c.min::BIGINT AS child_min, c.max::BIGINT AS child_max, p.min::BIGINT AS parent_min, p.max::BIGINT AS parent_max,
               c.n_unique AS n_keys
        FROM whole c JOIN whole p ON c.spark_type = p.spark_type AND c."table" <> p."table"
             AND c.min >= p.min AND c.max <= p.max AND p.n_unique = p.non_null
    )"""
INTEGER_VALUES = each_column(
    lambda table, i, column, kind: (
        f"SELECT DISTINCT '{table}' AS \"table\", '{column}' AS \"column\", {column}::BIGINT AS v FROM {table} WHERE {column} IS NOT NULL"
    ),
    lambda kind: kind in ("i", "l"),
)


@query(
    "fk_value_overlap",
    f"""
    WITH {RANGES_CTE}, vals AS ({INTEGER_VALUES}),
    matched AS (
        SELECT a."table" AS from_table, a."column" AS from_column, b."table" AS to_table, b."column" AS to_column, count(*) AS n
        FROM vals a JOIN vals b ON a.v = b.v AND a."table" <> b."table" GROUP BY ALL
    )
    SELECT from_table, from_column, to_table, to_column, n_keys, coalesce(n, 0) AS n_matched,
           round(coalesce(n, 0) / n_keys, 6) AS coverage
    FROM candidates LEFT JOIN matched USING (from_table, from_column, to_table, to_column)
    """,
)
def fk_value_overlap(t: Tables):
    """Every pair that the ranges of all tables allow, from one inverted list of values."""
    words = cut_lineage(integer_words(t.all()))
    candidates = cut_lineage(R.fk_range_candidates(cut_lineage(R.integer_stats(t.all(), words))))
    return rounded(R.fk_overlaps(words, candidates), coverage=6)


@query(
    "fk_range_candidates",
    f"WITH {RANGES_CTE} SELECT * EXCLUDE (n_keys) FROM candidates",
)
def fk_range_candidates(t: Tables):
    # Written once, as both sides of the join read it.
    return R.fk_range_candidates(cut_lineage(R.integer_stats(t.all())))


@query(
    "fk_orphans",
    """
    SELECT 'child' AS side, l_orderkey AS key, count(*) AS n_rows FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 2
    UNION ALL
    SELECT 'parent', o_orderkey, count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 2
    """,
)
def fk_orphans(t: Tables):
    """Line items without an order, and orders without a line item."""
    return R.fk_orphans(t.lineitem, "l_orderkey", t.orders, "o_orderkey")


@query("fk_orphan_rows", "SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def fk_orphan_rows(t: Tables):
    """Documents without a label."""
    return R.orphan_rows(t.documents, "doc_id", t.labels, "doc_id")
