"""Chart specifications of many plans, checked against reports and catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetscope.operators import insights as I
from sheetscope.operators import specs as V
from sheetscope.plans import catalogs as C
from sheetscope.plans.base import Tables, query, rounded

SECTIONS = f"WITH {C.SECTIONS_CTE}, {C.INSIGHTS_CTE}, {C.COLUMNS_CTE}, {C.ROLES_CTE} "

RESOLVED_CTE = """
    , resolved AS (
        SELECT s.*, coalesce(
            (SELECT min(r."table") FROM roles r WHERE r.workbook = s.workbook AND r.role = s."table"),
            (SELECT min(r."table") FROM roles r WHERE r.workbook = s.workbook AND lower(strip_accents(r.role)) = lower(strip_accents(s."table"))),
            (SELECT min(b."table") FROM tabs b WHERE b.workbook = s.workbook AND lower(strip_accents(b."table")) = lower(strip_accents(s."table")))
        ) AS table_id FROM sections s
    ),
    found AS (
        SELECT s.*,
            (SELECT coalesce(max(c."column") FILTER (c."column" = s.x), arg_min(c."column", c.position)) FROM all_cols c
             WHERE c.workbook = s.workbook AND c."table" = s.table_id AND lower(strip_accents(c."column")) = lower(strip_accents(s.x))) AS fx,
            (SELECT coalesce(max(c."column") FILTER (c."column" = s.y), arg_min(c."column", c.position)) FROM all_cols c
             WHERE c.workbook = s.workbook AND c."table" = s.table_id AND lower(strip_accents(c."column")) = lower(strip_accents(s.y))) AS fy
        FROM resolved s
    ),
    checked AS (
        SELECT workbook, plan_id, page_no, section_no, widget, chart_type, "table", x, y, title, table_id,
            CASE WHEN table_id IS NULL THEN 'table ''' || coalesce("table", '') || ''' unresolvable'
                 WHEN widget = 'chart' AND x IS NOT NULL AND fx IS NULL THEN 'x col ''' || x || ''' not in ' || table_id
                 WHEN widget = 'chart' AND y IS NOT NULL AND fy IS NULL THEN 'y col ''' || y || ''' not in ' || table_id END AS reason
        FROM found
    )
"""

REASON_SQL = """
    CASE WHEN widget NOT IN ('chart', 'table', 'card_list', 'card', 'form') THEN 'unknown widget'
         WHEN widget = 'chart' AND chart_type IS NULL THEN 'chart without chart_type'
         WHEN chart_type NOT IN ('bar', 'line', 'pie', 'area') THEN 'unknown chart_type'
         WHEN widget = 'chart' AND chart_type = 'line' AND (x IS NULL OR y IS NULL) THEN 'line without axis' END
"""


@query("spec_reasons", SECTIONS + f"SELECT *, {REASON_SQL} AS reason FROM sections")
def spec_reasons(t: Tables):
    return V.spec_reasons(C.sections(t))


@query("spec_prefilter", SECTIONS + f"SELECT * FROM sections WHERE ({REASON_SQL}) IS NULL")
def spec_prefilter(t: Tables):
    return V.valid_specs(C.sections(t))


@query(
    "spec_justified",
    SECTIONS
    + """SELECT * FROM sections s WHERE widget <> 'chart' OR EXISTS (
            SELECT 1 FROM reports r WHERE r.workbook = s.workbook
            AND (contains(lower(s.title), lower(r.finding)) OR contains(lower(r.finding), lower(s.title))))""",
)
def spec_justified(t: Tables):
    return V.justified_specs(C.sections(t), I.report(C.insights(t)))


def _resolved(t: Tables):
    return V.resolve_tables(C.sections(t), C.roles(t), C.tables(t))


@query("spec_resolve", SECTIONS + RESOLVED_CTE + "SELECT * FROM resolved")
def spec_resolve(t: Tables):
    return _resolved(t)


@query("spec_columns_exist", SECTIONS + RESOLVED_CTE + "SELECT * FROM checked")
def spec_columns_exist(t: Tables):
    return V.check_specs(_resolved(t), C.all_columns(t))


@query(
    "spec_drop_ratio",
    SECTIONS
    + RESOLVED_CTE
    + """SELECT workbook, plan_id, count(*) AS n_sections, count(reason) AS n_dropped, round(count(reason) / count(*), 6) AS drop_ratio,
                count(reason) / count(*) > 0.5 AS retry FROM checked GROUP BY 1, 2""",
)
def spec_drop_ratio(t: Tables):
    return rounded(V.drop_ratios(V.check_specs(_resolved(t), C.all_columns(t))), drop_ratio=6)


@query(
    "spec_axes",
    SECTIONS
    + RESOLVED_CTE
    + """SELECT workbook, plan_id, section_no, widget, table_id, x, y, title,
            CASE WHEN fx IS NOT NULL AND fy IS NOT NULL AND fx <> fy THEN fx || ', ' || fy WHEN fx IS NOT NULL THEN fx
                 ELSE (SELECT string_agg(c."column", ', ' ORDER BY c.position) FROM all_cols c
                       WHERE c.workbook = f.workbook AND c."table" = f.table_id AND c.position < 2) END AS axes
         FROM found f""",
)
def spec_axes(t: Tables):
    return V.chart_axes(_resolved(t), C.all_columns(t)).select(
        "workbook", "plan_id", "section_no", "widget", "table_id", "x", "y", "title", F.array_join("axes", ", ").alias("axes")
    )
