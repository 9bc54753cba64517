"""Catalogs of many workbooks, derived from the test tables.

Each customer is a workbook. Its sheets, columns, insights, chart sections and
questions are computed from the customer's orders and line items, so they grow
with the data. Every catalog comes with the SQL that gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetscope.operators.crosstab import summary_name_of
from sheetscope.operators.insights import report
from sheetscope.plans.base import Tables
from sheetscope.session import cut_lineage
from sheetscope.sources.tables import file_states


# Catalogs written so far, by application, the files they come from, and builder.
_WRITTEN: dict[tuple, DataFrame] = {}


def stored(t: Tables, build) -> DataFrame:
    """A catalog that queries read several times: computed once a session and written out.

    It is computed anew when a file of the folder has come, gone or changed.
    """
    key = t.spark.sparkContext.applicationId, file_states(t.spark, t.root), build.__name__
    if key not in _WRITTEN:
        _WRITTEN[key] = cut_lineage(build(t))
    return _WRITTEN[key]


def _sheet():
    """The order priority without its number names a sheet."""
    return F.substring("o_orderpriority", 3, 100)


def _total():
    return F.concat(F.lit("total_"), F.year("o_orderdate").cast("string"))


def _status_column(finished, opened, pending):
    return F.when(F.col("o_orderstatus") == "F", finished).when(F.col("o_orderstatus") == "O", opened).otherwise(pending)


def columns(t: Tables) -> DataFrame:
    """``workbook, table, position, column, is_numeric``.

    One sheet per priority with yearly totals and, by order status, coordinates or
    a site name; one sheet per status with references to the priority sheets.
    """
    status_sheet = F.concat(F.lit("Statut_"), "o_orderstatus")
    cell = lambda table, column, numeric: F.struct(
        table.alias("table"), column.alias("column"), numeric.alias("is_numeric")
    )
    cells = F.array(
        cell(_sheet(), _total(), F.lit(True)),
        cell(
            _sheet(),
            _status_column(F.lit("Latitude"), F.lit("Longitude"), F.lit("Nom_site")),
            F.col("o_orderstatus") != "P",
        ),
        cell(_sheet(), F.when(F.col("o_orderstatus") == "F", F.lit("ID")), F.lit(True)),
        cell(status_sheet, F.concat(F.lit("ID_"), _sheet()), F.lit(False)),
        cell(status_sheet, _total(), F.lit(True)),
    )
    # Cells of a sheet meet by one shuffle and one order, which numbers the columns and lays
    # equal cells side by side. Telling cells apart by hash held most of a split's at once.
    named = t.orders.select(F.col("o_custkey").alias("workbook"), F.inline(cells)).filter("column is not null")
    by_name = W.partitionBy("workbook", "table").orderBy("column", "is_numeric")
    own = F.struct("column", "is_numeric")
    return (
        named.withColumns({"position": F.dense_rank().over(by_name) - 1, "_before": F.lag(own).over(by_name)})
        .filter(~F.col("_before").eqNullSafe(own))
        .drop("_before")
    )


COLUMNS_CTE = """
    cells AS (
        SELECT o_custkey AS workbook, substr(o_orderpriority, 3) AS sheet, 'Statut_' || o_orderstatus AS status_sheet,
               'total_' || year(o_orderdate) AS total, o_orderstatus AS st FROM orders
    ),
    named AS (
        SELECT workbook, sheet AS "table", total AS "column", true AS is_numeric FROM cells
        UNION SELECT workbook, sheet, CASE st WHEN 'F' THEN 'Latitude' WHEN 'O' THEN 'Longitude' ELSE 'Nom_site' END, st <> 'P' FROM cells
        UNION SELECT workbook, sheet, 'ID', true FROM cells WHERE st = 'F'
        UNION SELECT workbook, status_sheet, 'ID_' || sheet, false FROM cells
        UNION SELECT workbook, status_sheet, total, true FROM cells
    ),
    cols AS (
        SELECT workbook, "table", "column", is_numeric,
               (row_number() OVER (PARTITION BY workbook, "table" ORDER BY "column") - 1)::INT AS position FROM named
    )
"""


def insights(t: Tables) -> DataFrame:
    """``workbook, seq, type, table, col, finding, priority``: one per order.

    Pending orders of low priority carry a type that does not exist, finished ones
    a priority out of range.
    """
    low = F.col("o_orderpriority") == "5-LOW"
    kind = _status_column(F.lit("trend"), F.lit("distribution"), F.when(low, "forecast").otherwise("outlier"))
    number = F.substring("o_orderpriority", 1, 1).cast("int")
    return t.orders.select(
        F.col("o_custkey").alias("workbook"),
        F.col("o_orderkey").alias("seq"),
        kind.alias("type"),
        _sheet().alias("table"),
        _status_column(_total(), F.lit("Longitude"), F.lit("Nom_site")).alias("col"),
        F.concat(F.lit("Commande "), F.col("o_orderkey").cast("string"), F.lit(" de "), _total()).alias("finding"),
        F.when(low & (F.col("o_orderstatus") == "F"), 6).otherwise(number).alias("priority"),
    )


INSIGHTS_CTE = """
    insights AS (
        SELECT o_custkey AS workbook, o_orderkey AS seq,
               CASE WHEN o_orderstatus = 'F' THEN 'trend' WHEN o_orderstatus = 'O' THEN 'distribution'
                    WHEN o_orderpriority = '5-LOW' THEN 'forecast' ELSE 'outlier' END AS type,
               substr(o_orderpriority, 3) AS "table",
               CASE o_orderstatus WHEN 'F' THEN 'total_' || year(o_orderdate) WHEN 'O' THEN 'Longitude' ELSE 'Nom_site' END AS col,
               'Commande ' || o_orderkey || ' de total_' || year(o_orderdate) AS finding,
               CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN 6 ELSE o_orderpriority[1]::INT END AS priority
        FROM orders
    ),
    reports AS (
        SELECT workbook, (row_number() OVER (PARTITION BY workbook ORDER BY priority, seq) - 1)::INT AS idx,
               type, "table", col, finding, priority
        FROM insights WHERE type IN ('distribution', 'trend', 'outlier', 'relation', 'kpi') AND priority BETWEEN 1 AND 5
        QUALIFY idx < 5
    )
"""


def questions(t: Tables) -> DataFrame:
    """``workbook, question`` from the latest order; blank where it is pending."""
    latest = t.orders.groupBy(F.col("o_custkey").alias("workbook")).agg(
        F.max(F.struct("o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus")).alias("o")
    )
    text = F.concat(
        F.lit("Total "), F.year("o.o_orderdate").cast("string"), F.lit(" pour "), F.substring("o.o_orderpriority", 3, 100)
    )
    return latest.select("workbook", F.when(F.col("o.o_orderstatus") == "P", "  ").otherwise(text).alias("question"))


QUESTIONS_CTE = """
    questions AS (
        SELECT o_custkey AS workbook, CASE WHEN o_orderstatus = 'P' THEN '  '
               ELSE 'Total ' || year(o_orderdate) || ' pour ' || substr(o_orderpriority, 3) END AS question
        FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
    )
"""


def sections(t: Tables) -> DataFrame:
    """Chart sections, one per line item: plan = order, workbook = its customer."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    line = F.col("l_linenumber")
    tax = F.round(F.col("l_tax") * 100).cast("int")
    discount = F.round(F.col("l_discount") * 100).cast("int")
    is_chart = (F.col("l_linestatus") == "O") | (line <= 3)
    widget = (
        F.when(is_chart, "chart").when(line == 4, "table").when(line == 5, "card_list").when(line == 6, "form").otherwise("gauge")
    )
    chart_type = (
        F.when(tax.isin(1, 5, 8), "bar").when(tax.isin(2, 6), "line").when(tax == 3, "pie").when(tax == 4, "area")
        .when(tax == 7, "radar")
    )
    table = (
        F.when(discount <= 4, F.concat(F.lit("role_"), F.lower(_sheet())))
        .when(discount <= 6, F.concat(F.lit("RÔLE_"), _sheet()))
        .when(discount <= 8, F.concat(F.lit("statut_"), F.lower("o_orderstatus")))
        .when(discount == 10, "fantome")
    )
    year = lambda c: F.concat(F.lit("total_"), F.year(c).cast("string"))
    x = F.when(F.col("l_returnflag") == "A", year("l_shipdate")).when(F.col("l_returnflag") == "N", "latitude").otherwise("Inconnu")
    y = F.when(F.col("l_quantity") < 20, year("o_orderdate")).when(F.col("l_quantity") < 35, x).when(F.col("l_quantity") >= 45, "nb_derive")
    finding = F.concat(F.lit("Commande "), F.col("l_orderkey").cast("string"), F.lit(" de "), year("o_orderdate"))
    title = (
        F.when(F.col("l_returnflag") == "A", F.concat(F.upper(finding), F.lit(" (détail)")))
        .when(F.col("l_returnflag") == "N", F.concat(F.lit("commande "), F.col("l_orderkey").cast("string"), F.lit(" de")))
        .otherwise(F.concat(F.lit("Article "), F.col("l_partkey").cast("string")))
    )
    return t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("workbook"), F.col("l_orderkey").alias("plan_id"),
        F.when(line <= 3, 1).otherwise(2).alias("page_no"), line.alias("section_no"),
        widget.alias("widget"), F.when(is_chart, chart_type).alias("chart_type"), table.alias("table"),
        x.alias("x"), y.alias("y"), title.alias("title"),
    )


SECTIONS_CTE = """
    lines AS (
        SELECT *, round(l_tax * 100)::INT AS tax, round(l_discount * 100)::INT AS discount,
               (l_linestatus = 'O' OR l_linenumber <= 3) AS is_chart, substr(o_orderpriority, 3) AS sheet
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    ),
    axes AS (
        SELECT *, CASE l_returnflag WHEN 'A' THEN 'total_' || year(l_shipdate) WHEN 'N' THEN 'latitude' ELSE 'Inconnu' END AS x FROM lines
    ),
    sections AS (
        SELECT o_custkey AS workbook, l_orderkey AS plan_id, CASE WHEN l_linenumber <= 3 THEN 1 ELSE 2 END AS page_no,
               l_linenumber AS section_no,
               CASE WHEN is_chart THEN 'chart' WHEN l_linenumber = 4 THEN 'table' WHEN l_linenumber = 5 THEN 'card_list'
                    WHEN l_linenumber = 6 THEN 'form' ELSE 'gauge' END AS widget,
               CASE WHEN NOT is_chart THEN NULL WHEN tax IN (1, 5, 8) THEN 'bar' WHEN tax IN (2, 6) THEN 'line'
                    WHEN tax = 3 THEN 'pie' WHEN tax = 4 THEN 'area' WHEN tax = 7 THEN 'radar' END AS chart_type,
               CASE WHEN discount <= 4 THEN 'role_' || lower(sheet) WHEN discount <= 6 THEN 'RÔLE_' || sheet
                    WHEN discount <= 8 THEN 'statut_' || lower(o_orderstatus) WHEN discount = 10 THEN 'fantome' END AS "table",
               x,
               CASE WHEN l_quantity < 20 THEN 'total_' || year(o_orderdate) WHEN l_quantity < 35 THEN x
                    WHEN l_quantity >= 45 THEN 'nb_derive' END AS y,
               CASE l_returnflag WHEN 'A' THEN 'COMMANDE ' || l_orderkey || ' DE TOTAL_' || year(o_orderdate) || ' (détail)'
                    WHEN 'N' THEN 'commande ' || l_orderkey || ' de' ELSE 'Article ' || l_partkey END AS title
        FROM axes
    )
"""


def tables(t: Tables) -> DataFrame:
    """``workbook, table`` of every sheet."""
    return stored(t, columns).select("workbook", "table").distinct()


def roles(t: Tables) -> DataFrame:
    """``workbook, role, table, position``: priority sheets play a role each."""
    return (
        tables(t)
        .filter(~F.col("table").startswith("Statut_"))
        .select("workbook", F.concat(F.lit("role_"), F.lower("table")).alias("role"), "table", F.lit(0).alias("position"))
    )


def all_columns(t: Tables) -> DataFrame:
    """Raw columns and one derived column per priority sheet."""
    derived = roles(t).select("workbook", "table", F.lit(100).alias("position"), F.lit("nb_dérivé").alias("column"))
    return stored(t, columns).select("workbook", "table", "position", "column").unionByName(derived)


def reports(t: Tables) -> DataFrame:
    """The report of each workbook."""
    return report(insights(t))


ROLES_CTE = """
    tabs AS (SELECT DISTINCT workbook, "table" FROM cols),
    roles AS (
        SELECT workbook, 'role_' || lower("table") AS role, "table" FROM tabs WHERE NOT starts_with("table", 'Statut_')
    ),
    all_cols AS (
        SELECT workbook, "table", position, "column" FROM cols
        UNION ALL SELECT workbook, "table", 100, 'nb_dérivé' FROM roles
    )
"""


def crosstabs(t: Tables) -> DataFrame:
    """``workbook, position, name, source_table, group_by, metric``: sheets that have
    both a site name and a yearly total."""
    text = ~F.col("is_numeric") & ~F.col("column").startswith("ID")
    number = F.col("is_numeric") & F.col("column").startswith("total_")
    pick = lambda condition: F.min(F.when(condition, F.struct("position", "column"))).getField("column")
    both = (
        stored(t, columns).groupBy("workbook", "table").agg(pick(text).alias("group_by"), pick(number).alias("metric")).dropna()
    )
    first = W.partitionBy("workbook").orderBy("table")
    return (
        both.withColumn("position", F.row_number().over(first) - 1)
        .select(
            "workbook", "position", summary_name_of(F.col("table"), F.col("group_by"), F.col("metric")).alias("name"),
            F.col("table").alias("source_table"), "group_by", "metric",
        )
    )


CROSSTABS_CTE = """
    crosstabs AS (
        SELECT workbook, (row_number() OVER (PARTITION BY workbook ORDER BY "table") - 1)::INT AS position,
               'Corr_' || replace("table", ' ', '_') || '_' || group_by || '_' || metric AS name,
               "table" AS source_table, group_by, metric
        FROM (
            SELECT workbook, "table",
                   arg_min("column", position) FILTER (NOT is_numeric AND NOT starts_with("column", 'ID')) AS group_by,
                   arg_min("column", position) FILTER (is_numeric AND starts_with("column", 'total_')) AS metric
            FROM cols GROUP BY ALL
        ) WHERE group_by IS NOT NULL AND metric IS NOT NULL
    )
"""

# The table role that each kind of event stands for.
EVENT_ROLES = {
    "signup": "Users",
    "error": "Incidents",
    "view": "Assets",
    "click": "Tickets",
    "purchase": "Customers",
}


def event_tables(t: Tables) -> DataFrame:
    """``workbook, table``: a user's day, with one table per kind of event."""
    pairs = F.create_map(*[F.lit(part) for pair in EVENT_ROLES.items() for part in pair])
    day = F.date_format("ts", "yyyy-MM-dd")
    return t.events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("_"), day).alias("workbook"),
        F.try_element_at(pairs, F.col("event_type")).alias("table"),
    )


def event_overrides(t: Tables) -> DataFrame:
    """``workbook, domain``: days with two purchases or more were put right by hand."""
    return (
        event_tables(t).filter("table = 'Customers'").groupBy("workbook").count().filter("count >= 2")
        .select("workbook", F.lit("DECISIONNEL").alias("domain"))
    )


# Sheet and column that an event of a user's day stands for.
EVENT_COLUMNS = {
    "signup": ("Employés", "Salaire brut"), "error": ("Incidents", "numeroSerie"), "view": ("Feuille 1", "Départements"),
    "click": ("Suivi", "Ticket_No"), "purchase": ("Ventes 2024", "Nom du client"),
}


def event_columns(t: Tables) -> DataFrame:
    """``workbook, table, column``: a workbook per user and day, a column per event."""
    kinds = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in EVENT_COLUMNS.items() for x in pair])
    names = F.try_element_at(kinds, F.col("event_type"))
    workbook = F.concat(F.lit("u"), F.col("user_id"), F.lit("_"), F.date_format("ts", "yyyy-MM-dd"))
    return t.events.select(workbook.alias("workbook"), names[0].alias("table"), names[1].alias("column"))


EVENT_TABLES_CTE = """
    event_tables AS (
        SELECT 'u' || user_id || '_' || strftime(ts, '%Y-%m-%d') AS workbook,
               CASE event_type WHEN 'signup' THEN 'Users' WHEN 'error' THEN 'Incidents' WHEN 'view' THEN 'Assets'
                    WHEN 'click' THEN 'Tickets' WHEN 'purchase' THEN 'Customers' END AS "table" FROM events
    ),
    hits AS (
        SELECT workbook, CASE "table" WHEN 'Users' THEN 'SI' WHEN 'Incidents' THEN 'SI' WHEN 'Assets' THEN 'SI' ELSE 'SUPPORT' END AS domain,
               count(DISTINCT "table") AS n FROM event_tables WHERE "table" IS NOT NULL GROUP BY ALL
    ),
    best AS (
        SELECT workbook, domain, n / sum(n) OVER (PARTITION BY workbook) AS confidence FROM hits
        QUALIFY row_number() OVER (PARTITION BY workbook ORDER BY n DESC, domain) = 1
    ),
    tags AS (
        SELECT workbook, CASE WHEN confidence >= 0.6 THEN domain ELSE 'GENERIC' END AS domain, confidence FROM best
    )
"""
