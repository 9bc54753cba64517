"""Insights computed from the tables, and reports over many workbooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetscope.operators import insights as I
from sheetscope.plans import catalogs as C
from sheetscope.plans.base import Tables, query, rounded

REPORTS = f"WITH {C.INSIGHTS_CTE} "


def _distribution_sql(column: str, table: str) -> str:
    return f"""
    SELECT value, n, round(n / sum(n) OVER (), 6) AS share,
           round(sum(n) OVER (ORDER BY n DESC, value ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS cumulative_share
    FROM (SELECT {column}::VARCHAR AS value, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY 1)
    """


@query("insight_distribution", _distribution_sql("p_name", "part"))
def insight_distribution(t: Tables):
    return rounded(I.distribution(t.part, "p_name"), share=6, cumulative_share=6)


@query("insight_distribution_keys", _distribution_sql("l_orderkey", "lineitem"))
def insight_distribution_keys(t: Tables):
    """A column with very many values."""
    return rounded(I.distribution(t.lineitem, "l_orderkey"), share=6, cumulative_share=6)


@query(
    "insight_trend",
    """
    WITH p AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, sum(o_totalprice) AS total FROM orders GROUP BY 1)
    SELECT period, round(total, 2) AS total, round(avg(total) OVER (), 2) AS mean_total,
           round((total - avg(total) OVER ()) / avg(total) OVER (), 6) AS gap_to_mean,
           round((total - lag(total) OVER (ORDER BY period)) / lag(total) OVER (ORDER BY period), 6) AS change FROM p
    """,
)
def insight_trend(t: Tables):
    return rounded(
        I.trend(t.orders, "o_orderdate", "o_totalprice"), total=2, mean_total=2, gap_to_mean=6, change=6
    )


@query(
    "insight_outliers",
    """
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_extendedprice, l.l_returnflag, round(s.mean, 6) AS mean, round(s.spread, 4) AS spread
    FROM lineitem l JOIN (
        SELECT l_returnflag, l_quantity, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS spread FROM lineitem GROUP BY 1, 2
    ) s ON l.l_returnflag = s.l_returnflag AND l.l_quantity = s.l_quantity
    WHERE abs(l_extendedprice - mean) > 1.5 * spread
    """,
)
def insight_outliers(t: Tables):
    found = I.sigma_outliers(t.lineitem, "l_extendedprice", ["l_returnflag", "l_quantity"], 1.5)
    return rounded(
        found.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag", "mean", "spread"), mean=6, spread=4
    )


@query(
    "insight_outliers_global",
    """
    SELECT event_id, event_type, value FROM events
    WHERE abs(value - (SELECT avg(value) FROM events)) > 3 * (SELECT stddev_samp(value) FROM events)
    """,
)
def insight_outliers_global(t: Tables):
    return I.sigma_outliers(t.events, "value", []).select("event_id", "event_type", "value")


_FENCES = """
    SELECT {by} round(q1, 4) AS q1, round(q3, 4) AS q3, round(q1 - 1.5 * (q3 - q1), 4) AS lower_fence,
           round(q3 + 1.5 * (q3 - q1), 4) AS upper_fence, count(*) AS n,
           count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outliers
    FROM events JOIN (SELECT {by} quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events {group}) {on}
    GROUP BY ALL
"""


@query("insight_fences", _FENCES.format(by="event_type,", group="GROUP BY event_type", on="USING (event_type)"))
def insight_fences(t: Tables):
    return rounded(I.fence_outliers(t.events, "value", ["event_type"]), q1=4, q3=4, lower_fence=4, upper_fence=4)


@query("insight_fences_global", _FENCES.format(by="", group="", on="ON true"))
def insight_fences_global(t: Tables):
    return rounded(I.fence_outliers(t.events, "value", []), q1=4, q3=4, lower_fence=4, upper_fence=4)


@query(
    "insight_quantiles",
    "\nUNION ALL\n".join(
        f"SELECT l_returnflag, {p}::DOUBLE AS p, round(quantile_cont(l_extendedprice, {p}), 4) AS quantile FROM lineitem GROUP BY 1"
        for p in (0.0, 0.1, 0.5, 0.99, 1.0)
    ),
)
def insight_quantiles(t: Tables):
    return rounded(
        I.quantiles(t.lineitem, "l_extendedprice", ["l_returnflag"], [0.0, 0.1, 0.5, 0.99, 1.0]), quantile=4
    )


@query(
    "insight_correlation",
    """
    SELECT 'l_quantity' AS left_col, 'l_extendedprice' AS right_col, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem
    UNION ALL SELECT 'l_discount', 'l_tax', round(corr(l_discount, l_tax), 6) FROM lineitem
    """,
)
def insight_correlation(t: Tables):
    return rounded(I.correlation(t.lineitem, [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")]), r=6)


@query(
    "insight_group_gap",
    """
    WITH m AS (SELECT p_brand AS grp, avg(p_retailprice) AS mean FROM part GROUP BY 1)
    SELECT arg_max(grp, mean) AS highest, round(max(mean), 4) AS highest_mean, arg_min(grp, mean) AS lowest,
           round(min(mean), 4) AS lowest_mean, round(max(mean) - min(mean), 4) AS gap FROM m
    """,
)
def insight_group_gap(t: Tables):
    return rounded(I.group_gap(t.part, "p_brand", "p_retailprice"), highest_mean=4, lowest_mean=4, gap=4)


@query(
    "insight_kpis",
    "\nUNION ALL\n".join(
        f"SELECT '{m}' AS measure, count({m}) AS n, round(sum({m}), 2)::DOUBLE AS total, round(avg({m}), 4) AS mean, "
        f"min({m})::DOUBLE AS min, max({m})::DOUBLE AS max FROM lineitem"
        for m in ("l_quantity", "l_extendedprice", "l_linenumber")
    ),
)
def insight_kpis(t: Tables):
    return rounded(I.kpis(t.lineitem, ["l_quantity", "l_extendedprice", "l_linenumber"]), total=2, mean=4)


@query("insight_top5", REPORTS + "SELECT * FROM reports")
def insight_top5(t: Tables):
    return I.report(C.insights(t))


@query(
    "insight_rejects",
    REPORTS
    + """SELECT * EXCLUDE (place) FROM (
             SELECT * EXCLUDE (fits), CASE WHEN type = 'forecast' THEN 'unknown type' WHEN priority > 5 THEN 'priority out of range'
                 WHEN place > 5 THEN 'report is full' END AS reason
             FROM (SELECT *, row_number() OVER (PARTITION BY workbook, fits ORDER BY priority, seq) AS place
                   FROM (SELECT *, type <> 'forecast' AND priority <= 5 AS fits FROM insights))
         ) WHERE reason IS NOT NULL""",
)
def insight_rejects(t: Tables):
    return I.rejects(C.insights(t))


@query(
    "insight_selection",
    REPORTS
    + """, chosen AS (SELECT DISTINCT o_custkey AS workbook, year(o_orderdate) - 1995 AS idx FROM orders WHERE o_orderpriority = '2-HIGH'),
    kept AS (SELECT r.* FROM reports r SEMI JOIN chosen c ON r.workbook = c.workbook AND r.idx = c.idx)
    SELECT * FROM kept UNION ALL SELECT r.* FROM reports r WHERE r.workbook NOT IN (SELECT workbook FROM kept)""",
)
def insight_selection(t: Tables):
    """Indices picked by urgent orders, some beyond the end of the report."""
    chosen = t.orders.filter("o_orderpriority = '2-HIGH'").select(
        F.col("o_custkey").alias("workbook"), (F.year("o_orderdate") - 1995).alias("idx")
    )
    return I.select_insights(I.report(C.insights(t)), chosen)


@query(
    "insight_digest",
    REPORTS
    + """SELECT workbook, string_agg('- **' || "table" || ' / ' || col || '** : ' || finding, chr(10) ORDER BY priority, idx) AS digest
         FROM reports GROUP BY 1""",
)
def insight_digest(t: Tables):
    return I.digest(I.report(C.insights(t)))
