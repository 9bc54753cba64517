"""Derived columns and chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetscope.operators import charts as G
from sheetscope.operators import derive as D
from sheetscope.plans.base import Tables, query, rounded

AS_OF = "2002-01-01"


@query(
    "derive_related_count",
    """
    SELECT c.*, coalesce(n, 0) AS n_orders FROM customer c
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey
    """,
)
def derive_related_count(t: Tables):
    return D.derive(t.customer, t.pick("orders"), [D.RelatedCount("n_orders", "orders", "o_custkey", "c_custkey")])


@query("derive_exists", "SELECT *, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS has_lines FROM orders")
def derive_exists(t: Tables):
    return D.derive(t.orders, t.pick("lineitem"), [D.RelatedExists("has_lines", "lineitem", "l_orderkey", "o_orderkey")])


@query(
    "derive_bucket",
    """
    SELECT p_partkey, size, CASE WHEN size IS NULL THEN NULL WHEN size > 35 THEN 'Haut' WHEN size > 15 THEN 'Moyen' ELSE 'Bas' END AS level
    FROM (SELECT p_partkey, nullif(p_size, 7) AS size FROM part)
    """,
)
def derive_bucket(t: Tables):
    part = t.part.select("p_partkey", F.nullif("p_size", F.lit(7)).alias("size"))
    return D.derive(part, {}, [D.Bucket("level", "size", ((35, "Haut"), (15, "Moyen")), "Bas")])


@query(
    "derive_related_avg",
    """
    SELECT c.*, round(coalesce(s, 0) / greatest(coalesce(n, 0), 1), 6) AS mean_order FROM customer c
    LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END) AS s
               FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey
    """,
)
def derive_related_avg(t: Tables):
    """Rows with a null value count in the divisor, as do all related rows."""
    priced = t.orders.withColumn("price", F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")))
    plan = [D.RelatedAverage("mean_order", "orders", "o_custkey", "c_custkey", "price")]
    return rounded(D.derive(t.customer, {"orders": priced}, plan), mean_order=6)


@query(
    "derive_days_since",
    f"""
    SELECT o_orderkey, d, coalesce(datediff('day', d::DATE, DATE '{AS_OF}'), 0)::INT AS age
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS d FROM orders)
    """,
)
def derive_days_since(t: Tables):
    dated = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("d"))
    return D.derive(dated, {}, [D.DaysSince("age", "d", AS_OF)])


@query(
    "derive_null_flag",
    """
    SELECT doc_id, quality, note, coalesce(quality = 0, true) AS no_quality, coalesce(note = '', true) AS no_note
    FROM (SELECT doc_id, CASE WHEN toxic = 0 THEN quality END AS quality,
                 CASE WHEN quality = 0 THEN '' WHEN toxic = 1 THEN NULL ELSE 'ok' END AS note FROM labels)
    """,
)
def derive_null_flag(t: Tables):
    note = F.when(F.col("quality") == 0, "").when(F.col("toxic") == 1, None).otherwise("ok")
    rows = t.labels.select("doc_id", F.when(F.col("toxic") == 0, F.col("quality")).alias("quality"), note.alias("note"))
    return D.derive(rows, {}, [D.NullFlag("no_quality", "quality"), D.NullFlag("no_note", "note")])


@query(
    "derive_plan",
    f"""
    SELECT c.*, coalesce(n, 0) AS n_orders, n IS NOT NULL AS has_orders,
           round(coalesce(s, 0) / greatest(coalesce(n, 0), 1), 6) AS mean_order,
           CASE WHEN c_acctbal > 7000 THEN 'Haut' WHEN c_acctbal > 4500 THEN 'Moyen' ELSE 'Bas' END AS balance,
           'n_orders,has_orders,mean_order,balance' AS applied, 'age,ghosts' AS failed
    FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1) o
      ON c.c_custkey = o.o_custkey
    """,
)
def derive_plan(t: Tables):
    """Six features in one plan, two of which name things that do not exist."""
    plan = [
        D.RelatedCount("n_orders", "orders", "o_custkey", "c_custkey"),
        D.RelatedExists("has_orders", "orders", "o_custkey", "c_custkey"),
        D.RelatedAverage("mean_order", "orders", "o_custkey", "c_custkey", "o_totalprice"),
        D.Bucket("balance", "c_acctbal", ((7000, "Haut"), (4500, "Moyen")), "Bas"),
        D.DaysSince("age", "c_birthday", AS_OF),
        D.RelatedCount("ghosts", "phantoms", "k", "c_custkey"),
    ]
    table, applied, failed = D.apply_plan(t.customer, t.pick("orders"), plan)
    reported = table.withColumns({"applied": F.lit(",".join(applied)), "failed": F.lit(",".join(failed))})
    return rounded(reported, mean_order=6)


@query("chart_bar_count", "SELECT event_type AS x, count(value) AS y FROM events GROUP BY 1")
def chart_bar_count(t: Tables):
    return G.chart_data(t.events, "event_type", "value", "count")


@query("chart_bar_avg", "SELECT l_returnflag AS x, round(avg(l_extendedprice), 4) AS y FROM lineitem GROUP BY 1")
def chart_bar_avg(t: Tables):
    return rounded(G.chart_data(t.lineitem, "l_returnflag", "l_extendedprice", "avg"), y=4)


@query("chart_bar_sum", "SELECT l_suppkey AS x, round(sum(l_extendedprice), 2) AS y FROM lineitem GROUP BY 1")
def chart_bar_sum(t: Tables):
    return rounded(G.chart_data(t.lineitem, "l_suppkey", "l_extendedprice", "sum"), y=2)


@query(
    "chart_max_min",
    "SELECT p_brand AS x, max(p_retailprice) AS max_y, min(p_retailprice) AS min_y FROM part GROUP BY 1",
)
def chart_max_min(t: Tables):
    return G.chart_extremes(t.part, "p_brand", "p_retailprice")


@query(
    "chart_line",
    "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS x, round(avg(o_totalprice), 4) AS y FROM orders GROUP BY 1",
)
def chart_line(t: Tables):
    return rounded(G.chart_line(t.orders, "o_orderdate", "o_totalprice", "avg"), y=4)


@query(
    "chart_pie",
    """
    SELECT o_orderpriority AS x, round(sum(o_totalprice), 2) AS y, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 6) AS share
    FROM orders GROUP BY 1 QUALIFY count(*) OVER () >= 3
    """,
)
def chart_pie(t: Tables):
    return rounded(G.chart_pie(t.orders, "o_orderpriority", "o_totalprice", "sum"), y=2, share=6)
