"""Sources, store edits, names, types and cleaning."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sheetscope.functions import names as N
from sheetscope.functions import types as Y
from sheetscope.plans.base import LOGICAL, Tables, each_column, query
from sheetscope.session import shared_folder
from sheetscope.sources import store as S
from sheetscope.sources.partitioned import edit_partitions, save_partitioned
from sheetscope.sources.tables import column_catalog, preview


@query(
    "preview_orders",
    "SELECT * FROM orders ORDER BY o_orderkey LIMIT 50",
)
def preview_orders(t: Tables):
    return preview(t.orders, ["o_orderkey"])


@query(
    "column_catalog",
    each_column(
        lambda table, i, column, kind: (
            f"SELECT '{table}' AS \"table\", {i} AS position, '{column}' AS \"column\", '{LOGICAL[kind]}' AS logical_type, "
            f"count(*) AS n_rows, count({column}) AS filled FROM {table}"
        )
    ),
)
def catalog(t: Tables):
    return column_catalog(t.all())


@query(
    "append_projected",
    """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
    UNION ALL
    SELECT s_suppkey + 1000000, s_name, s_nationkey, CASE WHEN s_nationkey = 3 THEN NULL ELSE s_acctbal END, NULL FROM supplier
    """,
)
def append_projected(t: Tables):
    """Suppliers appended to customers: an unknown column and a row id are
    dropped, a missing column is null, and NaN is stored as null."""
    nan = F.when(F.col("s_nationkey") == 3, F.lit(float("nan"))).otherwise(F.col("s_acctbal"))
    records = t.supplier.select(
        F.col("s_suppkey").alias("id"), (F.col("s_suppkey") + 1000000).alias("c_custkey"), F.col("s_name").alias("c_name"),
        F.col("s_nationkey").alias("c_nationkey"), nan.alias("c_acctbal"), F.lit("x").alias("unknown"),
    )
    return S.append_records(t.customer, records)


@query(
    "update_by_id",
    """
    WITH patch AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total, count(*) AS n, bool_or(l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1)
    SELECT o.o_orderkey, o.o_custkey,
           CASE WHEN p.returned THEN NULL ELSE o.o_orderstatus END AS o_orderstatus,
           CASE WHEN p.n >= 3 THEN p.total ELSE o.o_totalprice END AS o_totalprice, o.o_orderdate, o.o_orderpriority
    FROM orders o LEFT JOIN patch p ON o.o_orderkey = p.l_orderkey
    """,
)
def update_by_id(t: Tables):
    """Totals from the line items; a returned order has its status set to null."""
    patch = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("o_totalprice"),
        (F.count(F.lit(1)) >= 3).alias("gives_total"),
        F.lit(None).cast("string").alias("o_orderstatus"),
        F.bool_or(F.col("l_returnflag") == "R").alias("gives_status"),
    )
    return S.update_records(
        t.orders, patch, "o_orderkey", {"o_totalprice": "gives_total", "o_orderstatus": "gives_status"}
    )


@query(
    "upsert_customers",
    """
    WITH patch AS (
        SELECT o_custkey + 100 AS c_custkey, o_totalprice AS c_acctbal,
               CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS c_mktsegment
        FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1
    )
    SELECT coalesce(c.c_custkey, p.c_custkey) AS c_custkey, c.c_name, c.c_nationkey,
           coalesce(p.c_acctbal, c.c_acctbal) AS c_acctbal, coalesce(p.c_mktsegment, c.c_mktsegment) AS c_mktsegment
    FROM customer c FULL JOIN patch p ON c.c_custkey = p.c_custkey
    """,
)
def upsert_customers(t: Tables):
    """Changes from orders: several per key, some for customers that do not exist."""
    patch = t.orders.select(
        (F.col("o_custkey") + 100).alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("c_mktsegment"), F.col("o_orderkey").alias("version"),
    )
    return S.upsert_records(t.customer, patch, ["c_custkey"], "version")


@query(
    "delete_by_id",
    "SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
)
def delete_by_id(t: Tables):
    ids = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.delete_records(t.orders, ids, "o_orderkey")


@query(
    "edit_by_partition",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN year(o_orderdate) = 1998 THEN NULL ELSE o_totalprice END AS o_totalprice,
           o_orderdate, o_orderpriority, CAST(year(o_orderdate) AS INT) AS year
    FROM orders
    WHERE year(o_orderdate) NOT IN (1996, 1997) OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
    """,
)
def edit_by_partition(t: Tables):
    """Orders stored by year: those returned go from two years, a third loses its totals,
    and the folders of all other years stay as they are."""
    path = f"{shared_folder(t.spark)}/orders-{uuid.uuid4().hex}"
    orders = t.orders.withColumn("year", F.year("o_orderdate"))
    save_partitioned(orders, path, ["year"])
    edit = lambda years, change: edit_partitions(
        t.spark, path, orders.schema, ["year"], t.spark.createDataFrame([(y,) for y in years], "year int"), change
    )
    returned = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    edit((1996, 1997), lambda rows: S.delete_records(rows, returned, "o_orderkey"))
    emptied = orders.select("o_orderkey", F.lit(None).cast("double").alias("o_totalprice"), F.lit(True).alias("given"))
    edit((1998,), lambda rows: S.update_records(rows, emptied, "o_orderkey", {"o_totalprice": "given"}))
    return t.spark.read.schema(orders.schema).parquet(path)


@query(
    "read_filter_sort_limit",
    """
    SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT')
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 100
    """,
)
def read_filter_sort_limit(t: Tables):
    return S.read_records(
        t.orders, {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT"]}, ["-o_totalprice", "o_orderkey"], 100
    )


@query(
    "alter_columns",
    """
    SELECT p_partkey::DOUBLE AS p_partkey, p_name AS label, p_brand, p_size::VARCHAR AS p_size, p_retailprice::BIGINT AS p_retailprice,
           NULL::BOOLEAN AS flag, NULL::DATE AS seen, NULL::BIGINT AS supplier_ref
    FROM (SELECT * REPLACE (trunc(p_retailprice) AS p_retailprice) FROM part)
    """,
)
def alter_columns(t: Tables):
    return S.alter_columns(
        t.part,
        add={"flag": "Toggle", "seen": "Date", "supplier_ref": "Ref"},
        retype={"p_partkey": "Numeric", "p_size": "Text", "p_retailprice": "Int"},
        rename={"p_name": "label"},
        drop=["p_type"],
    )


def _raw_orders(t: Tables):
    """Orders as a sheet would hold them: spaced names, NaN, infinity, an interval."""
    price = F.col("o_totalprice")
    return t.orders.select(
        F.col("o_orderkey").alias("N° commande"),
        F.when(price < 100000, float("nan")).when(price > 400000, float("inf")).otherwise(price).alias("Prix été"),
        F.col("o_orderdate").alias("2e date"),
        (F.col("o_orderdate") + F.expr("make_dt_interval(0, 0, 0, cast(o_orderkey as decimal(18,6)) / 1000)")).alias("instant"),
        F.col("o_orderdate").cast("date").alias("jour"),
        F.col("o_orderpriority").alias("priority"),
    )


@query(
    "ingest_clean",
    """
    SELECT o_orderkey AS "N°_commande",
           CASE WHEN o_totalprice BETWEEN 100000 AND 400000 THEN o_totalprice END AS "Prix_ete",
           strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS "Col_2e_date",
           CASE WHEN o_orderkey % 1000 = 0 THEN strftime(m, '%Y-%m-%dT%H:%M:%S') ELSE strftime(m, '%Y-%m-%dT%H:%M:%S.%f') END AS instant,
           strftime(o_orderdate, '%Y-%m-%d') AS jour, o_orderpriority AS priority
    FROM (SELECT *, o_orderdate + to_microseconds(o_orderkey * 1000) AS m FROM orders)
    """,
)
def ingest_clean(t: Tables):
    return S.ingest(_raw_orders(t))


def _dirty_orders(t: Tables):
    """Text columns in the spellings that type inference has to see through."""
    status = F.col("o_orderstatus")
    day = F.col("o_orderdate")
    return t.orders.select(
        F.when(status == "F", "Oui").when(status == "O", "non").otherwise("VRAI").alias("switch"),
        F.when(status == "F", F.col("o_custkey").cast("string")).when(status == "O", F.concat(F.lit(" "), F.col("o_orderkey").cast("string"))).alias("whole"),
        F.when(status == "P", F.lit("1e3")).otherwise(F.format_string("%.2f", "o_totalprice")).alias("number"),
        F.when(status == "F", F.date_format(day, "yyyy-MM-dd")).when(status == "O", F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "MMM d, yyyy")).alias("day"),
        F.when(status == "F", F.date_format(day, "yyyy-MM-dd 10:20:30")).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("moment"),
        F.when(F.col("o_orderkey") == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("mixed"),
        F.nullif(F.col("o_orderkey"), F.col("o_orderkey")).alias("empty"),
        F.when(status == "F", 1).when(status == "O", 0).alias("bit"),
        F.floor("o_totalprice").cast("double").alias("whole_double"),
        day.alias("typed_day"),
        (day + F.expr("make_dt_interval(0, 1)")).alias("typed_moment"),
        F.when(status == "F", F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("nan_price"),
    )


@query(
    "infer_types",
    """
    WITH d AS (
        SELECT CASE o_orderstatus WHEN 'F' THEN 'Oui' WHEN 'O' THEN 'non' ELSE 'VRAI' END AS switch,
               CASE o_orderstatus WHEN 'F' THEN o_custkey::VARCHAR WHEN 'O' THEN ' ' || o_orderkey END AS whole,
               CASE o_orderstatus WHEN 'P' THEN '1e3' ELSE printf('%.2f', o_totalprice) END AS number,
               CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'O' THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%b %-d, %Y') END AS day,
               CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d 10:20:30') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS moment,
               CASE WHEN o_orderkey = 0 THEN 'n/a' ELSE o_custkey::VARCHAR END AS mixed,
               NULL::VARCHAR AS empty,
               CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '0' END AS bit,
               floor(o_totalprice)::BIGINT::VARCHAR AS whole_double,
               strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS typed_day,
               strftime(o_orderdate + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS typed_moment,
               CASE WHEN o_orderstatus <> 'F' THEN o_totalprice::VARCHAR END AS nan_price
        FROM orders
    ), tall AS (UNPIVOT d ON COLUMNS(*) INTO NAME "column" VALUE v),
    parsed AS (
        SELECT "column", v, try_cast(trim(v) AS DOUBLE) AS num,
               coalesce(try_strptime(v, ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%d/%m/%Y', '%b %-d, %Y'])) AS ts FROM tall
    ), kinds AS (
        SELECT "column", CASE
            WHEN bool_and(lower(v) IN ('true', 'false', 'vrai', 'faux', 'oui', 'non', '1', '0')) THEN 'Toggle'
            WHEN bool_and(num IS NOT NULL) THEN CASE WHEN bool_and(num = floor(num)) THEN 'Int' ELSE 'Numeric' END
            WHEN bool_and(ts IS NOT NULL) THEN CASE WHEN bool_or(ts <> date_trunc('day', ts)) THEN 'DateTime' ELSE 'Date' END
            ELSE 'Text' END AS inferred
        FROM parsed GROUP BY 1
        UNION ALL SELECT 'empty', 'Text'
    )
    SELECT "column", inferred, CASE inferred WHEN 'Toggle' THEN 'Bool' ELSE inferred END AS logical_type FROM kinds
    """,
)
def infer_types(t: Tables):
    return Y.infer_types(_dirty_orders(t)).drop("position", "day_first")


@query(
    "ingest_typed",
    """
    SELECT o_orderstatus <> 'O' AS switch,
           CASE o_orderstatus WHEN 'F' THEN o_custkey WHEN 'O' THEN o_orderkey END AS whole,
           CASE o_orderstatus WHEN 'P' THEN 1000.0::DOUBLE ELSE o_totalprice END AS number,
           o_orderdate::DATE AS day,
           CASE o_orderstatus WHEN 'F' THEN o_orderdate + INTERVAL '10:20:30' ELSE o_orderdate END AS moment,
           CASE WHEN o_orderkey = 0 THEN 'n/a' ELSE o_custkey::VARCHAR END AS mixed,
           NULL::VARCHAR AS empty,
           CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS bit,
           floor(o_totalprice)::BIGINT AS whole_double,
           o_orderdate::DATE AS typed_day,
           o_orderdate + INTERVAL 1 HOUR AS typed_moment,
           CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS nan_price
    FROM orders
    """,
)
def ingest_typed(t: Tables):
    """Load all columns under inferred types; days written day first keep their date."""
    return S.ingest_typed(_dirty_orders(t))


@query(
    "safe_ids",
    """
    WITH n AS (SELECT p_partkey, p_name, CASE p_size % 3 WHEN 0 THEN p_size || ' ' || p_name WHEN 1 THEN 'Été  ' || p_name ELSE p_name END AS raw FROM part)
    SELECT p_partkey, raw, CASE WHEN regexp_matches(raw, '^[0-9]') THEN 'Col_' ELSE '' END
           || regexp_replace(strip_accents(raw), '\\s+', '_', 'g') AS safe_id,
           regexp_replace(strip_accents(raw), '[^A-Za-z0-9]+', '_', 'g') AS token,
           lower(regexp_replace(raw, '[^\\p{L}\\p{N}_]', '', 'g')) AS search, lower(strip_accents(raw)) AS match_key FROM n
    """,
)
def safe_ids(t: Tables):
    size = F.col("p_size") % 3
    raw = (
        F.when(size == 0, F.concat_ws(" ", F.col("p_size").cast("string"), "p_name"))
        .when(size == 1, F.concat(F.lit("Été  "), "p_name"))
        .otherwise(F.col("p_name"))
    )
    named = t.part.select("p_partkey", raw.alias("raw"))
    col = F.col("raw")
    return named.select(
        "p_partkey", "raw", N.safe_id(col, "Col_").alias("safe_id"), N.compact_token(col).alias("token"),
        N.search_token(col).alias("search"), N.match_key(col).alias("match_key"),
    )


@query(
    "fold_documents",
    "SELECT doc_id, lower(strip_accents(text)) AS folded FROM documents",
)
def fold_documents(t: Tables):
    """Accents dropped from whole texts in four languages."""
    return t.documents.select("doc_id", N.match_key(F.col("text")).alias("folded"))
