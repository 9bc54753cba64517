"""Query registry, the test tables, and SQL helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the test tables, in file order. Kinds: i int, l bigint, d double,
# s string, t timestamp, a array.
SCHEMAS = {
    "region": "r_regionkey:i r_name:s",
    "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "customer": "c_custkey:l c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
    "supplier": "s_suppkey:l s_name:s s_nationkey:i s_acctbal:d",
    "part": "p_partkey:l p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
    "orders": "o_orderkey:l o_custkey:l o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s",
    "lineitem": (
        "l_orderkey:l l_partkey:l l_suppkey:l l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d l_tax:d "
        "l_returnflag:s l_linestatus:s l_shipdate:t"
    ),
    "events": "event_id:l ts:t user_id:l event_type:s value:d props:s",
    "documents": "doc_id:l text:s lang:s source:s n_chars:l",
    "embeddings": "vec_id:l embedding:a label:i",
    "pages": "page_id:l url:s html:s",
    "benchmark": "item_id:l text:s",
    "labels": "doc_id:l quality:i toxic:i",
    "conversations": "conv_id:l turn:l role:s text:s",
}
COLUMNS = {t: [tuple(c.split(":")) for c in text.split()] for t, text in SCHEMAS.items()}
SPARK_TYPE = {"i": "int", "l": "bigint", "d": "double", "s": "string", "t": "timestamp_ntz", "a": "array<float>"}
LOGICAL = {"i": "Int", "l": "Int", "d": "Numeric", "s": "Text", "t": "DateTime", "a": "Text"}
NUMERIC = ("i", "l", "d")


class Tables:
    """The tables of one folder, read when first asked for.

    Their schemas are known, so no file is opened before a query runs.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        schema = ", ".join(f"{column} {SPARK_TYPE[kind]}" for column, kind in COLUMNS[name])
        table = self.spark.read.schema(schema).parquet(f"{self.root}/{name}.parquet")
        setattr(self, name, table)
        return table

    def pick(self, *names: str) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in names}

    def all(self) -> dict[str, DataFrame]:
        return self.pick(*SCHEMAS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query on ``Tables`` under ``name`` with its SQL counterpart."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, root: build(Tables(spark, root))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round the named columns, so both engines print the same double."""
    return df.withColumns({name: F.round(name, n) for name, n in digits.items()})


def each_column(template: Callable[[str, int, str, str], str], keep: Callable[[str], bool] = lambda kind: True) -> str:
    """``UNION ALL`` of one SELECT per column of every test table."""
    return "\nUNION ALL\n".join(
        template(table, i, column, kind)
        for table, columns in COLUMNS.items()
        for i, (column, kind) in enumerate(columns)
        if keep(kind)
    )


def stats_sql() -> str:
    """One row of statistics per column of every test table."""

    def one(table: str, i: int, column: str, kind: str) -> str:
        span = (
            f"min({column})::DOUBLE AS min, max({column})::DOUBLE AS max, avg({column})::DOUBLE AS avg"
            if kind in NUMERIC
            else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS avg"
        )
        return (
            f"SELECT '{table}' AS \"table\", {i} AS position, '{column}' AS \"column\", '{SPARK_TYPE[kind]}' AS spark_type, "
            f"{'true' if kind in NUMERIC else 'false'} AS is_numeric, count(*) AS n_rows, count({column}) AS non_null, "
            f"count(*) - count({column}) AS n_null, count(DISTINCT {column}) AS n_unique, {span} FROM {table}"
        )

    return each_column(one)


def top_values_sql() -> str:
    """The five most frequent values of each text and time column."""
    counts = each_column(
        lambda table, i, column, kind: (
            f"SELECT '{table}' AS \"table\", '{column}' AS \"column\", {column}::VARCHAR AS value, count(*) AS n "
            f"FROM {table} WHERE {column} IS NOT NULL GROUP BY {column}"
        ),
        lambda kind: kind in ("s", "t"),
    )
    return (
        'SELECT "table", "column", row_number() OVER (PARTITION BY "table", "column" ORDER BY n DESC, value)::INT AS rank, '
        f"value, n FROM ({counts}) QUALIFY rank <= 5"
    )


# Identifier by name, or dense and nearly unique whole numbers.
IDENTIFIER_SQL = (
    "(regexp_matches(lower(\"column\"), 'id|code|uuid|matricule') OR (is_numeric AND non_null > 0 "
    "AND n_unique / non_null > 0.9 AND spark_type IN ('int', 'bigint') AND n_null = 0 "
    "AND max - min + 1 = non_null))"
)
