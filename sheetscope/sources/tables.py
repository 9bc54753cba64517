"""A workbook is a folder of tables, each read as one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetscope.functions.numbers import quoted, text_literal
from sheetscope.session import cut_lineage

PROFILE_SCHEMAS = {
    "columns": "table string, position int, column string, spark_type string, logical_type string, is_numeric boolean",
    "stats": (
        "table string, position int, column string, spark_type string, is_numeric boolean, n_rows bigint, "
        "non_null bigint, n_null bigint, n_unique bigint, min double, max double, avg double, lo bigint, hi bigint"
    ),
    "top_values": "table string, column string, rank int, value string, n bigint",
    "fk": "from_table string, from_column string, to_table string, to_column string, rule string",
    "crosstab": (
        "table string, group_by string, metric string, grp string, effectif bigint, somme double, "
        "moyenne double, min double, max double"
    ),
    "xt_scores": (
        "table string, group_by string, metric string, n_groups bigint, coverage double, score double, rank int"
    ),
    "insights": "workbook bigint, idx int, type string, table string, col string, finding string, priority int",
}


# What a file name may end with that is not part of the table's name.
FILE_ENDINGS = (".gz", ".bz2", ".zst", ".snappy", ".lz4", ".parquet", ".csv", ".json", ".orc", ".avro", ".txt")


def table_name(file_name: str) -> str:
    """The name without its format and compression endings; other dots belong to it."""
    while ending := next((e for e in FILE_ENDINGS if file_name.lower().endswith(e) and len(file_name) > len(e)), None):
        file_name = file_name[: -len(ending)]
    return file_name


def list_tables(spark: SparkSession, root: str) -> dict[str, str]:
    """Table name to path for every data file or folder directly under ``root``.

    Two entries that give one name are an error, not a choice.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for status in system.listStatus(path):
        name = status.getPath().getName()
        if not name.startswith(("_", ".")):
            if table_name(name) in found:
                raise ValueError(f"{root} holds two tables named {table_name(name)!r}")
            found[table_name(name)] = status.getPath().toString()
    return dict(sorted(found.items()))


def file_states(spark: SparkSession, root: str) -> tuple[tuple[str, int, int], ...]:
    """Path, size and time of every file under ``root``; what was derived from them holds as long as these."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while listed.hasNext():
        status = listed.next()
        found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))


def read_tables(
    spark: SparkSession,
    root: str,
    names: Iterable[str] | None = None,
    format: str = "parquet",
    schemas: dict[str, str | T.StructType] | None = None,
    **options: str,
) -> dict[str, DataFrame]:
    """Every table under ``root``, lazily; ``names`` fixes which ones and their order.

    ``format`` is any file format Spark reads. Give ``schemas`` for text formats:
    without one, CSV and JSON need a pass over the data to find it.
    """
    paths = list_tables(spark, root)
    wanted = list(names) if names is not None else list(paths)
    if format == "csv":
        options = {"header": "true", "inferSchema": "true"} | options
    tables = {}
    for name in wanted:
        reader = spark.read.format(format).options(**options)
        if schemas and name in schemas:
            reader = reader.schema(schemas[name])
        tables[name] = reader.load(paths[name])
    return tables


def read_with_rejects(
    spark: SparkSession, path: str, schema: str | T.StructType, format: str = "csv", **options: str
) -> tuple[DataFrame, DataFrame]:
    """Rows of a CSV or JSON source that fit ``schema``, and the lines that do not.

    The rejects have one column, ``record``: the line as it stands. A CSV line of another
    number of fields is one, as is a value that its type cannot read. The source
    is parsed once, into the shared folder, and every line that is not blank is in exactly
    one of the two.
    """
    if format not in ("csv", "json"):
        raise ValueError(f"{format} has no lines to reject")
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    mark = "_rejected"
    while mark in declared.names:
        mark += "_"
    if format == "csv":
        options = {"header": "true", "enforceSchema": "true"} | options
    # Without column pruning every value of a line is judged, whichever columns are asked for.
    given = {**options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": mark, "columnPruning": "false"}
    whole = T.StructType([*declared.fields, T.StructField(mark, T.StringType())])
    read = cut_lineage(spark.read.schema(whole).format(format).options(**given).load(path))
    return read.filter(F.col(mark).isNull()).drop(mark), read.filter(F.col(mark).isNotNull()).select(F.col(mark).alias("record"))


def preview(df: DataFrame, key: list[str], rows: int = 50) -> DataFrame:
    """The first rows in key order; each task keeps at most ``rows`` of them."""
    return df.orderBy(*key).limit(rows)


def save_profile(parts: dict[str, DataFrame], root: str, format: str = "parquet") -> None:
    """Write each profile table to its own folder, as parquet or JSON lines."""
    for name, part in parts.items():
        part.write.mode("overwrite").format(format).save(f"{root}/{name}")


def load_profile(
    spark: SparkSession, root: str, names: Iterable[str], format: str = "parquet"
) -> dict[str, DataFrame]:
    """Read saved profile tables back under their declared schemas."""
    return {name: spark.read.schema(PROFILE_SCHEMAS[name]).format(format).load(f"{root}/{name}") for name in names}


def save_crosstab(crosstab: DataFrame, path: str) -> None:
    """Store summary rows so that one pair of columns is one folder."""
    crosstab.write.mode("overwrite").partitionBy("table", "group_by", "metric").parquet(path)


def column_list(tables: dict[str, DataFrame]) -> list[tuple[str, int, str, T.DataType]]:
    """(table, position, column, type) for every column, from the schemas alone."""
    return [
        (table, i, field.name, field.dataType)
        for table, df in tables.items()
        for i, field in enumerate(df.schema.fields)
    ]


def declared_type(data_type: T.DataType) -> str:
    """Logical type that the schema alone implies."""
    if isinstance(data_type, T.BooleanType):
        return "Bool"
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "Int"
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "Numeric"
    if isinstance(data_type, T.DateType):
        return "Date"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "DateTime"
    if isinstance(data_type, T.ArrayType) and isinstance(data_type.elementType, T.StringType):
        return "ChoiceList"
    return "Text"


def column_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column with its row and null counts.

    The counts come from one aggregate per table, which reads every column unless the
    source answers counts from its footers.
    """
    parts = []
    for table, df in tables.items():
        counts, rows = ["'n_rows', count(1)"], []
        for i, field in enumerate(df.schema.fields):
            counts.append(f"'c{i}', count({quoted(field.name)})")
            rows.append(
                f"named_struct('table', {text_literal(table)}, 'position', {i}, 'column', {text_literal(field.name)}, "
                f"'logical_type', '{declared_type(field.dataType)}', 'n_rows', m.n_rows, 'filled', m.c{i})"
            )
        counted = df.agg(F.expr(f"named_struct({', '.join(counts)})").alias("m"))
        parts.append(counted.selectExpr(f"inline(array({', '.join(rows)}))"))
    return union_all(parts)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """One DataFrame from many of the same schema.

    Halves are joined up pairwise: every union is analysed when it is made, and this
    keeps the plans that are analysed again small.
    """
    while len(parts) > 1:
        pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
        parts = [pair[0].unionByName(pair[1]) if len(pair) == 2 else pair[0] for pair in pairs]
    return parts[0]
