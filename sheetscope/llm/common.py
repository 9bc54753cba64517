"""What the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sheetscope.functions.numbers import quoted
from sheetscope.session import ship_package

# Over UTF-8 bytes whose A-Z are lower-cased; the same words as
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ over the text.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

KEY = ("_k0", "_k1")

#: Spark hands 64 MB of rows to a worker at once unless the session says otherwise; each
#: task then holds them twice, outside the heap and in the worker. Here it is 8 MB.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: A Python worker takes Arrow batches apart into slices of about so many bytes, so that
#: what it makes of them stays small. One row is never cut.
SLICE_BYTES = 6_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowered(text: str | None) -> bytes:
    """UTF-8 bytes with only A-Z lower-cased; null is empty."""
    return (text or "").encode().lower()


def words_of(text: str | None) -> list[bytes]:
    """The words of a text."""
    return WORD.findall(lowered(text))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """The columns ``KEY``: the id, null below all, and a hash of the text.

    They order rows by id and tell those of one id apart by text. Rows that repeat both
    share a key, and so share every result.
    """
    return [F.coalesce(doc_id.cast("bigint"), F.lit(-(2**63))).alias(KEY[0]), F.xxhash64(text).alias(KEY[1])]


def whole_row(docs: DataFrame, carried: Iterable[str] | None = None) -> Column:
    """All columns, or the ``carried`` ones, as one struct, whatever characters their names hold."""
    return F.struct(*(F.col(quoted(name)) for name in carried or docs.columns))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else, inside the JVM."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partitions, by which the cluster states its size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` on workers that have this package, in slices of ``SLICE_BYTES``."""
    spark = df.sparkSession
    ship_package(spark)
    if spark.conf.get(BATCH_BYTES, None) in (None, "67108864b"):  # Spark's own default
        spark.conf.set(BATCH_BYTES, "8m")
    return df.mapInArrow(lambda batches: run(_sliced(batches)), schema)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = max(1, int(batch.num_rows * SLICE_BYTES / max(batch.nbytes, SLICE_BYTES)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def per_batch(
    df: DataFrame, make: Callable[[pa.RecordBatch], Iterable[dict[str, list]] | dict[str, list]], schema: str | T.StructType
) -> DataFrame:
    """Apply ``make`` to each Arrow batch; it gives columns by name, once or several times."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(batch)
            for columns in [made] if isinstance(made, dict) else made:
                own = [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(own, schema=arrow)

    return in_arrow(df, run, kind)


def sampled_ids(ids: DataFrame, n: int, seed: str) -> DataFrame:
    """At most ``n`` distinct non-null ``doc_id``, the first in a seeded hash order."""
    own = ids.select("doc_id").filter("doc_id is not null").distinct()
    return own.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(n)


def agreed_labels(labels: DataFrame, name: str) -> DataFrame:
    """``doc_id`` and ``label`` (0 or 1) of ids whose label rows agree; nulls are no labels."""
    own = labels.filter(F.col(name).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id")
    return own.agg(F.min(name).alias("label"), F.max(name).alias("other")).filter("label = other").drop("other")


def schema_with(df: DataFrame, more: str) -> T.StructType:
    """The schema of ``df`` and ``more`` columns after it."""
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(more).fields])
