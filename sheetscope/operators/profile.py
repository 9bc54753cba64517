"""Column profile: counts, distinct values, ranges, top values and column roles.

A table is read twice at most: one aggregate gives every count and range, and one
frequency pass per storage type gives distinct and top values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetscope.functions.names import contains_any
from sheetscope.functions.numbers import FLOATING, INTEGRAL, NESTED, TEMPORAL, is_numeric, known_sql, quoted, text_literal
from sheetscope.session import cut_lineage
from sheetscope.sources.tables import union_all

TOP_VALUES = 5
MAX_GROUPS = 25
MIN_MEASURE_VALUES = 3
UNIQUE_SHARE = 0.9

# Name parts that mark an identifier.
IDENTIFIER_WORDS = ("id", "code", "uuid", "matricule")


def _hash_bits_sql(col: str, words: int) -> tuple[str, str]:
    """Aggregates and final expression of a bitmap of hashed values.

    A value sets one bit, so the number of bits set never exceeds the number of
    distinct values: more bits than a limit prove more values than the limit. Unlike
    a cardinality sketch it is a plain ``bit_or`` and stays in generated code.
    """
    bit = f"pmod(xxhash64({col}), {64 * words})"
    parts = [
        f"bit_or(if({col} is not null and {bit} div 64 = {w}, shiftleft(1L, cast({bit} % 64 as int)), 0L))"
        for w in range(words)
    ]
    return ", ".join(f"'{{0}}_{w}', {part}" for w, part in enumerate(parts)), " + ".join(
        f"bit_count(m.{{0}}_{w})" for w in range(words)
    )


def column_metrics(
    df: DataFrame, table: str, ranges: bool = True, bits_for: int = 0
) -> DataFrame:
    """Counts and ranges of every column, from one aggregate over the table.

    Columns: table, position, column, spark_type, is_numeric, n_rows, non_null,
    n_null, min, max, avg (null without ``ranges``), and ``lo`` and ``hi``, the exact
    bounds of integer columns. With ``bits_for`` also
    ``hash_bits`` of the text and switch columns: a lower bound of their distinct
    count, wide enough to pass the number given.
    """
    aggregates, rows = ["'n_rows', count(1)"], []
    for i, field in enumerate(df.schema.fields):
        col = known_sql(field.name, field.dataType)
        numeric = is_numeric(field.dataType)
        aggregates.append(f"'c{i}', count({col})")
        low = high = mean = "cast(null as double)"
        least = most = "cast(null as bigint)"
        if ranges and numeric:
            aggregates.append(f"'lo{i}', min({col}), 'hi{i}', max({col}), 'avg{i}', avg({col})")
            low, high, mean = (f"cast(m.{part}{i} as double)" for part in ("lo", "hi", "avg"))
            if isinstance(field.dataType, INTEGRAL):
                least, most = (f"cast(m.{part}{i} as bigint)" for part in ("lo", "hi"))
        row = (
            f"'table', {text_literal(table)}, 'position', {i}, 'column', {text_literal(field.name)}, "
            f"'spark_type', {text_literal(field.dataType.simpleString())}, 'is_numeric', {str(numeric).lower()}, "
            f"'n_rows', m.n_rows, 'non_null', m.c{i}, 'n_null', m.n_rows - m.c{i}, "
            f"'min', {low}, 'max', {high}, 'avg', {mean}, 'lo', {least}, 'hi', {most}"
        )
        if bits_for:
            if numeric or isinstance(field.dataType, (*NESTED, *TEMPORAL)):
                row += ", 'hash_bits', cast(null as int)"
            else:
                bits, total = _hash_bits_sql(col, -(-2 * bits_for // 64))
                aggregates.append(bits.format(f"u{i}"))
                row += f", 'hash_bits', {total.format(f'u{i}')}"
        rows.append(f"named_struct({row})")
    return df.agg(F.expr(f"named_struct({', '.join(aggregates)})").alias("m")).selectExpr(
        f"inline(array({', '.join(rows)}))"
    )


def _numbered(tables: dict[str, DataFrame]) -> dict[tuple[str, str], int]:
    """A number for every column, by which its values are counted: narrow keys of fixed width."""
    return {key: i for i, key in enumerate((table, name) for table, df in tables.items() for name in df.columns)}


def _named(df: DataFrame, numbers: dict[tuple[str, str], int]) -> DataFrame:
    """``table, column`` in place of ``cid``."""
    table, column = (f"array({', '.join(text_literal(key[i]) for key in numbers)})[cid] as {name}" for i, name in enumerate(("table", "column")))
    return df.selectExpr(table, column, *(quoted(c) for c in df.columns if c != "cid"))


def _values(
    tables: dict[str, DataFrame], columns: dict[str, Sequence[str]] | None, cell: Callable, names: Sequence[str] = ("value",)
) -> dict[str, DataFrame]:
    """By storage type ``cid`` and ``names`` of the known cells of all tables.

    ``cell`` gives a column's storage type and the SQL of each name, or None to leave the
    column out; a cell is known where the first is. Each scan reads only its own columns.
    """
    numbers = _numbered(tables)
    tall: dict[str, list[DataFrame]] = {}
    for table, df in tables.items():
        cells: dict[str, list[str]] = {}
        for field in df.schema.fields:
            if columns is not None and field.name not in columns.get(table, ()):
                continue
            if found := cell(field):
                cells.setdefault(found[0], []).append(", ".join((str(numbers[table, field.name]), *found[1:])))
        for kind, rows in cells.items():
            tall.setdefault(kind, []).append(df.selectExpr(f"stack({len(rows)}, {', '.join(rows)}) as (cid, {', '.join(names)})"))
    return {kind: union_all(parts).filter(f"{names[0]} is not null") for kind, parts in tall.items()}


def integer_words(tables: dict[str, DataFrame], columns: dict[str, Sequence[str]] | None = None) -> DataFrame | None:
    """``table, column, word, bits`` of the integer columns: one bit a value, 64 values a word.

    Bits are set in the task that reads the value, so a key's values travel 64 to a row
    and never as rows of their own; sparse values cost a row each at worst. None without
    an integer column.
    """
    words = _integer_words(tables, columns)
    return None if words is None else _named(words, _numbered(tables))


def _integer_words(tables: dict[str, DataFrame], columns: dict[str, Sequence[str]] | None) -> DataFrame | None:
    known = lambda f: ("bigint", f"cast({quoted(f.name)} as bigint)") if isinstance(f.dataType, INTEGRAL) else None
    values = _values(tables, columns, known).get("bigint")
    if values is None:
        return None
    bit = "bit_or(shiftleft(1L, cast(value & 63L as int))) as bits"
    return values.groupBy("cid", F.expr("shiftright(value, 6)").alias("word")).agg(F.expr(bit))


def words_distinct(words: DataFrame, by: Sequence[str] = ("table", "column")) -> DataFrame:
    """Number of distinct values of each column, ``n_unique``, from ``integer_words``."""
    return words.groupBy(*by).agg(F.expr("sum(bit_count(bits)) as n_unique"))


def _counted_value(field: T.StructField) -> tuple[str, str] | None:
    """Storage type and value by which distinct values are told apart; none for integers."""
    if isinstance(field.dataType, INTEGRAL):
        return None
    col = known_sql(field.name, field.dataType)
    if isinstance(field.dataType, FLOATING):
        return "double", f"cast({col} as double)"
    if isinstance(field.dataType, T.StringType):
        # Shorter than a digest, so the two can't be mistaken for one another.
        return "string", f"if(octet_length({col}) < 32, cast({col} as binary), unhex(sha2({col}, 256)))"
    return field.dataType.simpleString(), col


def profile_distinct(tables: dict[str, DataFrame], columns: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """``table, column, n_unique``: exact distinct known values.

    Columns that hold no value at all have no row. Integers are counted by
    ``integer_words``. Other values travel once per task and value, all tables sharing one
    shuffle per type; texts of 32 bytes and more are told apart by their SHA-256.
    """
    words = _integer_words(tables, columns)
    parts = [words_distinct(words, ["cid"])] if words is not None else []
    for values in _values(tables, columns, _counted_value).values():
        # The first count makes values distinct, and combines in the task.
        distinct = values.groupBy("cid", "value").agg(F.expr("count(1) as n"))
        parts.append(distinct.groupBy("cid").agg(F.expr("count(1) as n_unique")))
    if not parts:
        return next(iter(tables.values())).sparkSession.createDataFrame([], "table string, column string, n_unique bigint")
    return _named(union_all(parts), _numbered(tables))


#: Characters of a text that are counted with it; a longer one travels as these and a digest.
HEAD_CHARS = 64
_DIGEST = "concat_ws('-', octet_length({0}), xxhash64({0}), xxhash64('text', {0}))"


def _headed_value(field: T.StructField) -> tuple[str, str, str] | None:
    """A value's text, cut to its head, and the digest of a longer one; none for nested columns."""
    col = known_sql(field.name, field.dataType)
    if isinstance(field.dataType, NESTED):
        return None
    if not isinstance(field.dataType, T.StringType):
        return "string", f"cast({col} as string)", "cast(null as string)"
    return "string", f"left({col}, {HEAD_CHARS})", f"if(char_length({col}) > {HEAD_CHARS}, {_DIGEST.format(col)}, null)"


def _whole_texts(tables: dict[str, DataFrame], columns: dict[str, Sequence[str]], wanted: DataFrame) -> DataFrame:
    """``cid, head, digest, text`` of the long texts among ``wanted``.

    Of all text columns only rows whose head is wanted go on, and of those one a task and text.
    """
    numbers, parts = _numbered(tables), []
    for table, df in tables.items():
        for field in df.schema.fields:
            if isinstance(field.dataType, T.StringType) and field.name in columns.get(table, ()):
                col = quoted(field.name)
                long = f"if(char_length({col}) > {HEAD_CHARS}, {col}, null) as text"
                parts.append(df.selectExpr(f"{numbers[table, field.name]} as cid", long))
    texts = union_all(parts).filter("text is not null").withColumn("head", F.left("text", F.lit(HEAD_CHARS)))
    found = texts.join(wanted, ["cid", "head"]).filter(f"digest = {_DIGEST.format('text')}")
    return found.groupBy("cid", "head", "digest").agg(F.min("text").alias("text"))


def heaviest_heads(tables: dict[str, DataFrame], columns: dict[str, Sequence[str]], top: int = TOP_VALUES) -> DataFrame | None:
    """``cid, head, digest, n`` of the first ``top`` values of each column by count and head, with all that tie.

    Counts combine in the task, and ranks are cut there before they are merged.
    """
    values = _values(tables, columns, _headed_value, ("head", "digest")).get("string")
    if values is None:
        return None
    best = W.partitionBy("cid").orderBy(F.col("n").desc(), "head")
    counted = values.groupBy("cid", "head", "digest").agg(F.expr("count(1) as n"))
    return counted.withColumn("place", F.rank().over(best)).filter(F.col("place") <= top).drop("place")


def top_values(tables: dict[str, DataFrame], columns: dict[str, Sequence[str]], top: int = TOP_VALUES) -> DataFrame:
    """``table, column, rank, value, n``: the most frequent values as text, ties by value.

    Values are counted by their first ``HEAD_CHARS`` characters and, where they are longer,
    length and 128 bits of hash: whole long texts stay in the scan. The first ``top`` by
    count and head are kept, with all that tie on both; then the long ones among these are
    fetched whole, and the ties settled.
    """
    heads = heaviest_heads(tables, columns, top)
    if heads is None:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "table string, column string, rank int, value string, n bigint")
    chosen = cut_lineage(heads)
    found = chosen.filter("digest is null").selectExpr("cid", "head as value", "n")
    long = chosen.filter("digest is not null")
    # At most one row a column: only these columns are read again.
    numbers = {number: key for key, number in _numbered(tables).items()}
    again: dict[str, list[str]] = {}
    for row in long.select("cid").distinct().collect():
        again.setdefault(numbers[row["cid"]][0], []).append(numbers[row["cid"]][1])
    if again:
        whole = _whole_texts(tables, again, long.drop("n"))
        found = found.unionByName(long.join(whole, ["cid", "head", "digest"]).selectExpr("cid", "text as value", "n"))
    order = W.partitionBy("cid").orderBy(F.col("n").desc(), "value")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return _named(ranked.select("cid", "rank", "value", "n"), _numbered(tables))


def profile_metrics(tables: dict[str, DataFrame], ranges: bool = True, bits_for: int = 0) -> DataFrame:
    """``column_metrics`` of every table."""
    return union_all([column_metrics(df, table, ranges, bits_for) for table, df in tables.items()])


def profile_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Statistics of every column of every table, with exact distinct counts."""
    return (
        profile_metrics(tables)
        .join(profile_distinct(tables), ["table", "column"], "left")
        .selectExpr(
            "table", "position", "column", "spark_type", "is_numeric", "n_rows", "non_null", "n_null",
            "coalesce(n_unique, 0L) as n_unique", "min", "max", "avg", "lo", "hi",
        )
    )


def profile_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row, known and missing counts per column."""
    return profile_metrics(tables, ranges=False).select("table", "column", "n_rows", "non_null", "n_null")


def profile_numeric(tables: dict[str, DataFrame]) -> DataFrame:
    """Smallest, largest and mean value of the numeric columns that hold any."""
    numeric = {table: [f.name for f in df.schema.fields if is_numeric(f.dataType)] for table, df in tables.items()}
    chosen = {table: df.select(numeric[table]) for table, df in tables.items() if numeric[table]}
    return profile_metrics(chosen).filter("non_null > 0").select("table", "column", "min", "max", "avg")


def profile_top_values(tables: dict[str, DataFrame], top: int = TOP_VALUES) -> DataFrame:
    """The most frequent values of the other columns, as text; ties by value."""
    others = {table: [f.name for f in df.schema.fields if not is_numeric(f.dataType)] for table, df in tables.items()}
    return top_values(tables, others, top)


def _unique_share() -> Column:
    return F.col("n_unique") / F.greatest(F.col("non_null"), F.lit(1))


def named_identifier() -> Column:
    """The name carries an identifier word, wherever it stands."""
    return contains_any(F.lower("column"), IDENTIFIER_WORDS)


def dense_key() -> Column:
    """Whole numbers with no gap and no null: a surrogate key."""
    return (
        F.col("spark_type").isin("tinyint", "smallint", "int", "bigint")
        & (F.col("n_null") == 0)
        & (F.col("non_null") > 0)
        & (F.col("hi").cast("decimal(20,0)") - F.col("lo") + 1 == F.col("non_null"))
    )


def identifier_like(stats: DataFrame) -> DataFrame:
    """Add ``identifier``: by name, or nearly unique and dense.

    Tables have no row order here, so density stands for "rising in row order".
    """
    by_value = F.col("is_numeric") & (_unique_share() > UNIQUE_SHARE) & dense_key()
    return stats.withColumn("identifier", named_identifier() | F.coalesce(by_value, F.lit(False)))


def identifier_like_ordered(df: DataFrame, table: str, order: str) -> DataFrame:
    """As ``identifier_like``, with the row order given by the column ``order``.

    Only the numeric columns that are nearly unique are put to the order test;
    their names come from the statistics, one row per column.
    """
    from sheetscope.operators.ordering import is_increasing

    stats = profile_stats({table: df}).withColumn("named", named_identifier())
    nearly_unique = F.col("is_numeric") & (F.col("non_null") > 0) & (_unique_share() > UNIQUE_SHARE)
    rows = stats.select("column", "named", nearly_unique.alias("candidate")).collect()
    tested = [r["column"] for r in rows if r["candidate"] and not r["named"]]
    named = F.col("column").isin([r["column"] for r in rows if r["named"]] or [""])
    base = column_metrics(df, table, ranges=False).select("table", "column")
    if not tested:
        return base.select("table", "column", named.alias("identifier"))
    order_test = is_increasing(df, order, tested)
    return base.join(order_test, "column", "left").select(
        "table", "column", (named | F.coalesce("increasing", F.lit(False))).alias("identifier")
    )


def _is_temporal_type() -> Column:
    return F.col("spark_type").isin("date", "timestamp", "timestamp_ntz")


def category_candidates(stats: DataFrame, max_groups: int = MAX_GROUPS) -> DataFrame:
    """Columns that form useful groups: few values, neither numbers nor dates."""
    return stats.filter(~F.col("is_numeric") & ~_is_temporal_type() & F.col("n_unique").between(2, max_groups))


def measure_candidates(stats: DataFrame) -> DataFrame:
    """Numeric columns that look like a quantity and not like a key."""
    return identifier_like(stats).filter(
        F.col("is_numeric") & ~F.col("identifier") & (F.col("n_unique") >= MIN_MEASURE_VALUES)
    )


def column_tags(stats: DataFrame) -> DataFrame:
    """``N`` for columns with a range and a mean, ``T`` for the others."""
    tag = F.when(F.col("avg").isNotNull() & F.col("min").isNotNull(), "N").otherwise("T")
    return stats.select("table", "column", tag.alias("tag"))


def null_share(stats: DataFrame) -> DataFrame:
    """Missing values per column as a share of the rows."""
    return stats.select("table", "column", "n_null", F.try_divide("n_null", "n_rows").alias("null_share"))


def profile_digest(stats: DataFrame, top_values: DataFrame, top: int = TOP_VALUES) -> DataFrame:
    """One readable line per column.

    Top values are at most ``top`` per column, so the gathered list is short.
    """
    listed = (
        top_values.filter(F.col("rank") <= top)
        .groupBy("table", "column")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("ranked"))
        .select("table", "column", F.array_join(F.transform("ranked", lambda r: r["value"]), ", ").alias("values"))
    )
    # Halves go to the even neighbour; the formatter alone would round them up.
    spread = F.when(
        F.col("avg").isNotNull(),
        F.format_string("min=%.0f max=%.0f avg=%.0f", F.bround("min"), F.bround("max"), F.bround("avg")),
    )
    listing = F.when(F.col("values").isNotNull(), F.concat(F.lit("top=["), "values", F.lit("]")))
    line = F.concat_ws(
        " | ",
        F.concat(F.lit("n="), F.col("non_null").cast("string")),
        F.concat(F.lit("unique="), F.col("n_unique").cast("string")),
        spread,
        listing,
    )
    return stats.join(listed, ["table", "column"], "left").select("table", "column", line.alias("line"))


def _values_between(df: DataFrame, table: str, spans: dict[str, tuple[float, float] | tuple[int, int]]) -> DataFrame:
    """``table, column, n_unique``: 3 where a value lies strictly inside the span of
    its column, else 2. It settles "three values or more" with no shuffle of values."""
    types = {f.name: f.dataType for f in df.schema.fields}
    found, rows = [], []
    for i, (name, (low, high)) in enumerate(spans.items()):
        kind, literal = ("bigint", "{0}L") if isinstance(types[name], INTEGRAL) else ("double", "double('{0!r}')")
        col = f"cast({known_sql(name, types[name])} as {kind})"
        inside = [f"{col} {sign} {literal.format(end)}" for sign, end in ((">", low), ("<", high))]
        found.append(f"'b{i}', bool_or({' and '.join(inside)})")
        rows.append(
            f"named_struct('table', {text_literal(table)}, 'column', {text_literal(name)}, 'n_unique', if(m.b{i}, 3L, 2L))"
        )
    return df.agg(F.expr(f"named_struct({', '.join(found)})").alias("m")).selectExpr(f"inline(array({', '.join(rows)}))")


def column_roles(
    tables: dict[str, DataFrame], max_groups: int = MAX_GROUPS
) -> dict[str, tuple[list[str], list[str], int]]:
    """Per table: category columns, measure columns and row count.

    Same answer as ``category_candidates`` and ``measure_candidates``, for less. The
    first job takes ranges, and for text a bitmap that proves which columns have too
    many values. The second counts the remaining text columns exactly, and looks for
    a third value in the numeric ones. No nearly unique column is shuffled for it,
    apart from a dense key, whose distinct share decides its role. Both jobs return
    one row per column.
    """
    types = {table: {f.name: f.dataType for f in df.schema.fields} for table, df in tables.items()}
    metrics: dict[str, list] = {table: [] for table in tables}
    for row in profile_metrics(tables, bits_for=max_groups).collect():
        metrics[row["table"]].append(row)
    texts: dict[str, list[str]] = {}
    numbers: dict[str, list[str]] = {}
    dense: dict[str, list[str]] = {}
    parts, to_count = [], {}
    for table, df in tables.items():
        texts[table], numbers[table], dense[table] = [], [], []
        exact: list[str] = []
        spans: dict[str, tuple[float, float]] = {}
        for row in sorted(metrics[table], key=lambda r: r["position"]):
            name, kind = row["column"], types[table][row["column"]]
            if row["non_null"] == 0:
                continue
            if not row["is_numeric"]:
                if row["hash_bits"] is not None and row["hash_bits"] <= max_groups:
                    texts[table].append(name)
                    exact.append(name)
                continue
            if any(word in name.lower() for word in IDENTIFIER_WORDS):
                continue
            numbers[table].append(name)
            whole = isinstance(kind, INTEGRAL)
            low, high = ("lo", "hi") if whole else ("min", "max")
            if whole and row["n_null"] == 0 and row["hi"] - row["lo"] + 1 == row["non_null"]:
                dense[table].append(name)
                exact.append(name)
            elif isinstance(kind, T.DecimalType):
                exact.append(name)
            elif row[low] < row[high]:
                spans[name] = (row[low], row[high])
        # A category without a measure, or the reverse, forms no pair.
        if texts[table] and numbers[table]:
            to_count[table] = exact
            if spans:
                parts.append(_values_between(df, table, spans))
    if to_count:
        parts.append(profile_distinct({table: tables[table] for table in to_count}, to_count))
    unique = {(r["table"], r["column"]): r["n_unique"] for r in union_all(parts).collect()} if parts else {}
    roles = {}
    for table in tables:
        filled = {row["column"]: row["non_null"] for row in metrics[table]}
        count = lambda name: unique.get((table, name), 1)
        categories = [n for n in texts[table] if 2 <= count(n) <= max_groups]
        measures = [
            n
            for n in numbers[table]
            if count(n) >= MIN_MEASURE_VALUES and not (n in dense[table] and count(n) / filled[n] > UNIQUE_SHARE)
        ]
        roles[table] = (categories, measures, metrics[table][0]["n_rows"] if metrics[table] else 0)
    return roles
