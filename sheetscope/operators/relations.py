"""Relations between tables: foreign keys by name, by range and by value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetscope.functions.numbers import INTEGRAL, filled, named, quoted
from sheetscope.operators.profile import integer_words, profile_metrics, words_distinct

KEY_PREFIX = "ID_"
KEY_NAME = "ID"


def fk_by_prefix(columns: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """A column ``ID_X`` points at every table whose name contains ``X``.

    ``columns`` has ``table`` and ``column`` and the ``within`` keys that tell
    workbooks apart. The substring test is an equality join: every part of a table
    name is listed once, so the work grows with the catalog and not with the pairs
    of tables and columns. Only parts as long as some suffix are listed. ``ID_`` alone
    refers to nothing. ``target_exists`` says whether the target has an ``ID``.
    """
    within = list(within)
    suffix = F.substring(F.upper("column"), len(KEY_PREFIX) + 1, 2**31 - 1)
    prefixed = columns.filter(F.upper("column").startswith(KEY_PREFIX) & (suffix != "")).select(
        *within, F.col("table").alias("from_table"), F.col("column").alias("from_column"), suffix.alias("_suffix")
    )
    lengths = prefixed.agg(F.coalesce(F.collect_set(F.length("_suffix")), F.array().cast("array<int>"))).scalar()
    tables = columns.select(*within, F.col("table").alias("to_table")).distinct()
    name = F.upper("to_table")
    size = F.length(name)
    parts = F.flatten(
        F.transform(
            F.filter("_lengths", lambda length: length <= size),
            lambda length: F.transform(F.sequence(F.lit(1), size - length + 1), lambda start: F.substring(name, start, length)),
        )
    )
    listed = tables.withColumn("_lengths", lengths).select(
        *within, "to_table", F.explode(F.array_distinct(parts)).alias("_suffix")
    )
    keys = columns.filter(F.col("column") == KEY_NAME).select(
        *within, F.col("table").alias("to_table"), F.lit(True).alias("_has_key")
    )
    return (
        prefixed.join(listed, [*within, "_suffix"])
        .join(keys.distinct(), [*within, "to_table"], "left")
        .select(
            *within, "from_table", "from_column", "to_table", F.lit(KEY_NAME).alias("to_column"),
            F.lit("prefix").alias("rule"), F.coalesce("_has_key", F.lit(False)).alias("target_exists"),
        )
    )


def fk_by_name(columns: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """The same column name in two tables links them, in both directions.

    ``ID`` itself is left out. The edges are the answer here: a name shared by k
    tables has k(k-1) of them. ``shared_columns`` is the form that stays linear.
    """
    within = list(within)
    named = columns.filter(F.upper("column") != KEY_NAME)
    source = named.select(*within, "column", F.col("table").alias("from_table"))
    target = named.select(*within, "column", F.col("table").alias("to_table"))
    return (
        source.join(target, [*within, "column"])
        .filter("from_table <> to_table")
        .select(
            *within, "from_table", F.col("column").alias("from_column"), "to_table",
            F.col("column").alias("to_column"), F.lit("name").alias("rule"), F.lit(True).alias("target_exists"),
        )
    )


def shared_columns(columns: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Column names found in several tables: one row per name and table.

    Any two rows of one name are an edge of ``fk_by_name``; nothing is lost and
    the size stays that of the catalog.
    """
    within = list(within)
    named = columns.filter(F.upper("column") != KEY_NAME).select(*within, "column", "table").distinct()
    sizes = named.groupBy(*within, "column").agg(F.count(F.lit(1)).alias("n_tables")).filter("n_tables > 1")
    return named.join(sizes, [*within, "column"]).select(*within, "column", "table", "n_tables")


def apparent_fk(columns: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Edges of both name rules, each once.

    A prefix edge ends at an ``ID`` and a name edge never does, so no edge is of both
    rules, and neither rule repeats an edge where no column is repeated. So columns are
    told apart here, not edges, of which a shared name has many times as many. Names are
    dealt the way that both sides of their join want them.
    """
    keys = [*within, "table", "column"]
    dealt = columns.select(*keys).repartition(*within, "column").distinct()
    return fk_by_prefix(columns.select(*keys).distinct(), within).unionByName(fk_by_name(dealt, within))


def fk_value_overlap(
    child: DataFrame, child_table: str, child_column: str, parent: DataFrame, parent_table: str, parent_column: str
) -> DataFrame:
    """Share of the child's distinct keys that the parent holds.

    Both sides are reduced to their distinct keys before the join, so a key held
    by a third of the rows weighs one row. ``parent_unique`` tells a real key.
    """
    wanted = filled(child, child_column).selectExpr(f"{quoted(child_column)} as k").distinct()
    held = (
        filled(parent, parent_column)
        .selectExpr(f"{quoted(parent_column)} as k")
        .groupBy("k")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_key = wanted.join(held, "k", "left")
    repeated = held.agg(F.max("n")).scalar()
    return per_key.agg(
        F.count(F.lit(1)).alias("n_keys"), F.count("n").alias("n_matched")
    ).select(
        F.lit(child_table).alias("from_table"), F.lit(child_column).alias("from_column"),
        F.lit(parent_table).alias("to_table"), F.lit(parent_column).alias("to_column"),
        "n_keys", "n_matched", F.try_divide("n_matched", "n_keys").alias("coverage"),
        F.coalesce(repeated == 1, F.lit(False)).alias("parent_unique"),
    )


def _nodes_over(lo: str, hi: str) -> str:
    """SQL array of the dyadic blocks ``(level, block)`` that make up ``[lo, hi]``.

    At a level the blocks inside the range run from ``first`` to ``last``; those of them
    whose double-sized block is not inside are taken, two a level at most. Shifts alone,
    so no bound overflows.
    """
    mask = "~shiftleft(-1L, {0})"
    first = f"(shiftright({lo}, {{0}}) + if({lo} & {mask} = 0, 0, 1))"
    last = f"(shiftright({hi}, {{0}}) - if({hi} & {mask} = {mask}, 0, 1))"
    own_first, own_last = first.format("v"), last.format("v")

    def outer(block: str) -> str:
        within = f"shiftright({block}, 1) between {first.format('v + 1')} and {last.format('v + 1')}"
        return f"{own_first} <= {own_last} and not (v < 63 and {within})"

    blocks = (
        f"if({outer(own_first)}, named_struct('level', v, 'block', {own_first}), null), "
        f"if({own_first} <> {own_last} and {outer(own_last)}, named_struct('level', v, 'block', {own_last}), null)"
    )
    return f"filter(flatten(transform(sequence(0, 63), v -> array({blocks}))), x -> x is not null)"


def fk_range_candidates(stats: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Integer columns whose range lies inside that of a unique column of their type.

    A cheap filter ahead of ``fk_overlaps``. It works on one row per column. A parent's
    range is taken apart into blocks of a power of two, at most 126 of them; a child's
    lower end lies in one block of each size. Exactly one of these is a block of the
    parent where the end is inside its range, so pairs meet on a block and never on their
    type alone, and columns of other ranges do not meet.
    """
    whole = stats.filter(F.col("lo").isNotNull())
    keys = [*within, "spark_type"]
    levels = ", ".join(f"named_struct('level', {level}, 'block', shiftright(lo, {level}))" for level in range(64))
    parents = whole.filter("n_unique = non_null").select(
        *keys, F.col("table").alias("to_table"), F.col("column").alias("to_column"),
        F.col("lo").alias("parent_min"), F.col("hi").alias("parent_max"),
    )
    parents = parents.withColumn("node", F.explode(F.expr(_nodes_over("parent_min", "parent_max"))))
    children = whole.withColumn("node", F.explode(F.expr(f"array({levels})"))).select(
        *keys, F.col("table").alias("from_table"), F.col("column").alias("from_column"),
        F.col("lo").alias("child_min"), F.col("hi").alias("child_max"), "node",
    )
    return (
        children.join(parents, [*keys, "node"])
        .filter("from_table <> to_table and child_max <= parent_max")
        .select(
            *within, "from_table", "from_column", "to_table", "to_column",
            "child_min", "child_max", "parent_min", "parent_max",
        )
    )


def integer_stats(tables: dict[str, DataFrame], words: DataFrame | None = None) -> DataFrame:
    """What ``fk_range_candidates`` asks for, of the integer columns alone."""
    whole = {t: df.select(*(F.col(quoted(c)) for c in integer_columns(df))) for t, df in tables.items() if integer_columns(df)}
    metrics = profile_metrics(whole).select("table", "column", "spark_type", "non_null", "lo", "hi")
    words = integer_words(whole) if words is None else words
    return metrics.join(words_distinct(words), ["table", "column"])


def integer_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, INTEGRAL)]


def fk_overlaps(words: DataFrame, candidates: DataFrame) -> DataFrame:
    """For every candidate pair of columns the share of the child's distinct keys that the parent holds.

    ``words`` is ``integer_words`` of all tables. One shuffle makes the inverted list: per
    word the columns that have values in it, with their bits. Lists that are alike, as
    those of dense keys are, fold into one with a weight. Within a list the bits of a child
    and of its candidate parents are intersected, so the tables are read once, however
    many pairs there are.
    """
    ends = F.struct("table", "column")
    parents = candidates.groupBy(F.struct(F.col("from_table").alias("table"), F.col("from_column").alias("column")).alias("child")).agg(
        F.collect_set(F.struct(F.col("to_table").alias("table"), F.col("to_column").alias("column"))).alias("parents")
    )
    lists = words.groupBy("word").agg(F.sort_array(F.collect_list(F.struct(ends.alias("of"), "bits"))).alias("held"))
    folded = lists.groupBy("held").agg(F.count(F.lit(1)).alias("weight"))
    met = folded.withColumn("c", F.explode("held")).join(parents, F.col("c.of") == F.col("child"))
    other = F.explode(F.filter("held", lambda x: F.array_contains("parents", x["of"])))
    pairs = met.select("child", "weight", F.col("c.bits").alias("bits"), other.alias("p")).groupBy("child", F.col("p.of").alias("parent"))
    matched = pairs.agg(F.sum(F.expr("weight * bit_count(bits & p.bits)")).alias("n"))
    matched = matched.select(
        F.col("child.table").alias("from_table"), F.col("child.column").alias("from_column"),
        F.col("parent.table").alias("to_table"), F.col("parent.column").alias("to_column"), "n",
    )
    sizes = words_distinct(words).select(F.col("table").alias("from_table"), F.col("column").alias("from_column"), F.col("n_unique").alias("n_keys"))
    edge = ["from_table", "from_column", "to_table", "to_column"]
    return (
        candidates.select(*edge)
        .join(sizes, edge[:2])
        .join(matched, edge, "left")
        .select(*edge, "n_keys", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_matched"))
        .withColumn("coverage", F.try_divide("n_matched", "n_keys"))
    )


def fk_orphans(
    child: DataFrame, child_column: str, parent: DataFrame, parent_column: str
) -> DataFrame:
    """Keys without a partner, both ways: ``side, key, n_rows``.

    A null key refers to nothing and is no orphan. Keys are counted per side
    first, so the joins meet one row per key.
    """
    def keys(df: DataFrame, column: str) -> DataFrame:
        return df.filter(named(column).isNotNull()).groupBy(named(column).alias("key")).agg(
            F.count(F.lit(1)).alias("n_rows")
        )

    below, above = keys(child, child_column), keys(parent, parent_column)
    return (
        below.join(above.select("key"), "key", "left_anti").select(F.lit("child").alias("side"), "key", "n_rows")
        .unionByName(
            above.join(below.select("key"), "key", "left_anti").select(F.lit("parent").alias("side"), "key", "n_rows")
        )
    )


def orphan_rows(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Whole child rows whose key the parent does not hold."""
    held = parent.select(F.col(parent_column).alias(child_column)).distinct()
    return child.filter(F.col(child_column).isNotNull()).join(held, child_column, "left_anti").select(child.columns)
