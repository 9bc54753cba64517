"""Category x measure summaries: build, score, rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetscope.functions.names import compact_token, compact_token_name, contains_any
from sheetscope.functions.numbers import filled, known_sql, quoted, text_literal
from sheetscope.operators.profile import MAX_GROUPS, column_roles
from sheetscope.sources.tables import union_all

MAX_TABLES = 4
# One grouping-sets job repeats each row once per category, so wide tables are
# summarised in several jobs.
CATEGORIES_PER_JOB = 16

# Name parts of business measures and of useful categories.
MEASURE_WORDS = (
    "salary", "salaire", "montant", "cout", "cost", "revenue", "ca",
    "score", "note", "budget", "amount", "duree", "duration", "temps",
)
CATEGORY_WORDS = (
    "depart", "service", "team", "type", "statut", "status", "region",
    "site", "manager", "equipe", "category", "categorie",
)

RESULT = ["table", "group_by", "metric", "grp", "effectif", "somme", "moyenne", "min", "max"]


def crosstab(df: DataFrame, category: str, measure: str, max_groups: int = MAX_GROUPS) -> DataFrame:
    """Size, sum, mean, min and max of a measure per category value.

    Rows that lack either side are left out. The largest groups come first, ties
    by the higher mean. Fewer than two groups give no summary.
    """
    pair = filled(df, category, measure).selectExpr(
        f"{quoted(category)} as grp", f"cast({quoted(measure)} as double) as v"
    )
    groups = (
        pair.groupBy("grp")
        .agg(
            F.count(F.lit(1)).alias("effectif"),
            F.sum("v").alias("somme"),
            F.avg("v").alias("moyenne"),
            F.min("v").alias("min"),
            F.max("v").alias("max"),
        )
        .orderBy(F.col("effectif").desc(), F.col("moyenne").desc(), "grp")
        .limit(max_groups)
    )
    enough = W.partitionBy(F.lit(0))
    return groups.withColumn("_groups", F.count(F.lit(1)).over(enough)).filter("_groups >= 2").drop("_groups")


def summary_name(table: str, category: str, measure: str) -> str:
    """Name of the stored summary table of one pair."""
    return "_".join(["Corr", *(compact_token_name(part) for part in (table, category, measure))])


def summary_name_of(table: Column, category: Column, measure: Column) -> Column:
    """``summary_name`` over values."""
    return F.concat_ws("_", F.lit("Corr"), compact_token(table), compact_token(category), compact_token(measure))


def _pair_rows(df: DataFrame, table_no: int, table: str, categories: Sequence[str], measures: Sequence[str], rows: int) -> list[DataFrame]:
    """Summary rows of every pair of one table, one scan per block of categories."""
    types = {f.name: f.dataType for f in df.schema.fields}
    blocks = [categories[i : i + CATEGORIES_PER_JOB] for i in range(0, len(categories), CATEGORIES_PER_JOB)]
    parts = []
    for block_no, block in enumerate(blocks):
        first = block_no * CATEGORIES_PER_JOB
        keys = [f"c{i}" for i in range(len(block))]
        values = df.selectExpr(
            *[f"{known_sql(c, types[c])} as c{i}" for i, c in enumerate(block)],
            *[f"cast({known_sql(m, types[m])} as double) as m{j}" for j, m in enumerate(measures)],
        )
        cells = ", ".join(
            f"named_struct('metric_no', {j}, 'metric', {text_literal(m)}, 'effectif', count(m{j}), 'somme', sum(m{j}), "
            f"'moyenne', avg(m{j}), 'min', min(m{j}), 'max', max(m{j}))"
            for j, m in enumerate(measures)
        )
        which = "case " + " ".join(f"when grouping(c{i}) = 0 then {i}" for i in range(len(block))) + " end"
        grouped = values.groupingSets([[F.col(k)] for k in keys], *keys).agg(
            F.expr(f"{which} as _cat"), F.expr(f"array({cells}) as _cells")
        )
        label = "case " + " ".join(f"when _cat = {i} then cast(c{i} as string)" for i in range(len(block))) + " end"
        names = ", ".join(text_literal(c) for c in block)
        parts.append(
            grouped.selectExpr(
                f"{table_no} as table_no", f"{text_literal(table)} as table", f"{rows}L as n_rows",
                f"_cat + {first} as group_no", f"array({names})[_cat] as group_by", f"{label} as grp", "inline(_cells)",
            ).filter("grp is not null and effectif > 0")
        )
    return parts


def crosstab_pairs(tables: dict[str, DataFrame], max_groups: int = MAX_GROUPS) -> DataFrame:
    """Summary rows of every category x measure pair of every table.

    Schema decisions need each table's column roles (one row per column); the
    summaries themselves take one scan per table, whatever the number of pairs.
    A pair keeps its ``max_groups`` largest groups and needs at least two.
    """
    parts = []
    wide_enough = {table: df for table, df in tables.items() if len(df.columns) >= 2}
    roles = column_roles(wide_enough, max_groups) if wide_enough else {}
    for table_no, (table, df) in enumerate(tables.items()):
        categories, measures, rows = roles.get(table, ([], [], 0))
        if categories and measures:
            parts += _pair_rows(df, table_no, table, categories, measures, rows)
    if not parts:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame(
            [],
            "table_no int, table string, n_rows bigint, group_no int, group_by string, grp string, metric_no int, "
            "metric string, effectif bigint, somme double, moyenne double, min double, max double, n_groups bigint",
        )
    pair = W.partitionBy("table_no", "group_no", "metric_no")
    largest = pair.orderBy(F.col("effectif").desc(), F.col("moyenne").desc(), "grp")
    return (
        union_all(parts)
        .withColumn("_rank", F.row_number().over(largest))
        .filter(F.col("_rank") <= max_groups)
        .withColumn("n_groups", F.count(F.lit(1)).over(pair))
        .filter("n_groups >= 2")
        .drop("_rank")
    )


def pair_score(group_by: Column, metric: Column, n_groups: Column, coverage: Column) -> Column:
    """Rank of a pair: coverage, a handful of groups, and business words."""
    return (
        coverage * 10
        + F.greatest(F.lit(0), F.lit(6) - F.abs(n_groups - 5))
        + F.when(contains_any(F.lower(metric), MEASURE_WORDS), 4).otherwise(0)
        + F.when(contains_any(F.lower(group_by), CATEGORY_WORDS), 2).otherwise(0)
        + F.least(n_groups, F.lit(10)) / 10
    )


def crosstab_scores(pairs: DataFrame) -> DataFrame:
    """One row per pair: number of groups, coverage, score, and rank in the workbook.

    There is one row per pair of columns here, so the ranking window is small
    whatever the size of the tables.
    """
    by_pair = pairs.groupBy("table_no", "group_no", "metric_no", "table", "group_by", "metric", "n_groups", "n_rows").agg(
        F.sum("effectif").alias("covered")
    )
    coverage = F.col("covered") / F.greatest(F.col("n_rows"), F.lit(1))
    order = W.orderBy(F.col("score").desc(), "table_no", "group_no", "metric_no")
    return (
        by_pair.withColumn("coverage", coverage)
        .withColumn("score", pair_score(F.col("group_by"), F.col("metric"), F.col("n_groups"), F.col("coverage")))
        .withColumn("rank", F.row_number().over(order))
        .select("table", "group_by", "metric", "n_groups", "coverage", "score", "rank")
    )


def crosstab_top(pairs: DataFrame, max_tables: int = MAX_TABLES) -> DataFrame:
    """Summary rows of the best pairs, with the name of the summary table.

    Scores are taken over the summary rows themselves, so the tables are not read
    again for the ranking.
    """
    pair = W.partitionBy("table_no", "group_no", "metric_no")
    coverage = F.sum("effectif").over(pair) / F.greatest(F.col("n_rows"), F.lit(1))
    order = W.orderBy(F.col("score").desc(), "table_no", "group_no", "metric_no")
    return (
        pairs.withColumn("coverage", coverage)
        .withColumn("score", pair_score(F.col("group_by"), F.col("metric"), F.col("n_groups"), F.col("coverage")))
        .withColumn("rank", F.dense_rank().over(order))
        .filter(F.col("rank") <= max_tables)
        .withColumn("name", summary_name_of(F.col("table"), F.col("group_by"), F.col("metric")))
        .select("rank", "name", *RESULT)
    )
