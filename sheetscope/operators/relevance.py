"""Columns relevant to a question: score, two-threshold choice, trimmed profile.

Everything is per workbook and for any number of workbooks at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetscope.functions.names import match_key

# Thresholds of the choice, its floor, and the score of a column
# that was not scored.
UPPER, LOWER, MIN_COLUMNS, NEUTRAL = 0.6, 0.25, 5, 0.5


def name_tokens(col: Column) -> Column:
    """Distinct words of a name or question, without case and accents."""
    return F.array_remove(F.array_distinct(F.split(match_key(col), "[^a-z0-9]+")), "")


def score_columns(columns: DataFrame, questions: DataFrame) -> DataFrame:
    """``score``: the share of a column name's words that the question uses.

    ``questions`` has one ``question`` per workbook. A workbook without one, and a
    name without words, get the neutral score.
    """
    asked = questions.select("workbook", name_tokens(F.col("question")).alias("_asked"))
    words = name_tokens(F.col("column"))
    share = F.try_divide(F.size(F.array_intersect(words, "_asked")), F.size(words))
    return columns.join(asked, "workbook", "left").select(
        *columns.columns, F.when(F.col("_asked").isNotNull(), share).alias("_share")
    ).withColumn("score", F.coalesce("_share", F.lit(NEUTRAL))).drop("_share")


def choose_columns(
    scores: DataFrame, upper: float = UPPER, lower: float = LOWER, min_columns: int = MIN_COLUMNS
) -> DataFrame:
    """``workbook, table, column, score, why`` of the chosen columns.

    At or above ``upper`` a column is in, at or below ``lower`` it is out. Between
    them it is in when its table has one that is in; after that the best of the
    rest fill the workbook up to ``min_columns``. Ties go by table and position.
    Counts are aggregated and ranks cut per task, so no workbook sits in one task.
    ``scores`` is read several times: pass a stored table.
    """
    scored = scores.select("workbook", "table", "position", "column", F.coalesce("score", F.lit(NEUTRAL)).alias("score"))
    hard = scored.filter(F.col("score") >= upper)
    soft = scored.filter((F.col("score") > lower) & (F.col("score") < upper))
    strong_tables = hard.select("workbook", "table").distinct().withColumn("_strong", F.lit(True))
    marked = soft.join(strong_tables, ["workbook", "table"], "left")
    together = marked.filter("_strong").drop("_strong")
    rest = marked.filter("_strong is null").drop("_strong")
    chosen = hard.withColumn("why", F.lit("hard")).unionByName(together.withColumn("why", F.lit("table")))
    n_chosen = chosen.groupBy("workbook").agg(F.count(F.lit(1)).alias("_n"))
    best = W.partitionBy("workbook").orderBy(F.col("score").desc(), "table", "position")
    fill = (
        rest.withColumn("_rank", F.row_number().over(best))
        .filter(F.col("_rank") <= min_columns)
        .join(n_chosen, "workbook", "left")
        .filter(F.col("_rank") <= min_columns - F.coalesce("_n", F.lit(0)))
        .drop("_rank", "_n")
        .withColumn("why", F.lit("fill"))
    )
    return chosen.unionByName(fill).select("workbook", "table", "column", "score", "why")


def trim_profile(stats: DataFrame, chosen: DataFrame, questions: DataFrame, min_columns: int = MIN_COLUMNS) -> DataFrame:
    """Statistics of the chosen columns only.

    A workbook keeps all its statistics when its question is blank or fewer than
    ``min_columns`` columns were chosen.
    """
    asked = questions.filter(F.trim("question") != "").select("workbook").distinct()
    enough = (
        chosen.groupBy("workbook")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") >= min_columns)
        .join(asked, "workbook", "left_semi")
        .select("workbook", F.lit(True).alias("_trim"))
    )
    keep = chosen.select("workbook", "table", "column").distinct().withColumn("_keep", F.lit(True))
    return (
        stats.join(enough, "workbook", "left")
        .join(keep, ["workbook", "table", "column"], "left")
        .filter("_trim is null or _keep")
        .select(*stats.columns)
    )
