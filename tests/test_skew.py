"""One key holds a third of all rows: results stay whole, and the plans show why."""

import contextlib
import io

from pyspark.sql import functions as F

from sheetscope.operators import crosstab as X
from sheetscope.operators import derive as D
from sheetscope.operators import insights as I
from sheetscope.operators import profile as P
from sheetscope.operators import relations as R

ROWS = 30_000


def hot(spark):
    """Key 0 on every third row, the rest nearly unique."""
    return spark.range(ROWS).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("n"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id").cast("string"))).alias("s"),
    )


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def test_profile_of_a_hot_value(spark):
    stats = {r["column"]: r for r in P.profile_stats({"t": hot(spark)}).collect()}
    assert stats["s"]["n_unique"] == ROWS // 3 * 2 + 1
    top = P.profile_top_values({"t": hot(spark)})
    assert top.filter("rank = 1").first()["n"] == ROWS // 3
    # Values are counted before they are shuffled, and ranks cut per task.
    heads = plan(P.heaviest_heads({"t": hot(spark)}, {"t": ["s"]}))
    assert "partial_count" in heads and "WindowGroupLimit" in heads
    two = plan(P.heaviest_heads({"t": hot(spark).withColumn("s2", F.col("s"))}, {"t": ["s", "s2"]}))
    assert "partial_count" in two and "rank(n" in two and "5, Partial" in two


def test_related_count_of_a_hot_key(spark):
    parents = spark.range(ROWS).withColumnRenamed("id", "pk")
    found = D.derive(parents, {"c": hot(spark)}, [D.RelatedCount("n", "c", "k", "pk")])
    assert found.count() == ROWS and found.filter("pk = 0").first()["n"] == ROWS // 3
    assert "partial_count" in plan(found)


def test_report_of_a_hot_workbook(spark):
    insights = hot(spark).select(
        F.col("k").alias("workbook"), F.col("n").alias("seq"), F.lit("kpi").alias("type"), F.lit("t").alias("table"),
        F.lit("c").alias("col"), F.lit("f").alias("finding"), F.lit(1).alias("priority"),
    )
    report = I.report(insights)
    assert report.filter("workbook = 0").count() == 5
    assert "row_number(), 5, Partial" in plan(report)


def test_overlap_and_quantiles_of_hot_groups(spark):
    overlap = R.fk_value_overlap(hot(spark), "c", "k", spark.range(10_000), "p", "id").first()
    expected = sum(1 for i in range(ROWS) if i % 3 and i < 10_000) + 1
    assert overlap["n_matched"] == expected and overlap["parent_unique"]
    median = I.quantiles(hot(spark), "n", ["s"], [0.5]).filter("s = 'hot'").first()["quantile"]
    assert median == sum(sorted(range(0, ROWS, 3))[ROWS // 6 - 1 : ROWS // 6 + 1]) / 2


def test_distribution_of_many_values(spark):
    shares = I.distribution(hot(spark), "s")
    first = shares.orderBy(F.col("n").desc()).first()
    assert first["value"] == "hot" and abs(first["cumulative_share"] - 1 / 3) < 1e-9
    assert abs(shares.agg(F.max("cumulative_share")).first()[0] - 1) < 1e-9


def test_no_cross_join_and_pruned_scan(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    text = plan(X.crosstab(part, "p_type", "p_retailprice"))
    assert "ReadSchema: struct<p_type:string,p_retailprice:double>" in text
    assert "IsNotNull(p_type)" in text and "TakeOrderedAndProject" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text
