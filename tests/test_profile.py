import math

import pytest
from pyspark.sql import functions as F

from sheetscope.operators import crosstab as X
from sheetscope.operators import profile as P
from sheetscope.operators import relations as R
from sheetscope.operators.ordering import is_increasing, running_total
from sheetscope.sources.tables import column_catalog, read_tables, save_crosstab


def by_column(df, key="column"):
    return {r[key]: r for r in df.collect()}


def test_statistics_of_a_small_workbook(workbook):
    stats = by_column(P.profile_stats(workbook))
    pay = stats["Salaire"]
    assert (pay["min"], pay["max"], pay["avg"], pay["non_null"]) == (45000, 75000, 60000, 3)
    assert stats["Departement"]["n_unique"] == 2
    top = {(r["column"], r["rank"]): r["value"] for r in P.profile_top_values(workbook).collect()}
    assert top["Departement", 1] == "IT"


def test_foreign_key_and_first_summary_of_the_workbook(workbook):
    edges = R.apparent_fk(column_catalog(workbook)).collect()
    assert {(e["from_table"], e["from_column"], e["to_table"], e["to_column"], e["target_exists"]) for e in edges} == {
        ("Absences", "ID_Employe", "Employes", "ID", True)
    }
    top = X.crosstab_top(X.crosstab_pairs(workbook)).orderBy("rank").collect()
    assert (top[0]["table"], top[0]["group_by"], top[0]["metric"]) == ("Employes", "Departement", "Salaire")
    assert top[0]["name"] == "Corr_Employes_Departement_Salaire"


def test_nan_is_missing_and_infinity_counts(rows):
    df = rows([(float("nan"), None), (1.0, None), (float("inf"), None)], "v double, e string")
    stats = by_column(P.profile_stats({"t": df}))
    assert (stats["v"]["non_null"], stats["v"]["n_null"], stats["v"]["n_unique"]) == (2, 1, 2)
    assert stats["v"]["max"] == math.inf
    assert (stats["e"]["non_null"], stats["e"]["n_unique"]) == (0, 0)


def test_empty_table_has_statistics_and_no_summary(rows):
    df = rows([], "a string, b int")
    assert by_column(P.profile_stats({"t": df}))["a"]["n_rows"] == 0
    assert X.crosstab_pairs({"t": df}).count() == 0


def test_long_texts_are_told_apart(rows):
    long = "x" * 1000
    df = rows([(long + "a",), (long + "b",), (long + "a",), ("x",)], "s string")
    assert by_column(P.profile_distinct({"t": df}))["s"]["n_unique"] == 3
    assert P.profile_top_values({"t": df}).filter("rank = 1").first()["value"] == long + "a"


def test_column_names_with_dots_spaces_and_quotes(rows):
    df = rows([("a", 10), ("b", 20), ("a", 30)], "`a.b 'c'` string, `x``y` int")
    stats = by_column(P.profile_stats({"it's": df}))
    assert stats["a.b 'c'"]["n_unique"] == 2 and stats["x`y"]["max"] == 30
    assert column_catalog({"t": df}).count() == 2
    assert X.crosstab_pairs({"t": df}).count() == 2


def test_roles_agree_with_exact_statistics(spark, rows):
    """The cheap way to find roles must give what the full statistics give."""
    cases = {
        "g25": spark.range(1000).select((F.col("id") % 25).cast("string").alias("c"), (F.col("id") % 3).alias("m")),
        "g26": spark.range(1000).select((F.col("id") % 26).cast("string").alias("c"), (F.col("id") % 2).alias("m")),
        "keys": spark.range(1000).select(
            F.col("id").alias("k"), (F.col("id") % 2).cast("boolean").alias("c"), (F.col("id") * 1.5).alias("m"),
            ((F.col("id") % 3) + 2**60).alias("huge"),
        ),
        "one": rows([("a", 1.0), ("a", 1.0)], "c string, m double"),
    }
    stats = P.profile_stats(cases)
    categories = {(r["table"], r["column"]) for r in P.category_candidates(stats).collect()}
    measures = {(r["table"], r["column"]) for r in P.measure_candidates(stats).collect()}
    roles = P.column_roles(cases)
    for table in cases:
        mine, theirs = roles[table], ([c for t, c in categories if t == table], [c for t, c in measures if t == table])
        if theirs[0] and theirs[1]:
            assert (set(mine[0]), set(mine[1])) == (set(theirs[0]), set(theirs[1])), table
        else:
            assert not (mine[0] and mine[1]), table


def test_summary_keeps_25_groups_and_needs_two(spark):
    many = spark.range(2600).select((F.col("id") % 26).cast("string").alias("c"), F.col("id").cast("double").alias("m"))
    assert X.crosstab(many, "c", "m").count() == 25
    single = many.filter("c = '1'")
    assert X.crosstab(single, "c", "m").count() == 0


def test_summary_drops_rows_without_category_or_measure(rows):
    df = rows([("a", 1.0), ("a", None), (None, 5.0), ("b", 3.0), ("b", 5.0)], "c string, m double")
    found = {r["grp"]: r["effectif"] for r in X.crosstab(df, "c", "m").collect()}
    assert found == {"a": 1, "b": 2}
    pairs = X.crosstab_pairs({"t": df})
    assert {r["grp"]: r["effectif"] for r in pairs.collect()} == found
    assert X.crosstab_scores(pairs).first()["coverage"] == 3 / 5


def test_many_categories_split_into_blocks(spark):
    wide = spark.range(60).select(
        *[(F.col("id") % (2 + i)).cast("string").alias(f"c{i}") for i in range(18)], (F.col("id") % 7).alias("m")
    )
    pairs = X.crosstab_pairs({"w": wide})
    assert pairs.select("group_by").distinct().count() == 18
    whole = pairs.groupBy("group_by").agg(F.sum("effectif").alias("n")).collect()
    assert {r["n"] for r in whole} == {60}


def test_summary_tables_are_stored_by_pair(workbook, spark, tmp_path):
    path = str(tmp_path / "xt")
    save_crosstab(X.crosstab_pairs(workbook).select(X.RESULT), path)
    assert spark.read.parquet(path).filter("metric = 'Salaire'").count() == 5


def test_order_test_across_slices(spark):
    df = spark.range(5000).select(
        F.col("id").alias("at"), (F.col("id") * 2).alias("up"),
        F.when(F.col("id") == 4000, 0).otherwise(F.col("id")).alias("dip"),
        F.nullif(F.col("id"), F.lit(17)).alias("gap"),
    ).repartition(7)
    found = {r["column"]: r["increasing"] for r in is_increasing(df, "at", ["up", "dip", "gap"]).collect()}
    assert found == {"up": True, "dip": False, "gap": False}


def test_running_total_counts_every_row_before(spark):
    df = spark.range(2000).select((F.col("id") * 7 % 2000).alias("k"), (F.col("id") % 5).alias("n"))
    rows = sorted(running_total(df, [F.col("k")], "n", "r").collect())
    total = 0
    for row in rows:
        total += row["n"]
        assert row["r"] == total


def test_dots_belong_to_table_names(spark, tmp_path):
    for name in ("sales.2023.parquet", "sales.2024.parquet"):
        spark.range(4).write.parquet(str(tmp_path / name))
    assert set(read_tables(spark, str(tmp_path))) == {"sales.2023", "sales.2024"}
    spark.range(4).write.json(str(tmp_path / "sales.2024.json"))
    with pytest.raises(ValueError, match="two tables"):
        read_tables(spark, str(tmp_path))


def test_tables_are_read_from_csv_and_json(spark, workbook, tmp_path):
    for format in ("csv", "json"):
        for name, df in workbook.items():
            df.coalesce(1).write.option("header", "true").format(format).save(str(tmp_path / format / name))
        back = read_tables(spark, str(tmp_path / format), format=format)
        assert set(back) == set(workbook)
        assert back["Employes"].agg(F.sum("Salaire")).first()[0] == 180000


def test_keys_beyond_double_precision(spark):
    base = 2**53 + 1
    df = spark.createDataFrame([(base + i, float(i)) for i in range(4)], "k bigint, v double")
    gaps = spark.createDataFrame([(base + 3 * i,) for i in range(4)], "k bigint")
    stats = P.profile_stats({"t": df, "g": gaps})
    found = {(r["table"], r["column"]): r["identifier"] for r in P.identifier_like(stats).collect()}
    assert found == {("t", "k"): True, ("t", "v"): False, ("g", "k"): False}
    assert "k" not in P.column_roles({"t": df.withColumn("c", F.when(F.col("v") > 1, "a").otherwise("b"))})["t"][1]
    wider = spark.createDataFrame([(base + i,) for i in range(1, 6)], "k bigint")
    edges = R.fk_range_candidates(P.profile_stats({"t": df, "w": wider}))
    assert edges.count() == 0
