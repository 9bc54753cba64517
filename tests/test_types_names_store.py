import datetime as dt

import pytest
from pyspark.sql import functions as F

from sheetscope.functions import names as N
from sheetscope.functions import types as Y
from sheetscope.sources import store as S


def inferred(df):
    return {r["column"]: r["inferred"] for r in Y.infer_types(df).collect()}


@pytest.mark.parametrize(
    "values, schema, expected",
    [
        ([30739, 55872, 97639, 42000, 85000], "v bigint", "Int"),
        ([1, 2, 3, 4, 5], "v bigint", "Int"),
        ([3.5, 4.0, 2.5, 5.0, 1.0], "v double", "Numeric"),
        (["2024-01-15", "2023-06-30", "2022-12-01"], "v string", "Date"),
        (["oui", "non", "oui", "oui"], "v string", "Toggle"),
        (["1", "0", "TRUE"], "v string", "Toggle"),
        ([None, None], "v string", "Text"),
        (["12", " 7 ", "1e3"], "v string", "Int"),
        (["1_000", "2.5"], "v string", "Numeric"),
        (["1d", "2"], "v string", "Text"),
        (["inf", "1"], "v string", "Numeric"),
        (["15/01/2024", "01/02/2024"], "v string", "Date"),
        (["2024-01-15 10:20:30", "2024-01-16"], "v string", "DateTime"),
        (["2024-01-15", "x"], "v string", "Text"),
        ([1, 0, None], "v int", "Toggle"),
        ([True, False], "v boolean", "Toggle"),
        ([float("nan")], "v double", "Text"),
        ([dt.date(2024, 1, 1)], "v date", "Date"),
    ],
)
def test_inference(rows, values, schema, expected):
    assert inferred(rows([(v,) for v in values], schema))["v"] == expected


def test_type_aliases(rows):
    df = rows([("Integer",), ("Toggle",), ("Ref",), ("Reference List",), ("Other",)], "t string")
    assert [r[0] for r in df.select(Y.canonical_type(F.col("t"))).collect()] == [
        "Int", "Bool", "Reference", "RefList", "Other",
    ]


NAMES = ["Été  2024", "2e date", "", "  ", "Ångström", "ﬁn", "½ part", "Ａｂｃ", "N° (x)", "日本", "ét x", "½éﬁ"]


def test_names_over_values_equal_names_on_the_driver(rows):
    df = rows([(i, n) for i, n in enumerate(NAMES)], "i int, n string")
    col = F.col("n")
    found = df.orderBy("i").select(
        N.fold(col), N.safe_id(col, "Col_"), N.compact_token(col), N.match_key(col)
    ).collect()
    for name, row in zip(NAMES, found):
        assert row[0] == N.fold_name(name)
        assert row[1] == N.safe_column_name(name)
        assert row[2] == N.compact_token_name(name)
        assert row[3] == N.match_key_name(name)


def test_safe_names():
    assert N.safe_table_name("Employés 2024") == "Employes_2024"
    assert N.safe_table_name("2024") == "Table_2024"
    assert N.safe_column_name("") == "Col_"


def test_append_drops_unknown_and_cleans(rows):
    target = rows([(1, 1.0)], "a int, b double")
    records = rows([(9, 2, float("inf"), "x")], "id int, a int, b double, other string")
    assert sorted(map(tuple, S.append_records(target, records).collect())) == [(1, 1.0), (2, None)]


def test_update_tells_null_from_absent(rows):
    base = rows([(1, "a", 10), (2, "b", 20), (3, "c", 30)], "id int, s string, n int")
    patch = rows([(1, None, True, 5, False), (2, "z", True, None, True)], "id int, s string, has_s boolean, n int, has_n boolean")
    found = S.update_records(base, patch, "id", {"s": "has_s", "n": "has_n"}).collect()
    assert sorted(map(tuple, found), key=lambda r: r[0]) == [(1, None, 10), (2, "z", None), (3, "c", 30)]


def test_upsert_is_idempotent_and_takes_the_latest(rows):
    base = rows([(1, "a"), (2, "b")], "k int, s string")
    patch = rows([(2, "x", 1), (2, "y", 2), (5, "new", 1)], "k int, s string, v int")
    once = S.upsert_records(base, patch, ["k"], "v")
    twice = S.upsert_records(once, patch, ["k"], "v")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "y"), (5, "new")]


def test_delete_read_and_alter(rows):
    base = rows([(1, "oui"), (2, "non"), (3, "?")], "id int, s string")
    assert S.delete_records(base, rows([(2,), (2,), (9,)], "id int"), "id").count() == 2
    assert [r["id"] for r in S.read_records(base, {"id": [1, 3]}, ["-id"], 1).collect()] == [3]
    changed = S.alter_columns(base, add={"d": "Date"}, retype={"s": "Toggle"}, rename={"id": "key"})
    assert changed.dtypes == [("key", "int"), ("s", "boolean"), ("d", "date")]
    assert [r["s"] for r in changed.orderBy("key").collect()] == [True, False, None]


def test_create_and_drop_table(spark):
    name = "made_for_a_test"
    S.drop_table(spark, name)
    assert S.create_table(spark, name, {"a": "Integer", "b": "Toggle"}).dtypes == [("a", "bigint"), ("b", "boolean")]
    S.drop_table(spark, name)
    S.drop_table(spark, name)
    assert not spark.catalog.tableExists(name)


def test_ingest_typed_keeps_every_row(rows):
    df = rows([("oui", "12", "2024-01-05"), (None, "7", "2024-02-06")], "`En été` string, n string, d string")
    typed = S.ingest_typed(df)
    assert typed.dtypes == [("En_ete", "boolean"), ("n", "bigint"), ("d", "date")]
    assert sorted(r["n"] for r in typed.collect()) == [7, 12]


def test_a_column_decides_how_its_dates_are_read(spark, tmp_path):
    df = spark.createDataFrame([("05/03/2024", "01/02/2024"), ("15/03/2024", "03/04/2024"), (" 06/03/2024" + " " * 60, "12/31/2024")], "d string, m string")
    assert [tuple(r) for r in S.ingest_typed(df).collect()] == [
        (dt.date(2024, 3, 5), dt.date(2024, 1, 2)), (dt.date(2024, 3, 15), dt.date(2024, 3, 4)), (dt.date(2024, 3, 6), dt.date(2024, 12, 31))
    ]


def test_big_ids_keep_their_value(spark):
    df = spark.createDataFrame([("9007199254740993",), (" 1_000 ",), ("1e3",)], "k string")
    assert [r[0] for r in S.ingest_typed(df).collect()] == [9007199254740993, 1000, 1000]


def test_names_that_fold_to_one_stay_apart(spark):
    df = spark.createDataFrame([(1, 2)], "`Prix été` int, `Prix_ete` int")
    assert S.ingest(df).columns == ["Prix_ete", "Prix_ete_2"]


def test_intervals_become_text(spark):
    df = spark.sql("SELECT INTERVAL '1 02:03:04' DAY TO SECOND AS a, INTERVAL '0 00:00:01.5' DAY TO SECOND AS b, INTERVAL '-1 00:00:00' DAY TO SECOND AS c")
    assert tuple(S.ingest(df).first()) == ("1 days 02:03:04", "0 days 00:00:01.500000", "-1 days 00:00:00")


def test_upsert_of_a_given_null(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    patch = spark.createDataFrame([(1, None, True, 1), (2, None, False, 1), (3, "c", True, 1), (3, "d", True, 2)], "k int, v string, has boolean, version int")
    found = S.upsert_records(base, patch, ["k"], "version", {"v": "has"})
    assert sorted(tuple(r) for r in found.collect()) == [(1, None), (2, "b"), (3, "d")]


def test_delete_takes_an_id_once(spark):
    base = spark.range(5)
    ids = spark.createDataFrame([(1,), (1,), (3,)], "id bigint")
    assert sorted(r[0] for r in S.delete_records(base, ids, "id").collect()) == [0, 2, 4]


def test_names_with_dots_and_quotes(spark):
    """Sheets name columns `N. commande`; every operator takes them as they are."""
    from sheetscope.operators import charts, derive, insights

    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 5.0), (3, "b", 9.0)], "`N. id` int, `x.y` string, `v``.w` double")
    patch = spark.createDataFrame([(2, "z", 2), (2, "q", 1), (4, "n", 1)], "`N. id` int, `x.y` string, `ver.` int")
    found = S.upsert_records(base, patch, ["N. id"], "ver.")
    assert sorted((r[0], r[1]) for r in found.collect()) == [(1, "a"), (2, "z"), (3, "b"), (4, "n")]
    marked = patch.filter("`ver.` = 2").withColumn("has.", F.lit(True))
    assert sorted(r[1] for r in S.update_records(base, marked, "N. id", {"x.y": "has."}).collect()) == ["a", "b", "z"]
    assert S.delete_records(base, patch, "N. id").columns == base.columns
    assert S.delete_records(base, patch, "N. id").count() == 2
    assert [r[0] for r in S.read_records(base, {"x.y": ["b"]}, ["-N. id"], 1).collect()] == [3]
    assert sorted(map(tuple, charts.chart_data(base, "x.y", "v`.w", "sum").collect())) == [("a", 1.0), ("b", 14.0)]
    assert charts.chart_extremes(base, "x.y", "v`.w").count() == 2
    assert sorted(map(tuple, insights.quantiles(base, "v`.w", ["x.y"], [0.5]).collect())) == [("a", 0.5, 1.0), ("b", 0.5, 7.0)]
    assert insights.fence_outliers(base, "v`.w", ["x.y"]).columns[0] == "x.y"
    assert insights.sigma_outliers(base, "v`.w", ["x.y"], 0.5).columns[:3] == base.columns
    assert insights.sigma_outliers(base, "v`.w", [], 0.5).count() == 2
    features = [derive.RelatedCount("n.", "c", "N. id", "N. id"), derive.RelatedAverage("avg.", "c", "N. id", "N. id", "ver."), derive.NullFlag("none.", "x.y")]
    got = derive.derive(base, {"c": patch}, features)
    assert got.columns == [*base.columns, "n.", "avg.", "none."]
    assert sorted((r[0], r["n."], r["avg."]) for r in got.collect()) == [(1, 0, 0.0), (2, 2, 1.5), (3, 0, 0.0)]
