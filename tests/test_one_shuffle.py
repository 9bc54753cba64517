"""Steps that read or shuffle their rows once, and the rows they must still give."""

import datetime

from sheetscope.operators import candidates as K
from sheetscope.operators import relations as R
from sheetscope.operators import specs as V
from sheetscope.plans import catalogs as C
from sheetscope.plans.base import Tables

COLUMNS = "workbook int, table string, position int, column string"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_both_axes_are_looked_up_by_one_join(rows):
    resolved = rows([(1, "chart", "b", "é", "t"), (1, "chart", "E", "zz", "t"), (1, "chart", None, "B", None)], "workbook int, widget string, x string, y string, table_id string")
    columns = rows([(1, "t", 2, "é"), (1, "t", 0, "E"), (1, "t", 0, "E"), (1, "t", 3, "B"), (1, None, 0, "x"), (1, "t", None, None)], COLUMNS)
    resolved = resolved.selectExpr("*", "table_id as table")
    checked = V.check_specs(resolved, columns)
    assert [(r["y"], r["reason"]) for r in checked.orderBy("y").collect()] == [("B", "table '' unresolvable"), ("zz", "y col 'zz' not in t"), ("é", None)]
    assert optimized(checked).count("Join ") == 1
    named = V.chart_axes(resolved, columns)
    assert {r["y"]: r["axes"] for r in named.collect()} == {"é": ["B", "é"], "zz": ["E"], "B": None}
    assert optimized(named).count("Join ") == 2  # the other is between parts of the catalog


def test_fallback_axes_keep_repeated_columns(rows):
    resolved = rows([(1, "chart", None, None, "t", "t")], "workbook int, widget string, x string, y string, table string, table_id string")
    columns = rows([(1, "t", 1, "b"), (1, "t", 0, "a"), (1, "t", 0, "a")], COLUMNS)
    assert V.chart_axes(resolved, columns).first()["axes"] == ["a", "a"]


def test_edges_are_not_told_apart_again(rows):
    columns = rows([(1, "A", "k"), (1, "A", "k"), (1, "B", "k"), (1, "B", "ID"), (1, "A", "ID_B"), (1, "A", "ID_B"), (None, "C", "k"), (1, None, "k")], "workbook int, table string, column string")
    edges = R.apparent_fk(columns, ["workbook"])
    found = [tuple(r) for r in edges.orderBy("from_table", "from_column", "to_table").collect()]
    assert found == [
        (1, "A", "ID_B", "B", "ID", "prefix", True), (1, "A", "k", "B", "k", "name", True), (1, "B", "k", "A", "k", "name", True),
    ]
    assert optimized(edges).startswith("Union")


def test_cells_meet_by_one_shuffle(spark, tmp_path):
    day = datetime.datetime(2024, 5, 1)
    orders = [(1, 7, "F", 1.0, day, "1-HIGH"), (2, 7, "F", 1.0, day, "1-HIGH"), (3, 7, None, 1.0, day, "1-HIGH"), (4, None, "O", 1.0, day, "5-LOW"), (5, None, "O", 1.0, None, "5-LOW")]
    kind = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(orders, kind).write.parquet(f"{tmp_path}/orders.parquet")
    cells = C.columns(Tables(spark, str(tmp_path)))
    plan = optimized(cells)
    assert "Aggregate" not in plan and plan.count("Window ") == 1
    high = [tuple(r) for r in cells.filter("workbook = 7 and `table` = 'HIGH'").select("position", "column", "is_numeric").orderBy("position").collect()]
    assert high == [(0, "ID", True), (1, "Latitude", True), (2, "Nom_site", None), (3, "total_2024", True)]
    assert cells.filter("workbook is null and `table` = 'LOW'").count() == 2 and cells.count() == len(cells.distinct().collect())


def test_columns_that_no_map_takes_are_not_grouped(rows):
    columns = rows([(1, "t", 0, "Latitude", True), (1, "t", 1, "Longitude", True), (1, "t", 2, "Ville", False), (1, "t", 3, "total", True)], COLUMNS + ", is_numeric boolean")
    geo = K.geo_columns(columns, ["workbook"])
    assert geo.first().asDict() | {} == {
        "workbook": 1, "table": "t", "name": "Ville", "longitude": "Longitude", "latitude": "Latitude", "geocode": None, "address": None, "geocoded_address": None,
    }
    assert "latitude|lat|y_coord|coord_y|longitude" in optimized(geo)
