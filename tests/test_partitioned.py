import pytest
from pyspark.sql import functions as F

from sheetscope.sources import partitioned as P
from sheetscope.sources import store as S

SCHEMA = "id int, v string, `part.` string"


def files(folder):
    return {p.relative_to(folder): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, "d", None), (5, "e", "1 2/é")]
    P.save_partitioned(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "t"), ["part."])
    return tmp_path / "t"


def read(spark, folder):
    return sorted(tuple(r) for r in spark.read.schema(SCHEMA).parquet(str(folder)).collect())


def test_an_edit_leaves_other_partitions_their_files(spark, stored):
    before = files(stored)
    patch = spark.createDataFrame([(2, "B", "x"), (9, "new", "x")], SCHEMA)
    P.edit_partitions(spark, str(stored), SCHEMA, ["part."], patch, lambda t: S.upsert_records(t, patch, ["id", "part."]))
    assert read(spark, stored) == [(1, "a", "x"), (2, "B", "x"), (3, "c", "y"), (4, "d", None), (5, "e", "1 2/é"), (9, "new", "x")]
    kept = {f: t for f, t in before.items() if "=x/" not in str(f)}
    assert len(kept) >= 3 and kept.items() <= files(stored).items()
    assert not (before.keys() - kept.keys()) & files(stored).keys()


def test_partitions_left_empty_go_and_new_ones_come(spark, stored):
    ids = spark.createDataFrame([(3, None, "y"), (4, None, None), (5, None, "1 2/é")], SCHEMA)
    P.edit_partitions(spark, str(stored), SCHEMA, ["part."], ids, lambda t: S.delete_records(t, ids, "id"))
    assert read(spark, stored) == [(1, "a", "x"), (2, "b", "x")]
    more = spark.createDataFrame([(7, "g", "z")], SCHEMA)
    P.edit_partitions(spark, str(stored), SCHEMA, ["part."], more, lambda t: S.append_records(t, more, None))
    assert read(spark, stored) == [(1, "a", "x"), (2, "b", "x"), (7, "g", "z")]


def test_an_edit_may_not_reach_other_partitions(spark, stored):
    before = files(stored)
    touched = spark.createDataFrame([("x",)], "`part.` string")
    with pytest.raises(ValueError, match="not touched"):
        P.edit_partitions(spark, str(stored), SCHEMA, ["part."], touched, lambda t: t.withColumn("part.", F.lit("y")))
    P.edit_partitions(spark, str(stored), SCHEMA, ["part."], touched.limit(0), lambda t: t.limit(0))
    assert files(stored) == before


def test_one_summary_is_one_folder(spark, tmp_path):
    rows = [(t, g, m, "k", 1, 1.0, 1.0, 1.0, 1.0) for t in "ab" for g in ("g1", "g2") for m in ("m1", "m2")]
    schema = "table string, group_by string, metric string, grp string, effectif bigint, somme double, moyenne double, min double, max double"
    path = str(tmp_path / "s")
    P.replace_summaries(spark.createDataFrame(rows, schema), path)
    before = files(tmp_path / "s")
    P.replace_summaries(spark.createDataFrame([("a", "g1", "m1", "new", 2, 2.0, 2.0, 2.0, 2.0)], schema), path)
    one = P.read_summaries(spark, path, "a", "g1", "m1")
    assert [r["grp"] for r in one.collect()] == ["new"]
    assert P.read_summaries(spark, path).count() == 8 and P.read_summaries(spark, path, "b").count() == 4
    changed = {f for f in files(tmp_path / "s") if f not in before}
    assert len(changed) == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(table" in plan
