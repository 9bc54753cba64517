"""Text sources under a declared schema, and the lines that do not fit it."""

import pytest

from sheetscope.sources.tables import read_with_rejects


def test_csv_lines_that_do_not_fit(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,a.b,price\n1,x,2.5\n2,y,much\n3,z\n4,,\nfive,w,1.0\n6,v,1,9\n")
    rows, rejects = read_with_rejects(spark, str(tmp_path), "id BIGINT, `a.b` STRING, price DOUBLE")
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "x", 2.5), (4, None, None)]
    assert sorted(r.record for r in rejects.collect()) == ["2,y,much", "3,z", "6,v,1,9", "five,w,1.0"]
    assert rows.select("id").count() == 2 and rejects.count() == 4


def test_json_lines_that_do_not_fit(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "_rejected": "u"}\n{"id": "x"}\n{broken\n{}\n')
    rows, rejects = read_with_rejects(spark, str(tmp_path), "id BIGINT, _rejected STRING", "json")
    assert sorted((tuple(r) for r in rows.collect()), key=str) == [(1, "u"), (None, None)]
    assert sorted(r.record for r in rejects.collect()) == ['{"id": "x"}', "{broken"]
    assert rejects.count() == 2


def test_other_formats_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        read_with_rejects(spark, str(tmp_path), "id BIGINT", "parquet")
