"""Small inputs that hold every awkward case."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, row string, size int, `a b` string, `a.b` string"
PASSAGE = "the quick brown fox jumps over the lazy dog. and then it runs far away into the deep dark green forest near the old stone mill by the river today. "


def documents(spark, rows):
    """``rows`` of (doc_id, text, source), with columns whose names clash with ours."""
    return spark.createDataFrame([(i, t, None, s, None, "x", "y", 7, "z", "w") for i, t, s in rows], SCHEMA)


def awkward(spark):
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return documents(
        spark,
        [
            (1, None, None),
            (2, "", "a"),
            (3, " \n\t ", "b"),
            (4, "One.", "b"),
            (5, long, "c"),
            (6, long + " more", "c"),
            (None, PASSAGE * 2, None),
            (7, PASSAGE + "Own end here.", "a"),
            (7, PASSAGE + "Another end with the same id.", "a"),
            (8, "Été ÀÉ 日本 \U0001f600 ", "a"),
            (9, "Repeated row.", "b"),
            (9, "Repeated row.", "b"),
            (10, "REPEATED row.", "b"),
        ],
    )
