"""Value words, inclusion search, range containment, top values and sketches against brute force."""

import random

from pyspark.sql import functions as F

from sheetscope.operators import profile as P
from sheetscope.operators import relations as R
from sheetscope.operators import sketches as K

LEAST, MOST = -(2**63), 2**63 - 1


def test_words_count_integers_of_any_size(rows):
    r = random.Random(2)
    values = [LEAST, LEAST, MOST, -1, 0, 63, 64, -64, -65, None, *(r.randrange(-300, 300) for _ in range(500)), *(r.randrange(LEAST, MOST) for _ in range(50))]
    df = rows([(v, None if v is None else v % 7, None) for v in values], "`a.b` bigint, small int, none bigint")
    found = {(x["table"], x["column"]): x["n_unique"] for x in P.profile_distinct({"t": df}).collect()}
    assert found == {("t", "a.b"): len(set(values) - {None}), ("t", "small"): 7}
    words = {(x["word"] * 64 + bit) for x in P.integer_words({"t": df}, {"t": ["a.b"]}).collect() for bit in range(64) if x["bits"] >> bit & 1}
    assert words == set(values) - {None}


def test_integers_do_not_travel_as_rows(spark):
    spark.range(200_000, numPartitions=2).createOrReplaceTempView("dense_keys")
    words = P.integer_words({"t": spark.table("dense_keys")})
    assert words.count() == 200_000 // 64
    plan = words._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert "partial_bit_or" in below


def stats_of(spark, ranges):
    """``ranges`` of (table, column, type, lo, hi, unique)."""
    data = [(t, c, k, 5, 5 if u else 4, lo, hi) for t, c, k, lo, hi, u in ranges]
    return spark.createDataFrame(data, "table string, column string, spark_type string, non_null bigint, n_unique bigint, lo bigint, hi bigint")


def test_range_containment_against_all_pairs(spark):
    r = random.Random(7)
    ends = [LEAST, LEAST + 1, MOST, MOST - 1, -1, 0, 1, 2, 63, 64, 100, 1 << 40]
    ranges = []
    for i in range(90):
        lo, hi = sorted(r.choice([r.choice(ends), r.randrange(-50, 50), r.randrange(LEAST, MOST)]) for _ in range(2))
        ranges.append((f"t{i % 9}", f"c{i}", r.choice(["int", "bigint"]), lo, hi, r.random() < 0.5))
    found = R.fk_range_candidates(stats_of(spark, ranges)).collect()
    expected = {
        (a[0], a[1], b[0], b[1]) for a in ranges for b in ranges if a[0] != b[0] and a[2] == b[2] and b[5] and b[3] <= a[3] and a[4] <= b[4]
    }
    assert len(found) == len(expected) > 100
    assert {(x["from_table"], x["from_column"], x["to_table"], x["to_column"]) for x in found} == expected


def test_many_columns_of_one_type_do_not_meet_on_it(spark):
    """10^5 columns in pairs of tables: each range fits its partner's alone."""
    i = F.col("id")
    stats = spark.range(100_000).select(
        F.format_string("t%d", i).alias("table"), F.lit("k").alias("column"), F.lit("bigint").alias("spark_type"),
        F.lit(9).cast("bigint").alias("non_null"), F.when(i % 2 == 0, 9).otherwise(8).cast("bigint").alias("n_unique"),
        (F.floor(i / 2) * 1000 + i % 2).alias("lo"), (F.floor(i / 2) * 1000 + 999 - i % 2).alias("hi"),
    )
    found = R.fk_range_candidates(stats)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("node" in line for line in joins)
    assert found.count() == 50_000


def test_overlaps_against_sets(rows):
    r = random.Random(3)
    tables, truth = {}, {}
    for t in range(5):
        own = [[r.choice([v, r.randrange(-200, 900), None]) for v in range(300)] for _ in range(2)]
        tables[f"t{t}"] = rows(list(zip(*own, range(300))), "a bigint, `b.c` bigint, k bigint")
        truth |= {(f"t{t}", "a"): set(own[0]) - {None}, (f"t{t}", "b.c"): set(own[1]) - {None}, (f"t{t}", "k"): set(range(300))}
    words = P.integer_words(tables)
    pairs = [(*a, *b) for a in truth for b in truth if a[0] != b[0]]
    candidates = rows(pairs, "from_table string, from_column string, to_table string, to_column string")
    found = {tuple(x)[:4]: (x["n_keys"], x["n_matched"]) for x in R.fk_overlaps(words, candidates).collect()}
    assert found == {p: (len(truth[p[:2]]), len(truth[p[:2]] & truth[p[2:]])) for p in pairs}
    # The dense keys' lists are alike and fold into few.
    lists = words.filter("column = 'k'").groupBy("word").agg(F.sort_array(F.collect_list("bits")).alias("held"))
    assert lists.count() == 5 and lists.select("held").distinct().count() == 2


def test_overlap_finds_references_among_all_integer_columns(rows):
    child = rows([(i % 40 + 1, 7) for i in range(300)], "ref bigint, n bigint")
    parent = rows([(i, -i) for i in range(1, 51)], "key bigint, other bigint")
    tables = {"c": child, "p": parent}
    words = P.integer_words(tables)
    candidates = R.fk_range_candidates(R.integer_stats(tables, words))
    found = {tuple(x)[:4]: x["coverage"] for x in R.fk_overlaps(words, candidates).collect()}
    assert found == {("c", "ref", "p", "key"): 1.0, ("c", "n", "p", "key"): 1.0}


def test_top_values_of_long_texts_that_share_a_head(rows):
    r = random.Random(9)
    head = "x" * 64
    texts = [head + str(r.randrange(40)) for _ in range(60)] + [head, head, "short", None, "é" * 64, "é" * 65] + ["y" * 5000] * 3
    other = [r.choice(["a", "b", None]) for _ in texts]
    df = rows(list(zip(texts, other)), "`long.text` string, other string")
    counts = {}
    for name, values in (("long.text", texts), ("other", other)):
        for v in values:
            if v is not None:
                counts[name, v] = counts.get((name, v), 0) + 1
    expected = []
    for name in ("long.text", "other"):
        best = sorted(((n, v) for (c, v), n in counts.items() if c == name), key=lambda x: (-x[0], x[1].encode()))[:5]
        expected += [("t", name, i, v, n) for i, (n, v) in enumerate(best, 1)]
    assert sorted(tuple(x) for x in P.profile_top_values({"t": df}).collect()) == sorted(expected)


def test_no_whole_text_is_shuffled_to_count_values(spark, rows):
    df = rows([("long " * 100 + str(i % 3),) for i in range(30)], "text string")
    values = P._values({"t": df}, {"t": ["text"]}, P._headed_value, ("head", "digest"))["string"]
    counted = values.groupBy("cid", "head", "digest").count()
    assert max(len(x["head"]) for x in counted.collect()) == P.HEAD_CHARS and counted.count() == 3


def test_sketches_unite_and_stay_near_the_truth(spark):
    df = spark.range(60_000).select(
        "id", (F.col("id") % 1000).alias("m"), F.concat(F.lit("v"), F.col("id") % 20_000).alias("text"),
        F.when(F.col("id") % 3 == 0, float("nan")).otherwise(F.col("id") / 7).alias("x"), F.lit(None).cast("string").alias("none"),
    )
    parts = [K.profile_sketches({"t": df.filter(F.col("id") % 4 == i)}) for i in range(4)]
    found = {r["column"]: r for r in K.approximate_stats(K.unite_sketches(*parts)).collect()}
    truth = {r["column"]: r for r in P.profile_stats({"t": df}).collect()}
    for name, exact in truth.items():
        own = found[name]
        assert all(own[k] == exact[k] for k in ("n_rows", "non_null", "n_null", "min", "max"))
        assert abs(own["n_unique"] - exact["n_unique"]) <= 0.03 * exact["n_unique"]
        assert (own["avg"] is None) == (exact["avg"] is None) and (own["avg"] is None or abs(own["avg"] - exact["avg"]) < 1e-6 * abs(exact["avg"]))
