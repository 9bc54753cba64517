"""Profile, category x measure and column-role queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sheetscope.operators import crosstab as X
from sheetscope.operators import profile as P
from sheetscope.operators import sketches as K
from sheetscope.plans.base import (
    COLUMNS, IDENTIFIER_SQL, NUMERIC, Tables, query, rounded, stats_sql, top_values_sql,
)
from sheetscope.session import cut_lineage, shared_folder
from sheetscope.sources.partitioned import read_summaries, replace_summaries
from sheetscope.sources.tables import load_profile, save_profile, union_all

STATS = f"WITH stats AS ({stats_sql()}) "


@query("profile_stats", STATS + "SELECT * EXCLUDE (avg), round(avg, 4) AS avg FROM stats")
def profile_stats(t: Tables):
    return rounded(P.profile_stats(t.all()).drop("lo", "hi"), avg=4)


@query("profile_counts", STATS + 'SELECT "table", "column", n_rows, non_null, n_null FROM stats')
def profile_counts(t: Tables):
    return P.profile_counts(t.all())


@query("profile_distinct", STATS + 'SELECT "table", "column", n_unique FROM stats')
def profile_distinct(t: Tables):
    return P.profile_distinct(t.all())


@query("profile_approx")
def profile_approx(t: Tables):
    """Estimated distinct counts; pytest holds them against the exact ones."""
    return K.approximate_stats(K.profile_sketches(t.all())).select("table", "column", "non_null", "n_unique")


@query(
    "profile_united",
    STATS
    + """SELECT "table", "column", n_rows, non_null, n_null, min, max, round(avg, 4) AS avg, true AS close FROM stats""",
)
def profile_united(t: Tables):
    """Two halves of every table profiled apart, stored, and united.

    ``close`` holds the estimate of distinct values against the exact count.
    """
    halves = [{n: df.filter(f"pmod(xxhash64({df.columns[0]}), 2) = {i}") for n, df in t.all().items()} for i in (0, 1)]
    stored = [cut_lineage(K.profile_sketches(half)) for half in halves]
    stats = K.approximate_stats(K.unite_sketches(*stored))
    exact = P.profile_distinct(t.all()).withColumnRenamed("n_unique", "exact")
    close = F.abs(F.col("n_unique") - F.col("exact")) <= 0.05 * F.col("exact")
    return rounded(
        stats.join(exact, ["table", "column"]).select("table", "column", "n_rows", "non_null", "n_null", "min", "max", "avg", close.alias("close")),
        avg=4,
    )


@query(
    "profile_numeric",
    STATS + 'SELECT "table", "column", min, max, round(avg, 4) AS avg FROM stats WHERE is_numeric AND non_null > 0',
)
def profile_numeric(t: Tables):
    return rounded(P.profile_numeric(t.all()), avg=4)


@query("profile_top_values", top_values_sql())
def profile_top_values(t: Tables):
    return P.profile_top_values(t.all())


@query("identifier_like", STATS + f'SELECT "table", "column", {IDENTIFIER_SQL} AS identifier FROM stats')
def identifier_like(t: Tables):
    return P.identifier_like(P.profile_stats(t.all())).select("table", "column", "identifier")


def _ordered_identifier_sql() -> str:
    """Numeric columns in the order of a key: nearly unique and never falling."""
    keys = {"part": "p_partkey", "orders": "o_orderkey", "events": "ts"}
    parts = []
    for table, key in keys.items():
        for column, kind in COLUMNS[table]:
            named = f"regexp_matches('{column}', 'id|code|uuid|matricule')"
            if kind not in NUMERIC:
                parts.append(f"SELECT '{table}' AS \"table\", '{column}' AS \"column\", {named} AS identifier")
                continue
            parts.append(
                f"SELECT '{table}' AS \"table\", '{column}' AS \"column\", {named} OR (count(DISTINCT v) / greatest(count(v), 1) > 0.9 "
                f"AND coalesce(bool_and(v >= p), true) AND count(v) = count(*)) AS identifier FROM "
                f"(SELECT {column} AS v, lag({column}) OVER (ORDER BY {key}) AS p FROM {table})"
            )
    return "\nUNION ALL\n".join(parts)


@query("identifier_like_ordered", _ordered_identifier_sql())
def identifier_like_ordered(t: Tables):
    keys = {"part": "p_partkey", "orders": "o_orderkey", "events": "ts"}
    return union_all([P.identifier_like_ordered(getattr(t, table), table, key) for table, key in keys.items()])


@query(
    "category_candidates",
    STATS
    + 'SELECT "table", "column", n_unique FROM stats WHERE NOT is_numeric AND spark_type <> \'timestamp_ntz\' '
    + "AND n_unique BETWEEN 2 AND 25",
)
def category_candidates(t: Tables):
    return P.category_candidates(P.profile_stats(t.all())).select("table", "column", "n_unique")


@query(
    "measure_candidates",
    STATS + f'SELECT "table", "column", n_unique FROM stats WHERE is_numeric AND n_unique >= 3 AND NOT {IDENTIFIER_SQL}',
)
def measure_candidates(t: Tables):
    return P.measure_candidates(P.profile_stats(t.all())).select("table", "column", "n_unique")


@query(
    "column_tags",
    STATS
    + 'SELECT "table", "column", CASE WHEN avg IS NOT NULL AND min IS NOT NULL THEN \'N\' ELSE \'T\' END AS tag FROM stats',
)
def column_tags(t: Tables):
    # The tag needs the range only, so the distinct pass is left out.
    return P.column_tags(P.profile_metrics(t.all()))


def _with_gaps(t: Tables):
    """Tables with nulls put in, since the test tables hold none."""
    return t.all() | {
        "part": t.part.withColumn("p_size", F.nullif("p_size", F.lit(1))).withColumn(
            "p_type", F.nullif("p_type", F.lit("PROMO"))
        ),
        "orders": t.orders.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P"))),
    }


@query(
    "null_share",
    """
    WITH part_gaps AS (SELECT * REPLACE (nullif(p_size, 1) AS p_size, nullif(p_type, 'PROMO') AS p_type) FROM part),
         orders_gaps AS (SELECT * REPLACE (nullif(o_orderstatus, 'P') AS o_orderstatus) FROM orders)
    """
    + "\nUNION ALL\n".join(
        f"SELECT '{table}' AS \"table\", '{column}' AS \"column\", count(*) - count({column}) AS n_null, "
        f"round((count(*) - count({column})) / count(*), 6) AS null_share FROM {table}{'_gaps' * (table in ('part', 'orders'))}"
        for table in COLUMNS
        for column, _ in COLUMNS[table]
    ),
)
def null_share(t: Tables):
    stats = P.profile_metrics(_with_gaps(t), ranges=False)
    return rounded(P.null_share(stats), null_share=6)


def _digest_sql() -> str:
    return f"""
    WITH stats AS ({stats_sql()}), top AS ({top_values_sql()}),
    listed AS (SELECT "table", "column", string_agg(value, ', ' ORDER BY rank) AS vals FROM top GROUP BY ALL)
    SELECT s."table", s."column", concat_ws(' | ', 'n=' || non_null, 'unique=' || n_unique,
        CASE WHEN avg IS NOT NULL THEN printf('min=%.0f max=%.0f avg=%.0f', min, max, avg) END,
        'top=[' || vals || ']') AS line
    FROM stats s LEFT JOIN listed l ON s."table" = l."table" AND s."column" = l."column"
    """


@query("profile_digest", _digest_sql())
def profile_digest(t: Tables):
    tables = t.all()
    return P.profile_digest(P.profile_stats(tables), P.profile_top_values(tables))


@query("profile_roundtrip", _digest_sql())
def profile_roundtrip(t: Tables):
    """Profile tables written as parquet and JSON, read back and joined again."""
    tables = t.all()
    stats, top = P.profile_stats(tables), P.profile_top_values(tables)
    root = f"{shared_folder(t.spark)}/profile-{uuid.uuid4().hex}"
    save_profile({"stats": stats}, root)
    save_profile({"top_values": top}, root, "json")
    back = load_profile(t.spark, root, ["stats"])["stats"]
    top_back = load_profile(t.spark, root, ["top_values"], "json")["top_values"]
    return P.profile_digest(back, top_back)


def _pairs_sql() -> str:
    """Summary rows of every pair whose columns qualify, at most 25 groups each."""
    parts = []
    for table_no, (table, columns) in enumerate(COLUMNS.items()):
        for group_no, (category, kind) in enumerate(columns):
            if kind != "s":
                continue
            for metric_no, (metric, metric_kind) in enumerate(columns):
                if metric_kind in NUMERIC:
                    parts.append(
                        f"SELECT {table_no} AS table_no, {group_no} AS group_no, {metric_no} AS metric_no, "
                        f"'{table}' AS \"table\", '{category}' AS group_by, '{metric}' AS metric, {category} AS grp, "
                        f"count(*) AS effectif, sum({metric})::DOUBLE AS somme, avg({metric})::DOUBLE AS moyenne, "
                        f"min({metric})::DOUBLE AS min, max({metric})::DOUBLE AS max FROM {table} "
                        f"WHERE {category} IS NOT NULL AND {metric} IS NOT NULL GROUP BY {category}"
                    )
    every = "\nUNION ALL\n".join(parts)
    return f"""
    WITH stats AS ({stats_sql()}),
    cats AS (SELECT "table", "column" FROM stats WHERE NOT is_numeric AND spark_type <> 'timestamp_ntz' AND n_unique BETWEEN 2 AND 25),
    nums AS (SELECT "table", "column" FROM stats WHERE is_numeric AND n_unique >= 3 AND NOT {IDENTIFIER_SQL}),
    sizes AS (SELECT "table", max(n_rows) AS n_rows FROM stats GROUP BY 1),
    pairs AS (
        SELECT e.*, z.n_rows FROM ({every}) e
        JOIN cats c ON c."table" = e."table" AND c."column" = e.group_by
        JOIN nums m ON m."table" = e."table" AND m."column" = e.metric
        JOIN sizes z ON z."table" = e."table"
        QUALIFY row_number() OVER (PARTITION BY e.table_no, e.group_no, e.metric_no ORDER BY effectif DESC, moyenne DESC, grp) <= 25
    ),
    kept AS (SELECT *, count(*) OVER (PARTITION BY table_no, group_no, metric_no) AS n_groups FROM pairs QUALIFY n_groups >= 2),
    scores AS (
        SELECT table_no, group_no, metric_no, "table", group_by, metric, n_groups,
            sum(effectif)::DOUBLE / max(n_rows) AS coverage,
            sum(effectif)::DOUBLE / max(n_rows) * 10 + greatest(0, 6 - abs(n_groups - 5))
            + CASE WHEN regexp_matches(lower(metric), 'salary|salaire|montant|cout|cost|revenue|ca|score|note|budget|amount|duree|duration|temps') THEN 4 ELSE 0 END
            + CASE WHEN regexp_matches(lower(group_by), 'depart|service|team|type|statut|status|region|site|manager|equipe|category|categorie') THEN 2 ELSE 0 END
            + least(n_groups, 10) / 10 AS score
        FROM kept GROUP BY table_no, group_no, metric_no, "table", group_by, metric, n_groups
    ),
    ranked AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, table_no, group_no, metric_no)::INT AS rank FROM scores)
    """


PAIRS = _pairs_sql()


@query(
    "crosstab_part_type_price",
    """
    SELECT p_type AS grp, count(*) AS effectif, round(sum(p_retailprice), 2) AS somme,
           round(avg(p_retailprice), 4) AS moyenne, min(p_retailprice) AS min, max(p_retailprice) AS max
    FROM part WHERE p_type IS NOT NULL AND p_retailprice IS NOT NULL
    GROUP BY p_type ORDER BY effectif DESC, moyenne DESC LIMIT 25
    """,
)
def crosstab_part_type_price(t: Tables):
    return rounded(X.crosstab(t.part, "p_type", "p_retailprice"), somme=2, moyenne=4)


@query(
    "crosstab_all_pairs",
    PAIRS
    + 'SELECT "table", group_by, metric, grp, effectif, round(somme, 2) AS somme, round(moyenne, 4) AS moyenne, min, max FROM kept',
)
def crosstab_all_pairs(t: Tables):
    return rounded(X.crosstab_pairs(t.all()).select(X.RESULT), somme=2, moyenne=4)


@query(
    "crosstab_stored",
    PAIRS
    + 'SELECT "table", group_by, metric, grp, effectif, round(somme, 2) AS somme, round(moyenne, 4) AS moyenne, min, max FROM kept',
)
def crosstab_stored(t: Tables):
    """All summaries stored, those of one table stored anew, and read back."""
    path = f"{shared_folder(t.spark)}/summaries-{uuid.uuid4().hex}"
    replace_summaries(X.crosstab_pairs(t.all()), path)
    replace_summaries(X.crosstab_pairs(t.pick("orders")), path)
    return rounded(read_summaries(t.spark, path), somme=2, moyenne=4)


@query(
    "crosstab_scores",
    PAIRS + 'SELECT "table", group_by, metric, n_groups, round(coverage, 6) AS coverage, round(score, 6) AS score, rank FROM ranked',
)
def crosstab_scores(t: Tables):
    return rounded(X.crosstab_scores(X.crosstab_pairs(t.all())), coverage=6, score=6)


@query(
    "crosstab_top4",
    PAIRS
    + """
    SELECT r.rank, concat_ws('_', 'Corr', r."table", r.group_by, r.metric) AS name, r."table", r.group_by, r.metric, k.grp,
           k.effectif, round(k.somme, 2) AS somme, round(k.moyenne, 4) AS moyenne, k.min, k.max
    FROM ranked r JOIN kept k USING (table_no, group_no, metric_no) WHERE r.rank <= 4
    """,
)
def crosstab_top4(t: Tables):
    return rounded(X.crosstab_top(X.crosstab_pairs(t.all())), somme=2, moyenne=4)
