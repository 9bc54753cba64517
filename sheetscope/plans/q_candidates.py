"""Column relevance, maps, chart candidates and domain tags over many workbooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetscope.operators import candidates as K
from sheetscope.operators import relevance as H
from sheetscope.plans import catalogs as C
from sheetscope.plans.base import Tables, query, rounded

WORDS = "list_distinct(regexp_extract_all(lower(strip_accents({})), '[a-z0-9]+'))"
SCORES = f"""
    WITH {C.COLUMNS_CTE}, {C.QUESTIONS_CTE},
    worded AS (
        SELECT c.workbook, c."table", c.position, c."column", c.is_numeric,
               {WORDS.format('c."column"')} AS own, {WORDS.format('q.question')} AS asked
        FROM cols c LEFT JOIN questions q ON c.workbook = q.workbook
    ),
    scores AS (
        SELECT workbook, "table", position, "column", is_numeric,
               coalesce(len(list_intersect(own, asked)) / len(own), 0.5) AS score FROM worded
    ),
    strong AS (SELECT *, bool_or(score >= 0.6) OVER (PARTITION BY workbook, "table") AS has_hard FROM scores),
    marked AS (SELECT *, score >= 0.6 OR (score > 0.25 AND has_hard) AS taken FROM strong),
    filled AS (
        SELECT *, count(*) FILTER (taken) OVER (PARTITION BY workbook) AS n_taken,
               row_number() OVER (PARTITION BY workbook, taken, score > 0.25 ORDER BY score DESC, "table", position) AS place FROM marked
    ),
    chosen AS (
        SELECT workbook, "table", "column", score,
               CASE WHEN score >= 0.6 THEN 'hard' WHEN taken THEN 'table' ELSE 'fill' END AS why
        FROM filled WHERE taken OR (score > 0.25 AND place <= 5 - n_taken)
    )
"""


def _scores(t: Tables):
    return H.score_columns(C.columns(t), C.questions(t))


def _chosen(t: Tables):
    return H.choose_columns(C.stored(t, _scores))


@query("relevance_scores", SCORES + "SELECT * REPLACE (round(score, 6) AS score) FROM scores")
def relevance_scores(t: Tables):
    return rounded(_scores(t), score=6)


@query("relevance_hysteresis", SCORES + "SELECT * REPLACE (round(score, 6) AS score) FROM chosen")
def relevance_hysteresis(t: Tables):
    return rounded(_chosen(t), score=6)


@query(
    "relevance_trim",
    SCORES
    + """SELECT c.* FROM cols c WHERE
            c.workbook NOT IN (SELECT workbook FROM chosen GROUP BY 1 HAVING count(*) >= 5)
            OR c.workbook IN (SELECT workbook FROM questions WHERE trim(question) = '')
            OR EXISTS (SELECT 1 FROM chosen k WHERE k.workbook = c.workbook AND k."table" = c."table" AND k."column" = c."column")""",
)
def relevance_trim(t: Tables):
    return H.trim_profile(C.columns(t), _chosen(t), C.questions(t))


GEO_CTE = f"""
    WITH {C.COLUMNS_CTE}, toks AS (SELECT *, lower(regexp_replace("column", '[^\\p{{L}}\\p{{N}}_]', '', 'g')) AS tok FROM cols),
    axes AS (
        SELECT workbook, "table",
               arg_min("column", position) FILTER (is_numeric AND regexp_matches(tok, 'latitude|lat|y_coord|coord_y')) AS latitude,
               arg_min("column", position) FILTER (is_numeric AND regexp_matches(tok, 'longitude|long|lng|lon|x_coord|coord_x')) AS longitude
        FROM toks GROUP BY ALL HAVING latitude <> longitude
    ),
    geo AS (
        SELECT a.workbook, a."table",
               coalesce(arg_min(k."column", k.position) FILTER (regexp_matches(tok, 'name|nom|label|title|site|city|ville|lieu')),
                        arg_min(k."column", k.position) FILTER (NOT k.is_numeric AND NOT regexp_matches(tok, 'id|code|uuid|matricule'))) AS name,
               a.longitude, a.latitude
        FROM axes a JOIN toks k ON a.workbook = k.workbook AND a."table" = k."table" AND k."column" NOT IN (a.latitude, a.longitude)
        GROUP BY ALL HAVING name IS NOT NULL
    )
"""


@query(
    "geo_columns",
    GEO_CTE + "SELECT *, NULL::VARCHAR AS geocode, NULL::VARCHAR AS address, NULL::VARCHAR AS geocoded_address FROM geo",
)
def geo_columns(t: Tables):
    return K.geo_columns(C.stored(t, C.columns), ["workbook"])


@query(
    "geo_points",
    """
    SELECT c_name AS "Name", lat AS "Latitude", lon AS "Longitude" FROM (
        SELECT nullif(c_name, 'Customer#000000007') AS c_name, c_acctbal / 100 AS lat, (c_nationkey * 16 - 192)::DOUBLE AS lon FROM customer
    ) WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND c_name IS NOT NULL
    """,
)
def geo_points(t: Tables):
    """Coordinates made from balances and nations, some of them out of range."""
    placed = t.customer.select(
        F.nullif("c_name", F.lit("Customer#000000007")).alias("c_name"),
        (F.col("c_acctbal") / 100).alias("lat"), (F.col("c_nationkey") * 16 - 192).alias("lon"),
    )
    return K.geo_points(placed, "c_name", "lat", "lon")


CANDIDATES_CTE = (
    GEO_CTE
    + f""", {C.INSIGHTS_CTE}, {C.CROSSTABS_CTE},
    crossed AS (
        SELECT x.workbook, x.position AS idx, x.name AS source_table, x.group_by || ', ' || x.metric AS source_columns,
               string_agg(r.idx::VARCHAR, ', ' ORDER BY r.idx) AS insight_refs,
               least(greatest(0.55, coalesce(1.0 - (min(r.priority) - 1) * 0.12, 0.55)), 0.95)::DOUBLE AS priority,
               CASE WHEN count(r.idx) > 0 THEN 0.9 ELSE 0.72 END::DOUBLE AS confidence,
               'Croisement ' || x.group_by || ' x ' || x.metric AS title
        FROM crosstabs x LEFT JOIN reports r ON r.workbook = x.workbook AND r."table" = x.source_table AND r.col IN (x.group_by, x.metric)
        GROUP BY x.workbook, x.position, x.name, x.group_by, x.metric
    ),
    trends AS (
        SELECT r.workbook, r.idx, r."table" AS source_table, r.col,
               (SELECT arg_min(c."column", c.position) FROM cols c WHERE c.workbook = r.workbook AND c."table" = r."table"
                AND c.is_numeric AND c."column" <> r.col) AS measure,
               greatest(0.5, 1.0 - (r.priority - 1) * 0.12)::DOUBLE AS priority, r.finding AS title
        FROM reports r WHERE r.type = 'trend'
        QUALIFY row_number() OVER (PARTITION BY r.workbook, r."table", r.col ORDER BY r.idx) = 1
    ),
    every AS (
        SELECT workbook, 1 AS kind_no, idx, 'cross_tab' AS kind, source_table, source_columns, coalesce(insight_refs, '') AS insight_refs, priority, confidence,
               'summary_page' AS presentation, 'advanced_chart' AS premium_widget, title, 0.06 + 0.04 AS bonus FROM crossed
        UNION ALL
        SELECT workbook, 2, idx, 'trend', source_table, concat_ws(', ', col, measure), idx::VARCHAR, priority, 0.8,
               CASE WHEN idx = 0 THEN 'hero_chart' ELSE 'secondary_chart' END, 'advanced_chart', title,
               0.08 + CASE WHEN idx = 0 THEN 0.10 ELSE 0.05 END FROM trends
        UNION ALL
        SELECT workbook, 3, 0, 'geo', "table", concat_ws(', ', name, longitude, latitude), '', 0.68, 0.83, 'geo_page', 'map',
               'Carte ' || "table", 0.05 + 0.04 FROM geo
        UNION ALL
        SELECT workbook, 4, 0, 'narrative', arg_min("table", idx), string_agg(col, ', ' ORDER BY idx), string_agg(idx::VARCHAR, ', ' ORDER BY idx),
               0.7, 0.75, 'narrative_block', 'markdown', 'Resume analytique', 0.04 + 0.03 FROM reports GROUP BY workbook
    )
"""
)
PUBLIC = "workbook, idx, kind, source_table, source_columns, insight_refs, round(priority, 6) AS priority, confidence, presentation, premium_widget, title"


def _flat(df):
    """Arrays as text, priorities rounded."""
    return rounded(
        df.withColumns(
            {
                "source_columns": F.array_join("source_columns", ", "),
                "insight_refs": F.array_join(F.col("insight_refs").cast("array<string>"), ", "),
            }
        ),
        priority=6,
    )


def _crosstab_candidates(t: Tables):
    return K.crosstab_candidates(C.crosstabs(t), C.stored(t, C.reports))


def _trend_candidates(t: Tables):
    return K.trend_candidates(C.stored(t, C.reports), C.stored(t, C.columns))


@query("candidate_crosstab", CANDIDATES_CTE + f"SELECT {PUBLIC} FROM every WHERE kind = 'cross_tab'")
def candidate_crosstab(t: Tables):
    return _flat(_crosstab_candidates(t))


@query("candidate_trend", CANDIDATES_CTE + f"SELECT {PUBLIC} FROM every WHERE kind = 'trend'")
def candidate_trend(t: Tables):
    return _flat(_trend_candidates(t))


def _narrative_candidates(t: Tables):
    return K.narrative_candidates(C.stored(t, C.reports))


@query("candidate_narrative", CANDIDATES_CTE + f"SELECT {PUBLIC} FROM every WHERE kind = 'narrative'")
def candidate_narrative(t: Tables):
    return _flat(_narrative_candidates(t))


@query(
    "candidate_promote",
    CANDIDATES_CTE
    + f"""SELECT {PUBLIC}, kind_no, round(priority * 0.7 + confidence * 0.3 + bonus, 6) AS score FROM every
          QUALIFY row_number() OVER (PARTITION BY workbook ORDER BY round(priority * 0.7 + confidence * 0.3 + bonus, 12) DESC,
                                     kind_no DESC, idx DESC, source_table DESC) = 1""",
)
def candidate_promote(t: Tables):
    """Cross-tabs come before trends, then maps, then the narrative; later ones win ties."""
    every = (
        _crosstab_candidates(t).withColumn("kind_no", F.lit(1))
        .unionByName(_trend_candidates(t).withColumn("kind_no", F.lit(2)))
        .unionByName(K.geo_candidates(K.geo_columns(C.stored(t, C.columns), ["workbook"])).withColumn("kind_no", F.lit(3)))
        .unionByName(_narrative_candidates(t).withColumn("kind_no", F.lit(4)))
    )
    return rounded(_flat(K.promote(every, ["kind_no", "idx", "source_table"])), score=6)


TAGS = f"WITH {C.EVENT_TABLES_CTE} "


@query("domain_tag", TAGS + "SELECT workbook, domain, round(confidence, 6) AS confidence FROM tags")
def domain_tag(t: Tables):
    return rounded(K.domain_tags(C.event_tables(t)), confidence=6)


def _column_tags_sql() -> str:
    kinds = ", ".join("('{}', '{}', '{}')".format(kind, *names) for kind, names in C.EVENT_COLUMNS.items())
    words = ", ".join(f"('{word}', '{domain}')" for word, domain in K.word_domains().items())
    tokens = "string_split_regex(lower(strip_accents(regexp_replace({}, '([a-z])([A-Z])', '\\1 \\2', 'g'))), '[^a-z0-9]+')"
    return f"""
    WITH kinds(event_type, tbl, col) AS (VALUES {kinds}), words(word, domain) AS (VALUES {words}),
    cols AS (SELECT 'u' || user_id || '_' || strftime(ts, '%Y-%m-%d') AS workbook, tbl, col FROM events LEFT JOIN kinds USING (event_type)),
    named AS (
        SELECT DISTINCT workbook, unnest({tokens.format("tbl")}) AS word, {K.TABLE_WEIGHT} AS weight FROM cols
        UNION SELECT DISTINCT workbook, unnest({tokens.format("col")}), {K.COLUMN_WEIGHT} FROM cols
    ),
    found AS (
        SELECT workbook, domain, w.word, max(weight) AS weight FROM named n JOIN words w ON w.word IN (n.word, regexp_replace(n.word, 's$', '')) GROUP BY ALL
    ),
    best AS (
        SELECT workbook, domain, sum(weight) / sum(sum(weight)) OVER (PARTITION BY workbook) AS share FROM found GROUP BY workbook, domain
        QUALIFY row_number() OVER (PARTITION BY workbook ORDER BY sum(weight) DESC, domain) = 1
    )
    SELECT workbook, CASE WHEN share >= {K.DOMAIN_SHARE} THEN domain ELSE 'GENERIC' END AS domain, round(coalesce(share, 0), 6) AS confidence
    FROM (SELECT DISTINCT workbook FROM cols) LEFT JOIN best USING (workbook)
    """


@query("domain_tag_columns", _column_tags_sql())
def domain_tag_columns(t: Tables):
    return rounded(K.column_domain_tags(C.event_columns(t)), confidence=6)


@query(
    "domain_roles",
    TAGS + 'SELECT DISTINCT workbook, lower("table") AS role, "table" FROM event_tables WHERE "table" IS NOT NULL',
)
def domain_roles(t: Tables):
    return K.role_mapping(C.event_tables(t))


@query(
    "domain_override",
    TAGS
    + """, fixes AS (SELECT workbook FROM event_tables WHERE "table" = 'Customers' GROUP BY 1 HAVING count(*) >= 2)
    SELECT t.workbook, CASE WHEN f.workbook IS NOT NULL THEN 'DECISIONNEL' ELSE t.domain END AS domain,
           round(t.confidence, 6) AS confidence, f.workbook IS NOT NULL AS overridden
    FROM tags t LEFT JOIN fixes f ON t.workbook = f.workbook""",
)
def domain_override(t: Tables):
    return rounded(K.override_domains(K.domain_tags(C.event_tables(t)), C.event_overrides(t)), confidence=6)
