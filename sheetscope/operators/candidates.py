"""Chart candidates: maps, cross-tabs, trends, the promoted one, and the domain tag."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetscope.functions.names import contains_any, match_key, search_token
from sheetscope.functions.numbers import named
from sheetscope.operators.insights import reports_by_workbook
from sheetscope.operators.profile import IDENTIFIER_WORDS

# Name parts of coordinates, labels and addresses.
LATITUDE_WORDS = ("latitude", "lat", "y_coord", "coord_y")
LONGITUDE_WORDS = ("longitude", "long", "lng", "lon", "x_coord", "coord_x")
LABEL_WORDS = ("name", "nom", "label", "title", "site", "city", "ville", "lieu")
GEOCODE_WORDS = ("geocode", "geocoder")
ADDRESS_WORDS = ("address", "adresse", "location", "lieu")
GEOCODED_WORDS = ("geocoded", "adresse_geocodee")

# Bonuses of the promotion score.
KIND_BONUS = {"trend": 0.08, "cross_tab": 0.06, "geo": 0.05, "narrative": 0.04, "entity_detail": 0.02}
PRESENTATION_BONUS = {
    "hero_chart": 0.10,
    "secondary_chart": 0.05,
    "summary_page": 0.04,
    "geo_page": 0.04,
    "narrative_block": 0.03,
    "detail_page": 0.01,
}

# Domain of each table role, and the share a domain needs.
ROLE_DOMAINS = {
    "employees": "HR",
    "absences": "HR",
    "evaluations": "HR",
    "main": "DECISIONNEL",
    "tickets": "SUPPORT",
    "customers": "SUPPORT",
    "agents": "SUPPORT",
    "students": "STUDENT",
    "grades": "STUDENT",
    "courses": "STUDENT",
    "assets": "SI",
    "users": "SI",
    "incidents": "SI",
    "tasks": "PROJECT",
    "team": "PROJECT",
    "milestones": "PROJECT",
}
DOMAIN_SHARE = 0.6
# Words of sheet and column names, without accents and in the singular, by domain.
DOMAIN_WORDS = {
    "HR": "employee employe salarie personnel salary salaire absence leave conge evaluation manager departement department matricule contrat hire embauche",
    "DECISIONNEL": "revenue chiffre vente sale budget indicateur kpi marge margin objectif target forecast prevision",
    "SUPPORT": "ticket customer client agent priorite priority reclamation complaint sla resolution",
    "STUDENT": "student etudiant eleve grade note course cours matiere classe exam examen semestre",
    "SI": "asset actif materiel serveur server incident user utilisateur licence license logiciel software inventaire",
    "PROJECT": "task tache milestone jalon project projet team equipe echeance deadline sprint livrable",
}
# A word in a sheet's name says more of a workbook than one in a column's.
TABLE_WEIGHT, COLUMN_WEIGHT = 3, 1
GENERIC = "GENERIC"


def _literal_map(values: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])


def _first(condition: Column) -> Column:
    """Name of the leftmost column that meets ``condition``."""
    return F.min(F.when(condition, F.struct("position", "column"))).getField("column")


def geo_columns(columns: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Tables with coordinates: their latitude, longitude, label and address columns.

    ``columns`` has ``table, position, column, is_numeric`` and the ``within``
    keys. All picks are minima, combined on the map side.
    """
    keys = [*within, "table"]
    columns = columns.withColumn("_token", search_token(F.col("column")))
    token = F.col("_token")
    numeric = F.coalesce("is_numeric", F.lit(False))
    # Columns that no pick can take, mostly all of them, are not put in order.
    any_pick = contains_any(token, (*LATITUDE_WORDS, *LONGITUDE_WORDS, *GEOCODE_WORDS, *ADDRESS_WORDS, *GEOCODED_WORDS))
    picks = (
        columns.filter(any_pick)
        .groupBy(*keys)
        .agg(
            _first(numeric & contains_any(token, LATITUDE_WORDS)).alias("latitude"),
            _first(numeric & contains_any(token, LONGITUDE_WORDS)).alias("longitude"),
            _first(contains_any(token, GEOCODE_WORDS)).alias("geocode"),
            _first(contains_any(token, ADDRESS_WORDS)).alias("address"),
            _first(contains_any(token, GEOCODED_WORDS)).alias("geocoded_address"),
        )
        .filter("latitude is not null and longitude is not null and latitude <> longitude")
    )
    other = ~F.col("column").isin(F.col("latitude"), F.col("longitude"))
    preferred = contains_any(token, LABEL_WORDS)
    usable = ~numeric & ~contains_any(token, IDENTIFIER_WORDS)
    labels = (
        columns.join(picks.select(*keys, "latitude", "longitude"), keys)
        .filter(other & (preferred | usable))
        .groupBy(*keys)
        .agg(
            F.min(F.struct(F.when(preferred, 0).otherwise(1).alias("rank"), F.col("position"), F.col("column")))
            .getField("column")
            .alias("name")
        )
    )
    return picks.join(labels, keys).select(
        *keys, "name", "longitude", "latitude", "geocode", "address", "geocoded_address"
    )


def geo_points(df: DataFrame, name: str, latitude: str, longitude: str) -> DataFrame:
    """``Name, Latitude, Longitude`` of the rows that can stand on a map."""
    lat, lon = F.col(latitude).cast("double"), F.col(longitude).cast("double")
    return df.filter(lat.between(-90, 90) & lon.between(-180, 180) & named(name).isNotNull()).select(
        named(name).alias("Name"), lat.alias("Latitude"), lon.alias("Longitude")
    )


def _priority(best: Column, floor: float) -> Column:
    return F.greatest(F.lit(floor), F.lit(1.0) - (best - 1) * 0.12)


def crosstab_candidates(crosstabs: DataFrame, reports: DataFrame) -> DataFrame:
    """One candidate per summary table, stronger when an insight speaks of it.

    ``crosstabs`` is ``workbook, position, name, source_table, group_by, metric``.
    A report is one short array per workbook, so no summary is repeated.
    """
    joined = crosstabs.join(reports_by_workbook(reports), "workbook", "left").withColumn(
        "_hits",
        F.filter(
            F.coalesce("entries", F.array().cast("array<struct<idx:int,type:string,table:string,col:string,finding:string,priority:int>>")),
            lambda e: (e["table"] == F.col("source_table")) & e["col"].isin(F.col("group_by"), F.col("metric")),
        ),
    )
    best = F.array_min(F.transform("_hits", lambda e: e["priority"]))
    matched = F.size("_hits") > 0
    return joined.select(
        "workbook", F.col("position").alias("idx"), F.lit("cross_tab").alias("kind"), F.col("name").alias("source_table"),
        F.array("group_by", "metric").alias("source_columns"),
        F.transform("_hits", lambda e: e["idx"]).alias("insight_refs"),
        F.least(F.when(matched, _priority(best, 0.55)).otherwise(0.55), F.lit(0.95)).alias("priority"),
        F.when(matched, 0.9).otherwise(0.72).alias("confidence"),
        F.lit("summary_page").alias("presentation"), F.lit("advanced_chart").alias("premium_widget"),
        F.concat(F.lit("Croisement "), "group_by", F.lit(" x "), "metric").alias("title"),
    )


def trend_candidates(reports: DataFrame, columns: DataFrame) -> DataFrame:
    """One candidate per table and column with a trend insight.

    The measure beside it is the first other numeric column of the table; a report
    has at most five insights, which bounds the rows of the join.
    """
    earliest = W.partitionBy("workbook", "table", "col").orderBy("idx")
    trends = (
        reports.filter("type = 'trend'")
        .withColumn("_rank", F.row_number().over(earliest))
        .filter("_rank = 1")
        .drop("_rank")
    )
    numeric = columns.filter("is_numeric").select("workbook", "table", "position", "column")
    measures = (
        trends.select("workbook", "table", "col")
        .join(numeric, ["workbook", "table"])
        .filter(F.col("column") != F.col("col"))
        .groupBy("workbook", "table", "col")
        .agg(F.min_by("column", "position").alias("_measure"))
    )
    return trends.join(measures, ["workbook", "table", "col"], "left").select(
        "workbook", "idx", F.lit("trend").alias("kind"), F.col("table").alias("source_table"),
        F.array_compact(F.array("col", "_measure")).alias("source_columns"), F.array("idx").alias("insight_refs"),
        _priority(F.col("priority"), 0.5).alias("priority"), F.lit(0.8).alias("confidence"),
        F.when(F.col("idx") == 0, "hero_chart").otherwise("secondary_chart").alias("presentation"),
        F.lit("advanced_chart").alias("premium_widget"), F.col("finding").alias("title"),
    )


def geo_candidates(geo: DataFrame) -> DataFrame:
    """One map candidate per table of ``geo_columns``."""
    return geo.select(
        "workbook", F.lit(0).alias("idx"), F.lit("geo").alias("kind"), F.col("table").alias("source_table"),
        F.array_compact(F.array("name", "longitude", "latitude", "geocode", "address", "geocoded_address")).alias(
            "source_columns"
        ),
        F.array().cast("array<int>").alias("insight_refs"), F.lit(0.68).alias("priority"), F.lit(0.83).alias("confidence"),
        F.lit("geo_page").alias("presentation"), F.lit("map").alias("premium_widget"),
        F.concat(F.lit("Carte "), "table").alias("title"),
    )


def narrative_candidates(reports: DataFrame) -> DataFrame:
    """One candidate per workbook with a report: its digest as a text block.

    It speaks of all the report's insights, and stands with the first one's table.
    """
    entries = reports_by_workbook(reports)
    return entries.select(
        "workbook", F.lit(0).alias("idx"), F.lit("narrative").alias("kind"), F.col("entries")[0]["table"].alias("source_table"),
        F.transform("entries", lambda e: e["col"]).alias("source_columns"),
        F.transform("entries", lambda e: e["idx"]).alias("insight_refs"), F.lit(0.7).alias("priority"),
        F.lit(0.75).alias("confidence"), F.lit("narrative_block").alias("presentation"),
        F.lit("markdown").alias("premium_widget"), F.lit("Resume analytique").alias("title"),
    )


def promotion_score() -> Column:
    """Priority and confidence, plus what the kind and the presentation add."""
    kind = F.coalesce(F.try_element_at(_literal_map(KIND_BONUS), F.col("kind")), F.lit(0.0))
    place = F.coalesce(F.try_element_at(_literal_map(PRESENTATION_BONUS), F.col("presentation")), F.lit(0.0))
    return F.col("priority") * 0.7 + F.col("confidence") * 0.3 + kind + place


def promote(candidates: DataFrame, order: Sequence[str] = ("idx",)) -> DataFrame:
    """The best candidate of each workbook that has a premium widget.

    Equal scores go to the later candidate in ``order``. The pick is a maximum,
    combined on the map side.
    """
    rest = [c for c in candidates.columns if c not in ("workbook", *order)]
    # Scores are compared to twelve digits: sums in another order are still ties.
    ranked = F.struct(F.round(F.col("score"), 12).alias("score"), *order, *rest)
    return (
        candidates.filter("premium_widget is not null")
        .withColumn("score", promotion_score())
        .groupBy("workbook")
        .agg(F.max(ranked).alias("best"))
        .select("workbook", "best.*")
    )


def role_mapping(tables: DataFrame) -> DataFrame:
    """``workbook, role, table`` for the tables that carry a role's name."""
    role = match_key(F.col("table"))
    return tables.filter(role.isin(*ROLE_DOMAINS)).groupBy("workbook", role.alias("role")).agg(F.min("table").alias("table"))


def domain_tags(tables: DataFrame) -> DataFrame:
    """``workbook, domain, confidence`` from the roles its tables play.

    A domain's confidence is its share of the roles found; below the limit, or
    with no role at all, the workbook is generic.
    """
    found = role_mapping(tables).select("workbook", F.element_at(_literal_map(ROLE_DOMAINS), F.col("role")).alias("domain"))
    return _best_domains(tables, found.groupBy("workbook", "domain").agg(F.count(F.lit(1)).alias("hits")))


def _best_domains(tables: DataFrame, hits: DataFrame) -> DataFrame:
    """The domain with the largest share of each workbook's ``hits``."""
    best = hits.groupBy("workbook").agg(
        F.sum("hits").alias("_all"), F.min(F.struct((-F.col("hits")).alias("rank"), F.col("domain"))).alias("_best")
    )
    confidence = F.coalesce(-F.col("_best.rank") / F.col("_all"), F.lit(0.0))
    return tables.select("workbook").distinct().join(best, "workbook", "left").select(
        "workbook",
        F.when(confidence >= DOMAIN_SHARE, F.col("_best.domain")).otherwise(GENERIC).alias("domain"),
        confidence.alias("confidence"),
    )


def word_domains() -> dict[str, str]:
    """Domain of every word of ``DOMAIN_WORDS``."""
    return {word: domain for domain, words in DOMAIN_WORDS.items() for word in words.split()}


def name_tokens(name: Column) -> Column:
    """Words of a name: no accents, lower case, capitals inside a word begin one, no plural ``s``."""
    parted = F.regexp_replace(name, r"(\p{Ll})(\p{Lu})", "$1 $2")
    words = F.split(match_key(parted), "[^a-z0-9]+")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, F.regexp_replace(w, "s$", "")))))


def column_domain_tags(columns: DataFrame) -> DataFrame:
    """``workbook, domain, confidence`` from the words of sheet and column names.

    ``columns`` has ``workbook, table, column``. A word counts once a workbook, as a word
    of a sheet or of a column, with that place's weight. A domain's confidence is its share
    of all weight found; below the limit, or with no word known, the workbook is generic.
    Nulls have no words; ties go to the domain that is first by name.
    """
    words = _literal_map(word_domains())
    place = lambda name, weight: F.transform(
        F.coalesce(name_tokens(F.col(name)), F.array().cast("array<string>")), lambda w: F.struct(w.alias("word"), F.lit(weight).alias("weight"))
    )
    named_words = columns.select("workbook", F.inline(F.concat(place("table", TABLE_WEIGHT), place("column", COLUMN_WEIGHT))))
    found = (
        named_words.withColumn("domain", F.try_element_at(words, F.col("word")))
        .filter("domain is not null")
        .groupBy("workbook", "domain", "word")
        .agg(F.max("weight").alias("weight"))
    )
    hits = found.groupBy("workbook", "domain").agg(F.sum("weight").alias("hits"))
    return _best_domains(columns, hits)


def override_domains(tags: DataFrame, overrides: DataFrame) -> DataFrame:
    """Domain tags with the users' corrections; confidence is kept."""
    chosen = overrides.select("workbook", F.col("domain").alias("_domain"))
    return tags.join(chosen, "workbook", "left").select(
        "workbook", F.coalesce("_domain", "domain").alias("domain"), "confidence",
        (F.col("_domain").isNotNull() & (F.col("_domain") != F.col("domain"))).alias("overridden"),
    )
