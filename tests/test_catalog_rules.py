"""Insights, specs, relevance and candidates on small literal inputs."""

import random

import pytest
from pyspark.sql import functions as F

from sheetscope.operators import candidates as K
from sheetscope.operators import charts as G
from sheetscope.operators import derive as D
from sheetscope.operators import insights as I
from sheetscope.operators import relations as R
from sheetscope.operators import relevance as H
from sheetscope.operators import specs as V

SCORES = "workbook int, table string, position int, column string, score double"
SECTION = (
    "workbook int, plan_id int, page_no int, section_no int, widget string, chart_type string, table string, "
    "x string, y string, title string"
)
INSIGHT = "workbook int, seq int, type string, table string, col string, finding string, priority int"
REPORT = "workbook int, idx int, type string, table string, col string, finding string, priority int"


def chosen(rows, scores, **limits):
    data = [(1, *key.split("."), s) for key, s in scores.items()]
    df = rows([(w, t, i, c, s) for i, (w, t, c, s) in enumerate(data)], SCORES)
    return {f"{r['table']}.{r['column']}" for r in H.choose_columns(df, **limits).collect()}


def test_hard_in_and_hard_out(rows):
    found = chosen(rows, {"E.Département": 0.9, "E.Salaire": 0.8, "E.Nom": 0.1, "E.ID": 0.05, "A.Date": 0.1})
    assert found == {"E.Département", "E.Salaire"}


def test_soft_column_follows_its_table(rows):
    found = chosen(rows, {"E.Département": 0.9, "E.Salaire": 0.4, "A.Date": 0.4}, min_columns=2)
    assert found == {"E.Département", "E.Salaire"}


def test_floor_is_filled_by_score(rows):
    assert len(chosen(rows, {"A.col1": 0.9, "B.col2": 0.4, "C.col3": 0.35, "D.col4": 0.3}, min_columns=3)) == 3


def test_choice_agrees_with_a_plain_loop(rows):
    """Random scores against the rule written as a loop over one dict."""
    rng = random.Random(5)
    data, expected = [], {}
    for workbook in range(40):
        scores = {(f"T{rng.randrange(4)}", i): rng.choice([0.1, 0.25, 0.3, 0.45, 0.59, 0.6, 0.9]) for i in range(rng.randrange(1, 12))}
        data += [(workbook, t, i, f"c{i}", s) for (t, i), s in scores.items()]
        hard = {k for k, s in scores.items() if s >= 0.6}
        soft = sorted((k for k, s in scores.items() if 0.25 < s < 0.6), key=lambda k: (-scores[k], k))
        picked = hard | {k for k in soft if k[0] in {t for t, _ in hard}}
        for key in soft:
            if len(picked) >= 5:
                break
            picked.add(key)
        expected[workbook] = {(t, f"c{i}") for t, i in picked}
    found = {}
    for r in H.choose_columns(rows(data, SCORES)).collect():
        found.setdefault(r["workbook"], set()).add((r["table"], r["column"]))
    assert found == {w: keys for w, keys in expected.items() if keys}


def test_profile_is_kept_whole_without_question_or_with_too_few(rows):
    stats = rows([(w, "T", f"c{i}", 0.0) for w in (1, 2, 3) for i in range(6)], "workbook int, table string, column string, avg double")
    few = rows([(1, "T", "c0")], "workbook int, table string, column string")
    five = rows([(w, "T", f"c{i}") for w in (2, 3) for i in range(5)], "workbook int, table string, column string")
    asked = rows([(1, "total"), (2, "total"), (3, "  ")], "workbook int, question string")
    kept = H.trim_profile(stats, few.union(five), asked).groupBy("workbook").count().collect()
    assert {r["workbook"]: r["count"] for r in kept} == {1: 6, 2: 5, 3: 6}


@pytest.fixture
def spec_catalog(rows):
    roles = rows([(1, "employees", "Employes", 0)], "workbook int, role string, table string, position int")
    columns = rows(
        [(1, "Employes", i, c) for i, c in enumerate(["ID_Employe", "Salaire_Brute", "Manager", "nb_absences", "sans_manager"])],
        "workbook int, table string, position int, column string",
    )
    return roles, columns.select("workbook", "table").distinct(), columns


def checked(rows, catalog, *sections):
    roles, tables, columns = catalog
    data = [(1, 1, 1, i, w, c, t, x, y, f"S{i}") for i, (w, c, t, x, y) in enumerate(sections)]
    return V.check_specs(V.resolve_tables(rows(data, SECTION), roles, tables), columns)


BAR = ("chart", "bar", "employees", "ID_Employe", "Salaire_Brute")
BAD = ("chart", "bar", "employees", "NonExistent", "Salaire_Brute")
LIST = ("card_list", None, "employees", None, None)


@pytest.mark.parametrize(
    "section, reason",
    [
        (BAR, None),
        (BAD, "x col 'NonExistent' not in Employes"),
        (("chart", "pie", "EMPLOYÉES", "manager", "nb_absences"), None),
        (("chart", "pie", "employés", "Manager", None), None),
        (LIST, None),
        (("card_list", None, "ghost_table", None, None), "table 'ghost_table' unresolvable"),
        (("card_list", None, None, None, None), "table '' unresolvable"),
    ],
)
def test_section_checks(rows, spec_catalog, section, reason):
    assert checked(rows, spec_catalog, section).first()["reason"] == reason


def test_drop_ratio_and_retry(rows, spec_catalog):
    mostly_bad = V.drop_ratios(checked(rows, spec_catalog, LIST, BAD, BAD)).first()
    assert mostly_bad["drop_ratio"] > 0.5 and mostly_bad["retry"]
    mostly_good = V.drop_ratios(checked(rows, spec_catalog, LIST, BAR, BAD)).first()
    assert not mostly_good["retry"]


@pytest.mark.parametrize(
    "x, y, axes",
    [
        ("Manager", "salaire_brute", ["Manager", "Salaire_Brute"]),
        ("Manager", "Manager", ["Manager"]),
        ("Manager", None, ["Manager"]),
        ("Nope", "Manager", ["ID_Employe", "Salaire_Brute"]),
        (None, None, ["ID_Employe", "Salaire_Brute"]),
    ],
)
def test_axes(rows, spec_catalog, x, y, axes):
    roles, tables, columns = spec_catalog
    section = rows([(1, 1, 1, 1, "chart", "bar", "employees", x, y, "t")], SECTION)
    assert V.chart_axes(V.resolve_tables(section, roles, tables), columns).first()["axes"] == axes


def test_specs_without_axis_or_type_are_dropped(rows):
    data = [
        (1, 1, 1, 1, "chart", "line", "t", "x", None, "no y"), (1, 1, 1, 2, "chart", "bar", "t", "x", None, "bar"),
        (1, 1, 1, 3, "chart", None, "t", "x", "y", "no type"), (1, 1, 1, 4, "gauge", None, "t", None, None, "odd"),
        (1, 1, 1, 5, "chart", "radar", "t", "x", "y", "odd chart"),
    ]
    assert [r["title"] for r in V.valid_specs(rows(data, SECTION)).collect()] == ["bar"]


def test_charts_need_a_finding(rows):
    reports = rows([(1, 0, "kpi", "t", "c", "Pic en Janvier", 1)], REPORT)
    data = [
        (1, 1, 1, 1, "chart", "bar", "t", "x", "y", "Le pic en janvier 2024"), (1, 1, 1, 2, "chart", "bar", "t", "x", "y", "janvier"),
        (1, 1, 1, 3, "chart", "bar", "t", "x", "y", "Autre"), (1, 1, 1, 4, "form", None, "t", None, None, "Autre"),
        (2, 1, 1, 5, "chart", "bar", "t", "x", "y", "janvier"),
    ]
    kept = V.justified_specs(rows(data, SECTION), reports).collect()
    assert sorted(r["section_no"] for r in kept) == [1, 2, 4]


def test_report_rules(rows):
    data = [(1, i, "kpi", "t", "c", f"f{i}", 1 + i % 5) for i in range(9)] + [
        (1, 20, "guess", "t", "c", "bad", 1), (1, 21, "kpi", "t", "c", "bad", 9), (1, 22, None, "t", "c", "bad", 1),
    ]
    insights = rows(data, INSIGHT)
    found = I.report(insights).orderBy("idx").collect()
    assert [r["finding"] for r in found] == ["f0", "f5", "f1", "f6", "f2"]
    assert {r["seq"]: r["reason"] for r in I.rejects(insights).collect()} == {
        20: "unknown type", 21: "priority out of range", 22: "unknown type", **dict.fromkeys([3, 4, 7, 8], "report is full"),
    }
    digest = I.digest(I.report(insights)).first()["digest"]
    assert digest.split("\n")[0] == "- **t / c** : f0" and len(digest.split("\n")) == 5


def test_selection_falls_back_to_all(rows):
    reports = rows([(w, i, "kpi", "t", "c", "f", 1) for w in (1, 2) for i in range(3)], REPORT)
    kept = I.select_insights(reports, rows([(1, 2), (1, 2), (1, 9), (2, 9)], "workbook int, idx int")).collect()
    assert sorted((r["workbook"], r["idx"]) for r in kept) == [(1, 2), (2, 0), (2, 1), (2, 2)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 1000])
def test_quantiles_equal_the_exact_percentile(spark, n):
    df = spark.range(n).select((F.col("id") * 7919 % 1009).cast("double").alias("v"), (F.col("id") % 3).alias("g"))
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    exact = df.agg(F.percentile("v", F.array(*[F.lit(p) for p in probabilities]))).first()[0]
    found = {r["p"]: r["quantile"] for r in I.quantiles(df, "v", [], probabilities, accuracy=100).collect()}
    assert [found[p] for p in probabilities] == pytest.approx(exact)


def test_candidates_and_promotion(rows):
    columns = rows(
        [
            (1, "Employes", 0, "ID", False), (1, "Employes", 1, "Departement", False), (1, "Employes", 2, "Salaire", True),
            (1, "Absences", 0, "Date_Debut", False), (1, "Absences", 1, "Duree_Jours", True),
            (1, "Sites", 0, "Nom", False), (1, "Sites", 1, "Latitude", True), (1, "Sites", 2, "Longitude", True),
        ],
        "workbook int, table string, position int, column string, is_numeric boolean",
    )
    reports = rows(
        [(1, 0, "relation", "Employes", "Departement", "f0", 1), (1, 1, "trend", "Absences", "Date_Debut", "f1", 2)], REPORT
    )
    crosstabs = rows(
        [(1, 0, "Corr_Employes_Departement_Salaire", "Employes", "Departement", "Salaire")],
        "workbook int, position int, name string, source_table string, group_by string, metric string",
    )
    geo = K.geo_columns(columns, ["workbook"])
    place = geo.first()
    assert (place["name"], place["latitude"], place["longitude"]) == ("Nom", "Latitude", "Longitude")
    crossed = K.crosstab_candidates(crosstabs, reports)
    assert (crossed.first()["priority"], crossed.first()["confidence"]) == (0.95, 0.9)
    trend = K.trend_candidates(reports, columns).first()
    assert trend["source_columns"] == ["Date_Debut", "Duree_Jours"] and trend["priority"] == pytest.approx(0.88)
    every = crossed.unionByName(K.trend_candidates(reports, columns)).unionByName(K.geo_candidates(geo))
    best = K.promote(every, ["kind", "idx"]).first()
    assert best["kind"] in ("trend", "cross_tab") and best["premium_widget"] == "advanced_chart"


def test_the_narrative_wins_over_an_unmatched_summary(rows):
    reports = rows([(1, 0, "kpi", "Ventes", "Total", "f0", 3), (1, 1, "trend", "Ventes", "Jour", "f1", 5)], REPORT)
    crosstabs = rows(
        [(1, 0, "Corr_Sites_Ville_Prix", "Sites", "Ville", "Prix")],
        "workbook int, position int, name string, source_table string, group_by string, metric string",
    )
    columns = rows([(1, "Ventes", 0, "Total", True)], "workbook int, table string, position int, column string, is_numeric boolean")
    every = (
        K.crosstab_candidates(crosstabs, reports)
        .unionByName(K.trend_candidates(reports, columns))
        .unionByName(K.narrative_candidates(reports))
    )
    best = K.promote(every, ["kind", "idx"]).first()
    assert (best["kind"], best["source_table"], best["source_columns"]) == ("narrative", "Ventes", ["Total", "Jour"])
    assert best["score"] == pytest.approx(0.785)


def test_one_column_for_both_axes_is_no_map(rows):
    columns = rows([("T", 0, "latlong", True), ("T", 1, "Nom", False)], "table string, position int, column string, is_numeric boolean")
    assert K.geo_columns(columns).count() == 0


def test_promotion_tie_goes_to_the_later(rows):
    same = rows(
        [(1, i, "trend", "secondary_chart", 0.5, 0.5, "advanced_chart") for i in range(3)] + [(1, 9, "trend", "hero_chart", 1.0, 1.0, None)],
        "workbook int, idx int, kind string, presentation string, priority double, confidence double, premium_widget string",
    )
    assert K.promote(same).first()["idx"] == 2


def test_domain_needs_a_clear_majority(rows):
    tables = rows(
        [(1, "Employees"), (1, "Absences"), (1, "Other"), (2, "Tasks"), (2, "Grades"), (3, "Nothing")], "workbook int, table string"
    )
    tags = K.domain_tags(tables)
    found = {r["workbook"]: (r["domain"], r["confidence"]) for r in tags.collect()}
    assert found == {1: ("HR", 1.0), 2: ("GENERIC", 0.5), 3: ("GENERIC", 0.0)}
    fixed = K.override_domains(tags, rows([(2, "PROJECT"), (1, "HR")], "workbook int, domain string")).collect()
    assert {r["workbook"]: (r["domain"], r["overridden"]) for r in fixed}[2] == ("PROJECT", True)
    assert {r["workbook"]: r["overridden"] for r in fixed}[1] is False


def test_prefix_keys_match_anywhere_in_the_name(rows):
    columns = rows(
        [("Old_Clients", 0, "ID"), ("Orders", 0, "id_client"), ("Orders", 1, "ID_"), ("Clients", 0, "Nom")],
        "table string, position int, column string",
    )
    found = {(r["from_column"], r["to_table"], r["target_exists"]) for r in R.fk_by_prefix(columns).collect()}
    assert found == {
        ("id_client", "Old_Clients", True), ("id_client", "Clients", False),
    }  # ID_ alone refers to nothing


def test_derived_columns(workbook):
    plan = [
        D.RelatedCount("nb_absences", "Absences", "ID_Employe", "ID"), D.RelatedExists("absent", "Absences", "ID_Employe", "ID"),
        D.RelatedAverage("jours", "Absences", "ID_Employe", "ID", "Duree_Jours"), D.NullFlag("sans_nom", "Nom"),
        D.RelatedCount("x", "Absences", "Nope", "ID"),
    ]
    table, applied, failed = D.apply_plan(workbook["Employes"], workbook, plan)
    assert applied == ["nb_absences", "absent", "jours", "sans_nom"] and failed == ["x"]
    found = {r["ID"]: (r["nb_absences"], r["absent"], r["jours"]) for r in table.collect()}
    assert found == {1: (1, True, 3.0), 2: (1, True, 1.0), 3: (0, False, 0.0)}
    with pytest.raises(ValueError):
        D.apply_plan(workbook["Employes"], workbook, plan * 2)


def test_chart_guards(workbook):
    employees = workbook["Employes"]
    with pytest.raises(ValueError):
        G.chart_line(employees, "Nom", "Salaire", "sum")
    with pytest.raises(ValueError):
        G.chart_pie(employees, "Salaire", "ID", "count")
    with pytest.raises(ValueError):
        G.chart_data(employees, "Nom", "Salaire", "median")
    assert G.chart_pie(employees, "Departement", "Salaire", "sum").count() == 0
    assert G.chart_pie(employees, "Nom", "Salaire", "sum").agg(F.sum("share")).first()[0] == pytest.approx(1)


def test_quantiles_of_a_million_values_use_no_window(spark):
    df = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_000).cast("double").alias("v"))
    odd = spark.createDataFrame([(float("-inf"),), (-1e300,), (1e-300,), (1e300,), (float("inf"),)], "v double")
    found = {r["p"]: r["quantile"] for r in I.quantiles(df, "v", [], [0.25, 0.5]).collect()}
    assert found == {0.25: 249999.75, 0.5: 499999.5}
    assert I.quantiles(odd, "v", [], [0.5, 0.75], accuracy=100).orderBy("p").first()["quantile"] == 1e-300
    plan = I._narrowed(df, spark.createDataFrame([(1, 0.5, "below", 0, 0.0, 9.0)], "n bigint, p double, side string, rank bigint, low double, high double"), [])
    assert "Window" not in plan._jdf.queryExecution().toString()


def test_domain_from_column_words(rows):
    from sheetscope.operators import candidates

    sheets = {"hr": {"Employes": ["ID", "Nom", "Departement", "Salaire"], "Absences": ["ID_Employe", "Date_Debut", "Duree_Jours"]}, "none": {"A": ["b"]}, "two": {"Tickets": ["x"], "Tâches": ["y"]}, "camel": {"F1": ["dateEmbauche", None]}}
    data = [(w, t, c) for w, tables in sheets.items() for t, names in tables.items() for c in names] + [("null", None, None)]
    tags = candidates.column_domain_tags(rows(data, "workbook string, table string, column string"))
    found = {r["workbook"]: (r["domain"], r["confidence"]) for r in tags.collect()}
    assert found == {"hr": ("HR", 1.0), "none": ("GENERIC", 0.0), "two": ("GENERIC", 0.5), "camel": ("HR", 1.0), "null": ("GENERIC", 0.0)}


def test_report_and_rejects_hold_every_insight_once(rows):
    from collections import Counter

    from sheetscope.operators import insights

    data = [(w, i // 2, "trend" if i % 7 else "odd", "t", "c", f"f{i}", (i * 5) % 8) for w in (1, 2, None) for i in range(40 if w == 1 else 4)]
    df = rows(data, "workbook bigint, seq int, type string, table string, col string, finding string, priority int")
    kept = Counter(r["workbook"] for r in insights.report(df).collect())
    gone = insights.rejects(df).collect()
    assert Counter(r["workbook"] for r in gone) + kept == Counter(r[0] for r in data)
    assert {r["reason"] for r in gone} == {"unknown type", "priority out of range", "report is full"}
    worst = sorted((r[6], r[1]) for r in data if r[0] == 1 and r[2] == "trend" and 1 <= r[6] <= 5)[insights.REPORT_SIZE - 1]
    assert all((r["priority"], r["seq"]) >= worst for r in gone if r["workbook"] == 1 and r["reason"] == "report is full")
