"""Insights computed from the data: distribution, trend, outlier, relation, kpi.

The second half handles insight reports: at most five entries per workbook.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetscope.functions.numbers import filled, known, named, quoted
from sheetscope.operators.ordering import running_total
from sheetscope.session import cut_lineage

# The accepted insight types, priorities and report size.
INSIGHT_TYPES = ("distribution", "trend", "outlier", "relation", "kpi")
HIGHEST_PRIORITY, LOWEST_PRIORITY = 1, 5
REPORT_SIZE = 5
PERIODS = ("hour", "day", "week", "month", "quarter", "year")


def _column(df: DataFrame, name: str):
    return known(name, {f.name: f.dataType for f in df.schema.fields}[name])


def distribution(df: DataFrame, column: str) -> DataFrame:
    """``value, n, share, cumulative_share``, largest value first, ties by value.

    The values are counted and written out once, then their running share is taken
    slice by slice, whatever their number.
    """
    counts = cut_lineage(
        filled(df, column)
        .selectExpr(f"cast({quoted(column)} as string) as value")
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.lit(float(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    running = running_total(counts, [F.col("n").desc(), F.col("value")], "n", "_running")
    return running.select(
        "value", "n", (F.col("n") / total).alias("share"), (F.col("_running") / total).alias("cumulative_share")
    )


def period_start(df: DataFrame, moment: str, unit: str):
    """Start of the calendar period of a date, in the type of the column."""
    if unit not in PERIODS:
        raise ValueError(f"unit must be one of {PERIODS}")
    return F.date_trunc(unit, named(moment)).cast(df.schema[moment].dataType)


def trend(df: DataFrame, moment: str, measure: str, unit: str = "month") -> DataFrame:
    """Measure per period with its gap to the mean period and to the one before.

    The windows run over one row per period; the calendar bounds their number.
    """
    periods = (
        df.filter(named(moment).isNotNull())
        .groupBy(period_start(df, moment, unit).alias("period"))
        .agg(F.sum(_column(df, measure)).alias("total"))
    )
    order = W.partitionBy(F.lit(0)).orderBy("period")
    mean = F.avg("total").over(W.partitionBy(F.lit(0)))
    previous = F.lag("total").over(order)
    return periods.select(
        "period", "total", mean.alias("mean_total"),
        F.try_divide(F.col("total") - mean, mean).alias("gap_to_mean"),
        F.try_divide(F.col("total") - previous, previous).alias("change"),
    )


def sigma_outliers(df: DataFrame, measure: str, by: Sequence[str], k: float = 3.0) -> DataFrame:
    """Rows further than ``k`` standard deviations from the mean of their group.

    The limits are one row per group. They meet the rows in an ordinary join: Spark
    broadcasts them when they are small and splits a hot group when they are not.
    """
    value = _column(df, measure)
    limits = df.groupBy(*map(named, by)).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("spread"))
    if by:
        same = [named(name, "d").eqNullSafe(named(name, "l")) for name in by]
        joined = df.alias("d").join(limits.alias("l"), same).select("d.*", "mean", "spread")
    else:
        joined = df.withColumn("_limits", limits.select(F.struct("mean", "spread")).scalar()).select(
            *map(named, df.columns), "_limits.*"
        )
    return joined.filter(F.abs(named(measure) - F.col("mean")) > k * F.col("spread"))


#: Parts into which a quantile's bracket is cut in one round.
QUANTILE_BINS = 256


def quantiles(df: DataFrame, measure: str, by: Sequence[str], probabilities: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """Exact interpolated quantiles per group: ``by..., p, quantile``.

    The built-in exact percentile holds all values of a group in one task. Here each
    order statistic has a bracket of values, at first from a sketch. A round counts the
    rows below, inside and above it, cut into bins, and the bin that holds the wanted
    rank is the next bracket, until it holds one value. Rounds are sums that combine in
    the task; no values are put in order, whatever their number.
    """
    by = [quoted(name) for name in by]
    slack = 5.0 / accuracy
    grid = [min(max(p + d, 0.0), 1.0) for p in probabilities for d in (-slack, slack)]
    rows = filled(df, measure).select(*by, F.expr(f"cast({quoted(measure)} as double) as v"))
    sketch = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", grid, accuracy).alias("grid"))
    targets = []
    for i, p in enumerate(probabilities):
        place = F.lit(float(p)) * (F.col("n") - 1)
        for side, rank in (("below", F.floor(place)), ("above", F.ceil(place))):
            bounds = F.element_at("grid", 2 * i + 1).alias("low"), F.element_at("grid", 2 * i + 2).alias("high")
            targets.append(F.struct(F.lit(float(p)).alias("p"), F.lit(side).alias("side"), rank.alias("rank"), *bounds))
    brackets = cut_lineage(sketch.filter("n > 0").select(*by, "n", F.lit(False).alias("found"), F.inline(F.array(*targets))))
    while not (left := brackets.filter("not found")).isEmpty():
        brackets = cut_lineage(brackets.filter("found").unionByName(_narrowed(rows, left, by)))
    value = lambda side: F.max(F.when(F.col("side") == side, F.col("low")))
    fraction = F.col("p") * (F.col("n") - 1) - F.floor(F.col("p") * (F.col("n") - 1))
    return (
        brackets.groupBy(*by, "n", "p")
        .agg(value("below").alias("below"), value("above").alias("above"))
        .select(*by, "p", (F.col("below") + (F.col("above") - F.col("below")) * fraction).alias("quantile"))
    )


def _narrowed(rows: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    """Brackets after one more round. The ends of a bracket are bins of their own, so it shrinks."""
    entry = F.struct("n", "p", "side", "rank", "low", "high")
    wanted = brackets.groupBy(*by).agg(F.collect_list(entry).alias("targets"))
    if by:
        same = [F.col(f"r.{name}").eqNullSafe(F.col(f"b.{name}")) for name in by]
        met = rows.alias("r").join(wanted.alias("b"), same).select("r.*", "b.targets")
    else:
        met = rows.withColumn("targets", wanted.select("targets").scalar())
    v, low, high = F.col("v"), F.col("low"), F.col("high")
    share = F.nanvl((v / 2 - low / 2) / (high / 2 - low / 2), F.lit(0.0))
    inner = F.lit(2) + F.least(F.floor(share * QUANTILE_BINS), F.lit(QUANTILE_BINS - 1)).cast("int")
    place = F.when(v < low, 0).when(v == low, 1).when(v < high, inner).when(v == high, QUANTILE_BINS + 2).otherwise(QUANTILE_BINS + 3)
    keys = [*by, "n", "p", "side", "rank"]
    counted = (
        met.select(*by, "v", F.inline("targets"))
        .groupBy(*keys, place.alias("bin"))
        .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
    )
    # A target has as many rows here as there are bins.
    bins = F.array_sort(F.collect_list(F.struct("bin", "c", "low", "high")))
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), none.alias("low"), none.alias("high"))

    def step(state, own):
        upto = state["seen"] + own["c"]
        holds = (state["seen"] <= F.col("rank")) & (F.col("rank") < upto)
        kept = [F.when(holds, own[end]).otherwise(state[end]).alias(end) for end in ("low", "high")]
        return F.struct(upto.alias("seen"), *kept)

    picked = counted.groupBy(*keys).agg(bins.alias("bins")).withColumn("best", F.aggregate("bins", start, step))
    return picked.select(*by, "n", (F.col("best.low") == F.col("best.high")).alias("found"), "p", "side", "rank", "best.low", "best.high")


def fence_outliers(df: DataFrame, measure: str, by: Sequence[str], k: float = 1.5) -> DataFrame:
    """Per group: quartiles, fences, and how many rows lie outside them."""
    value = _column(df, measure)
    quartiles = quantiles(df, measure, by, [0.25, 0.75])
    by = [quoted(name) for name in by]
    fences = (
        quartiles
        .groupBy(*by)
        .agg(
            F.max(F.when(F.col("p") == 0.25, F.col("quantile"))).alias("q1"),
            F.max(F.when(F.col("p") == 0.75, F.col("quantile"))).alias("q3"),
        )
        .select(
            *by, "q1", "q3",
            (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lower_fence"),
            (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("upper_fence"),
        )
    )
    limits = ["q1", "q3", "lower_fence", "upper_fence"]
    rows = df.select(*by, value.alias("_v"))
    if by:
        same = [F.col(f"d.{name}").eqNullSafe(F.col(f"f.{name}")) for name in by]
        met = rows.alias("d").join(fences.alias("f"), same).select("d.*", *limits)
    else:
        met = rows.withColumn("_f", fences.select(F.struct(*limits)).scalar()).select("_v", "_f.*")
    outside = (F.col("_v") < F.col("lower_fence")) | (F.col("_v") > F.col("upper_fence"))
    return met.groupBy(*by, *limits).agg(F.count("_v").alias("n"), F.count_if(outside).alias("n_outliers"))


def correlation(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson correlation of pairs of measures, in one aggregate."""
    found = df.agg(*[F.corr(_column(df, a), _column(df, b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = [
        F.struct(F.lit(a).alias("left_col"), F.lit(b).alias("right_col"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ]
    return found.select(F.inline(F.array(*rows)))


def group_gap(df: DataFrame, category: str, measure: str) -> DataFrame:
    """Distance between the highest and the lowest group mean, and which they are."""
    means = (
        filled(df, category, measure)
        .selectExpr(f"cast({quoted(category)} as string) as grp", f"{quoted(measure)} as v")
        .groupBy("grp")
        .agg(F.avg("v").alias("mean"))
    )
    ends = means.agg(
        F.max(F.struct(F.col("mean"), F.col("grp"))).alias("top"), F.min(F.struct(F.col("mean"), F.col("grp"))).alias("low")
    )
    return ends.select(
        F.col("top.grp").alias("highest"), F.col("top.mean").alias("highest_mean"),
        F.col("low.grp").alias("lowest"), F.col("low.mean").alias("lowest_mean"),
        (F.col("top.mean") - F.col("low.mean")).alias("gap"),
    )


def kpis(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Headline figures of each measure, in one aggregate."""
    aggregates, rows = [], []
    for i, name in enumerate(measures):
        col = _column(df, name).cast("double")
        aggregates += [
            F.count(col).alias(f"n{i}"), F.sum(col).alias(f"s{i}"), F.avg(col).alias(f"a{i}"),
            F.min(col).alias(f"lo{i}"), F.max(col).alias(f"hi{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(name).alias("measure"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("total"),
                F.col(f"a{i}").alias("mean"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def valid_insight():
    """Known type, and a priority from 1 to 5."""
    return F.coalesce(
        F.col("type").isin(*INSIGHT_TYPES) & F.col("priority").between(HIGHEST_PRIORITY, LOWEST_PRIORITY), F.lit(False)
    )


def report(insights: DataFrame, size: int = REPORT_SIZE) -> DataFrame:
    """The report of each workbook: its best valid insights, numbered from 0.

    ``insights`` has ``workbook, seq, type, table, col, finding, priority``. Each
    task keeps ``size`` rows per workbook before the shuffle.
    """
    best = W.partitionBy("workbook").orderBy("priority", "seq")
    return (
        insights.filter(valid_insight())
        .withColumn("_rank", F.row_number().over(best))
        .filter(F.col("_rank") <= size)
        .select("workbook", (F.col("_rank") - 1).alias("idx"), "type", "table", "col", "finding", "priority")
    )


def rejects(insights: DataFrame, size: int = REPORT_SIZE) -> DataFrame:
    """Insights that are not in the report, with the reason.

    Every insight is in the report or here. The report's last entry of each workbook is
    found first, each task keeping ``size`` rows; what comes after it is surplus, told by
    a join, so that no task holds all insights of a workbook. Insights that tie with the
    last entry are numbered among themselves.
    """
    reason = F.when(~F.coalesce(F.col("type").isin(*INSIGHT_TYPES), F.lit(False)), "unknown type").when(
        ~valid_insight(), "priority out of range"
    )
    invalid = insights.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    valid = insights.filter(valid_insight())
    place = F.struct("priority", "seq")
    best = W.partitionBy("workbook").orderBy("priority", "seq")
    kept = valid.select("workbook", place.alias("_last"), F.row_number().over(best).alias("_rank")).filter(F.col("_rank") <= size)
    # At most ``size`` rows a workbook.
    lasts = kept.groupBy("workbook", "_last").agg(F.count(F.lit(1)).alias("_ties"))
    ends = lasts.groupBy("workbook").agg(F.max(F.struct("_last", "_ties")).alias("_end")).select(F.col("workbook").alias("_workbook"), "_end.*")
    met = valid.join(ends, F.col("workbook").eqNullSafe(F.col("_workbook"))).withColumn("_place", place)
    beyond = met.filter(F.col("_place") > F.col("_last"))
    tied = met.filter(F.col("_place") == F.col("_last"))
    among = W.partitionBy("workbook", "priority", "seq").orderBy("type")
    surplus = beyond.unionByName(tied.withColumn("_n", F.row_number().over(among)).filter(F.col("_n") > F.col("_ties")).drop("_n"))
    return invalid.unionByName(surplus.select(*map(named, insights.columns), F.lit("report is full").alias("reason")))


def reports_by_workbook(reports: DataFrame) -> DataFrame:
    """One row per workbook with its report as an array, ordered by index.

    A report has at most ``REPORT_SIZE`` entries, so the array is short; an entry
    numbered beyond that is an error.
    """
    entry = F.struct("idx", "type", "table", "col", "finding", "priority")
    whole = F.when(F.col("idx") < REPORT_SIZE, F.col("idx")).otherwise(F.raise_error("not a report"))
    return reports.withColumn("idx", whole.cast(reports.schema["idx"].dataType)).groupBy("workbook").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def select_insights(reports: DataFrame, selection: DataFrame) -> DataFrame:
    """Keep the chosen indices of each workbook.

    Indices outside the report are ignored; a workbook left with none keeps all.
    """
    wanted = selection.select("workbook", "idx").distinct().withColumn("_chosen", F.lit(True))
    marked = reports.join(wanted, ["workbook", "idx"], "left")
    per_workbook = W.partitionBy("workbook")
    return (
        marked.withColumn("_any", F.bool_or(F.col("_chosen").isNotNull()).over(per_workbook))
        .filter(F.col("_chosen").isNotNull() | ~F.col("_any"))
        .drop("_chosen", "_any")
    )


def digest(reports: DataFrame) -> DataFrame:
    """One bullet per insight of a workbook, best priority first."""
    line = F.concat(F.lit("- **"), "table", F.lit(" / "), "col", F.lit("** : "), "finding")
    ordered = F.array_sort(F.collect_list(F.struct("priority", "idx", line.alias("line"))))
    return reports.groupBy("workbook").agg(
        F.array_join(F.transform(ordered, lambda e: e["line"]), "\n").alias("digest")
    )
