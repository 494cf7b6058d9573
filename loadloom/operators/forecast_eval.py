"""Forecast evaluation: metrics, slices, conformal intervals and coverage alerts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadloom.config import DEFAULT
from loadloom.functions import aggregates as A
from loadloom.operators import gram as G
from loadloom.operators.ranks import order_statistic
from loadloom.sources.stage import stage


def long_predictions(df: DataFrame, models: Sequence[str], keep: Sequence[str], y="y") -> DataFrame:
    """Wide predictions to one row per (row, model)."""
    return df.unpivot([*keep, y], [F.col(m).cast("double").alias(m) for m in models], "model", "pred")


def point_metrics(df: DataFrame, by: Sequence[str] = ("model",), y="y", p="pred", price=DEFAULT.price_eur_mwh) -> DataFrame:
    return df.groupBy(*by).agg(
        A.n_pairs(y, p).alias("n"), A.mae(y, p).alias("mae"), A.rmse(y, p).alias("rmse"), A.mape(y, p).alias("mape"),
        A.smape(y, p).alias("smape"), A.wape(y, p).alias("wape"), A.cost(y, p, price).alias("cost"),
        A.cost_per_mwh(y, p, price).alias("cost_per_mwh"))


def seasonal_scale(train: DataFrame, y="y", date="date", m=1, key: Sequence[str] = ()) -> DataFrame:
    """Mean absolute m-step difference of the training series (the MASE denominator)."""
    w = Window.partitionBy(*key).orderBy(date)
    d = train.withColumn("_d", F.abs(F.col(y) - F.lag(y, m).over(w)))
    return d.groupBy(*key).agg(F.avg("_d").alias("scale"))


def add_mase(metrics: DataFrame, scale: DataFrame) -> DataFrame:
    """MASE against a one-row seasonal scale."""
    return metrics.crossJoin(F.broadcast(scale)).withColumn("mase", F.expr("IF(scale > 0, mae / scale, NULL)")).drop("scale")


def relative_mae(df: DataFrame, base: str, by: Sequence[str] = ("model",), y="y", p="pred") -> DataFrame:
    """MAE of each model over the MAE of a base prediction on the same rows."""
    both = df.where(F.col(y).isNotNull() & F.col(p).isNotNull() & F.col(base).isNotNull())
    return both.groupBy(*by).agg(A.mae(y, p).alias("mae"), A.mae(y, base).alias("base_mae")).withColumn(
        "relative_mae", F.expr("try_divide(mae, base_mae)"))


def interval_metrics(df: DataFrame, by: Sequence[str] = (), y="y", lo="lo", hi="hi", alpha=DEFAULT.alpha) -> DataFrame:
    return df.groupBy(*by).agg(
        F.expr(f"count_if({y} IS NOT NULL AND {lo} IS NOT NULL AND {hi} IS NOT NULL) AS n"),
        A.coverage(y, lo, hi).alias("coverage"), A.mean_width(lo, hi).alias("width"), A.winkler(y, lo, hi, alpha).alias("winkler"),
        A.pinball(y, lo, alpha / 2).alias("pinball_lo"), A.pinball(y, hi, 1 - alpha / 2).alias("pinball_hi"))


SEASON_SQL = """CASE WHEN month({d}) IN (12, 1, 2) THEN 'winter' WHEN month({d}) IN (3, 4, 5) THEN 'spring'
    WHEN month({d}) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END"""


def slice_keys(date="date", extra: dict[str, str] | None = None) -> dict[str, str]:
    """SQL text of the standard slices of a dated row."""
    keys = {"overall": "'all'", "month": f"date_format({date}, 'yyyy-MM')", "is_weekend": f"string(weekday({date}) >= 5)",
            "dow": f"string(weekday({date}) + 1)", "season": SEASON_SQL.format(d=date),
            "season_dow": f"concat({SEASON_SQL.format(d=date)}, '-', weekday({date}) + 1)"}
    return {**keys, **(extra or {})}


def by_slices(df: DataFrame, slices: dict[str, str]) -> DataFrame:
    """One row per (row, slice): every slice is then a plain grouping of one scan."""
    cells = ", ".join(f"named_struct('slice_type', '{n}', 'slice_value', {e})" for n, e in slices.items())
    return df.selectExpr("*", f"inline(array({cells}))").where("slice_value IS NOT NULL")


def error_slices(df: DataFrame, slices: dict[str, str] | None = None, y="y", p="pred") -> DataFrame:
    """Point metrics per model and slice."""
    return point_metrics(by_slices(df, slices or slice_keys()), ["model", "slice_type", "slice_value"], y, p).drop("cost", "cost_per_mwh")


def interval_slices(df: DataFrame, slices: dict[str, str] | None = None, **kw) -> DataFrame:
    return interval_metrics(by_slices(df, slices or slice_keys()), ["slice_type", "slice_value"], **kw)


def conformal(df: DataFrame, resid: str, by: Sequence[str] = (), alpha=DEFAULT.alpha, finite=True, out="q") -> DataFrame:
    """Split-conformal quantile of absolute residuals per group.

    ``finite`` takes the ceil((n + 1)(1 - alpha))-th smallest (capped at the
    largest); otherwise the plain inverse-distribution quantile.
    """
    size = "(total + 1)" if finite else "total"
    # The tolerance keeps exact products such as 10 * 0.9 from rounding up.
    rank = f"ceil({size} * {1 - alpha!r}D - 1e-9D)"
    return order_statistic(df, resid, rank, out, by)


def add_interval(df: DataFrame, pred="pred", q="q", floor_zero=True) -> DataFrame:
    lo = f"greatest(0D, {pred} - {q})" if floor_zero else f"{pred} - {q}"
    return df.selectExpr("*", f"CASE WHEN {pred} IS NOT NULL AND {q} IS NOT NULL THEN {lo} END AS lo", f"{pred} + {q} AS hi")


def safety_factor(df: DataFrame, resid: str, q: str, by: Sequence[str] = (), target=1 - DEFAULT.alpha, min_factor=1.5,
                  max_factor=2.5, step=0.05) -> DataFrame:
    """Smallest factor of a grid whose widened interval covers the calibration rows, floored.

    All grid points are counted in the same aggregate, without multiplying rows.
    """
    n = int(round((max_factor - 1) / step)) + 1
    grid = [round(1 + step * i, 10) for i in range(n)]
    cov = ", ".join(f"named_struct('f', {f!r}D, 'c', avg(int({resid} <= {q} * {f!r}D)))" for f in grid)
    first = f"array_min(transform(filter(_g, x -> x.c >= {target!r}D), x -> x.f))"
    return df.groupBy(*by).agg(F.expr(f"array({cov}) AS _g"), F.count(resid).alias("n_calibration")).selectExpr(
        *by, "n_calibration", f"greatest({min_factor!r}D, coalesce({first}, {max_factor!r}D)) AS safety_factor")


def calibrate(df: DataFrame, resid: str, by: Sequence[str], alpha=DEFAULT.alpha, min_factor=1.5) -> DataFrame:
    """Conformal quantile times its safety factor per group."""
    q = stage(conformal(df, resid, by, alpha, out="qhat_raw").drop("n"))  # one row per group, used twice
    joined = df.join(F.broadcast(q), list(by))
    f = safety_factor(joined, resid, "qhat_raw", by, 1 - alpha, min_factor)
    return q.join(f, list(by)).selectExpr(*by, "n_calibration", "qhat_raw", "safety_factor", "qhat_raw * safety_factor AS qhat")


def mondrian(cal: DataFrame, test: DataFrame, resid: str, group: str, sub: str, min_n=60, alpha=DEFAULT.alpha) -> DataFrame:
    """Group-conditional width: the larger of the group's and the (group, sub-group)'s, where the latter has enough rows."""
    wide = calibrate(cal, resid, [group], alpha).selectExpr(group, "qhat AS _qg")
    fine = calibrate(cal, resid, [group, sub], alpha).where(F.col("n_calibration") >= min_n).selectExpr(group, sub, "qhat AS _qs")
    return (test.join(F.broadcast(wide), group, "left").join(F.broadcast(fine), [group, sub], "left")
            .withColumn("q", F.expr("greatest(_qg, _qs)")).drop("_qg", "_qs"))


def coverage_alerts(df: DataFrame, group="cluster", date="date", min_cov=DEFAULT.min_coverage, **kw) -> DataFrame:
    """Groups, seasons and months whose coverage falls short."""
    slices = {"group": "'all'", "season": SEASON_SQL.format(d=date), "month": f"date_format({date}, 'yyyy-MM')"}
    m = interval_metrics(by_slices(df, slices), [group, "slice_type", "slice_value"], **kw)
    level = "CASE slice_type WHEN 'group' THEN 'group' WHEN 'season' THEN 'group_season' ELSE 'diagnostic_month' END"
    return m.where(F.col("coverage") < min_cov).withColumn("alert_level", F.expr(level))


def segment_review(df: DataFrame, date="date", y="y", p="pred", n="n_users", min_cov=DEFAULT.min_coverage) -> DataFrame:
    """Special segment: per-user level, variability, error and coverage, overall and by season."""
    d = df.withColumn("_u", F.expr(f"try_divide({y}, {n})"))
    s = by_slices(d, {"overall": "'all'", "season": SEASON_SQL.format(d=date)})
    g = s.groupBy("slice_type", "slice_value").agg(
        F.count(F.lit(1)).alias("n_days"), F.avg("_u").alias("mean_user"), F.stddev_samp("_u").alias("sd_user"),
        A.mae(y, p).alias("mae"), A.rmse(y, p).alias("rmse"), A.wape(y, p).alias("wape"), A.coverage(y, "lo", "hi").alias("coverage"),
        A.mean_width("lo", "hi").alias("width"))
    base = g.where("slice_type = 'overall'").selectExpr("mean_user AS _m")
    return g.crossJoin(F.broadcast(base)).selectExpr(
        "slice_type", "slice_value", "n_days", "mean_user", "sd_user", "try_divide(sd_user, mean_user) AS cv_user", "mae", "rmse", "wape",
        "coverage", "width", "try_divide(mean_user, _m) AS index_vs_overall",
        "coalesce(coverage < 90 OR try_divide(sd_user, mean_user) >= 0.15, false) AS needs_treatment",
        f"""CASE WHEN slice_value = 'summer' AND coverage < {min_cov} THEN 'summer under-coverage'
            WHEN slice_type = 'overall' AND coverage < 90 THEN 'below overall target'
            WHEN try_divide(sd_user, mean_user) >= 0.15 THEN 'high variability' ELSE 'monitor' END AS review""")


def leaderboard(boards: dict[str, DataFrame]) -> DataFrame:
    """Metric tables of several targets stacked and ordered."""
    out = None
    for target, df in boards.items():
        t = df.withColumn("target", F.lit(target))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out.orderBy("target", "wape", "model")


def ablation(metrics: DataFrame, mode_col="mode", base="operational", metric="wape", by: Sequence[str] = ("model",)) -> DataFrame:
    """Change of a metric in each mode against the base mode."""
    b = metrics.where(F.col(mode_col) == base).select(*by, F.col(metric).alias("_b"))
    return metrics.join(F.broadcast(b), list(by), "left").withColumn("delta", F.col(metric) - F.col("_b")).drop("_b")


def _extreme(df: DataFrame, finding: str, subject: str, value: str, largest=False) -> DataFrame:
    """The row with the least (or largest) value, ties by subject; none where there is no value."""
    rows = df.selectExpr(f"'{finding}' AS finding", f"string({subject}) AS subject", f"double({value}) AS value").where("value IS NOT NULL")
    key = F.round("value", 9)
    return rows.orderBy(key.desc() if largest else key, "subject").limit(1)


def evidence(metrics: DataFrame, intervals: DataFrame, reconciled: DataFrame | None = None, scope: DataFrame | None = None,
             special: DataFrame | None = None, metric="wape") -> DataFrame:
    """Headline rows (finding, subject, value) of a forecasting run, one per table that is given.

    Best and worst model, the slice with the least coverage, the best reconciled forecast, the share of the energy that
    clusters cover per period, and the season in which the special segment is covered worst.
    """
    out = [_extreme(metrics, "best_model", "model", metric), _extreme(metrics, "worst_model", "model", metric, largest=True),
           _extreme(intervals, "worst_coverage", "concat(slice_type, '=', slice_value)", "coverage")]
    if reconciled is not None:
        out.append(_extreme(reconciled, "best_reconciliation", "model", metric))
    if scope is not None:
        out.append(scope.selectExpr("'clustered_energy_pct' AS finding", "period AS subject", "pct_kwh AS value"))
    if special is not None:
        out.append(_extreme(special.where("slice_type = 'season'"), "special_segment_coverage", "slice_value", "coverage"))
    return reduce(DataFrame.unionByName, out)


def ablation_evidence(metrics: DataFrame, metric="wape", mode_col="mode") -> DataFrame:
    """Two rows per learner: what leaving the weather out adds to the error, and what knowing only past weather adds."""
    modes = {m: F.max(F.when(F.col(mode_col) == m, F.col(metric))).alias(m) for m in ("none", "operational", "ex_post")}
    return metrics.groupBy("model").agg(*modes.values()).selectExpr(
        "inline(array(named_struct('finding', 'weather_ablation', 'subject', model, 'value', none - ex_post), "
        "named_struct('finding', 'operational_weather_cost', 'subject', model, 'value', operational - ex_post)))")


def residual_series(df: DataFrame, models: Sequence[str], keep: Sequence[str], y="y") -> DataFrame:
    """(keep, model, residual): actual minus predicted value of every row and model; null where either is."""
    return long_predictions(df, models, keep, y).select(*keep, "model", (F.col(y) - F.col("pred")).alias("residual"))


def time_slice(df: DataFrame, models: Sequence[str], time: str, start: str, days=7, y="y") -> DataFrame:
    """Actual and predicted values of the ``days`` from ``start`` on, one row per time and series."""
    begin = F.lit(start).cast("timestamp_ntz")
    at = F.col(time).cast("timestamp_ntz")
    part = df.where((at >= begin) & (at < begin + F.make_dt_interval(F.lit(days))))
    return part.unpivot([time], [F.col(y).cast("double").alias("actual"), *[F.col(m).cast("double").alias(m) for m in models]], "series", "value")


def calibration_assessment(intervals: DataFrame, calibration: DataFrame, alerts: DataFrame, group="cluster", special=0, rule_factor=1.5,
                           target=90.0) -> DataFrame:
    """One row per group: test error and coverage, its calibration, its alerts, and whether it needs a calibration of its own.

    ``intervals`` are the test rows with y, pred, lo and hi; ``calibration`` has safety_factor and qhat per group; ``alerts`` are
    rows of ``coverage_alerts``. Only the ``special`` group can need its own calibration: when it uses at least the rule's
    factor, is covered below ``target`` or has an alert above the level of months.
    """
    m = intervals.groupBy(group).agg(F.count(F.lit(1)).alias("n_test"), A.wape("y", "pred").alias("wape"), A.coverage("y", "lo", "hi").alias("coverage_test"))
    a = alerts.groupBy(group).agg(F.count(F.lit(1)).alias("n_alerts"), F.bool_or(F.col("alert_level") != "diagnostic_month").alias("has_group_alert"),
                                  F.min("coverage").alias("worst_coverage"))
    j = (m.join(F.broadcast(calibration.select(group, "safety_factor", "qhat")), group, "left").join(F.broadcast(a), group, "left")
         .fillna({"n_alerts": 0, "has_group_alert": False}))
    low = f"coalesce(coverage_test < {float(target)!r}D, false)"
    j = j.withColumn("needs_calibration", F.expr(f"coalesce({group} = {special}, false) AND (coalesce(safety_factor >= {float(rule_factor)!r}D, false) OR {low} OR has_group_alert)"))
    return j.withColumn("recommendation", F.expr(f"""CASE WHEN needs_calibration THEN 'own calibration' WHEN {group} = {special} THEN 'own monitoring'
        WHEN {low} THEN 'standard with follow-up' ELSE 'standard' END"""))


def rolling_refit(df: DataFrame, date: str, y: str, features: Sequence[str], cutoffs: Sequence[str], horizon=DEFAULT.cv_horizon, calibration_days=90, alpha=0.10,
                  penalty: float = 0.0) -> DataFrame:
    """(fold, date, y, pred, lo, hi) of a linear model refitted at every cutoff, with an interval from the days before it.

    Days are dealt to segments by a range join with the fit points (each cutoff, and ``calibration_days`` before it); a fit is the
    running sum of the segments' Gram matrices, so all refits share one pass over the rows. A fold's
    model up to its calibration window predicts that window; the finite-sample quantile of its absolute errors is the half width.
    The model up to the cutoff predicts the next ``horizon`` days. Rows with nulls in features or target take no part.
    """
    spark = df.sparkSession
    folds = spark.createDataFrame([(i + 1, c) for i, c in enumerate(cutoffs)], "fold int, cut string").selectExpr("fold", "to_date(cut) AS cut")
    ends = folds.select("cut").union(folds.select(F.date_sub("cut", calibration_days))).distinct()
    points = F.broadcast(ends.agg(F.array_sort(F.collect_set("cut")).alias("_ends")))
    rows = stage(df.dropna(subset=[*features, y]).crossJoin(points)
                 .withColumn("segment", F.expr(f"get(filter(_ends, e -> e >= {date}), 0)")).drop("_ends"))
    grams = G.gram(rows.where("segment IS NOT NULL"), ["segment"], features, y)
    # A fit point without rows of its own takes the model of the one before.
    padded = ends.select(F.col("cut").alias("segment")).join(grams, "segment", "left")
    zero = F.array_repeat(F.lit(0.0), (len(features) + 2) * (len(features) + 3) // 2)
    padded = padded.select("segment", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("moments", zero).alias("moments"))
    models = G.fit_all(G.running(padded, [], "segment").where("n > 0"), ["segment"], len(features), penalty).select("segment", "coefficients")

    def window(at, low, high):
        part = folds.join(models, F.col("segment") == at).select("fold", "cut", "coefficients")
        return rows.drop("segment").join(F.broadcast(part), (F.col(date) > low) & (F.col(date) <= high)).withColumn("pred", G.predicted(features))

    before = window(F.date_sub("cut", calibration_days), F.date_sub("cut", calibration_days), F.col("cut"))
    width = conformal(before.withColumn("resid", F.abs(F.col(y) - F.col("pred"))), "resid", ["fold"], alpha, out="_q").select("fold", "_q")
    after = window(F.col("cut"), F.col("cut"), F.date_add("cut", horizon))
    return add_interval(after.join(F.broadcast(width), "fold"), "pred", "_q").select("fold", date, y, "pred", "lo", "hi")
