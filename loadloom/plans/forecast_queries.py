"""Series features, forecasts, evaluation, intervals and reconciliation."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from loadloom.functions import aggregates as A, columns as C
from loadloom.operators import boosting, forecast_eval as E, gram, learners, reconcile, series
from loadloom.plans import roles as R
from loadloom.plans.registry import query
from loadloom.plans.roles_sql import ROLES
from loadloom.sources.stage import stage

MODELS = ("naive", "weekly", "rolling")
VAL, TEST = "year(date) = 2000", "year(date) = 2001"

ROLES["r_long"] = """SELECT date, y, 'naive' AS model, naive AS pred FROM r_forecast UNION ALL SELECT date, y, 'weekly', weekly FROM r_forecast
    UNION ALL SELECT date, y, 'rolling', rolling FROM r_forecast"""


def _round(df, digits=8):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def long_forecast(spark, sf, p=None):
    return E.long_predictions(R.forecast(spark, sf, p), MODELS, ["date"])


def written_series(spark, sf):
    """(user-days, portfolio series, cluster series), each written once: a query with many parts rolls the readings up only here."""
    days = stage(R.daily(spark, sf).select("user_id", "date", "daily_kwh", "hours_recorded"))
    return days, stage(R.portfolio(spark, sf, days)), stage(R.cluster_daily(spark, sf, days))


_LAGS = (1, 2, 7, 14, 28, 365)


def _lag_sql(src, part=""):
    w = f"({part} ORDER BY date)"
    cols = [f"lag(y, {k}) OVER {w} AS lag{k}" for k in _LAGS]
    for n in (7, 14, 28):
        f = f"({part} ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        cols.append(f"round(CASE WHEN count(y) OVER {f} = {n} THEN avg(y) OVER {f} END, 8) AS roll{n}")
    for n in (7, 28):
        f = f"({part} ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        cols.append(f"round(CASE WHEN count(y) OVER {f} = {n} THEN stddev_samp(y) OVER {f} END, 6) AS roll{n}_sd")
    return ", ".join(cols) + f" FROM {src}"


@query("series_lags", "E11 E12", "SELECT date, y, " + _lag_sql("r_portfolio"))
def series_lags(spark, sf):
    p = series.add_lags(R.portfolio(spark, sf).select("date", "y"), "y", "date", lags=_LAGS, means=(7, 14, 28), sds=(7, 28))
    return p.withColumns({**{f"roll{n}": F.round(f"roll{n}", 8) for n in (7, 14, 28)}, **{f"roll{n}_sd": F.round(f"roll{n}_sd", 6) for n in (7, 28)}})


@query("cluster_lags", "E11 E12", "SELECT date, cluster, y, " + _lag_sql("r_cluster_daily", "PARTITION BY cluster"))
def cluster_lags(spark, sf):
    p = series.add_lags(R.cluster_daily(spark, sf).select("date", "cluster", "y"), "y", "date", ["cluster"], lags=_LAGS, means=(7, 14, 28), sds=(7, 28))
    return p.withColumns({**{f"roll{n}": F.round(f"roll{n}", 8) for n in (7, 14, 28)}, **{f"roll{n}_sd": F.round(f"roll{n}_sd", 6) for n in (7, 28)}})


@query("hourly_lags", "E11 E12 B20", """
    WITH h AS (SELECT date_trunc('hour', ts) AS datetime, sum(kwh) AS y FROM r_readings WHERE kwh >= 0 GROUP BY 1)
    SELECT datetime, y, """ + ", ".join(f"lag(y, {k}) OVER (ORDER BY datetime) AS lag{k}" for k in (1, 24, 48, 168, 336)) + """,
      round(CASE WHEN count(y) OVER f24 = 24 THEN avg(y) OVER f24 END, 8) AS roll24, round(CASE WHEN count(y) OVER f168 = 168 THEN avg(y) OVER f168 END, 8) AS roll168,
      round(sin(2 * pi() * hour(datetime) / 24), 8) AS sin_h, round(cos(2 * pi() * hour(datetime) / 24), 8) AS cos_h
    FROM h WINDOW f24 AS (ORDER BY datetime ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), f168 AS (ORDER BY datetime ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)""")
def hourly_lags(spark, sf):
    h = (R.readings(spark, sf).where("kwh >= 0").groupBy(C.hour_start("ts").alias("datetime"))
         .agg(F.sum("kwh").alias("y")))
    p = series.add_lags(h, "y", "datetime", lags=(1, 24, 48, 168, 336), means=(24, 168))
    s, c = C.cyclic(F.hour("datetime"), 24)
    return _round(p.withColumns({"sin_h": s, "cos_h": c}))


@query("series_differences", "E13", """SELECT date, y, lag(y, 1) OVER w - lag(y, 2) OVER w AS diff_1, lag(y, 1) OVER w - lag(y, 8) OVER w AS diff_7,
    lag(y, 1) OVER w - lag(y, 366) OVER w AS yoy_diff FROM r_portfolio WINDOW w AS (ORDER BY date)""")
def series_differences(spark, sf):
    return series.add_differences(R.portfolio(spark, sf).select("date", "y"), "y", "date")


@query("past_weather", "E14", """
    WITH p AS (SELECT date, avg(tmean) AS tmean FROM r_panel GROUP BY date)
    SELECT date, round(lag(tmean) OVER (ORDER BY date), 8) AS tmean_lag1,
      round(CASE WHEN count(tmean) OVER f = 7 THEN avg(tmean) OVER f END, 8) AS tmean_roll7,
      round(avg(tmean) OVER (PARTITION BY month(date) ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 8) AS tmean_month_normal
    FROM p WINDOW f AS (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""")
def past_weather(spark, sf):
    p = R.panel(spark, sf).groupBy("date").agg(F.avg("tmean").alias("tmean"))
    return _round(series.add_past_weather(p, ["tmean"], "date").drop("tmean"))


@query("year_ago_join", "C11 J5", """SELECT a.date, a.y, b.y AS year_ago FROM r_portfolio a LEFT JOIN r_portfolio b ON a.date = b.date + 365""")
def year_ago_join(spark, sf):
    return series.shifted_join(R.portfolio(spark, sf).select("date", "y"), "y", "date", 365, "year_ago")


@query("tail_trim", "E19", """
    WITH c AS (SELECT date, CASE WHEN date > (SELECT max(date) - 10 FROM r_portfolio) THEN y * 0.1 ELSE y END AS y FROM r_portfolio),
    m AS (SELECT date, y, coalesce(y < 0.35 * CASE WHEN count(y) OVER f = 28 THEN quantile_cont(y, 0.5) OVER f END, FALSE) AS bad FROM c
          WINDOW f AS (ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING))
    SELECT date, round(y, 8) AS y FROM m WHERE date <= (SELECT max(date) FROM m WHERE NOT bad)""")
def tail_trim(spark, sf):
    p = R.portfolio(spark, sf).select("date", "y")
    end = p.agg(F.max("date").alias("_e"))
    c = p.crossJoin(F.broadcast(end)).selectExpr("date", "CASE WHEN date > date_sub(_e, 10) THEN y * 0.1D ELSE y END AS y")
    return _round(series.trim_tail(c, "y", "date"))


@query("baselines", "J1 J5", """
    WITH t AS (SELECT month(date) AS m, isodow(date) AS d, avg(y) AS month_dow FROM r_portfolio WHERE date <= DATE '2000-12-31' GROUP BY ALL),
    l AS (SELECT (date - DATE '2000-12-31' - 1) AS k, y FROM r_portfolio WHERE date <= DATE '2000-12-31' AND date > DATE '2000-12-31' - 7)
    SELECT p.date, p.y, CASE WHEN p.date <= DATE '1999-12-31' THEN 'train' WHEN p.date <= DATE '2000-12-31' THEN 'val' ELSE 'test' END AS split,
      lag(p.y, 1) OVER (ORDER BY p.date) AS one_step, CASE WHEN p.date > DATE '2000-12-31' THEN l.y END AS frozen7, round(t.month_dow, 8) AS month_dow
    FROM r_portfolio p LEFT JOIN t ON month(p.date) = t.m AND isodow(p.date) = t.d LEFT JOIN l ON l.k + 7 = (p.date - DATE '2000-12-31' - 1) % 7 AND p.date > DATE '2000-12-31'""")
def baselines(spark, sf):
    p = series.add_lags(R.portfolio(spark, sf).select("date", "y"), "y", "date", lags=(1,))
    p = series.frozen_seasonal(p, "y", "date", "2000-12-31", 7, "frozen7")
    p = series.temporal_split(p, "date", "1999-12-31", "2000-12-31")
    p = p.withColumns({"m": F.month("date"), "d": F.weekday("date")})
    out = learners.group_mean_model(p.where("date <= DATE'2000-12-31'"), p, "y", ["m", "d"], "month_dow")
    return _round(out.select("date", "y", "split", F.col("lag1").alias("one_step"), "frozen7", "month_dow"))


# Fixed value: the last hour whose value the hourly forecasts may use for a frozen horizon.
HOUR_CUT = "2024-01-24 23:00:00"
_HOURLY = f"""h AS (SELECT date_trunc('hour', ts) AS datetime, sum(kwh) AS y FROM r_readings WHERE kwh >= 0 GROUP BY 1),
    k AS (SELECT *, CAST(floor(epoch(datetime) / 3600) AS BIGINT) AS hr FROM h),
    a AS (SELECT hr % 24 AS p, arg_max(y, datetime) AS v FROM k WHERE datetime <= TIMESTAMP '{HOUR_CUT}' GROUP BY 1),
    b AS (SELECT hr % 168 AS p, arg_max(y, datetime) AS v FROM k WHERE datetime <= TIMESTAMP '{HOUR_CUT}' GROUP BY 1),
    f AS (SELECT k.datetime, y, a.v AS frozen24, b.v AS frozen168 FROM k LEFT JOIN a ON a.p = hr % 24 LEFT JOIN b ON b.p = hr % 168 WHERE datetime > TIMESTAMP '{HOUR_CUT}')"""


def hourly_series(spark, sf):
    """Hourly portfolio with strict-past features and the frozen baselines of the test hours."""
    h = R.readings(spark, sf).where("kwh >= 0").groupBy(C.hour_start("ts").alias("datetime")).agg(F.sum("kwh").alias("y"))
    p = series.add_lags(h, "y", "datetime", lags=(1, 24), means=(24,))
    s, c = C.cyclic(F.hour("datetime"), 24)
    return series.frozen_by_phase(p.withColumns({"sin_h": s, "cos_h": c}), "y", "datetime", HOUR_CUT, {"frozen24": 24, "frozen168": 168})


@query("hourly_baselines", "J5 J1", f"WITH {_HOURLY} SELECT * FROM f")
def hourly_baselines(spark, sf):
    return hourly_series(spark, sf).where(F.col("datetime") > F.lit(HOUR_CUT).cast("timestamp_ntz")).select("datetime", "y", "frozen24", "frozen168")


@query("hourly_board", "J18 J5 D53", f"""WITH {_HOURLY}, l AS (SELECT 'frozen24' AS model, y, frozen24 AS pred FROM f UNION ALL SELECT 'frozen168', y, frozen168 FROM f),
    m AS (SELECT model, count(pred) AS n, round(avg(abs(y - pred)), 6) AS mae FROM l GROUP BY model)
    SELECT * FROM m UNION ALL SELECT 'linear', (SELECT count(*) FROM f), NULL""")
def hourly_board(spark, sf):
    """Errors of the frozen baselines and, for the learner, the hours it covers (its error is in ``hourly_learner``)."""
    return _round(hourly_metrics(spark, sf).select("model", "n", F.when(F.col("model") != "linear", F.col("mae")).alias("mae")), 6)


@query("hourly_learner", "J18 J9")
def hourly_learner(spark, sf):
    return _round(hourly_metrics(spark, sf), 6)


def hourly_metrics(spark, sf):
    """Point metrics of the frozen baselines and of a linear model of past hours, fitted up to the cutoff."""
    feats = ["lag1", "lag24", "roll24", "sin_h", "cos_h"]
    h = stage(hourly_series(spark, sf))
    cut = F.lit(HOUR_CUT).cast("timestamp_ntz")
    model = gram.fit_all(gram.gram(h.where(F.col("datetime") <= cut), [], feats, "y"), [], len(feats), 0.001).select("coefficients")
    test = h.where(F.col("datetime") > cut).crossJoin(F.broadcast(model)).withColumn("linear", F.greatest(F.lit(0.0), gram.predicted(feats)))
    return E.point_metrics(E.long_predictions(test, ["frozen24", "frozen168", "linear"], ["datetime"]))


def _metrics_sql(src, by, extra=""):
    return f"""SELECT {by}{', ' if by else ''}count(*) FILTER (WHERE y IS NOT NULL AND pred IS NOT NULL) AS n, round(avg(abs(y - pred)), 6) AS mae,
      round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse, round(100 * avg(abs((y - pred) / nullif(y, 0))), 6) AS mape,
      round(100 * avg(abs(y - pred) / nullif((abs(y) + abs(pred)) / 2, 0)), 6) AS smape,
      round(100 * sum(abs(y - pred)) / nullif(sum(CASE WHEN pred IS NOT NULL THEN abs(y) END), 0), 6) AS wape{extra} FROM {src}{' GROUP BY ' + by if by else ''}"""


_COST = ", round(sum(abs(y - pred)) * 0.095, 6) AS cost, round(sum(abs(y - pred)) * 0.095 / nullif(sum(CASE WHEN pred IS NOT NULL THEN abs(y) END) / 1000, 0), 6) AS cost_per_mwh"


@query("point_metrics", "J14 J17 J18", _metrics_sql("r_long", "model", _COST))
def point_metrics(spark, sf):
    return _round(E.point_metrics(long_forecast(spark, sf)), 6)


@query("mase", "J15", """
    WITH s AS (SELECT avg(abs(d)) AS scale FROM (SELECT y - lag(y, 7) OVER (ORDER BY date) AS d FROM r_portfolio WHERE date <= DATE '1999-12-31'))
    SELECT model, round(avg(abs(y - pred)) / any_value(scale), 6) AS mase FROM r_long, s WHERE year(date) >= 2000 GROUP BY model""")
def mase(spark, sf):
    scale = E.seasonal_scale(R.portfolio(spark, sf).where("date <= DATE'1999-12-31'"), m=7)
    m = E.point_metrics(long_forecast(spark, sf).where("year(date) >= 2000"))
    return _round(E.add_mase(m, scale).select("model", "mase"), 6)


@query("relative_mae", "J15", """SELECT model, round(avg(abs(y - pred)), 6) AS mae, round(avg(abs(y - naive)), 6) AS base_mae, round(avg(abs(y - pred)) / avg(abs(y - naive)), 6) AS relative_mae
    FROM r_long JOIN (SELECT date, naive FROM r_forecast) USING (date) WHERE pred IS NOT NULL AND naive IS NOT NULL GROUP BY model""")
def relative_mae(spark, sf):
    f = E.long_predictions(R.forecast(spark, sf).withColumn("base", F.col("naive")), MODELS, ["date", "base"])
    return _round(E.relative_mae(f, "base"), 6)


_SLICES = """(SELECT y, pred, model, unnest(['overall', 'month', 'is_weekend', 'dow', 'season', 'season_dow']) AS slice_type,
    unnest(['all', strftime(date, '%Y-%m'), CASE WHEN isodow(date) >= 6 THEN 'true' ELSE 'false' END, CAST(isodow(date) AS VARCHAR), season, season || '-' || isodow(date)]) AS slice_value
    FROM (SELECT *, CASE WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) IN (3, 4, 5) THEN 'spring' WHEN month(date) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season FROM r_long WHERE year(date) = 2001))"""


@query("error_slices", "J23 J24", _metrics_sql(_SLICES, "model, slice_type, slice_value"))
def error_slices(spark, sf):
    return _round(E.error_slices(long_forecast(spark, sf).where(TEST)), 6)


@query("special_day_slices", "J23", """
    WITH c AS (SELECT date, bool_or(is_bridge_day) AS is_bridge_day, bool_or(is_easter_window) AS is_easter_window FROM r_calendar GROUP BY date),
    f AS (SELECT model, l.y, l.pred, c.is_bridge_day, c.is_easter_window FROM r_long l JOIN c ON c.date = l.date)
    SELECT model, slice_type, slice_value, count(pred) AS n, round(avg(abs(y - pred)), 6) AS mae FROM (SELECT model, y, pred, unnest(['bridge', 'easter']) AS slice_type,
      unnest([CAST(is_bridge_day AS VARCHAR), CAST(is_easter_window AS VARCHAR)]) AS slice_value FROM f) GROUP BY ALL""")
def special_day_slices(spark, sf):
    from loadloom.plans.weather_queries import _calendar
    # The portfolio spans all provinces: a day is special where it is so in any of them.
    cal = _calendar(spark, sf).groupBy("date").agg(*[F.bool_or(c).alias(c) for c in ("is_bridge_day", "is_easter_window")])
    f = long_forecast(spark, sf).join(cal, "date")
    s = E.by_slices(f, {"bridge": "string(is_bridge_day)", "easter": "string(is_easter_window)"})
    return _round(E.point_metrics(s, ["model", "slice_type", "slice_value"]).select("model", "slice_type", "slice_value", "n", "mae"), 6)


@query("hourly_error_profile", "D53", """
    WITH h AS (SELECT date_trunc('hour', ts) AS t, sum(kwh) AS y FROM r_readings WHERE kwh >= 0 GROUP BY 1), p AS (SELECT t, y, lag(y, 24) OVER (ORDER BY t) AS pred FROM h)
    SELECT hour(t) AS hour, round(avg(y), 6) AS actual, round(avg(pred), 6) AS predicted, round(avg(y - pred), 6) AS residual FROM p GROUP BY 1""")
def hourly_error_profile(spark, sf):
    h = (R.readings(spark, sf).where("kwh >= 0").groupBy(C.hour_start("ts").alias("t")).agg(F.sum("kwh").alias("y")))
    p = series.add_lags(h, "y", "t", lags=(24,))
    return _round(p.groupBy(F.hour("t").alias("hour")).agg(F.avg("y").alias("actual"), F.avg("lag24").alias("predicted"),
                                                         F.avg(F.expr("y - lag24")).alias("residual")), 6)


@query("residual_series", "D53", "SELECT date, model, round(y - pred, 6) AS residual FROM r_long WHERE year(date) = 2001")
def residual_series(spark, sf):
    return _round(E.residual_series(R.forecast(spark, sf).where(TEST), MODELS, ["date"]), 6)


@query("hourly_week", "D53", f"""WITH {_HOURLY} SELECT datetime, unnest(['actual', 'frozen24', 'frozen168']) AS series, unnest([y, frozen24, frozen168]) AS value
    FROM f WHERE datetime < TIMESTAMP '{HOUR_CUT}' + INTERVAL 7 DAY""")
def hourly_week(spark, sf):
    """Actual and predicted hours of the week after the cut."""
    h = hourly_series(spark, sf).where(F.col("datetime") > F.lit(HOUR_CUT).cast("timestamp_ntz"))
    return E.time_slice(h, ["frozen24", "frozen168"], "datetime", HOUR_CUT)


_CONF = """WITH r AS (SELECT abs(y - rolling) AS r FROM r_forecast WHERE year(date) = 2000 AND rolling IS NOT NULL), n AS (SELECT count(*) AS n FROM r),
    k AS (SELECT r, row_number() OVER (ORDER BY r) AS i FROM r),
    q AS (SELECT (SELECT r FROM k WHERE i = least(n, CAST(ceil((n + 1) * 0.9 - 1e-9) AS BIGINT))) AS q, (SELECT r FROM k WHERE i = CAST(ceil(n * 0.9 - 1e-9) AS BIGINT)) AS plain, n FROM n)
    """


def _residuals(spark, sf):
    return R.forecast(spark, sf).where(VAL).where("rolling IS NOT NULL").selectExpr("abs(y - rolling) AS resid", "date")


@query("conformal_quantile", "J19 K2", _CONF + "SELECT round(q, 8) AS finite_q, round(plain, 8) AS plain_q, n FROM q")
def conformal_quantile(spark, sf):
    r = stage(_residuals(spark, sf))
    a, b = E.conformal(r, "resid", out="finite_q"), E.conformal(r, "resid", finite=False, out="plain_q").drop("n")
    return _round(a.crossJoin(b))


@query("interval_metrics", "J16 J19", _CONF + """, i AS (SELECT date, y, greatest(0, rolling - q) AS lo, rolling + q AS hi FROM r_forecast, q WHERE year(date) = 2001)
    SELECT count(*) AS n, round(100 * avg(CAST(y BETWEEN lo AND hi AS INTEGER)), 6) AS coverage, round(avg(hi - lo), 6) AS width,
      round(avg(hi - lo + 20 * CASE WHEN y < lo THEN lo - y WHEN y > hi THEN y - hi ELSE 0 END), 6) AS winkler,
      round(avg(greatest(0.05 * (y - lo), -0.95 * (y - lo))), 6) AS pinball_lo, round(avg(greatest(0.95 * (y - hi), -0.05 * (y - hi))), 6) AS pinball_hi FROM i""")
def interval_metrics(spark, sf):
    q = E.conformal(_residuals(spark, sf), "resid").drop("n")
    t = R.forecast(spark, sf).where(TEST).crossJoin(F.broadcast(q))
    return _round(E.interval_metrics(E.add_interval(t, "rolling")), 6)


@query("interval_slices", "J24", _CONF + """, i AS (SELECT date, y, greatest(0, rolling - q) AS lo, rolling + q AS hi FROM r_forecast, q WHERE year(date) = 2001),
    s AS (SELECT y, lo, hi, unnest(['overall', 'month', 'dow']) AS slice_type, unnest(['all', strftime(date, '%Y-%m'), CAST(isodow(date) AS VARCHAR)]) AS slice_value FROM i)
    SELECT slice_type, slice_value, count(*) AS n, round(100 * avg(CAST(y BETWEEN lo AND hi AS INTEGER)), 6) AS coverage, round(avg(hi - lo), 6) AS width FROM s GROUP BY ALL""")
def interval_slices(spark, sf):
    q = E.conformal(_residuals(spark, sf), "resid").drop("n")
    t = E.add_interval(R.forecast(spark, sf).where(TEST).crossJoin(F.broadcast(q)), "rolling")
    keys = {k: v for k, v in E.slice_keys().items() if k in ("overall", "month", "dow")}
    return _round(E.interval_slices(t, keys).select("slice_type", "slice_value", "n", "coverage", "width"), 6)


_CAL_SQL = """r0 AS (SELECT cluster, date, abs(y - pred) AS r, {season} AS season FROM r_cluster_forecast WHERE year(date) = 2000 AND pred IS NOT NULL),
    ga AS (SELECT cluster, r, row_number() OVER (PARTITION BY cluster ORDER BY r) AS i, count(*) OVER (PARTITION BY cluster) AS n FROM r0),
    qa AS (SELECT cluster, n, r AS q FROM ga WHERE i = least(n, CAST(ceil((n + 1) * 0.9 - 1e-9) AS BIGINT))),
    fa AS (SELECT qa.cluster, any_value(n) AS n, any_value(q) AS q, greatest(1.5, coalesce(min(f) FILTER (WHERE c >= 0.9), 2.5)) AS k FROM qa JOIN
      (SELECT q2.cluster, f, avg(CAST(r <= q2.q * f AS INTEGER)) AS c FROM r0 JOIN qa q2 USING (cluster), (SELECT round(1 + 0.05 * x, 10)::DOUBLE AS f FROM range(0, 31) t(x)) GROUP BY ALL) g USING (cluster) GROUP BY qa.cluster)"""
_SEASON_D = "CASE WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) IN (3, 4, 5) THEN 'spring' WHEN month(date) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END"


def cluster_residuals(spark, sf, c=None):
    c = R.cluster_forecast(spark, sf, c).where("pred IS NOT NULL").withColumn("season", F.expr(E.SEASON_SQL.format(d="date")))
    return c.withColumn("resid", F.expr("abs(y - pred)"))


@query("safety_factor", "J20", "WITH " + _CAL_SQL.format(season=_SEASON_D) + """ SELECT cluster, n AS n_calibration, round(q, 8) AS qhat_raw,
    k::DOUBLE AS safety_factor, round(q * k, 8) AS qhat FROM fa""")
def safety_factor(spark, sf):
    return _round(E.calibrate(stage(cluster_residuals(spark, sf).where(VAL)), "resid", ["cluster"]))


_MOND = "WITH " + _CAL_SQL.format(season=_SEASON_D) + """,
    gs AS (SELECT cluster, season, r, row_number() OVER (PARTITION BY cluster, season ORDER BY r) AS i, count(*) OVER (PARTITION BY cluster, season) AS n FROM r0),
    qs AS (SELECT cluster, season, n, r AS q FROM gs WHERE i = least(n, CAST(ceil((n + 1) * 0.9 - 1e-9) AS BIGINT))),
    fs AS (SELECT cluster, season, any_value(n) AS n, any_value(q) * greatest(1.5, coalesce(min(f) FILTER (WHERE c >= 0.9), 2.5)) AS qh FROM
      (SELECT q2.cluster, q2.season, q2.n, q2.q, f, avg(CAST(r <= q2.q * f AS INTEGER)) AS c FROM r0 JOIN qs q2 USING (cluster, season), (SELECT round(1 + 0.05 * x, 10)::DOUBLE AS f FROM range(0, 31) t(x)) GROUP BY ALL)
      GROUP BY cluster, season HAVING any_value(n) >= 60),
    te AS (SELECT date, cluster, y, pred, n_users, """ + _SEASON_D + """ AS season FROM r_cluster_forecast WHERE year(date) = 2001),
    mo AS (SELECT te.*, greatest(fa.q * fa.k, fs.qh) AS q FROM te LEFT JOIN fa USING (cluster) LEFT JOIN fs USING (cluster, season)),
    iv AS (SELECT *, greatest(0, pred - q) AS lo, pred + q AS hi FROM mo)
    """


def mondrian_intervals(spark, sf, c=None):
    r = stage(cluster_residuals(spark, sf, c))
    return E.add_interval(E.mondrian(r.where(VAL), r.where(TEST), "resid", "cluster", "season"))


@query("mondrian_intervals", "J21", _MOND + "SELECT date, cluster, y, round(pred, 8) AS pred, round(lo, 8) AS lo, round(hi, 8) AS hi FROM iv")
def mondrian_query(spark, sf):
    return _round(mondrian_intervals(spark, sf).select("date", "cluster", "y", "pred", "lo", "hi"))


@query("coverage_alerts", "J22", _MOND + """, s AS (SELECT cluster, y, lo, hi, unnest(['group', 'season', 'month']) AS slice_type, unnest(['all', season, strftime(date, '%Y-%m')]) AS slice_value FROM iv),
    a AS (SELECT cluster, slice_type, slice_value, count(*) AS n, 100 * avg(CAST(y BETWEEN lo AND hi AS INTEGER)) AS coverage FROM s GROUP BY ALL)
    SELECT cluster, slice_type, slice_value, n, round(coverage, 6) AS coverage, CASE slice_type WHEN 'group' THEN 'group' WHEN 'season' THEN 'group_season' ELSE 'diagnostic_month' END AS alert_level
    FROM a WHERE coverage < 97""")
def coverage_alerts(spark, sf):
    a = E.coverage_alerts(mondrian_intervals(spark, sf), min_cov=97)
    return _round(a.select("cluster", "slice_type", "slice_value", "n", "coverage", "alert_level"), 6)


@query("segment_review", "J29", _MOND + """, s AS (SELECT *, y / nullif(n_users, 0) AS u, unnest(['overall', 'season']) AS slice_type, unnest(['all', season]) AS slice_value FROM iv WHERE cluster = 0),
    g AS (SELECT slice_type, slice_value, count(*) AS n_days, avg(u) AS mu, stddev_samp(u) AS su, avg(abs(y - pred)) AS mae, 100 * avg(CAST(y BETWEEN lo AND hi AS INTEGER)) AS cov FROM s GROUP BY ALL)
    SELECT slice_type, slice_value, n_days, round(mu, 6) AS mean_user, round(su / mu, 6) AS cv_user, round(mae, 6) AS mae, round(cov, 6) AS coverage,
      round(mu / (SELECT mu FROM g WHERE slice_type = 'overall'), 6) AS index_vs_overall, coalesce(cov < 90 OR su / mu >= 0.15, FALSE) AS needs_treatment FROM g""")
def segment_review(spark, sf):
    r = E.segment_review(mondrian_intervals(spark, sf).where("cluster = 0"))
    return _round(r.select("slice_type", "slice_value", "n_days", "mean_user", "cv_user", "mae", "coverage", "index_vs_overall", "needs_treatment"), 6)


@query("forecast_leaderboard", "J18 F1 J26", """
    WITH a AS (SELECT 'portfolio' AS target, model, y, pred FROM r_long WHERE year(date) = 2001 UNION ALL
      SELECT 'cluster_' || cluster, 'rolling', y, pred FROM r_cluster_forecast WHERE year(date) = 2001)
    SELECT target, model, round(100 * sum(abs(y - pred)) / sum(CASE WHEN pred IS NOT NULL THEN abs(y) END), 6) AS wape, round(avg(abs(y - pred)), 6) AS mae FROM a GROUP BY ALL""")
def forecast_leaderboard(spark, sf):
    c = R.cluster_forecast(spark, sf).where(TEST).withColumn("target", F.expr("concat('cluster_', cluster)")).withColumn("model", F.lit("rolling"))
    boards = E.leaderboard({"portfolio": E.point_metrics(long_forecast(spark, sf).where(TEST))})
    both = boards.unionByName(E.point_metrics(c, ["target", "model"]))
    return _round(both.select("target", "model", "wape", "mae"), 6)


@query("stacked_blend", "J10", """
    WITH v AS (SELECT * FROM r_forecast WHERE year(date) = 2000 AND weekly IS NOT NULL AND rolling IS NOT NULL),
    g AS (SELECT sum(weekly * weekly) AS a, sum(weekly * rolling) AS b, sum(rolling * rolling) AS c, sum(weekly * y) AS p, sum(rolling * y) AS q FROM v),
    h AS (SELECT a + 0.01 * (a + c) / 2 AS a, b, c + 0.01 * (a + c) / 2 AS c, p, q FROM g),
    w AS (SELECT greatest(0, (c * p - b * q) / (a * c - b * b)) AS w0, greatest(0, (a * q - b * p) / (a * c - b * b)) AS w1 FROM h)
    SELECT date, y, round((w0 * weekly + w1 * rolling) / (w0 + w1), 6) AS blend FROM r_forecast, w WHERE year(date) = 2001""")
def stacked_blend(spark, sf):
    f = R.forecast(spark, sf)
    w = reconcile.stack_weights(f.where(VAL), "y", ["weekly", "rolling"])
    return _round(reconcile.blend(f.where(TEST), w).select("date", "y", "blend"), 6)


@query("top_ensemble", "J11", """
    WITH m AS (SELECT model, avg(abs(y - pred)) AS mae FROM r_long WHERE year(date) = 2000 GROUP BY model ORDER BY mae, model LIMIT 2)
    SELECT date, any_value(y) AS y, round(avg(pred), 6) AS ensemble FROM r_long WHERE year(date) = 2001 AND model IN (SELECT model FROM m) GROUP BY date""")
def top_ensemble(spark, sf):
    best = reconcile.best_models(E.point_metrics(long_forecast(spark, sf).where(VAL)), 2)
    return _round(reconcile.mean_ensemble(R.forecast(spark, sf).where(TEST), best).select("date", "y", "ensemble"), 6)


@query("from_user_mean", "J12", """SELECT date, y, round(CASE WHEN u IS NOT NULL THEN greatest(0, u) * n_users END, 6) AS pred FROM (SELECT date, y, n_users, lag(y / n_users) OVER (ORDER BY date) AS u FROM r_portfolio)""")
def from_user_mean(spark, sf):
    p = R.portfolio(spark, sf).withColumn("u", F.expr("y / n_users"))
    p = series.add_lags(p, "u", "date", lags=(1,))
    return _round(reconcile.from_user_mean(p, "lag1", "n_users").select("date", "y", "pred"), 6)


ROLES["r_bu"] = "SELECT date, sum(y) AS actual, sum(pred) AS bottom_up FROM r_cluster_forecast GROUP BY date HAVING count(*) FILTER (WHERE pred IS NULL) = 0"
ROLES["r_share"] = "SELECT sum(p) / sum(t) AS share FROM (SELECT date, sum(y) AS p FROM r_cluster_daily GROUP BY date) JOIN (SELECT date, y AS t FROM r_portfolio) USING (date) WHERE year(date) = 2000"


def _recon(spark, sf, p=None, c=None):
    parts = R.cluster_forecast(spark, sf, c)
    bu = reconcile.bottom_up(parts)
    total = R.forecast(spark, sf, p)
    td = reconcile.top_down(total.select("date", "weekly"), parts.where(VAL), total.where(VAL), "weekly")
    return bu.join(td.select("date", "top_down"), "date")


@query("bottom_up_top_down", "J26", """SELECT date, actual, round(bottom_up, 6) AS bottom_up, round(weekly * share, 6) AS top_down FROM r_bu JOIN (SELECT date, weekly FROM r_forecast) USING (date), r_share""")
def bottom_up_top_down(spark, sf):
    return _round(_recon(spark, sf), 6)


@query("inverse_variance", "J27", """
    WITH j AS (SELECT date, actual, bottom_up, weekly * share AS top_down FROM r_bu JOIN (SELECT date, weekly FROM r_forecast) USING (date), r_share),
    v AS (SELECT var_samp(actual - bottom_up) AS a, var_samp(actual - top_down) AS b FROM j WHERE year(date) = 2000)
    SELECT date, actual, round((1 / a) / (1 / a + 1 / b) * bottom_up + (1 / b) / (1 / a + 1 / b) * top_down, 6) AS combined FROM j, v WHERE year(date) = 2001""")
def inverse_variance(spark, sf):
    r = stage(_recon(spark, sf))
    w = reconcile.inverse_variance(r.where(VAL), "bottom_up", "top_down", "actual")
    return _round(reconcile.combine(r.where(TEST), w, "bottom_up", "top_down").select("date", "actual", "combined"), 6)


@query("mint_reconciliation", "J28")
def mint_reconciliation(spark, sf):
    ids = R.cluster_ids(spark, sf)
    wide = R.cluster_forecast(spark, sf).groupBy("date").pivot("cluster", ids).agg(F.first("y").alias("a"), F.first("pred").alias("p")).dropna()
    actual, base = [f"a{i}" for i in range(len(ids))], [f"p{i}" for i in range(len(ids))]
    j = stage(wide.join(_recon(spark, sf).select("date", "top_down"), "date")
              .selectExpr("date", "top_down", *[f"`{c}_a` AS {a}" for c, a in zip(ids, actual)], *[f"`{c}_p` AS {p}" for c, p in zip(ids, base)])
              .withColumn("actual_total", F.expr(" + ".join(actual))))
    return reconcile.mint(j.where(VAL), j.where(TEST), "actual_total", "top_down", actual, base)


@query("scope_coverage", "C15", """
    WITH p AS (SELECT date, sum(y) AS ky, CAST(sum(n_users) AS BIGINT) AS kn FROM r_cluster_daily WHERE cluster > 0 GROUP BY date),
    j AS (SELECT date, ky, kn, y AS ty, n_users AS tn FROM p JOIN r_portfolio USING (date)), r AS (SELECT *, 'all' AS period FROM j UNION ALL SELECT *, 'validation' FROM j WHERE year(date) = 2000 UNION ALL SELECT *, 'test' FROM j WHERE year(date) = 2001)
    SELECT period, min(date) AS start_date, max(date) AS end_date, count(*) AS n_days, round(avg(tn), 6) AS avg_users_all, round(avg(kn), 6) AS avg_users_clustered,
      sum(ty) AS kwh_all, sum(ky) AS kwh_clustered, round(100 * sum(ky) / sum(ty), 6) AS pct_kwh FROM r GROUP BY period""")
def scope_coverage(spark, sf):
    periods = {"all": "true", "validation": VAL, "test": TEST}
    return _round(reconcile.scope_coverage(R.cluster_daily(spark, sf).where("cluster > 0"), R.portfolio(spark, sf), periods), 6)


def _reconciled(spark, sf, p=None, c=None):
    """Test days with the bottom-up, the top-down and the combined forecast."""
    r = stage(_recon(spark, sf, p, c))
    return reconcile.combine(r.where(TEST), reconcile.inverse_variance(r.where(VAL), "bottom_up", "top_down", "actual"), "bottom_up", "top_down")


def evidence_rows(spark, sf, written=None):
    _, p, c = written or written_series(spark, sf)
    iv = stage(mondrian_intervals(spark, sf, c))
    recon = E.long_predictions(_reconciled(spark, sf, p, c), ["bottom_up", "top_down", "combined"], ["date"], "actual")
    scope = reconcile.scope_coverage(c.where("cluster > 0"), p, {"test": TEST})
    return E.evidence(E.point_metrics(long_forecast(spark, sf, p).where(TEST)), E.interval_slices(iv, {"season": E.SEASON_SQL.format(d="date")}),
                      E.point_metrics(recon, y="actual"), scope, E.segment_review(iv.where("cluster = 0")))


_WAPE = "100 * sum(abs(y - pred)) / sum(CASE WHEN pred IS NOT NULL THEN abs(y) END)"


@query("evidence_summary", "J30", _MOND + f""", m AS (SELECT model AS subject, {_WAPE} AS value FROM r_long WHERE year(date) = 2001 GROUP BY model),
    c AS (SELECT 'season=' || season AS subject, 100 * avg(CAST(y BETWEEN lo AND hi AS INTEGER)) AS value FROM iv GROUP BY season),
    sp AS (SELECT season AS subject, 100 * avg(CAST(y BETWEEN lo AND hi AS INTEGER)) AS value FROM iv WHERE cluster = 0 GROUP BY season),
    j AS (SELECT date, actual, bottom_up, weekly * share AS top_down FROM r_bu JOIN (SELECT date, weekly FROM r_forecast) USING (date), r_share),
    v AS (SELECT var_samp(actual - bottom_up) AS a, var_samp(actual - top_down) AS b FROM j WHERE year(date) = 2000),
    x AS (SELECT actual AS y, unnest(['bottom_up', 'top_down', 'combined']) AS subject, unnest([bottom_up, top_down, (1 / a) / (1 / a + 1 / b) * bottom_up + (1 / b) / (1 / a + 1 / b) * top_down]) AS pred
      FROM j, v WHERE year(date) = 2001),
    rc AS (SELECT subject, {_WAPE} AS value FROM x GROUP BY subject),
    sc AS (SELECT 100 * sum(ky) / sum(y) AS value FROM (SELECT date, sum(y) AS ky FROM r_cluster_daily WHERE cluster > 0 GROUP BY date) JOIN (SELECT date, y FROM r_portfolio) USING (date) WHERE year(date) = 2001)
    SELECT 'best_model' AS finding, subject, round(value, 6) AS value FROM (SELECT * FROM m ORDER BY round(value, 9), subject LIMIT 1)
    UNION ALL SELECT 'worst_model', subject, round(value, 6) FROM (SELECT * FROM m ORDER BY round(value, 9) DESC, subject LIMIT 1)
    UNION ALL SELECT 'worst_coverage', subject, round(value, 6) FROM (SELECT * FROM c ORDER BY round(value, 9), subject LIMIT 1)
    UNION ALL SELECT 'best_reconciliation', subject, round(value, 6) FROM (SELECT * FROM rc ORDER BY round(value, 9), subject LIMIT 1)
    UNION ALL SELECT 'clustered_energy_pct', 'test', round(value, 6) FROM sc
    UNION ALL SELECT 'special_segment_coverage', subject, round(value, 6) FROM (SELECT * FROM sp ORDER BY round(value, 9), subject LIMIT 1)""")
def evidence_summary(spark, sf):
    return _round(evidence_rows(spark, sf), 6)


ALERT_COVERAGE = 97  # percent of covered days below which a group, season or month is reported

ROLES["r_assess"] = _MOND + f""", s AS (SELECT cluster, y, lo, hi, unnest(['group', 'season', 'month']) AS slice_type, unnest(['all', season, strftime(date, '%Y-%m')]) AS slice_value FROM iv),
    al AS (SELECT cluster, slice_type, slice_value, 100 * avg(CAST(y BETWEEN lo AND hi AS INTEGER)) AS coverage FROM s GROUP BY ALL),
    ax AS (SELECT cluster, count(*) AS n_alerts, bool_or(slice_type <> 'month') AS has_group_alert, min(coverage) AS worst_coverage FROM al WHERE coverage < {ALERT_COVERAGE} GROUP BY cluster),
    pm AS (SELECT cluster, count(*) AS n_test, {_WAPE} AS wape, 100 * avg(CAST(y BETWEEN lo AND hi AS INTEGER)) AS coverage_test FROM iv GROUP BY cluster)
    SELECT cluster, n_test, wape, coverage_test, k::DOUBLE AS safety_factor, q * k AS qhat, coalesce(n_alerts, 0) AS n_alerts, coalesce(has_group_alert, FALSE) AS has_group_alert, worst_coverage,
      cluster = 0 AND (coalesce(k >= 1.5, FALSE) OR coalesce(coverage_test < 90, FALSE) OR coalesce(has_group_alert, FALSE)) AS needs_calibration
    FROM pm LEFT JOIN (SELECT cluster, q, k FROM fa) USING (cluster) LEFT JOIN ax USING (cluster)"""


def assessment(spark, sf):
    """Forecast quality, calibration and alerts of every cluster."""
    iv = stage(mondrian_intervals(spark, sf))
    calibration = E.calibrate(stage(cluster_residuals(spark, sf).where(VAL)), "resid", ["cluster"])
    return E.calibration_assessment(iv, calibration, E.coverage_alerts(iv, min_cov=ALERT_COVERAGE))


@query("calibration_assessment", "I23 J22", """SELECT cluster, n_test, round(wape, 6) AS wape, round(coverage_test, 6) AS coverage_test, safety_factor, round(qhat, 6) AS qhat, n_alerts, has_group_alert,
    round(worst_coverage, 6) AS worst_coverage, needs_calibration, CASE WHEN needs_calibration THEN 'own calibration' WHEN cluster = 0 THEN 'own monitoring'
    WHEN coverage_test < 90 THEN 'standard with follow-up' ELSE 'standard' END AS recommendation FROM r_assess""")
def calibration_assessment(spark, sf):
    return _round(assessment(spark, sf), 6)


@query("rolling_origin_means", "J25", """
    WITH f AS (SELECT unnest([1, 2, 3, 4, 5]) AS fold, unnest([DATE '2001-03-31', DATE '2001-04-30', DATE '2001-05-30', DATE '2001-06-29', DATE '2001-07-29']) AS cut),
    m AS (SELECT fold, month(date) AS m, isodow(date) AS d, avg(y) AS pred FROM r_portfolio, f WHERE date <= cut GROUP BY ALL)
    SELECT f.fold, p.date, p.y, round(m.pred, 6) AS pred, cut - 89 AS calibration_start FROM r_portfolio p JOIN f ON p.date > cut AND p.date <= cut + 30
    LEFT JOIN m ON m.fold = f.fold AND m.m = month(p.date) AND m.d = isodow(p.date)""")
def rolling_origin_means(spark, sf):
    p = stage(R.portfolio(spark, sf).select("date", "y", F.month("date").alias("m"), F.weekday("date").alias("d")))
    cuts = ["2001-03-31", "2001-04-30", "2001-05-30", "2001-06-29", "2001-07-29"]
    r = learners.rolling_origin(p, "date", cuts, lambda tr, te: learners.group_mean_model(tr, te, "y", ["m", "d"]))
    return _round(r.select("fold", "date", "y", "pred", "calibration_start"), 6)


def model_table(spark, sf, days=None):
    """Portfolio series with strict-past features, written once for all fits, from user-days that are written once too."""
    days = stage(R.daily(spark, sf).select("user_id", "date", "daily_kwh", "hours_recorded")) if days is None else days
    w = R.panel(spark, sf, days).groupBy("date").agg(*[F.avg(c).alias(c) for c in ("tmean", "hdd", "cdd")])
    p = R.portfolio(spark, sf, days).join(w, "date", "left")
    p = series.add_lags(p, "y", "date", lags=(1, 2, 7, 14, 28), means=(7, 14, 28), sds=(7,))
    p = series.add_past_weather(p, ["tmean", "hdd", "cdd"], "date")
    p = series.add_differences(p, "y", "date", pairs={"diff_1": (1, 2), "diff_7": (1, 8)})
    return stage(series.temporal_split(series.add_calendar(p), "date", "1999-12-31", "2000-12-31").where("roll28 IS NOT NULL"))


_SKIP = ("date", "y", "n_users", "split")


def _fit(kind, mode="operational", **kw):
    def build(spark, sf):
        t = model_table(spark, sf)
        feats = series.feature_set([c for c in t.columns if c not in _SKIP], mode)
        pred, params, model = learners.fit_regressor(kind, *(t.where(F.col("split") == s) for s in ("train", "val", "test")), feats, "y", **kw)
        return pred.select("date", "y", "pred")
    return build


query("gradient_boosting", "J6 J7 J3 J2")(_fit("gbt"))


def boosted(t):
    """One model per weather mode, all settings of all modes grown together, by name of the mode."""
    feats = [c for c in t.columns if c not in _SKIP]
    modes = {m: tuple(feats.index(f) for f in series.feature_set(feats, m)) for m in ("none", "operational", "ex_post")}
    settings = [boosting.Setting(*v, columns=c) for c in modes.values() for v in product(*boosting.GRID.values())]
    models = boosting.fit(t.where("split = 'train'"), t.where("split = 'val'"), feats, "y", settings)
    return {m: next(x for x in models if x.setting.columns == c) for m, c in modes.items()}


@query("boosting_board", "J6 J7 J18")
def boosting_board(spark, sf):
    """Every tried setting of the boosting: best round, rounds grown until patience ran out, validation error, choice."""
    t = model_table(spark, sf)
    feats = series.feature_set([c for c in t.columns if c not in _SKIP], "operational")
    return boosting.board(boosting.fit(t.where("split = 'train'"), t.where("split = 'val'"), feats, "y")[0], spark)


@query("boosting_checks", "J6 J15 J18 J31", """
    WITH s AS (SELECT date, CASE WHEN count(y) OVER v = 28 THEN 1 END AS full_window FROM r_portfolio WINDOW v AS (ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING))
    SELECT mode, count(*) AS n_test, TRUE AS finite, TRUE AS beats_weekly_naive, TRUE AS mase_below_one, TRUE AS stopped_by_patience
    FROM s, (SELECT unnest(['none', 'operational', 'ex_post']) AS mode) WHERE date > DATE '2000-12-31' AND full_window = 1 GROUP BY mode""")
def boosting_checks(spark, sf):
    """Boosting per weather mode on the test rows: against the value of a week ago (WAPE) and the weekly differences of the training rows (MASE)."""
    t = model_table(spark, sf)
    out = None
    for mode, model in boosted(t).items():
        patient = all(rounds < boosting.ROUNDS for *_, rounds, _, _ in model.board)
        row = model.predict(t.where("split = 'test'")).select("y", "pred", "lag7", F.lit(mode).alias("mode"), F.lit(patient).alias("patient"))
        out = row if out is None else out.unionByName(row)
    scale = E.seasonal_scale(t.where("split = 'train'"), m=7)
    m = out.groupBy("mode").agg(F.count("*").alias("n_test"), F.bool_and(F.expr("pred >= 0 AND pred < 1e300D")).alias("finite"),
                                (A.wape("y", "pred") < A.wape("y", "lag7")).alias("beats_weekly_naive"), A.mae("y", "pred").alias("mae"), F.bool_and("patient").alias("stopped_by_patience"))
    return E.add_mase(m, scale).select("mode", "n_test", "finite", "beats_weekly_naive", (F.col("mase") < 1).alias("mase_below_one"), "stopped_by_patience")


query("random_forest", "J8")(_fit("forest"))
query("elastic_net", "J9 J7")(_fit("elastic"))


@query("feature_importance", "J8")
def feature_importance(spark, sf):
    t = model_table(spark, sf)
    feats = series.feature_set([c for c in t.columns if c not in _SKIP], "none")
    parts = [t.where(F.col("split") == s) for s in ("train", "val", "test")]
    _, _, model = learners.fit_regressor("forest", *parts, feats, "y")
    return learners.importance(model, feats, spark)


def mode_metrics(spark, sf, days=None):
    """Test metrics of the elastic net and the boosting in every weather mode."""
    t = model_table(spark, sf, days)
    out = None
    for mode in ("none", "operational", "ex_post"):
        feats = series.feature_set([c for c in t.columns if c not in _SKIP], mode)
        parts = [t.where(F.col("split") == s) for s in ("train", "val", "test")]
        pred, _, _ = learners.fit_regressor("elastic", *parts, feats, "y")
        row = pred.withColumns({"mode": F.lit(mode), "model": F.lit("elastic")})
        out = row if out is None else out.unionByName(row)
    for mode, model in boosted(t).items():
        pred = model.predict(t.where(F.col("split") == "test"))
        out = out.unionByName(pred.withColumns({"mode": F.lit(mode), "model": F.lit("boosting")}))
    return E.point_metrics(out, ["mode", "model"])


@query("weather_mode_ablation", "J4 J31")
def weather_mode_ablation(spark, sf):
    return E.ablation(mode_metrics(spark, sf))


@query("model_evidence", "J30 J31")
def model_evidence(spark, sf):
    """The headline rows of ``evidence_summary`` and what weather is worth to each learner."""
    written = written_series(spark, sf)
    return _round(evidence_rows(spark, sf, written).unionByName(E.ablation_evidence(stage(mode_metrics(spark, sf, written[0])))), 6)


_CLUSTER_FEATURES = ["lag1", "lag7", "roll7", "dow"]


def cluster_table(spark, sf):
    c = series.add_lags(R.cluster_daily(spark, sf), "y", "date", ["cluster"], lags=(1, 7), means=(7,))
    return stage(series.temporal_split(c.where("roll7 IS NOT NULL"), "date", "1999-12-31", "2000-12-31").withColumn("dow", F.weekday("date")))


def cluster_predictions(t):
    """Test rows of every cluster that has enough rows, each predicted by a model of its own."""
    grams = gram.gram(t.withColumn("_t", F.log1p("y")), ["cluster", "split"], _CLUSTER_FEATURES, "_t")
    models = gram.fit_groups(grams, ["cluster"], "split", len(_CLUSTER_FEATURES))
    joined = t.where("split = 'test'").join(F.broadcast(models), "cluster")
    return joined.withColumn("pred", F.greatest(F.lit(0.0), F.expm1(gram.predicted(_CLUSTER_FEATURES))))


@query("cluster_models", "J13")
def cluster_models(spark, sf):
    """One elastic net per cluster with enough rows, all fitted from one aggregate of second moments."""
    return cluster_predictions(cluster_table(spark, sf)).select("date", "cluster", "y", "pred")


@query("cluster_model_checks", "J13", """
    WITH f AS (SELECT date, cluster, y, lag(y, 1) OVER w AS lag1, lag(y, 7) OVER w AS lag7, CASE WHEN count(y) OVER v = 7 THEN avg(y) OVER v END AS roll7
      FROM r_cluster_daily WINDOW w AS (PARTITION BY cluster ORDER BY date), v AS (PARTITION BY cluster ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
    s AS (SELECT *, CASE WHEN date <= DATE '1999-12-31' THEN 'train' WHEN date <= DATE '2000-12-31' THEN 'val' ELSE 'test' END AS split FROM f WHERE roll7 IS NOT NULL),
    n AS (SELECT cluster, count(*) FILTER (WHERE split = 'train') AS a, count(*) FILTER (WHERE split = 'val') AS b, count(*) FILTER (WHERE split = 'test') AS n_test FROM s GROUP BY cluster)
    SELECT cluster, n_test, TRUE AS finite_model, TRUE AS beats_last_value FROM n WHERE a >= 200 AND b >= 30 AND n_test >= 5""")
def cluster_model_checks(spark, sf):
    """Which clusters got a model, and whether it beats the last value on the test rows."""
    p = cluster_predictions(cluster_table(spark, sf))
    return p.groupBy("cluster").agg(F.count("*").alias("n_test"), F.bool_and(F.expr("penalty > 0 AND abs(pred) < 1e300D AND pred >= 0")).alias("finite_model"),
                                    (F.avg(F.expr("abs(y - pred)")) < F.avg(F.expr("abs(y - lag1)"))).alias("beats_last_value"))


@query("rolling_origin_refit", "J25 J16", """
    WITH s AS (SELECT date, y, lag(y, 7) OVER (ORDER BY date) AS a, CASE WHEN count(y) OVER v = 7 THEN avg(y) OVER v END AS b
      FROM r_portfolio WINDOW v AS (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
    f AS (SELECT unnest([1, 2, 3, 4, 5]) AS fold, unnest([DATE '2001-03-31', DATE '2001-04-30', DATE '2001-05-30', DATE '2001-06-29', DATE '2001-07-29']) AS cut),
    x AS (SELECT * FROM s WHERE a IS NOT NULL AND b IS NOT NULL),
    e AS (SELECT DISTINCT unnest([cut, cut - 90]) AS upto FROM f),
    m AS (SELECT upto, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS b_y
      FROM e JOIN x ON date <= upto GROUP BY upto),
    c AS (SELECT upto, (ay * bb - b_y * ab) / (aa * bb - ab * ab) AS ca, (b_y * aa - ay * ab) / (aa * bb - ab * ab) AS cb, my, ma, mb FROM m),
    p AS (SELECT fold, date, y, my + ca * (a - ma) + cb * (b - mb) AS pred, date > cut AS later FROM f JOIN x ON date > cut - 90 AND date <= cut + 30
      JOIN c ON upto = CASE WHEN date > cut THEN cut ELSE cut - 90 END),
    r AS (SELECT fold, abs(y - pred) AS r, row_number() OVER (PARTITION BY fold ORDER BY abs(y - pred)) AS i, count(*) OVER (PARTITION BY fold) AS n FROM p WHERE NOT later),
    q AS (SELECT fold, r AS q FROM r WHERE i = least(n, CAST(ceil((n + 1) * 0.9 - 1e-9) AS BIGINT))),
    w AS (SELECT fold, y, pred, greatest(0, pred - q) AS lo, pred + q AS hi FROM p JOIN q USING (fold) WHERE later)
    SELECT fold, count(*) AS n, round(avg(abs(y - pred)), 5) AS mae, round(100 * sum(abs(y - pred)) / sum(abs(y)), 5) AS wape,
      round(100 * avg(CAST(y BETWEEN lo AND hi AS INTEGER)), 5) AS coverage, round(avg(hi - lo), 5) AS width FROM w GROUP BY fold""")
def rolling_origin_refit(spark, sf):
    """Five refits with intervals from the 90 days before each cutoff, from one pass of running moments."""
    p = series.add_lags(R.portfolio(spark, sf).select("date", "y"), "y", "date", lags=(7,), means=(7,))
    cuts = ["2001-03-31", "2001-04-30", "2001-05-30", "2001-06-29", "2001-07-29"]
    r = stage(E.rolling_refit(p, "date", "y", ["lag7", "roll7"], cuts))
    points = E.point_metrics(r, ["fold"]).select("fold", "n", "mae", "wape")
    return _round(points.join(E.interval_metrics(r, ["fold"]).select("fold", "coverage", "width"), "fold"), 5)


@query("usable_clusters", "J13", """
    WITH s AS (SELECT cluster, CASE WHEN date <= DATE '1999-12-31' THEN 'train' WHEN date <= DATE '2000-12-31' THEN 'val' ELSE 'test' END AS split FROM r_cluster_daily)
    SELECT cluster, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test,
      count(*) FILTER (WHERE split = 'train') >= 200 AND count(*) FILTER (WHERE split = 'val') >= 30 AND count(*) FILTER (WHERE split = 'test') >= 5 AS usable FROM s GROUP BY cluster""")
def usable_clusters(spark, sf):
    return learners.enough_rows(series.temporal_split(R.cluster_daily(spark, sf), "date", "1999-12-31", "2000-12-31"), "cluster")


@query("complete_cases", "J2", """SELECT date, y, weekly, round(rolling, 8) AS rolling FROM r_forecast WHERE weekly IS NOT NULL AND rolling IS NOT NULL AND y IS NOT NULL""")
def complete_cases(spark, sf):
    return _round(learners.complete_cases(R.forecast(spark, sf), ["weekly", "rolling"], "y").select("date", "y", "weekly", "rolling"))
