"""User features, climate regressions, the clustering pool and feature audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadloom.functions import aggregates as A
from loadloom.functions import columns as C
from loadloom.operators import checks, features, quality
from loadloom.plans import roles as R
from loadloom.plans.registry import query
from loadloom.plans.roles_sql import ROLES
from loadloom.plans.weather_queries import _CAL, _calendar
from loadloom.sources.stage import broadcast_if_small, stage

R8 = lambda c: F.round(c, 8)

_S = {"winter": "12, 1, 2", "spring": "3, 4, 5", "summer": "6, 7, 8", "autumn": "9, 10, 11"}
ROLES["r_calendar"] = _CAL.strip() + " SELECT * FROM cal"
ROLES["r_cells"] = "SELECT user_id, hour, avg(kwh) AS m, avg(kwh) FILTER (WHERE isodow(ts) < 6) AS wd, avg(kwh) FILTER (WHERE isodow(ts) >= 6) AS we, " + ", ".join(
    f"avg(kwh) FILTER (WHERE month(ts) IN ({v})) AS m_{k}" for k, v in _S.items()) + " FROM r_meter WHERE kwh >= 0 GROUP BY ALL"
ROLES["r_shape"] = """
    SELECT *, v_ + f_ + p_ AS t_ FROM (SELECT user_id, avg(m) AS um, """ + ", ".join(
    f"max(m) FILTER (WHERE hour = {h}) AS h{h}" for h in range(24)) + """, avg(m) FILTER (WHERE hour <= 6) AS night, avg(m) FILTER (WHERE hour >= 7) AS day_,
    avg(wd) AS wd, avg(we) AS we, sum(m) AS all_, coalesce(sum(m) FILTER (WHERE hour BETWEEN 6 AND 11), 0) AS mo,
    coalesce(sum(m) FILTER (WHERE hour BETWEEN 12 AND 17), 0) AS af, coalesce(sum(m) FILTER (WHERE hour BETWEEN 18 AND 23), 0) AS ev,
    coalesce(sum(m) FILTER (WHERE hour BETWEEN 0 AND 5), 0) AS sm, arg_max(hour, (m, -hour)) AS ph,
    arg_max(hour, (wd, -hour)) FILTER (WHERE wd IS NOT NULL) AS wdp, arg_max(hour, (we, -hour)) FILTER (WHERE we IS NOT NULL) AS wep,
    avg(m_winter) AS wi, avg(m_spring) AS sp, avg(m_summer) AS su, avg(m_autumn) AS au,
    coalesce(sum(wd * 5) FILTER (WHERE hour <= 7), 0) + coalesce(sum(we * 2), 0) AS v_,
    coalesce(sum(wd * 5) FILTER (WHERE hour IN (10, 11, 12, 13, 18, 19, 20, 21)), 0) AS p_,
    coalesce(sum(wd * 5) FILTER (WHERE hour IN (8, 9, 14, 15, 16, 17, 22, 23)), 0) AS f_ FROM r_cells GROUP BY user_id)"""
_AMP = "(greatest(wi, sp, su, au) - least(wi, sp, su, au))"
_MS = "((coalesce(wi, 0) + coalesce(sp, 0) + coalesce(su, 0) + coalesce(au, 0)) / (CAST(wi IS NOT NULL AS INTEGER) + CAST(sp IS NOT NULL AS INTEGER) + CAST(su IS NOT NULL AS INTEGER) + CAST(au IS NOT NULL AS INTEGER)))"
ROLES["r_f_shape"] = "SELECT user_id, " + ", ".join(
    f"CASE WHEN h{h} IS NOT NULL THEN CASE WHEN um > 0 THEN h{h} / um ELSE 0 END END AS norm_h{h:02d}" for h in range(24)) + f""",
    CASE WHEN day_ > 0 THEN night / day_ END AS ratio_night_day, CASE WHEN wd > 0 THEN we / wd END AS ratio_weekend_weekday,
    mo / nullif(all_, 0) AS morning_share, af / nullif(all_, 0) AS afternoon_share, ev / nullif(all_, 0) AS evening_share,
    sm / nullif(all_, 0) AS night_share, mo / nullif(af, 0) AS ratio_morning_afternoon, ev / nullif(mo, 0) AS ratio_evening_morning,
    sm / nullif(mo, 0) AS ratio_night_morning, ph AS peak_hour, wdp AS weekday_peak_hour, wep AS weekend_peak_hour, abs(wep - wdp) AS peak_shift,
    {_AMP} AS seasonal_amplitude, CASE WHEN {_MS} > 0 THEN {_AMP} / {_MS} ELSE 0 END AS seasonal_amplitude_norm,
    v_ AS valley_kwh_week, f_ AS flat_kwh_week, p_ AS peak_kwh_week, v_ / nullif(t_, 0) AS valley_share, f_ / nullif(t_, 0) AS flat_share,
    p_ / nullif(t_, 0) AS peak_share, p_ / nullif(v_, 0) AS peak_to_valley_ratio FROM r_shape"""
ROLES["r_f_daily"] = """SELECT user_id, avg(daily_kwh) AS mean_daily_kwh, stddev_samp(daily_kwh) AS sd_daily_kwh, median(daily_kwh) AS median_daily_kwh,
    quantile_cont(daily_kwh, 0.9) AS p90_daily_kwh, sum(daily_kwh) AS total_kwh, count(*) AS active_days, min(date) AS first_date, max(date) AS last_date,
    avg(CASE WHEN daily_kwh = 0 THEN 1.0 ELSE 0.0 END) AS zero_day_rate, avg(CASE WHEN daily_kwh <= 1 THEN 1.0 ELSE 0.0 END) AS low_day_rate,
    CAST(max(date) - min(date) AS INTEGER) AS span_days, CASE WHEN avg(daily_kwh) > 0 THEN stddev_samp(daily_kwh) / avg(daily_kwh) END AS cv_daily
    FROM r_daily WHERE hours_recorded >= 1 GROUP BY user_id"""
ROLES["r_f_month"] = """SELECT user_id, count(*) AS months_observed, max(k / t) AS max_month_share,
    CASE WHEN count(*) > 1 THEN -sum(k / t * ln(k / t)) / ln(count(*)) ELSE 0 END AS monthly_entropy,
    coalesce(sum(k) FILTER (WHERE month IN (6, 7, 8)), 0) / nullif(coalesce(sum(k) FILTER (WHERE month IN (12, 1, 2)), 0), 0) AS summer_winter_ratio,
    coalesce(sum(k) FILTER (WHERE month IN (6, 7, 8)), 0) / any_value(t) AS summer_share, coalesce(sum(k) FILTER (WHERE month IN (12, 1, 2)), 0) / any_value(t) AS winter_share
    FROM (SELECT *, sum(k) OVER (PARTITION BY user_id) AS t FROM (SELECT user_id, year(date) AS year, month(date) AS month, sum(daily_kwh) AS k FROM r_daily GROUP BY ALL)) GROUP BY user_id"""
ROLES["r_resp"] = """SELECT d.user_id, d.date, d.daily_kwh, u.province, c.is_holiday AS h, c.is_holiday_national AS n, c.is_holiday_regional AS r, c.is_bridge_day AS b,
    isodow(d.date) >= 6 AS we, d.daily_kwh <= 1 AND (coalesce(lag(d.daily_kwh <= 1) OVER w, FALSE) OR coalesce(lead(d.daily_kwh <= 1) OVER w, FALSE)) AS low_spell
    FROM r_daily d JOIN (SELECT s_suppkey AS user_id, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS province FROM supplier) u USING (user_id)
    JOIN r_calendar c ON c.province = u.province AND c.date = d.date WINDOW w AS (PARTITION BY d.user_id ORDER BY d.date)"""
ROLES["r_f_resp"] = """SELECT user_id, avg(CAST(h AS INTEGER)) AS holiday_rate, avg(CAST(n AS INTEGER)) AS national_rate, avg(CAST(r AS INTEGER)) AS regional_rate,
    avg(CAST(b AS INTEGER)) AS bridge_rate, avg(CAST(low_spell AS INTEGER)) AS low_spell_rate,
    avg(daily_kwh) FILTER (WHERE h) / nullif(avg(daily_kwh) FILTER (WHERE NOT h), 0) AS holiday_ratio,
    avg(daily_kwh) FILTER (WHERE n) / nullif(avg(daily_kwh) FILTER (WHERE NOT h), 0) AS national_ratio,
    avg(daily_kwh) FILTER (WHERE r) / nullif(avg(daily_kwh) FILTER (WHERE NOT h), 0) AS regional_ratio,
    avg(CAST(r AS INTEGER)) / nullif(avg(CAST(n AS INTEGER)), 0) AS regional_to_national,
    avg(daily_kwh) FILTER (WHERE we) / nullif(avg(daily_kwh) FILTER (WHERE NOT we), 0) AS weekend_weekday_daily_ratio FROM r_resp GROUP BY user_id"""
_CORR = "CASE WHEN var_pop({x}) > 1e-12 AND var_pop(daily_kwh) > 1e-12 THEN covar_pop(daily_kwh, {x}) / sqrt(var_pop(daily_kwh) * var_pop({x})) END"
ROLES["r_f_climate"] = f"""SELECT user_id, {_CORR.format(x='hdd')} AS corr_hdd, {_CORR.format(x='cdd')} AS corr_cdd, {_CORR.format(x='tmean')} AS corr_tmean,
    avg(hdd) AS mean_hdd, avg(cdd) AS mean_cdd FROM r_panel WHERE tmean IS NOT NULL GROUP BY user_id HAVING count(*) >= 90"""
ROLES["r_mom"] = """SELECT user_id, count(*) AS n_obs, avg(daily_kwh) AS ym, var_samp(daily_kwh) AS yy, var_samp(hdd) AS s11, var_samp(cdd) AS s22,
    covar_samp(hdd, cdd) AS s12, covar_samp(hdd, daily_kwh) AS s1y, covar_samp(cdd, daily_kwh) AS s2y
    FROM r_panel WHERE hdd IS NOT NULL AND cdd IS NOT NULL GROUP BY user_id HAVING count(*) >= 60"""
ROLES["r_b"] = """SELECT *, CASE WHEN s11 > 1e-9 AND s22 > 1e-9 AND s11 * s22 - s12 * s12 > 1e-9 * s11 * s22 THEN (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12)
    WHEN s11 > 1e-9 THEN s1y / s11 END AS b1, CASE WHEN s11 > 1e-9 AND s22 > 1e-9 AND s11 * s22 - s12 * s12 > 1e-9 * s11 * s22 THEN (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12)
    WHEN NOT s11 > 1e-9 AND s22 > 1e-9 THEN s2y / s22 END AS b2 FROM r_mom"""
ROLES["r_f_ols"] = """SELECT user_id, n_obs, b1 AS beta_hdd, b2 AS beta_cdd, CASE WHEN yy > 1e-9 AND (b1 IS NOT NULL OR b2 IS NOT NULL) THEN
    (coalesce(b1 * s1y, 0) + coalesce(b2 * s2y, 0)) / yy END AS r2_joint, b1 / nullif(ym, 0) AS beta_hdd_norm, b2 / nullif(ym, 0) AS beta_cdd_norm FROM r_b"""
ROLES["r_f_ext"] = """SELECT user_id, count(*) FILTER (WHERE kwh > 6) AS n_extreme_hourly, 100.0::DOUBLE * count(*) FILTER (WHERE kwh > 6) / count(*) AS pct_extreme_hourly,
    (100.0::DOUBLE * count(*) FILTER (WHERE kwh > 6) / count(*) > 3) OR count(*) FILTER (WHERE kwh > 6) > 50 AS has_sustained_extreme FROM r_meter GROUP BY user_id"""
ROLES["r_context"] = """SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS province, r_name AS region, n_nationkey % 2 = 0 AS coastal_flag,
    CASE WHEN n_nationkey % 3 = 0 THEN 'dense' WHEN n_nationkey % 3 = 1 THEN 'medium' END AS density_bucket FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 9"""
ROLES["r_features"] = """
    SELECT s.*, d.* EXCLUDE (user_id), m.* EXCLUDE (user_id), coalesce(holiday_rate, 0) AS holiday_rate, coalesce(national_rate, 0) AS national_rate,
      coalesce(regional_rate, 0) AS regional_rate, coalesce(bridge_rate, 0) AS bridge_rate, coalesce(low_spell_rate, low_day_rate) AS low_spell_rate,
      holiday_ratio, national_ratio, regional_ratio, coalesce(regional_to_national, 0) AS regional_to_national, weekend_weekday_daily_ratio,
      u.province, u.tariff_clean, u.p1_kw, CASE WHEN u.activity IS NOT NULL AND CAST(CAST(activity AS DOUBLE) AS INTEGER) > 0
        THEN lpad(CAST(CAST(CAST(activity AS DOUBLE) AS INTEGER) AS VARCHAR), 4, '0') END AS activity_code,
      coalesce(u.tariff IN ('2.0TD', '2.0DHA', '3.0TD'), FALSE) AS is_residential_strict,
      coalesce(u.tariff IN ('2.0TD', '2.0DHA', '3.0TD'), FALSE) OR ((u.tariff IS NULL OR trim(u.tariff) = '') AND coalesce(u.p1_kw <= 15, FALSE)) AS is_residential_permissive,
      coalesce(x.n_extreme_hourly, 0) AS n_extreme_hourly, coalesce(x.pct_extreme_hourly, 0) AS pct_extreme_hourly, coalesce(x.has_sustained_extreme, FALSE) AS has_sustained_extreme,
      c.* EXCLUDE (user_id), o.* EXCLUDE (user_id), coalesce(g.region, 'unknown') AS region, coalesce(g.coastal_flag, FALSE) AS coastal_flag,
      coalesce(g.density_bucket, 'unknown') AS density_bucket, ln(1 + mean_daily_kwh) AS log_mean_daily_kwh,
      (low_day_rate >= 0.50) OR (zero_day_rate >= 0.20) OR (max_month_share >= 0.16) AS intermittent_home,
      (low_day_rate >= 0.35) AND (morning_share >= 0.22) AND (peak_share <= 0.28) AS second_home
    FROM r_f_shape s JOIN r_f_daily d USING (user_id) LEFT JOIN r_f_month m USING (user_id) LEFT JOIN r_f_resp p USING (user_id)
    JOIN r_user u USING (user_id) LEFT JOIN r_f_ext x USING (user_id) LEFT JOIN r_f_climate c USING (user_id)
    LEFT JOIN r_f_ols o USING (user_id) LEFT JOIN r_context g ON g.province = u.province"""

TARIFFS = ("2.0TD", "2.0DHA", "3.0TD")


def context(spark, sf):
    n, r = R.table(spark, sf, "nation"), R.table(spark, sf, "region")
    k = F.col("n_nationkey")
    return (n.where("n_nationkey <> 9").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lpad(k.cast("string"), 2, "0").alias("province"), F.col("r_name").alias("region"), (k % 2 == 0).alias("coastal_flag"),
        F.when(k % 3 == 0, "dense").when(k % 3 == 1, "medium").alias("density_bucket")))


def response_panel(spark, sf, daily=None):
    d = (R.daily(spark, sf) if daily is None else daily).join(R.meter_province(spark, sf), "user_id").join(
        broadcast_if_small(stage(_calendar(spark, sf))), ["province", "date"])
    return d.withColumn("is_weekend", C.is_weekend("date"))


def feature_table(spark, sf):
    # The daily table feeds five blocks: the hourly fact is rolled up once and written,
    # as the daily layer of the pipeline is.
    daily = stage(R.daily(spark, sf))
    p = R.panel(spark, sf, daily)
    return features.assemble(
        features.shape_features(features.hour_cells(R.meter(spark, sf))), features.daily_stats(daily, full=1),
        features.monthly_behaviour(daily, full=1), features.calendar_response(response_panel(spark, sf, daily)),
        features.climate_correlation(p), features.ols2(p, "user_id", "daily_kwh", "hdd", "cdd"),
        quality.extremes(R.meter(spark, sf), 6.0, pct_limit=3.0), R.user_dimension(spark, sf), context(spark, sf), tariffs=TARIFFS)


def _rounded(df, digits=8):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _sql_round(cols, src, digits=8, plain=()):
    return "SELECT " + ", ".join([*plain, *[f"round({c}, {digits}) AS {c}" for c in cols]]) + f" FROM {src}"


_RATIOS = ["ratio_night_day", "ratio_weekend_weekday", "morning_share", "afternoon_share", "evening_share", "night_share",
           "ratio_morning_afternoon", "ratio_evening_morning", "ratio_night_morning", "seasonal_amplitude", "seasonal_amplitude_norm"]
_PEAKS = ["peak_hour", "weekday_peak_hour", "weekend_peak_hour", "peak_shift"]
_TOU = ["valley_kwh_week", "flat_kwh_week", "peak_kwh_week", "valley_share", "flat_share", "peak_share", "peak_to_valley_ratio"]


def _shape(spark, sf):
    return features.shape_features(features.hour_cells(R.meter(spark, sf)))


@query("behaviour_ratios", "D13 D14 C3 E4 B18", _sql_round(_RATIOS, "r_f_shape", plain=["user_id", *_PEAKS]))
def behaviour_ratios(spark, sf):
    return _rounded(_shape(spark, sf).select("user_id", *_PEAKS, *_RATIOS))


@query("tou_shares", "D17 B11", _sql_round(_TOU, "r_f_shape", plain=["user_id"]))
def tou_shares(spark, sf):
    return _rounded(_shape(spark, sf).select("user_id", *_TOU))


_DS = ["mean_daily_kwh", "sd_daily_kwh", "median_daily_kwh", "p90_daily_kwh", "total_kwh", "zero_day_rate", "low_day_rate", "cv_daily"]


@query("daily_stats", "D15 B2", _sql_round(_DS, "r_f_daily", plain=["user_id", "active_days", "first_date", "last_date", "span_days"]))
def daily_stats(spark, sf):
    return _rounded(features.daily_stats(R.daily(spark, sf), full=1))


_MB = ["max_month_share", "monthly_entropy", "summer_winter_ratio", "summer_share", "winter_share"]


@query("monthly_behaviour", "D16 K2", _sql_round(_MB, "r_f_month", plain=["user_id", "months_observed"]))
def monthly_behaviour(spark, sf):
    return _rounded(features.monthly_behaviour(R.daily(spark, sf), full=1))


_CR = ["holiday_rate", "national_rate", "regional_rate", "bridge_rate", "low_spell_rate", "holiday_ratio", "national_ratio",
       "regional_ratio", "regional_to_national", "weekend_weekday_daily_ratio"]


@query("calendar_response", "D18 E5", _sql_round(_CR, "r_f_resp", plain=["user_id"]))
def calendar_response(spark, sf):
    return _rounded(features.calendar_response(response_panel(spark, sf)))


@query("low_spells", "E5", "SELECT user_id, date, low_spell FROM r_resp")
def low_spells(spark, sf):
    d = R.daily(spark, sf)
    return features.low_spells(d).select("user_id", "date", "low_spell")


@query("climate_correlation", "D20", _sql_round(["corr_hdd", "corr_cdd", "corr_tmean", "mean_hdd", "mean_cdd"], "r_f_climate", plain=["user_id"]))
def climate_correlation(spark, sf):
    return _rounded(features.climate_correlation(R.panel(spark, sf)))


@query("climate_slopes", "D21", """
    SELECT user_id, count(*) AS n_obs, round(CASE WHEN var_pop(hdd) > 1e-12 THEN covar_pop(hdd, daily_kwh) / var_pop(hdd) END, 8) AS slope_hdd,
      round(CASE WHEN var_pop(hdd) > 1e-12 AND var_pop(daily_kwh) > 1e-12 THEN covar_pop(hdd, daily_kwh) ** 2 / (var_pop(hdd) * var_pop(daily_kwh)) END, 8) AS r2_hdd,
      round(CASE WHEN var_pop(tmean) > 1e-12 THEN covar_pop(tmean, daily_kwh) / var_pop(tmean) END, 8) AS slope_tmean,
      round(CASE WHEN var_pop(tmean) > 1e-12 AND var_pop(daily_kwh) > 1e-12 THEN covar_pop(tmean, daily_kwh) ** 2 / (var_pop(tmean) * var_pop(daily_kwh)) END, 8) AS r2_tmean
    FROM r_panel WHERE tmean IS NOT NULL GROUP BY user_id HAVING count(*) >= 60""")
def climate_slopes(spark, sf):
    p = R.panel(spark, sf).where("tmean IS NOT NULL")
    return _rounded(features.slopes(p, "user_id", "daily_kwh", ["hdd", "tmean"]))


_OLS = ["beta_hdd", "beta_cdd", "r2_joint", "beta_hdd_norm", "beta_cdd_norm"]


@query("climate_ols", "D22 D23", _sql_round(_OLS, "r_f_ols", plain=["user_id", "n_obs"]))
def climate_ols(spark, sf):
    return _rounded(features.ols2(R.panel(spark, sf), "user_id", "daily_kwh", "hdd", "cdd"))


@query("coefficient_summary", "D24", "WITH l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS coefficient, {c} AS v FROM r_f_ols" for c in _OLS) + """)
    SELECT coefficient, count(v) AS n, round(avg(v), 8) AS mean, round(median(v), 8) AS median, round(quantile_cont(v, 0.9), 8) AS p90
    FROM l WHERE v IS NOT NULL GROUP BY 1""")
def coefficient_summary(spark, sf):
    betas = features.ols2(R.panel(spark, sf), "user_id", "daily_kwh", "hdd", "cdd")
    return _rounded(features.coefficient_summary(betas, _OLS))


_ALL_PLAIN = ["user_id", *_PEAKS, "active_days", "first_date", "last_date", "span_days", "months_observed", "province", "tariff_clean", "p1_kw",
              "activity_code", "is_residential_strict", "is_residential_permissive", "n_extreme_hourly", "has_sustained_extreme", "n_obs", "region",
              "coastal_flag", "density_bucket", "intermittent_home", "second_home"]
_ALL_ROUND = [*features.HOUR_COLUMNS, *_RATIOS, *_TOU, *_DS, *_MB, *_CR, "pct_extreme_hourly", "corr_hdd", "corr_cdd", "corr_tmean", "mean_hdd",
              "mean_cdd", *_OLS, "log_mean_daily_kwh"]


@query("user_features", "C4 B8 B34 B35 B19", _sql_round(_ALL_ROUND, "r_features", plain=_ALL_PLAIN))
def user_features(spark, sf):
    return _rounded(feature_table(spark, sf)).select(*_ALL_PLAIN, *_ALL_ROUND)


_FOCUS = ("00", "01", "02", "03", "05", "07", "12", "18", "20", "23")
_FOCUS_SQL = ", ".join(f"'{p}'" for p in _FOCUS)


@query("pool_funnel", "D29", f"""
    WITH f AS (SELECT province IN ({_FOCUS_SQL}) AS a, is_residential_strict AS b, NOT has_sustained_extreme AS c,
               active_days >= 300 AND mean_daily_kwh > 0 AS d, mean_daily_kwh >= 3.5 AS e FROM r_features),
    n AS (SELECT count(*) AS t, count(*) FILTER (WHERE a) AS s1, count(*) FILTER (WHERE a AND b) AS s2, count(*) FILTER (WHERE a AND b AND c) AS s3,
          count(*) FILTER (WHERE a AND b AND c AND d) AS s4, count(*) FILTER (WHERE a AND b AND c AND d AND e) AS s5 FROM f)
    SELECT unnest(range(0, 6)) AS step_no, unnest(['all', 'in scope', 'residential', 'no sustained extreme', 'enough active days', 'occupied home']) AS step,
           unnest([t, s1, s2, s3, s4, s5]) AS n, unnest([100.0, round(100.0 * s1 / t, 2), round(100.0 * s2 / t, 2), round(100.0 * s3 / t, 2),
           round(100.0 * s4 / t, 2), round(100.0 * s5 / t, 2)])::DOUBLE AS pct FROM n""")
def pool_funnel(spark, sf):
    return checks.funnel(feature_table(spark, sf), features.pool_steps(_FOCUS, 300, 3.5))


def _dictionary(spark, sf):
    f = feature_table(spark, sf)
    audit = checks.column_audit(f)
    position = F.array_position(F.array(*[F.lit(c) for c in f.columns]), F.col("column"))
    return checks.classify_names(audit, features.FEATURE_FAMILIES).withColumn("position", position)


@query("feature_dictionary", "B31 D25")
def feature_dictionary(spark, sf):
    return _dictionary(spark, sf)


@query("feature_family_groups", "D26")
def feature_family_groups(spark, sf):
    return checks.family_groups(_dictionary(spark, sf))


@query("context_audit", "D27", """
    SELECT unnest(['region', 'coastal_flag', 'density_bucket']) AS "column", unnest(['string', 'boolean', 'string']) AS type, n AS n_rows,
           unnest([a, 0, b]) AS n_missing, round(100.0::DOUBLE * unnest([a, 0, b]) / n, 2) AS pct_missing
    FROM (SELECT count(*) AS n, count(*) FILTER (WHERE region = 'unknown') AS a, count(*) FILTER (WHERE density_bucket = 'unknown') AS b FROM r_features)""")
def context_audit(spark, sf):
    f = feature_table(spark, sf).select("region", "coastal_flag", "density_bucket")
    return checks.column_audit(f, placeholders=("", "unknown"))


@query("scope_audit", "D28 B6 E15", f"""
    WITH p AS (SELECT province, count(*) AS n_users FROM r_user WHERE province IS NOT NULL GROUP BY 1),
    t AS (SELECT CAST(sum(n_users) AS BIGINT) AS total_users, CAST(sum(n_users) FILTER (WHERE province IN ({_FOCUS_SQL})) AS BIGINT) AS scope_users FROM p)
    SELECT province, n_users, province IN ({_FOCUS_SQL}) AS in_scope, round(100.0::DOUBLE * n_users / total_users, 2) AS pct_total, scope_users, total_users,
           total_users - scope_users AS excluded_users, round(100.0::DOUBLE * scope_users / total_users, 2) AS scope_pct FROM p, t""")
def scope_audit(spark, sf):
    from loadloom.operators.reports import scope_audit as op
    return op(R.user_dimension(spark, sf), "province", _FOCUS)
