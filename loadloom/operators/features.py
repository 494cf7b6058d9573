"""One wide feature row per user.

The hourly fact is read once into (user, hour) cells and the daily fact once into
(user, month) and (user, day) facts. Every block below is one aggregate by user,
so the blocks come out hash-partitioned on the same key and join without moving
data again.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadloom.config import DEFAULT
from loadloom.functions import aggregates as A
from loadloom.functions import columns as C

HOURS = tuple(range(24))
HOUR_COLUMNS = tuple(f"norm_h{h:02d}" for h in HOURS)
SEASONS = ("winter", "spring", "summer", "autumn")
SHAPE_COLUMNS = ("ratio_night_day", "ratio_weekend_weekday", "seasonal_amplitude_norm", "monthly_entropy",
                 "summer_winter_ratio", "peak_share", "flat_share", "valley_share", "peak_to_valley_ratio")
CLIMATE_COLUMNS = ("beta_hdd_norm", "beta_cdd_norm", "r2_joint")


def _normalised(mean: str) -> list[str]:
    return [f"CASE WHEN _h{h} IS NOT NULL THEN IF({mean} > 0, _h{h} / {mean}, 0D) END AS norm_h{h:02d}" for h in HOURS]


def hour_shape(profile: DataFrame, user="user_id") -> DataFrame:
    """24 columns: the hourly profile divided by the user's mean (zero if the mean is not positive).

    One aggregate instead of a window plus a pivot: the mean and the 24 cells
    come out of the same grouping, with at most 24 input rows per user.
    """
    cells = [F.expr(f"max(mean_kwh) FILTER (WHERE hour = {h}) AS _h{h}") for h in HOURS]
    return profile.groupBy(user).agg(F.avg("mean_kwh").alias("_mean"), *cells).selectExpr(user, *_normalised("_mean"))


def hour_cells(df: DataFrame, user="user_id", ts="ts", value="kwh") -> DataFrame:
    """Mean reading per user and hour: overall, by day type and by season (24 rows per user)."""
    months = {"winter": "12, 1, 2", "spring": "3, 4, 5", "summer": "6, 7, 8", "autumn": "9, 10, 11"}
    aggs = [f"avg({value}) AS m", f"avg({value}) FILTER (WHERE weekday({ts}) < 5) AS m_weekday",
            f"avg({value}) FILTER (WHERE weekday({ts}) >= 5) AS m_weekend"]
    aggs += [f"avg({value}) FILTER (WHERE month({ts}) IN ({m})) AS m_{s}" for s, m in months.items()]
    return (df.where(C.valid_reading(value, user)).groupBy(user, F.hour(ts).alias("hour"))
            .agg(*[F.expr(a) for a in aggs]))


def shape_features(cells: DataFrame, user="user_id") -> DataFrame:
    """Normalised curve, behaviour ratios, peak hours, seasonal amplitude and tariff-period shares.

    A single aggregate over the 24 cells of each user feeds every column.
    """
    def total(col, hours):
        return f"coalesce(sum({col}) FILTER (WHERE {hours}), 0D)"

    def top_hour(col, name):  # highest mean, earliest hour on ties
        return f"max_by(hour, struct({col}, -hour)) FILTER (WHERE {col} IS NOT NULL) AS {name}"

    aggs = [
        "avg(m) AS user_mean", *[f"max(m) FILTER (WHERE hour = {k}) AS _h{k}" for k in HOURS],
        "avg(m) FILTER (WHERE hour <= 6) AS _night", "avg(m) FILTER (WHERE hour >= 7) AS _day",
        "avg(m_weekday) AS _wd", "avg(m_weekend) AS _we", "sum(m) AS _all",
        f"{total('m', 'hour BETWEEN 6 AND 11')} AS _morning", f"{total('m', 'hour BETWEEN 12 AND 17')} AS _afternoon",
        f"{total('m', 'hour >= 18')} AS _evening", f"{total('m', 'hour <= 5')} AS _small",
        top_hour("m", "peak_hour"), top_hour("m_weekday", "weekday_peak_hour"), top_hour("m_weekend", "weekend_peak_hour"),
        *[f"avg(m_{s}) AS _{s}" for s in SEASONS],
        # Five weekdays by tariff period; both weekend days are valley.
        f"{total('m_weekday * 5', 'hour <= 7')} + {total('m_weekend * 2', 'true')} AS valley_kwh_week",
        f"{total('m_weekday * 5', 'hour IN (8, 9, 14, 15, 16, 17, 22, 23)')} AS flat_kwh_week",
        f"{total('m_weekday * 5', 'hour IN (10, 11, 12, 13, 18, 19, 20, 21)')} AS peak_kwh_week"]
    cols = ", ".join(f"_{s}" for s in SEASONS)
    known = f"filter(array({cols}), x -> x IS NOT NULL)"
    amplitude = f"greatest({cols}) - least({cols})"
    week = "valley_kwh_week + flat_kwh_week + peak_kwh_week"
    g = cells.groupBy(user).agg(*[F.expr(a) for a in aggs])
    g = g.selectExpr("*", f"{amplitude} AS seasonal_amplitude", f"{week} AS _week",
                     f"try_divide(aggregate({known}, 0D, (a, x) -> a + x), size({known})) AS _season_mean")
    return g.selectExpr(
        user, *_normalised("user_mean"), "IF(_day > 0, _night / _day, NULL) AS ratio_night_day",
        "IF(_wd > 0, _we / _wd, NULL) AS ratio_weekend_weekday",
        *[f"try_divide(_{p}, _all) AS {n}_share" for p, n in (("morning", "morning"), ("afternoon", "afternoon"),
                                                             ("evening", "evening"), ("small", "night"))],
        "try_divide(_morning, _afternoon) AS ratio_morning_afternoon", "try_divide(_evening, _morning) AS ratio_evening_morning",
        "try_divide(_small, _morning) AS ratio_night_morning", "peak_hour", "weekday_peak_hour", "weekend_peak_hour",
        "abs(weekend_peak_hour - weekday_peak_hour) AS peak_shift", "seasonal_amplitude",
        "IF(_season_mean > 0, seasonal_amplitude / _season_mean, 0D) AS seasonal_amplitude_norm",
        "valley_kwh_week", "flat_kwh_week", "peak_kwh_week",
        *[f"try_divide({p}_kwh_week, _week) AS {p}_share" for p in ("valley", "flat", "peak")],
        "try_divide(peak_kwh_week, valley_kwh_week) AS peak_to_valley_ratio")


def daily_stats(daily: DataFrame, user="user_id", date="date", value="daily_kwh", full=24) -> DataFrame:
    """Level, spread and continuity of complete days. Percentile maps hold one calendar of days."""
    v = F.col(value)
    g = daily.where(C.complete_day(value=value, full=full)).groupBy(user).agg(
        F.avg(v).alias("mean_daily_kwh"), F.stddev_samp(v).alias("sd_daily_kwh"), F.median(v).alias("median_daily_kwh"),
        F.percentile(v, F.lit(0.9)).alias("p90_daily_kwh"), F.sum(v).alias("total_kwh"), F.count(F.lit(1)).alias("active_days"),
        F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        F.avg((v == 0).cast("int")).alias("zero_day_rate"), F.avg((v <= 1).cast("int")).alias("low_day_rate"))
    return g.select("*", F.datediff("last_date", "first_date").alias("span_days"),
                    C.positive_ratio("sd_daily_kwh", "mean_daily_kwh").alias("cv_daily"))


def monthly_behaviour(daily: DataFrame, user="user_id", date="date", value="daily_kwh", full=24) -> DataFrame:
    """Months seen, largest month, normalised entropy and summer/winter contrast.

    The entropy of the shares m/T is ln T - sum(m ln m)/T, so no second pass over
    the months is needed to divide by the total first.
    """
    months = (daily.where(C.complete_day(value=value, full=full))
              .groupBy(user, F.year(date).alias("year"), F.month(date).alias("month")).agg(F.sum(value).alias("k")))
    k, m = F.col("k"), F.col("month")
    g = months.groupBy(user).agg(
        F.count(F.lit(1)).alias("months_observed"), F.sum(k).alias("_t"), F.max(k).alias("_max"),
        F.count_if(k > 0).alias("_n"), F.sum(F.when(k > 0, k * F.ln(k))).alias("_klnk"),
        A.sum_where(m.isin(6, 7, 8), k).alias("_s"), A.sum_where(m.isin(12, 1, 2), k).alias("_w"))
    entropy = C.ratio(F.ln(F.when(F.col("_t") > 0, F.col("_t"))) - C.ratio("_klnk", "_t"), F.ln(F.when(F.col("_n") > 0, F.col("_n"))))
    return g.select(
        user, "months_observed", C.positive_ratio("_max", "_t").alias("max_month_share"),
        F.when(F.col("_n") > 1, entropy).otherwise(F.lit(0.0)).alias("monthly_entropy"),
        C.ratio("_s", "_w").alias("summer_winter_ratio"), C.ratio("_s", "_t").alias("summer_share"),
        C.ratio("_w", "_t").alias("winter_share"))


def low_spells(daily: DataFrame, user="user_id", date="date", value="daily_kwh", low=1.0) -> DataFrame:
    """Flag low days that touch another low observed day (one calendar per window)."""
    w = Window.partitionBy(user).orderBy(date)
    is_low = F.col(value) <= low
    beside = F.coalesce(F.lag(is_low).over(w), F.lit(False)) | F.coalesce(F.lead(is_low).over(w), F.lit(False))
    return daily.withColumn("low_spell", is_low & beside)


def calendar_response(panel: DataFrame, user="user_id", value="daily_kwh") -> DataFrame:
    """Rates of special days and the energy on them relative to ordinary days.

    Uses the holiday split when the panel has it, else treats all holidays as national.
    """
    v = F.col(value)
    cols = set(panel.columns)
    hol = F.col("is_holiday")
    nat = F.col("is_holiday_national") if "is_holiday_national" in cols else hol
    reg = F.col("is_holiday_regional") if "is_holiday_regional" in cols else F.lit(False)
    p = low_spells(panel, user, value=value)
    g = p.groupBy(user).agg(
        *[F.avg(c.cast("int")).alias(n) for n, c in {
            "holiday_rate": hol, "national_rate": nat, "regional_rate": reg, "bridge_rate": F.col("is_bridge_day"),
            "low_spell_rate": F.col("low_spell")}.items()],
        A.mean_where(hol, v).alias("_h"), A.mean_where(nat, v).alias("_n"), A.mean_where(reg, v).alias("_r"),
        A.mean_where(~hol, v).alias("_o"), A.mean_where(F.col("is_weekend"), v).alias("_we"),
        A.mean_where(~F.col("is_weekend"), v).alias("_wd"))
    return g.select(
        user, "holiday_rate", "national_rate", "regional_rate", "bridge_rate", "low_spell_rate",
        C.ratio("_h", "_o").alias("holiday_ratio"), C.ratio("_n", "_o").alias("national_ratio"),
        C.ratio("_r", "_o").alias("regional_ratio"), C.ratio("regional_rate", "national_rate").alias("regional_to_national"),
        C.ratio("_we", "_wd").alias("weekend_weekday_daily_ratio"))


def climate_correlation(panel: DataFrame, user="user_id", value="daily_kwh", min_n=90) -> DataFrame:
    g = panel.where(F.col("tmean").isNotNull()).groupBy(user).agg(
        F.count(F.lit(1)).alias("_n"), A.safe_corr(value, "hdd").alias("corr_hdd"), A.safe_corr(value, "cdd").alias("corr_cdd"),
        A.safe_corr(value, "tmean").alias("corr_tmean"), F.avg("hdd").alias("mean_hdd"), F.avg("cdd").alias("mean_cdd"))
    return g.where(F.col("_n") >= min_n).drop("_n")


def slopes(df: DataFrame, key, y, xs: Sequence[str], min_n=60) -> DataFrame:
    """Univariate slope and R2 of ``y`` on each regressor."""
    aggs = []
    for x in xs:
        aggs += [A.safe_slope(y, x).alias(f"slope_{x}"), A.safe_r2(y, x).alias(f"r2_{x}")]
    return df.groupBy(key).agg(F.count(y).alias("n_obs"), *aggs).where(F.col("n_obs") >= min_n)


def ols2(df: DataFrame, key, y, x1, x2, min_n=60, tol=1e-9) -> DataFrame:
    """Least squares ``y ~ x1 + x2`` per key from second moments: one aggregate, no UDF.

    A regressor without variance, or one that repeats the first, gets a null
    coefficient and the other is fitted alone.
    """
    a, b, c = A._paired(y, x1, x2)
    g = df.groupBy(key).agg(
        F.count(a).alias("n_obs"), F.avg(a).alias("y_mean"), F.var_samp(a).alias("_yy"), F.var_samp(b).alias("_11"),
        F.var_samp(c).alias("_22"), F.covar_samp(b, c).alias("_12"), F.covar_samp(b, a).alias("_1y"),
        F.covar_samp(c, a).alias("_2y")).where(F.col("n_obs") >= min_n)
    s11, s22, s12, s1y, s2y, syy = (F.col(n) for n in ("_11", "_22", "_12", "_1y", "_2y", "_yy"))
    flat1, flat2 = s11 <= tol, s22 <= tol
    det = s11 * s22 - s12 * s12
    both = ~flat1 & ~flat2 & (det > tol * s11 * s22)
    b1 = F.when(both, (s22 * s1y - s12 * s2y) / det).when(~flat1, s1y / s11)
    b2 = F.when(both, (s11 * s2y - s12 * s1y) / det).when(flat1 & ~flat2, s2y / s22)
    fitted = g.select(key, "n_obs", "y_mean", "_1y", "_2y", "_yy", b1.alias(f"beta_{x1}"), b2.alias(f"beta_{x2}"))
    explained = F.coalesce(F.col(f"beta_{x1}") * s1y, F.lit(0.0)) + F.coalesce(F.col(f"beta_{x2}") * s2y, F.lit(0.0))
    r2 = F.when((syy > tol) & (F.col(f"beta_{x1}").isNotNull() | F.col(f"beta_{x2}").isNotNull()), explained / syy)
    return fitted.select(key, "n_obs", f"beta_{x1}", f"beta_{x2}", r2.alias("r2_joint"),
                         C.ratio(f"beta_{x1}", "y_mean").alias(f"beta_{x1}_norm"),
                         C.ratio(f"beta_{x2}", "y_mean").alias(f"beta_{x2}_norm"))


def coefficient_summary(betas: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Non-null count, median and p90 of each coefficient, exact for any number of users."""
    from loadloom.operators.ranks import percentiles

    long = betas.unpivot([], list(cols), "coefficient", "value").where(F.col("value").isNotNull())
    n = long.groupBy("coefficient").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    return n.join(percentiles(long, "value", {"median": 0.5, "p90": 0.9}, by=["coefficient"]), "coefficient")


def assemble(shape: DataFrame, stats: DataFrame, months: DataFrame, response: DataFrame, climate: DataFrame,
             betas: DataFrame, extremes: DataFrame, users: DataFrame, context: DataFrame, user="user_id",
             key="province", tariffs: Iterable[str] = DEFAULT.residential_tariffs) -> DataFrame:
    """Join the blocks (inner: shape, stats, users; left: the rest), fill and derive."""
    users = users.select(user, key, "tariff_clean", "p1_kw", C.activity_code("activity").alias("activity_code"),
                         C.residential_strict("tariff", tariffs).alias("is_residential_strict"),
                         C.residential_permissive("tariff", "p1_kw", tariffs).alias("is_residential_permissive"))
    df = (shape.join(stats, user).join(months, user, "left").join(response, user, "left").join(users, user)
          .join(extremes, user, "left").join(climate, user, "left").join(betas, user, "left").join(context, key, "left"))
    df = df.fillna(0, ["n_extreme_hourly", "pct_extreme_hourly", "holiday_rate", "national_rate", "regional_rate",
                       "regional_to_national", "bridge_rate"])
    df = df.fillna("unknown", ["region", "density_bucket"]).fillna(False, ["has_sustained_extreme", "coastal_flag"])
    return df.withColumns({
        "low_spell_rate": F.coalesce("low_spell_rate", "low_day_rate"),
        "log_mean_daily_kwh": F.log1p("mean_daily_kwh"),
        "intermittent_home": C.intermittent_home("low_day_rate", "zero_day_rate", "max_month_share"),
        "second_home": C.second_home("low_day_rate", "morning_share", "peak_share")})


def pool_steps(provinces: Iterable[str], min_days=DEFAULT.min_active_days, min_kwh=DEFAULT.min_daily_kwh) -> list:
    """Ordered conditions of the clustering pool."""
    return [
        ("in scope", C.in_scope("province", provinces)),
        ("residential", F.col("is_residential_strict")),
        ("no sustained extreme", ~F.coalesce("has_sustained_extreme", F.lit(False))),
        ("enough active days", (F.col("active_days") >= min_days) & (F.col("mean_daily_kwh") > 0)),
        ("occupied home", F.col("mean_daily_kwh") >= min_kwh),
    ]


# Name patterns of the feature families, first match wins.
FEATURE_FAMILIES = (
    (r"^(user_id|province)$", "identity and scope"),
    (r"^norm_h[0-9]{2}$", "normalised hourly profile"),
    (r"^(ratio_|morning_|afternoon_|evening_|night_share|peak_hour|weekday_peak|weekend_peak|peak_shift|seasonal_)", "behaviour ratios"),
    (r"^(mean_daily|sd_daily|median_daily|p90_daily|total_kwh|active_days|first_date|last_date|span_days|zero_day|low_day|cv_daily|log_mean)", "level and variability"),
    (r"^(months_observed|max_month_share|monthly_entropy|summer_|winter_share)", "monthly behaviour"),
    (r"^(valley_|flat_|peak_kwh|peak_share|peak_to_valley)", "tariff periods"),
    (r"^(holiday_|national_|regional_|bridge_|weekend_weekday|low_spell)", "calendar response"),
    (r"^(tariff|p1_kw|activity|is_residential)", "contract metadata"),
    (r"^(region|coastal_flag|density_bucket|climate_zone)$", "territorial context"),
    (r"(extreme)", "quality and outliers"),
    (r"^(corr_|mean_hdd|mean_cdd|beta_|r2_joint|n_obs)", "climate sensitivity"),
    (r"^(intermittent_home|second_home)$", "exploratory proxies"),
)
