"""Weather layer: normalise, complete, impute, flag extremes and merge with energy.

Tables here are (station, date) or (province, date) sized. Windows are keyed by
station and so hold one calendar each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadloom.functions import columns as C
from loadloom.operators.ranks import latest_per_key

MEASURES = ("tmean", "tmax", "tmin", "prec", "rh", "sun", "wind")


def normalize_weather(df: DataFrame, keys=("province", "station"), date="date", tie: str | None = None) -> DataFrame:
    """Add absent measures as null, keep one row per key and day, derive the indices."""
    for m in MEASURES:
        if m not in df.columns:
            df = df.withColumn(m, F.lit(None).cast("double"))
    n_known = sum((F.col(m).isNotNull().cast("int") for m in MEASURES), F.lit(0))
    order = [n_known] + [F.col(m) for m in ([tie] if tie else MEASURES)]
    one = latest_per_key(df.select(*keys, date, *MEASURES), [*keys, date], order=order)
    return derive(one)


def derive(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "hdd": C.heating_degrees("tmean"), "cdd": C.cooling_degrees("tmean"),
        "thermal_range": C.thermal_range("tmax", "tmin"), "thi": C.thermal_index("tmean", "rh")})


def representative_station(df: DataFrame, group="province", station="station", date="date") -> DataFrame:
    """The station with most days per group (lowest name on ties)."""
    n = df.groupBy(group, station).agg(F.countDistinct(date).alias("n_days"))
    top = n.groupBy(group).agg(F.max("n_days").alias("n_days"), F.count(F.lit(1)).alias("n_stations"))
    first = n.join(top, [group, "n_days"]).groupBy(group, "n_days", "n_stations").agg(F.min(station).alias(station))
    return first.select(group, station, "n_days", "n_stations")


def pad_daily(df: DataFrame, keys: Sequence[str], spine: DataFrame, date="date") -> DataFrame:
    """Complete grid of keys x days with ``row_present`` and ``row_imputed`` flags."""
    grid = df.select(*keys).distinct().crossJoin(spine.select(date))
    out = grid.join(df.withColumn("row_present", F.lit(True)), [*keys, date], "left")
    out = out.withColumn("row_present", F.coalesce("row_present", F.lit(False)))
    return out.withColumn("row_imputed", ~F.col("row_present"))


def impute_seasonal(df: DataFrame, keys: Sequence[str], cols: Sequence[str], date="date") -> DataFrame:
    """Fill gaps with the day-of-year mean plus an interpolated departure from it.

    Each column gets an ``<col>_imputed`` flag. A column with no observation at
    all in a series stays null; :func:`imputation_summary` reports it.
    """
    part = f"PARTITION BY {', '.join(keys)}"
    # Both directions are running frames (the second on descending dates), which Spark
    # evaluates in one pass; a frame that shrinks towards the end costs a pass per row.
    running = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    back, ahead = f"OVER ({part} ORDER BY {date} {running})", f"OVER ({part} ORDER BY {date} DESC {running})"
    out = df.selectExpr("*", *[f"coalesce(avg({c}) OVER ({part}, dayofyear({date})), avg({c}) OVER ({part})) AS _s_{c}" for c in cols])
    ends = []
    for c in cols:
        seen = f"CASE WHEN {c} IS NOT NULL THEN {date} END"
        for k, frame in enumerate((back, ahead)):
            ends += [f"last({c} - _s_{c}, true) {frame} AS _r{k}_{c}", f"last({seen}, true) {frame} AS _d{k}_{c}"]
    out = out.selectExpr("*", *ends)
    filled = []
    for c in cols:
        step = f"try_divide(double(datediff({date}, _d0_{c})), datediff(_d1_{c}, _d0_{c}))"
        filled.append(f"coalesce({c}, _s_{c} + coalesce(_r0_{c} + (_r1_{c} - _r0_{c}) * {step}, _r0_{c}, _r1_{c})) AS {c}")
        filled.append(f"{c} IS NULL AS {c}_imputed")
    return out.selectExpr(*[x for x in df.columns if x not in cols], *filled)


def repair(df: DataFrame) -> DataFrame:
    """Physical ranges and temperature order after imputation."""
    lo, mid, hi, bad = C.ordered_temperatures("tmin", "tmean", "tmax")
    return df.withColumns({
        "tmin": lo, "tmean": mid, "tmax": hi, "temperature_order_corrected": bad,
        "prec": C.clamp("prec", 0), "sun": C.clamp("sun", 0), "wind": C.clamp("wind", 0), "rh": C.clamp("rh", 0, 100)})


def count_imputed(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    n = sum((F.col(f"{c}_imputed").cast("int") for c in cols), F.lit(0))
    return df.withColumn("n_values_imputed", n).withColumn("any_imputed", (n > 0) | F.col("row_imputed"))


def complete_weather(df: DataFrame, spine: DataFrame, keys=("province", "station")) -> DataFrame:
    """Pad, impute, repair and derive: the imputed weather layer."""
    padded = pad_daily(df.select(*keys, "date", *MEASURES), keys, spine)
    return derive(count_imputed(repair(impute_seasonal(padded, keys, MEASURES)), MEASURES))


def imputation_summary(df: DataFrame, keys=("province", "station"), cols=MEASURES) -> DataFrame:
    """Imputed count and share per station and measure, with a status."""
    one = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"), *[F.count_if(f"{c}_imputed").alias(f"_i_{c}") for c in cols],
        *[F.count_if(F.col(c).isNull()).alias(f"_m_{c}") for c in cols])
    rows = one.select(*keys, "n_days", F.inline(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(f"_i_{c}").alias("n_imputed"),
                 F.col(f"_m_{c}").alias("n_missing_after")) for c in cols])))
    share = C.pct("n_imputed", "n_days")
    status = (F.when(F.col("n_missing_after") > 0, "failed")
              .otherwise(C.threshold_class(share, ((0, "complete"), (10, "light"), (30, "moderate")), "heavy")))
    return rows.select("*", share.alias("pct_imputed"), status.alias("status"))


def imputation_by_date(df: DataFrame, keys=("province", "station"), cols=MEASURES) -> DataFrame:
    """Rows with any imputed value, naming the measures that were filled."""
    names = F.array(*[F.when(F.col(f"{c}_imputed"), c) for c in cols])
    return df.where("any_imputed").select(
        *keys, "date", "row_imputed", "n_values_imputed",
        F.array_join(F.filter(names, lambda x: x.isNotNull()), ", ").alias("measures"))


def imputation_ranges(df: DataFrame, keys=("province", "station")) -> DataFrame:
    """Observed against imputed ranges of the daily mean temperature."""
    imp = F.col("tmean_imputed")
    return df.groupBy(*keys).agg(
        F.min(F.when(~imp, F.col("tmean"))).alias("observed_min"), F.max(F.when(~imp, F.col("tmean"))).alias("observed_max"),
        F.min(F.when(imp, F.col("tmean"))).alias("imputed_min"), F.max(F.when(imp, F.col("tmean"))).alias("imputed_max"),
        F.count_if(imp).alias("n_imputed"))


def station_audit(df: DataFrame, users: DataFrame | None = None, keys=("province", "station"), date="date") -> DataFrame:
    """Range, days and missing shares per station; optional user counts by the first key."""
    def miss(c):
        return F.round(F.lit(100.0) * F.avg(F.col(c).isNull().cast("int")), 2)
    g = df.groupBy(*keys).agg(F.min(date).alias("date_min"), F.max(date).alias("date_max"),
                              F.countDistinct(date).alias("n_days"), miss("tmean").alias("pct_tmean_missing"),
                              miss("prec").alias("pct_prec_missing"), miss("sun").alias("pct_sun_missing"))
    g = g.withColumn("station_status", C.station_status("pct_sun_missing"))
    if users is None:
        return g
    n = users.groupBy(keys[0]).agg(F.count(F.lit(1)).alias("n_users"))
    return g.join(n, keys[0], "left").fillna(0, ["n_users"])


def weather_summary(df: DataFrame, layer: str) -> DataFrame:
    """One row describing a weather layer, so layers can be stacked and compared."""
    return df.agg(
        F.lit(layer).alias("layer"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("station").alias("n_stations"),
        F.min("date").alias("date_min"), F.max("date").alias("date_max"),
        F.count_if(F.col("tmean").isNull()).alias("n_tmean_missing"), F.count_if(F.col("prec").isNull()).alias("n_prec_missing"),
        F.avg("tmean").alias("mean_tmean"), F.avg(C.heating_degrees("tmean")).alias("mean_hdd"),
        F.avg(C.cooling_degrees("tmean")).alias("mean_cdd"))


def extreme_days(df: DataFrame, key="station", date="date", mode="quantile", hot=0.95, cold=0.05) -> DataFrame:
    """Heat- and cold-wave flags.

    ``quantile``: single days beyond the all-year quantile of the key.
    ``run3``: days inside a run of at least three days beyond the quantile of the
    warm (June to September) or cold (December to February) season.
    """
    month = F.month(date)
    warm = month.between(6, 9) if mode == "run3" else F.lit(True)
    cool = month.isin(12, 1, 2) if mode == "run3" else F.lit(True)
    limits = df.groupBy(key).agg(
        F.percentile(F.when(warm, F.col("tmax")), F.lit(hot)).alias("_hi"),
        F.percentile(F.when(cool, F.col("tmin")), F.lit(cold)).alias("_lo"))
    out = df.join(limits, key)
    flags = {"is_heatwave": F.col("tmax") >= F.col("_hi"), "is_coldwave": F.col("tmin") <= F.col("_lo")}
    flags = {n: F.coalesce(c, F.lit(False)) for n, c in flags.items()}
    out = out.withColumns(flags).drop("_hi", "_lo")
    if mode == "quantile":
        return out
    w = Window.partitionBy(key).orderBy(date)
    for f in flags:
        # A day belongs to a run of three when it, with its neighbours, fills any of the three placements.
        at = {k: F.coalesce(F.lag(f, k).over(w) if k > 0 else F.lead(f, -k).over(w), F.lit(False)) for k in (2, 1, -1, -2)}
        run = F.col(f) & ((at[2] & at[1]) | (at[1] & at[-1]) | (at[-1] & at[-2]))
        out = out.withColumn(f"_run_{f}", run)
    return out.withColumns({f: F.col(f"_run_{f}") for f in flags}).drop(*[f"_run_{f}" for f in flags])


def longest_run(df: DataFrame, key: Sequence[str], order: str, flag: str) -> DataFrame:
    """Length of the longest run of TRUE per key (zero when there is none)."""
    w = Window.partitionBy(*key).orderBy(order)
    wf = Window.partitionBy(*key, flag).orderBy(order)
    island = F.row_number().over(w) - F.row_number().over(wf)
    runs = df.select(*key, F.col(flag).alias("_f"), island.alias("_i")).groupBy(*key, "_f", "_i").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(*key).agg(F.coalesce(F.max(F.when(F.col("_f"), F.col("n"))), F.lit(0)).alias("longest_run"))


def day_dimension(calendar: DataFrame, weather: DataFrame, latitude: DataFrame, key="province") -> DataFrame:
    """Calendar, daylight and weather joined once at (key, date).

    Merging the small tables first leaves the fact table a single join instead
    of three.
    """
    from loadloom.operators.calendars import daylight_hours

    lit = latitude.select(key, "latitude")
    base = calendar.join(lit, key, "left").withColumn("daylight_hours", daylight_hours("date", "latitude")).drop("latitude")
    return base.join(weather.drop("station"), [key, "date"], "left")


def merge_daily(daily: DataFrame, users: DataFrame, days: DataFrame, key="province", user="user_id", full=24) -> DataFrame:
    """Complete user-days with their province, weather, daylight and calendar.

    Pass ``days`` through ``broadcast_if_small`` to keep the facts in place while
    it is small; otherwise both sides are shuffled and AQE splits skewed keys.
    """
    facts = daily.where(C.complete_day(full=full)).join(users.select(user, key), user)
    out = facts.join(days, [key, "date"], "left")
    flags = [c for c, t in days.dtypes if t == "boolean"]
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags})
    return out.withColumns({
        "dow": C.iso_dow("date"), "week_of_year": F.weekofyear("date"), "month": F.month("date"), "year": F.year("date"),
        "is_weekend": C.is_weekend("date"), "season": C.season(F.month("date"))})


def merge_audit(panel: DataFrame, key="province", user="user_id") -> DataFrame:
    """Rows, users and dates with, without and with imputed weather per key."""
    t, imp = F.col("tmean"), F.coalesce("any_imputed", F.lit(False))
    per_user = panel.groupBy(key, user).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(t.isNull()).alias("m"), F.count_if(imp).alias("i"),
        F.min("date").alias("a"), F.max("date").alias("b"), F.max("n_values_imputed").alias("x"))
    dates = (panel.where(imp).groupBy(key, "date").agg(F.count(F.lit(1)).alias("_k"))
             .groupBy(key).agg(F.count(F.lit(1)).alias("dates_imputed")))
    g = per_user.groupBy(key).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_users"), F.sum(F.col("n") - F.col("m")).alias("n_with_weather"),
        F.sum("m").alias("n_without_weather"), F.sum("i").alias("n_imputed"), F.count_if(F.col("i") > 0).alias("users_imputed"),
        F.min("a").alias("date_min"), F.max("b").alias("date_max"), F.max("x").alias("max_values_imputed"))
    share = C.pct("n_without_weather", "n_rows")
    return (g.join(dates, key, "left").fillna(0, ["dates_imputed"])
            .withColumns({"pct_without": share, "pct_imputed": C.pct("n_imputed", "n_rows"), "status": C.merge_status(share)}))


def missing_reasons(panel: DataFrame, weather: DataFrame, key="province", user="user_id") -> DataFrame:
    """Days of a key whose rows have no temperature, and why."""
    gone = panel.where(F.col("tmean").isNull()).groupBy(key, "date", user).agg(F.count(F.lit(1)).alias("n"))
    per_day = gone.groupBy(key, "date").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_users"))
    w = weather.groupBy(key, "date").agg(F.count("tmean").alias("_t"))
    return per_day.join(w, [key, "date"], "left").select(
        key, "date", "n_rows", "n_users",
        F.when(F.col("_t").isNull(), "no_weather_row").when(F.col("_t") == 0, "no_temperature")
        .otherwise("not_merged").alias("reason"))
