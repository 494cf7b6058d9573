"""Calendar and weather dimensions, their audits and the merged daily panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadloom.functions import columns as C
from loadloom.operators import calendars, weather
from loadloom.plans import roles as R
from loadloom.plans.registry import query
from loadloom.sources.stage import broadcast_if_small, stage

R8 = lambda c: F.round(c, 8)

RULES = ((("01", "20"), (-3, 1), ((7, 25),), "North"), (("05", "12", "20"), (), ((5, 2), (5, 15), (7, 25)), "Centre"))

# The SQL twin of Easter uses the same published computus; tests compare it with known dates.
_SPINE = "SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM r_daily"
_CAL = f"""
    WITH sp AS ({_SPINE}), yr AS (SELECT DISTINCT year(date) AS y FROM sp),
    e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM yr),
    e2 AS (SELECT y, a, c, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h, b % 4 AS e FROM e1),
    e3 AS (SELECT y, a, h, (32 + 2 * e + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e2),
    e4 AS (SELECT y, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS n FROM e3),
    ea AS (SELECT y, make_date(y, n // 31, n % 31 + 1) AS easter FROM e4),
    nat AS (SELECT make_date(y, m, d) AS date FROM yr, (VALUES (1, 1), (1, 6), (5, 1), (8, 15), (10, 12), (11, 1), (12, 6), (12, 8), (12, 25)) f(m, d)
            UNION SELECT easter - 2 FROM ea),
    reg0 AS (SELECT p AS province, easter + o AS date, 'North' AS label FROM ea, (VALUES ('01'), ('20')) p(p), (VALUES (-3), (1)) o(o)
      UNION SELECT p, make_date(y, 7, 25), 'North' FROM yr, (VALUES ('01'), ('20')) p(p)
      UNION SELECT p, make_date(y, m, d), 'Centre' FROM yr, (VALUES ('05'), ('12'), ('20')) p(p), (VALUES (5, 2), (5, 15), (7, 25)) f(m, d)),
    reg AS (SELECT province, date, string_agg(label, '; ' ORDER BY label) AS label FROM reg0 GROUP BY ALL),
    prov AS (SELECT DISTINCT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS province FROM supplier),
    g AS (SELECT prov.province, sp.date, nat.date IS NOT NULL AS n, reg.date IS NOT NULL AS r, reg.label,
                 sp.date - easter BETWEEN -3 AND 1 AS is_easter_window
          FROM prov CROSS JOIN sp LEFT JOIN nat ON nat.date = sp.date LEFT JOIN reg ON reg.province = prov.province AND reg.date = sp.date
          JOIN ea ON ea.y = year(sp.date)),
    cal AS (SELECT province, date, n OR r AS is_holiday, n AS is_holiday_national, r AS is_holiday_regional,
      CASE WHEN n AND r THEN 'national_and_regional' WHEN n THEN 'national' WHEN r THEN 'regional' ELSE 'none' END AS holiday_scope,
      concat_ws('; ', CASE WHEN n THEN 'National' END, label) AS holiday_label, is_easter_window,
      CAST(least(30, date - max(CASE WHEN n OR r THEN date END) OVER (PARTITION BY province ORDER BY date),
        min(CASE WHEN n OR r THEN date END) OVER (PARTITION BY province ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - date) AS INTEGER) AS days_to_holiday,
      isodow(date) <= 5 AND NOT (n OR r) AND (lag(n OR r, 1, FALSE) OVER (PARTITION BY province ORDER BY date)
        OR lead(n OR r, 1, FALSE) OVER (PARTITION BY province ORDER BY date)) AS is_bridge_day FROM g)
    """


def _calendar(spark, sf):
    keys = R.meter_province(spark, sf).select("province")
    return calendars.calendar(keys, calendars.spine_of(R.meter(spark, sf).select("date")), RULES)


@query("calendar", "H1 H2 H3 H4 E9 E10 C10 G9", _CAL + "SELECT * FROM cal")
def calendar(spark, sf):
    return _calendar(spark, sf)


@query("calendar_holidays_by_scope", "H4", _CAL + """
    SELECT province, holiday_scope, count(*) AS n_days, count(*) FILTER (WHERE is_bridge_day) AS n_bridges FROM cal GROUP BY ALL""")
def calendar_holidays_by_scope(spark, sf):
    return _calendar(spark, sf).groupBy("province", "holiday_scope").agg(
        F.count(F.lit(1)).alias("n_days"), F.count_if("is_bridge_day").alias("n_bridges"))


_DAYLIGHT = """24.0 / pi() * acos(greatest(-1.0, least(1.0, (sin(radians(-0.833)) - sin(radians({lat})) * sin({d})) / (cos(radians({lat})) * cos({d})))))"""
_TILT = "asin(sin(radians(23.44)) * sin(2 * pi() * (dayofyear(date) - 81) / 365.25))"


@query("daylight", "H5", f"""
    WITH g AS (SELECT DISTINCT province, date FROM r_weather)
    SELECT province, date, round({_DAYLIGHT.format(lat='(36 + CAST(province AS INTEGER) * 0.25)', d=_TILT)}, 8) AS daylight_hours FROM g""")
def daylight(spark, sf):
    g = R.weather(spark, sf).select("province", "date")
    lat = "(36 + int(province) * 0.25D)"
    return g.select("province", "date", R8(calendars.daylight_hours("date", lat)).alias("daylight_hours"))


@query("weather_normalized", "H10 B15 E2", """
    SELECT province, station, date, round(tmean, 8) AS tmean, tmax, tmin, prec, round(rh, 8) AS rh, sun, wind,
           round(CASE WHEN tmean IS NOT NULL THEN greatest(0.0, 15 - tmean) END, 8) AS hdd, round(greatest(0.0, tmean - 22), 8) AS cdd,
           tmax - tmin AS thermal_range, round(tmean - (0.55::DOUBLE - 0.0055::DOUBLE * rh) * (tmean - 14.5::DOUBLE), 8) AS thi FROM r_weather""")
def weather_normalized(spark, sf):
    w = weather.normalize_weather(R.weather(spark, sf))
    return w.withColumns({c: R8(c) for c in ("tmean", "rh", "hdd", "cdd", "thi")})


_STATION = """SELECT s_nationkey, l_suppkey AS station, CAST(l_shipdate AS DATE) AS date, l_quantity, l_tax FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""


@query("representative_station", "H9", f"""
    WITH n AS (SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS province, station, count(DISTINCT date) AS n_days FROM ({_STATION}) GROUP BY ALL)
    SELECT province, station, n_days, count(*) OVER (PARTITION BY province) AS n_stations FROM n
    QUALIFY row_number() OVER (PARTITION BY province ORDER BY n_days DESC, station) = 1""")
def representative_station(spark, sf):
    m = R.meter(spark, sf).join(R.meter_province(spark, sf), "user_id").select(
        "province", F.col("user_id").alias("station"), "date")
    return weather.representative_station(m)


@query("stations_without_data", "C6 H9", """
    SELECT 'S' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS station FROM nation
    WHERE lpad(CAST(n_nationkey AS VARCHAR), 2, '0') NOT IN (SELECT province FROM r_weather)""")
def stations_without_data(spark, sf):
    mapped = R.table(spark, sf, "nation").select(F.concat(F.lit("S"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("station"))
    return mapped.join(R.weather(spark, sf).select("station").distinct(), "station", "left_anti")


_M = ("tmean", "tmax", "tmin", "prec", "rh", "sun", "wind")
_PAD = f"""
    WITH sp AS ({_SPINE}), k AS (SELECT DISTINCT province, station FROM r_weather),
    pad AS (SELECT k.province, k.station, sp.date, w.date IS NOT NULL AS row_present, w.date IS NULL AS row_imputed,
            {', '.join('w.' + m for m in _M)} FROM k CROSS JOIN sp LEFT JOIN r_weather w ON w.province = k.province AND w.station = k.station AND w.date = sp.date)
    """
_SEAS = ", ".join(f"coalesce(avg({m}) OVER (PARTITION BY station, dayofyear(date)), avg({m}) OVER (PARTITION BY station)) AS s_{m}" for m in _M)
_BACK = "OVER (PARTITION BY station ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_AHEAD = "OVER (PARTITION BY station ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_ENDS = ", ".join(
    f"last_value({m} - s_{m} IGNORE NULLS) {_BACK} AS r0_{m}, last_value(CASE WHEN {m} IS NOT NULL THEN date END IGNORE NULLS) {_BACK} AS d0_{m}, "
    f"first_value({m} - s_{m} IGNORE NULLS) {_AHEAD} AS r1_{m}, first_value(CASE WHEN {m} IS NOT NULL THEN date END IGNORE NULLS) {_AHEAD} AS d1_{m}"
    for m in _M)
_FILL = ", ".join(
    f"coalesce({m}, s_{m} + coalesce(r0_{m} + (r1_{m} - r0_{m}) * (CAST(date - d0_{m} AS DOUBLE) / nullif(d1_{m} - d0_{m}, 0)), r0_{m}, r1_{m})) AS {m}, "
    f"{m} IS NULL AS {m}_imputed" for m in _M)
_IMPUTED = _PAD + f"""
    , s AS (SELECT *, {_SEAS} FROM pad), e AS (SELECT *, {_ENDS} FROM s),
    f AS (SELECT province, station, date, row_present, row_imputed, {_FILL} FROM e),
    fix AS (SELECT * REPLACE (least(tmin, tmean, tmax) AS tmin, greatest(tmin, tmean, tmax) AS tmax, greatest(0.0, prec) AS prec,
            greatest(0.0, sun) AS sun, greatest(0.0, wind) AS wind, least(100.0, greatest(0.0, rh)) AS rh),
            {' + '.join(f'CAST({m}_imputed AS INTEGER)' for m in _M)} AS n_values_imputed FROM f)
    """


def _imputed(spark, sf):
    return weather.complete_weather(R.weather(spark, sf), calendars.spine_of(R.meter(spark, sf)))


@query("weather_padded", "H6 A10", _PAD + "SELECT province, station, date, row_present, row_imputed, prec FROM pad")
def weather_padded(spark, sf):
    w = R.weather(spark, sf)
    return weather.pad_daily(w, ["province", "station"], calendars.spine_of(R.meter(spark, sf))).select(
        "province", "station", "date", "row_present", "row_imputed", "prec")


@query("weather_imputed", "H7 H8 B16 B17", _IMPUTED + f"""
    SELECT province, station, date, {', '.join(f'round({m}, 8) AS {m}, {m}_imputed' for m in _M)}, n_values_imputed,
           n_values_imputed > 0 OR row_imputed AS any_imputed FROM fix""")
def weather_imputed(spark, sf):
    w = _imputed(spark, sf)
    return w.select("province", "station", "date", *[F.round(m, 8).alias(m) for m in _M], *[f"{m}_imputed" for m in _M],
                    "n_values_imputed", "any_imputed")


@query("imputation_summary", "D32 B27 G6", _IMPUTED + ", u AS (" + " UNION ALL ".join(
    f"SELECT province, station, count(*) AS n_days, '{m}' AS measure, count(*) FILTER (WHERE {m}_imputed) AS n_imputed, count(*) FILTER (WHERE {m} IS NULL) AS n_missing_after FROM fix GROUP BY ALL"
    for m in _M) + """) SELECT *, round(100.0::DOUBLE * n_imputed / n_days, 2) AS pct_imputed, CASE WHEN n_missing_after > 0 THEN 'failed'
      WHEN n_imputed = 0 THEN 'complete' WHEN round(100.0::DOUBLE * n_imputed / n_days, 2) <= 10 THEN 'light'
      WHEN round(100.0::DOUBLE * n_imputed / n_days, 2) <= 30 THEN 'moderate' ELSE 'heavy' END AS status FROM u""")
def imputation_summary(spark, sf):
    return weather.imputation_summary(_imputed(spark, sf))


@query("imputation_by_date", "H8 G7", _IMPUTED + f"""
    SELECT province, station, date, row_imputed, n_values_imputed,
           concat_ws(', ', {', '.join(f"CASE WHEN {m}_imputed THEN '{m}' END" for m in _M)}) AS measures
    FROM fix WHERE n_values_imputed > 0 OR row_imputed""")
def imputation_by_date(spark, sf):
    return weather.imputation_by_date(_imputed(spark, sf))


@query("imputation_ranges", "D32", _IMPUTED + """
    SELECT province, station, round(min(CASE WHEN NOT tmean_imputed THEN tmean END), 8) AS observed_min,
      round(max(CASE WHEN NOT tmean_imputed THEN tmean END), 8) AS observed_max, round(min(CASE WHEN tmean_imputed THEN tmean END), 8) AS imputed_min,
      round(max(CASE WHEN tmean_imputed THEN tmean END), 8) AS imputed_max, count(*) FILTER (WHERE tmean_imputed) AS n_imputed FROM fix GROUP BY ALL""")
def imputation_ranges(spark, sf):
    r = weather.imputation_ranges(_imputed(spark, sf))
    return r.withColumns({c: F.round(c, 8) for c in ("observed_min", "observed_max", "imputed_min", "imputed_max")})


@query("station_audit", "D32 B27 C4", """
    WITH a AS (SELECT province, station, min(date) AS date_min, max(date) AS date_max, count(DISTINCT date) AS n_days,
      round(100 * avg(CAST(tmean IS NULL AS INTEGER)), 2) AS pct_tmean_missing, round(100 * avg(CAST(prec IS NULL AS INTEGER)), 2) AS pct_prec_missing,
      round(100 * avg(CAST(sun IS NULL AS INTEGER)), 2) AS pct_sun_missing FROM r_weather GROUP BY ALL),
    n AS (SELECT province, count(*) AS n_users FROM r_user GROUP BY 1)
    SELECT a.*, CASE WHEN pct_sun_missing <= 1 THEN 'ok' WHEN pct_sun_missing <= 5 THEN 'review' ELSE 'weak' END AS station_status,
           coalesce(n_users, 0) AS n_users FROM a LEFT JOIN n USING (province)""")
def station_audit(spark, sf):
    return weather.station_audit(R.weather(spark, sf), R.user_dimension(spark, sf))


@query("weather_layers", "D52", _IMPUTED + " ".join([
    "SELECT 'original' AS layer, count(*) AS n_rows, count(DISTINCT station) AS n_stations, min(date) AS date_min, max(date) AS date_max,",
    "count(*) FILTER (WHERE tmean IS NULL) AS n_tmean_missing, count(*) FILTER (WHERE prec IS NULL) AS n_prec_missing, round(avg(tmean), 8) AS mean_tmean,",
    "round(avg(CASE WHEN tmean IS NOT NULL THEN greatest(0.0, 15 - tmean) END), 8) AS mean_hdd, round(avg(greatest(0.0, tmean - 22)), 8) AS mean_cdd FROM r_weather",
    "UNION ALL SELECT 'imputed', count(*), count(DISTINCT station), min(date), max(date), count(*) FILTER (WHERE tmean IS NULL),",
    "count(*) FILTER (WHERE prec IS NULL), round(avg(tmean), 8), round(avg(greatest(0.0, 15 - tmean)), 8), round(avg(greatest(0.0, tmean - 22)), 8) FROM fix"]))
def weather_layers(spark, sf):
    a = weather.weather_summary(R.weather(spark, sf), "original")
    b = weather.weather_summary(_imputed(spark, sf), "imputed")
    return a.unionByName(b).withColumns({c: F.round(c, 8) for c in ("mean_tmean", "mean_hdd", "mean_cdd")})


@query("extreme_days", "E6 C12", """
    WITH q AS (SELECT station, quantile_cont(tmax, 0.95) AS hi, quantile_cont(tmin, 0.05) AS lo FROM r_weather GROUP BY 1)
    SELECT province, date, tmax >= hi AS is_heatwave, tmin <= lo AS is_coldwave FROM r_weather JOIN q USING (station)""")
def extreme_days(spark, sf):
    return weather.extreme_days(R.weather(spark, sf)).select("province", "date", "is_heatwave", "is_coldwave")


@query("extreme_runs", "E7 C12", """
    WITH q AS (SELECT station, quantile_cont(tmax, 0.6) FILTER (WHERE month(date) BETWEEN 6 AND 9) AS hi,
                      quantile_cont(tmin, 0.4) FILTER (WHERE month(date) IN (12, 1, 2)) AS lo FROM r_weather GROUP BY 1),
    f AS (SELECT province, station, date, tmax >= hi AS hot, tmin <= lo AS cold FROM r_weather JOIN q USING (station)),
    r AS (SELECT *, hot AND lag(hot, 1, FALSE) OVER w AND lag(hot, 2, FALSE) OVER w AS hr, cold AND lag(cold, 1, FALSE) OVER w AND lag(cold, 2, FALSE) OVER w AS cr
          FROM f WINDOW w AS (PARTITION BY station ORDER BY date))
    SELECT province, date, hr OR lead(hr, 1, FALSE) OVER w OR lead(hr, 2, FALSE) OVER w AS is_heatwave,
           cr OR lead(cr, 1, FALSE) OVER w OR lead(cr, 2, FALSE) OVER w AS is_coldwave
    FROM r WINDOW w AS (PARTITION BY station ORDER BY date)""")
def extreme_runs(spark, sf):
    w = weather.extreme_days(R.weather(spark, sf), mode="run3", hot=0.6, cold=0.4)
    return w.select("province", "date", "is_heatwave", "is_coldwave")


@query("longest_gap_run", "E8", _PAD + """
    , i AS (SELECT station, row_imputed AS f, row_number() OVER (PARTITION BY station ORDER BY date)
              - row_number() OVER (PARTITION BY station, row_imputed ORDER BY date) AS k FROM pad)
    SELECT station, CAST(coalesce(max(n) FILTER (WHERE f), 0) AS BIGINT) AS longest_run FROM (SELECT station, f, k, count(*) AS n FROM i GROUP BY ALL) GROUP BY station""")
def longest_gap_run(spark, sf):
    p = weather.pad_daily(R.weather(spark, sf), ["province", "station"], calendars.spine_of(R.meter(spark, sf)))
    return weather.longest_run(p, ["station"], "date", "row_imputed")


_MERGED = _CAL + f""", lat AS (SELECT DISTINCT province, 36 + CAST(province AS INTEGER) * 0.25 AS latitude FROM prov WHERE province <> '07'),
    us AS (SELECT s_suppkey AS user_id, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS province FROM supplier),
    m AS (SELECT d.user_id, d.date, d.daily_kwh, u.province, w.tmean, w.tmax, w.tmin, w.prec,
      CASE WHEN lat.latitude IS NOT NULL THEN {_DAYLIGHT.format(lat='lat.latitude', d=_TILT.replace('date', 'd.date'))} END AS daylight_hours,
      cal.is_holiday, cal.is_bridge_day, cal.is_easter_window, cal.days_to_holiday, cal.holiday_scope
      FROM r_daily d JOIN us u USING (user_id) LEFT JOIN cal ON cal.province = u.province AND cal.date = d.date
      LEFT JOIN lat ON lat.province = u.province
      LEFT JOIN r_weather w ON w.province = u.province AND w.date = d.date WHERE d.hours_recorded >= 1)
    """


def merged_panel(spark, sf, weather_layer=None):
    lat = R.meter_province(spark, sf).select("province").distinct().where("province <> '07'").select(
        "province", (F.lit(36) + F.col("province").cast("int") * 0.25).alias("latitude"))
    layer = R.weather(spark, sf) if weather_layer is None else weather_layer
    days = broadcast_if_small(stage(weather.day_dimension(_calendar(spark, sf), layer, lat)))
    return weather.merge_daily(R.daily(spark, sf), R.meter_province(spark, sf), days, full=1)


@query("merged_panel", "H11 C1 C2 B35", _MERGED + """
    SELECT user_id, date, daily_kwh, province, round(tmean, 8) AS tmean, tmax, tmin, prec, round(daylight_hours, 6) AS daylight_hours,
      is_holiday, is_bridge_day, is_easter_window, days_to_holiday, holiday_scope, isodow(date) AS dow, week(date) AS week_of_year,
      isodow(date) >= 6 AS is_weekend, CASE WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) IN (3, 4, 5) THEN 'spring'
      WHEN month(date) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season FROM m""")
def merged_panel_query(spark, sf):
    return merged_panel(spark, sf).select(
        "user_id", "date", "daily_kwh", "province", R8("tmean").alias("tmean"), "tmax", "tmin", "prec",
        F.round("daylight_hours", 6).alias("daylight_hours"), "is_holiday", "is_bridge_day", "is_easter_window",
        "days_to_holiday", "holiday_scope", "dow", "week_of_year", "is_weekend", "season")


def _audit_panel(spark, sf):
    """Panel against yesterday's weather, so that some rows have none."""
    w = R.weather(spark, sf).withColumn("date", F.date_add("date", 1))
    flags = w.select("province", "date", "tmean", (F.dayofmonth("date") % 4 == 0).alias("any_imputed"),
                     (F.dayofmonth("date") % 4).alias("n_values_imputed"))
    return R.daily(spark, sf).join(R.meter_province(spark, sf), "user_id").join(flags, ["province", "date"], "left"), w


_AUDIT = """
    WITH p AS (SELECT d.user_id, d.date, u.province, w.tmean, coalesce(day(d.date) % 4 = 0 AND w.date IS NOT NULL, FALSE) AS any_imputed,
           CASE WHEN w.date IS NOT NULL THEN day(d.date) % 4 END AS n_values_imputed
      FROM r_daily d JOIN (SELECT s_suppkey AS user_id, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS province FROM supplier) u USING (user_id)
      LEFT JOIN r_weather w ON w.province = u.province AND w.date = d.date - 1)
    """


@query("merge_audit", "D30 B27", _AUDIT + """
    , a AS (SELECT province, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(tmean) AS n_with_weather,
        count(*) FILTER (WHERE tmean IS NULL) AS n_without_weather, count(*) FILTER (WHERE any_imputed) AS n_imputed,
        count(DISTINCT user_id) FILTER (WHERE any_imputed) AS users_imputed, count(DISTINCT date) FILTER (WHERE any_imputed) AS dates_imputed,
        min(date) AS date_min, max(date) AS date_max, CAST(max(n_values_imputed) AS INTEGER) AS max_values_imputed FROM p GROUP BY 1)
    SELECT *, round(100.0::DOUBLE * n_without_weather / n_rows, 2) AS pct_without, round(100.0::DOUBLE * n_imputed / n_rows, 2) AS pct_imputed,
      CASE WHEN n_without_weather = 0 THEN 'ok' WHEN round(100.0::DOUBLE * n_without_weather / n_rows, 2) <= 0 THEN 'ok'
           WHEN round(100.0::DOUBLE * n_without_weather / n_rows, 2) <= 1 THEN 'low'
           WHEN round(100.0::DOUBLE * n_without_weather / n_rows, 2) <= 5 THEN 'review' ELSE 'fallback' END AS status FROM a""")
def merge_audit(spark, sf):
    return weather.merge_audit(_audit_panel(spark, sf)[0])


@query("missing_weather_reasons", "D31", _AUDIT + """
    , w2 AS (SELECT province, date + 1 AS date, count(tmean) AS t FROM r_weather GROUP BY ALL),
    g AS (SELECT province, date, count(*) AS n_rows, count(DISTINCT user_id) AS n_users FROM p WHERE tmean IS NULL GROUP BY ALL)
    SELECT g.*, CASE WHEN t IS NULL THEN 'no_weather_row' WHEN t = 0 THEN 'no_temperature' ELSE 'not_merged' END AS reason
    FROM g LEFT JOIN w2 USING (province, date)""")
def missing_weather_reasons(spark, sf):
    p, w = _audit_panel(spark, sf)
    return weather.missing_reasons(p, w)


@query("monthly_climate", "D49 B14", """
    SELECT province, CAST(date_trunc('month', date) AS DATE) AS month, round(avg(daily_kwh), 8) AS mean_kwh, round(avg(tmean), 8) AS mean_tmean,
           round(avg(hdd), 8) AS mean_hdd, round(avg(cdd), 8) AS mean_cdd, count(DISTINCT user_id) AS n_users FROM r_panel GROUP BY ALL""")
def monthly_climate(spark, sf):
    return R.panel(spark, sf).groupBy("province", C.month_start("date").alias("month")).agg(
        R8(F.avg("daily_kwh")).alias("mean_kwh"), R8(F.avg("tmean")).alias("mean_tmean"), R8(F.avg("hdd")).alias("mean_hdd"),
        R8(F.avg("cdd")).alias("mean_cdd"), F.countDistinct("user_id").alias("n_users"))
