"""Scalar expressions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadloom.functions import columns as C
from loadloom.plans import roles as R
from loadloom.plans.registry import query

R6 = lambda c: F.round(c, 8)


@query("complete_days", "B2 B3", """
    SELECT user_id, date, daily_kwh, hours_recorded >= 2 AND daily_kwh >= 0 AS complete,
           hours_recorded >= 2 AND daily_kwh > 0 AS complete_positive FROM r_daily""")
def complete_days(spark, sf):
    return R.daily(spark, sf).select("user_id", "date", "daily_kwh", C.complete_day(full=2).alias("complete"),
                                     C.complete_day(full=2, strict=True).alias("complete_positive"))


@query("province_of_contract", "B4 B5 B6", """
    SELECT contract_id, substr(lpad(CAST(postcode AS VARCHAR), 5, '0'), 1, 2) AS province,
           lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS padded,
           substr(lpad(CAST(postcode AS VARCHAR), 5, '0'), 1, 2) IN ('01', '07', '12', '18', '23') AS in_scope
    FROM r_contracts JOIN customer ON user_id = c_custkey""")
def province_of_contract(spark, sf):
    c = R.contracts(spark, sf)
    cust = R.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    return c.join(cust, "user_id").select(
        "contract_id", C.province_code("postcode").alias("province"),
        C.norm_code(F.concat(F.lit(" "), F.col("c_nationkey").cast("string"))).alias("padded"),
        C.in_scope(C.province_code("postcode"), ["01", "07", "12", "18", "23"]).alias("in_scope"))


@query("residential_flags", "B7 B8", """
    SELECT contract_id, coalesce(nullif(trim(tariff), ''), 'unknown') AS tariff_clean,
           coalesce(tariff IN ('2.0TD', '2.0DHA'), FALSE) AS strict,
           coalesce(tariff IN ('2.0TD', '2.0DHA'), FALSE)
             OR ((tariff IS NULL OR trim(tariff) = '') AND coalesce(p1_kw <= 15, FALSE)) AS permissive
    FROM r_contracts""")
def residential_flags(spark, sf):
    return R.contracts(spark, sf).select(
        "contract_id", C.blank_to("tariff", "unknown").alias("tariff_clean"),
        C.residential_strict("tariff").alias("strict"),
        C.residential_permissive("tariff", "p1_kw").alias("permissive"))


@query("time_parts", "B9 B10 B13 B14 B21", """
    SELECT user_id, ts, year(ts) AS year, month(ts) AS month, hour(ts) AS hour, dayofweek(ts) AS dow0,
           isodow(ts) AS iso_dow, week(ts) AS iso_week, dayofyear(ts) AS doy,
           CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) IN (3, 4, 5) THEN 'spring'
                WHEN month(ts) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season,
           CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type,
           CAST(date_trunc('month', ts) AS DATE) AS month_start,
           CASE WHEN isodow(ts) >= 6 OR hour(ts) <= 7 THEN 'valley'
                WHEN hour(ts) IN (10, 11, 12, 13, 18, 19, 20, 21) THEN 'peak' ELSE 'flat' END AS tou
    FROM r_meter""")
def time_parts(spark, sf):
    m = R.meter(spark, sf)
    return m.select("user_id", "ts", F.year("ts").alias("year"), F.month("ts").alias("month"),
                    F.hour("ts").alias("hour"), (F.dayofweek("ts") - 1).alias("dow0"),
                    C.iso_dow("ts").alias("iso_dow"), F.weekofyear("ts").alias("iso_week"),
                    F.dayofyear("ts").alias("doy"), C.season(F.month("ts")).alias("season"),
                    C.day_type("ts").alias("day_type"), C.month_start("date").alias("month_start"),
                    C.tou_period(C.day_type("ts"), "hour").alias("tou"))


@query("tou_and_region", "B11 B12", """
    SELECT CASE WHEN s_nationkey IN (0, 5, 10) THEN 'north' WHEN s_nationkey IN (1, 6, 11) THEN 'south'
                ELSE 'other' END AS region,
           CASE WHEN isodow(ts) >= 6 OR hour <= 7 THEN 'valley'
                WHEN hour IN (10, 11, 12, 13, 18, 19, 20, 21) THEN 'peak' ELSE 'flat' END AS tou,
           sum(kwh) AS kwh, count(*) AS n
    FROM r_meter JOIN supplier ON user_id = s_suppkey GROUP BY ALL""")
def tou_and_region(spark, sf):
    per_user = (R.meter(spark, sf).groupBy("user_id", C.tou_period(C.day_type("ts"), "hour").alias("tou"))
                .agg(F.sum("kwh").alias("kwh"), F.count(F.lit(1)).alias("n")))
    groups = {"north": ["00", "05", "10"], "south": ["01", "06", "11"]}
    return (per_user.join(R.meter_province(spark, sf), "user_id")
            .groupBy(C.region_bucket("province", groups).alias("region"), "tou")
            .agg(F.sum("kwh").alias("kwh"), F.sum("n").alias("n")))


@query("weather_derivations", "B15 B16 B17 H10", """
    SELECT province, date, round(CASE WHEN tmean IS NOT NULL THEN greatest(0.0, 15 - tmean) END, 8) AS hdd,
           round(greatest(0.0, tmean - 22), 8) AS cdd, tmax - tmin AS thermal_range,
           round(tmean - (0.55::DOUBLE - 0.0055::DOUBLE * rh) * (tmean - 14.5::DOUBLE), 8) AS thi,
           least(tmax - 4, tmean, tmin + 4) AS tmin_fixed, greatest(tmax - 4, tmean, tmin + 4) AS tmax_fixed,
           round(tmean, 8) AS tmean_fixed, (tmin + 4 > tmean OR tmean > tmax - 4 OR tmin + 4 > tmax - 4) AS corrected,
           CASE WHEN prec IS NOT NULL THEN greatest(0.0, prec - 1) END AS prec_clamped,
           round(least(60.0, greatest(40.0, rh)), 8) AS rh_clamped
    FROM r_weather""")
def weather_derivations(spark, sf):
    w = R.weather(spark, sf)
    lo, mid, hi, bad = C.ordered_temperatures(F.col("tmin") + 4, "tmean", F.col("tmax") - 4)
    return w.select("province", "date", R6(C.heating_degrees("tmean")).alias("hdd"),
                    R6(C.cooling_degrees("tmean")).alias("cdd"), C.thermal_range("tmax", "tmin").alias("thermal_range"),
                    R6(C.thermal_index("tmean", "rh")).alias("thi"), lo.alias("tmin_fixed"), hi.alias("tmax_fixed"),
                    R6(mid).alias("tmean_fixed"), bad.alias("corrected"),
                    C.clamp(F.col("prec") - 1, lo=0).alias("prec_clamped"),
                    R6(C.clamp("rh", 40, 60)).alias("rh_clamped"))


@query("safe_ratios", "B18 B19 B35", """
    SELECT user_id, round(sum(CASE WHEN kwh < 0 THEN kwh END) / nullif(sum(CASE WHEN kwh >= 0 THEN kwh END), 0), 8) AS neg_share,
           round(CASE WHEN avg(kwh) > 0 THEN max(kwh) / avg(kwh) END, 8) AS peak_ratio,
           round(ln(1 + abs(avg(kwh))), 8) AS log_mean, round(exp(ln(1 + abs(avg(kwh)))) - 1, 8) AS back,
           coalesce(sum(CASE WHEN kwh < 0 THEN kwh END), 0) AS neg_filled
    FROM r_readings GROUP BY user_id""")
def safe_ratios(spark, sf):
    neg, pos = F.sum(F.when(F.col("kwh") < 0, F.col("kwh"))), F.sum(F.when(F.col("kwh") >= 0, F.col("kwh")))
    g = R.readings(spark, sf).groupBy("user_id").agg(
        neg.alias("neg"), pos.alias("pos"), F.avg("kwh").alias("m"), F.max("kwh").alias("x"))
    log_mean = F.log1p(F.abs("m"))
    return g.select("user_id", R6(C.ratio("neg", "pos")).alias("neg_share"),
                    R6(C.positive_ratio("x", "m")).alias("peak_ratio"), R6(log_mean).alias("log_mean"),
                    R6(F.expm1(log_mean)).alias("back"), F.coalesce("neg", F.lit(0.0)).alias("neg_filled"))


@query("cyclic_encodings", "B20 B21", """
    SELECT date, round(sin(2 * pi() * dayofyear(date) / 365.25), 8) AS sin_doy,
           round(cos(2 * pi() * dayofyear(date) / 365.25), 8) AS cos_doy,
           round(sin(4 * pi() * dayofyear(date) / 365.25), 8) AS sin_doy2,
           round(cos(4 * pi() * dayofyear(date) / 365.25), 8) AS cos_doy2,
           round(sin(2 * pi() * isodow(date) / 7), 8) AS sin_dow, round(cos(2 * pi() * isodow(date) / 7), 8) AS cos_dow,
           round(sin(2 * pi() * month(date) / 12), 8) AS sin_month, round(cos(2 * pi() * month(date) / 12), 8) AS cos_month,
           CAST(isodow(date) IN (6, 7) AS INTEGER) AS is_weekend, CAST(isodow(date) = 5 AS INTEGER) AS is_friday,
           CAST(isodow(date) = 1 AS INTEGER) AS is_monday, CAST(month(date) IN (6, 7, 8) AS INTEGER) AS is_summer,
           CAST(month(date) IN (12, 1, 2) AS INTEGER) AS is_winter
    FROM r_portfolio""")
def cyclic_encodings(spark, sf):
    from loadloom.operators.series import add_calendar
    d = add_calendar(R.portfolio(spark, sf))
    names = ["sin_doy", "cos_doy", "sin_doy2", "cos_doy2", "sin_dow", "cos_dow", "sin_month", "cos_month"]
    return d.select("date", *[F.round(n, 8).alias(n) for n in names], "is_weekend", "is_friday", "is_monday",
                    "is_summer", "is_winter")


@query("locale_numbers", "B22 B23", """
    SELECT o_orderkey, replace(CAST(o_totalprice AS VARCHAR), '.', ',') AS comma_text,
           round(o_totalprice, 2) AS parsed, round(o_totalprice, 2) AS round_trip
    FROM orders""")
def locale_numbers(spark, sf):
    o = R.table(spark, sf, "orders")
    text = F.translate(F.format_string("%.2f", "o_totalprice"), ".", ",")
    shown = C.fmt_es("o_totalprice", 2)
    plain = F.regexp_replace(F.regexp_replace(text, "0+$", ""), ",$", ",0")
    return o.select("o_orderkey", plain.alias("comma_text"), C.parse_decimal_comma(text).alias("parsed"),
                    C.parse_es(shown).alias("round_trip"))


@query("activity_sections", "B24 B25", """
    WITH k AS (SELECT contract_id, CASE WHEN activity IS NOT NULL AND CAST(CAST(activity AS DOUBLE) AS INTEGER) > 0
                 THEN lpad(CAST(CAST(CAST(activity AS DOUBLE) AS INTEGER) AS VARCHAR), 4, '0') END AS code FROM r_contracts),
    d AS (SELECT *, CAST(substr(code, 1, 2) AS INTEGER) AS division FROM k),
    s(section, lo, hi) AS (VALUES ('A',1,3),('B',5,9),('C',10,33),('D',35,35),('E',36,39),('F',41,43),('G',45,47),
      ('H',49,53),('I',55,56),('J',58,63),('K',64,66),('L',68,68),('M',69,75),('N',77,82),('O',84,84),('P',85,85),
      ('Q',86,88),('R',90,93),('S',94,96),('T',97,98),('U',99,99))
    SELECT contract_id, code, division, section, CASE WHEN section IS NULL THEN 'Unknown' WHEN section = 'T' THEN 'Households'
      WHEN section = 'I' THEN 'Hospitality and tourism' WHEN section IN ('O','P','Q') THEN 'Public and social services'
      WHEN section IN ('C','D','E','F') THEN 'Industry, energy and construction'
      WHEN section IN ('A','B') THEN 'Primary and extractive' WHEN section = 'U' THEN 'Other' ELSE 'Trade and services' END AS family
    FROM d LEFT JOIN s ON division BETWEEN lo AND hi""")
def activity_sections(spark, sf):
    c = R.contracts(spark, sf).select("contract_id", C.activity_code("activity").alias("code"))
    c = c.withColumn("division", C.activity_division("code"))
    return c.select("*", C.activity_section("division").alias("section"), C.activity_family("division").alias("family"))


@query("rating_classes", "B26 B27 B28", """
    SELECT user_id, date, CASE WHEN hours_recorded >= 4 THEN 'complete' WHEN hours_recorded >= 3 THEN 'almost complete'
             WHEN hours_recorded >= 2 THEN 'partial' ELSE 'sparse' END AS completeness,
           CASE WHEN hours_recorded - 1 > 0 THEN 'warn' ELSE 'pass' END AS check_status,
           CASE WHEN daily_kwh <= 1 THEN 'ok' WHEN daily_kwh <= 5 THEN 'review' ELSE 'weak' END AS station_status,
           CASE WHEN daily_kwh - 1 <= 0 THEN 'ok' WHEN daily_kwh - 1 <= 1 THEN 'low' WHEN daily_kwh - 1 <= 5 THEN 'review'
             ELSE 'fallback' END AS merge_status,
           CASE WHEN daily_kwh / 8 >= 1 THEN 'high' WHEN daily_kwh / 8 >= 0.1 THEN 'medium' ELSE 'low' END AS impact
    FROM r_daily""")
def rating_classes(spark, sf):
    return R.daily(spark, sf).select(
        "user_id", "date", C.day_completeness_class("hours_recorded", full=4).alias("completeness"),
        C.check_status(F.col("hours_recorded") - 1, "warn").alias("check_status"),
        C.station_status("daily_kwh").alias("station_status"),
        C.merge_status(F.col("daily_kwh") - 1).alias("merge_status"),
        C.impact_level(F.col("daily_kwh") / 8).alias("impact"))


@query("display_ids", "B33", """
    SELECT c_custkey, substr(c_name, 1, 8) AS short_id,
           'C' || (c_nationkey % 4) || '-P' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS profile_id FROM customer""")
def display_ids(spark, sf):
    c = R.table(spark, sf, "customer")
    return c.select("c_custkey", C.short_id("c_name").alias("short_id"),
                    C.profile_id(F.col("c_nationkey") % 4, F.col("c_custkey") % 100).alias("profile_id"))


@query("power_subsets", "D55", """
    SELECT user_id, p1_kw, round(m, 8) AS mean_daily_kwh, round(sd / nullif(m, 0), 8) AS cv
    FROM r_user JOIN (SELECT user_id, avg(daily_kwh) AS m, stddev_samp(daily_kwh) AS sd FROM r_daily GROUP BY user_id) USING (user_id)
    WHERE p1_kw > 0.5 AND p1_kw <= 20 AND sd / nullif(m, 0) < 3""")
def power_subsets(spark, sf):
    m = R.daily(spark, sf).groupBy("user_id").agg(F.avg("daily_kwh").alias("m"), F.stddev_samp("daily_kwh").alias("sd"))
    cv = C.ratio("sd", "m")
    return (R.user_dimension(spark, sf).join(m, "user_id")
            .where((F.col("p1_kw") > 0.5) & (F.col("p1_kw") <= 20) & (cv < 3))
            .select("user_id", "p1_kw", R6("m").alias("mean_daily_kwh"), R6(cv).alias("cv")))
