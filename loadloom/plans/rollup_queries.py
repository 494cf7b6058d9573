"""Roll-ups, profiles, set operations and the flagship query."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from loadloom.functions import aggregates as A
from loadloom.functions import columns as C
from loadloom.operators import ranks, rollups
from loadloom.plans import roles as R
from loadloom.plans.registry import query
from loadloom.sources import maintained
from loadloom.sources.stage import broadcast_if_small, checkpoint_dir

R6 = lambda c: F.round(c, 8)


@query("top_users", "A5 B1 D1 D15 F1 F2", """
    SELECT user_id, round(avg(daily_kwh), 8) AS mean_daily_kwh, round(stddev_samp(daily_kwh), 8) AS sd_daily_kwh,
           count(*) AS active_days
    FROM r_daily GROUP BY user_id ORDER BY avg(daily_kwh) DESC, user_id LIMIT 20""")
def top_users(spark, sf):
    return (R.daily(spark, sf).groupBy("user_id")
            .agg(F.avg("daily_kwh").alias("m"), F.stddev_samp("daily_kwh").alias("s"),
                 F.count(F.lit(1)).alias("active_days"))
            .orderBy(F.desc("m"), "user_id").limit(20)
            .select("user_id", R6("m").alias("mean_daily_kwh"), R6("s").alias("sd_daily_kwh"), "active_days"))


_DAILY = """SELECT user_id, date, daily_kwh, round(mean_hourly_kwh, 8) AS mean_hourly_kwh, min_hourly_kwh,
    max_hourly_kwh, round(sd_hourly_kwh, 8) AS sd_hourly_kwh, hours_recorded FROM """


def _daily(d):
    return d.select("user_id", "date", "daily_kwh", R6("mean_hourly_kwh").alias("mean_hourly_kwh"),
                    "min_hourly_kwh", "max_hourly_kwh", R6("sd_hourly_kwh").alias("sd_hourly_kwh"),
                    "hours_recorded")


@query("daily_rollup", "D1 B1", _DAILY + "r_daily")
def daily_rollup(spark, sf):
    return _daily(R.daily(spark, sf))


@query("daily_rollup_readings", "D1 B1", _DAILY + "r_short_daily")
def daily_rollup_readings(spark, sf):
    return _daily(R.short_daily(spark, sf))


@query("monthly_rollup", "D2", """
    SELECT user_id, year(date) AS year, month(date) AS month, sum(daily_kwh) AS monthly_kwh,
           round(avg(daily_kwh), 8) AS mean_daily_kwh, max(daily_kwh) AS max_daily_kwh,
           round(stddev_samp(daily_kwh), 8) AS sd_daily_kwh,
           CAST(sum(hours_recorded) AS BIGINT) AS total_hours, count(*) AS days_recorded
    FROM r_daily GROUP BY ALL""")
def monthly_rollup(spark, sf):
    m = rollups.monthly_rollup(R.daily(spark, sf))
    return m.withColumns({"mean_daily_kwh": R6("mean_daily_kwh"), "sd_daily_kwh": R6("sd_daily_kwh")})


def _profile(kind):
    def build(spark, sf):
        p = rollups.profile(rollups.profile_grid(R.meter(spark, sf)), kind)
        return p.withColumn("mean_kwh", R6("mean_kwh"))
    return build


_SEASON = """CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) IN (3, 4, 5) THEN 'spring'
    WHEN month(ts) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END"""
_DAY_TYPE = "CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'weekday' END"

query("profile_hour", "D3 B13", """SELECT user_id, hour(ts) AS hour, round(avg(kwh), 8) AS mean_kwh
    FROM r_meter GROUP BY ALL""")(_profile("hour"))
query("profile_day_type", "D3 B10", f"""SELECT user_id, {_DAY_TYPE} AS day_type, hour(ts) AS hour,
    round(avg(kwh), 8) AS mean_kwh FROM r_meter GROUP BY ALL""")(_profile("day_type"))
query("profile_season", "D3 B9", f"""SELECT user_id, {_SEASON} AS season, hour(ts) AS hour,
    round(avg(kwh), 8) AS mean_kwh FROM r_meter GROUP BY ALL""")(_profile("season"))
query("profile_weekday", "D3 B13", """SELECT user_id, isodow(ts) AS dow, round(avg(kwh), 8) AS mean_kwh
    FROM r_meter GROUP BY ALL""")(_profile("weekday"))


@query("profile_bundle", "D43 G1", f"""
    WITH b AS (SELECT {_SEASON} AS season, {_DAY_TYPE} AS day_type, month(ts) AS month,
                      isodow(ts) AS dow, hour(ts) AS hour, kwh FROM r_meter)
    SELECT 'by_hour' AS profile, NULL::VARCHAR AS season, NULL::VARCHAR AS day_type, NULL::BIGINT AS month,
           NULL::BIGINT AS dow, hour, round(avg(kwh), 8) AS mean_kwh, count(*) AS n_readings FROM b GROUP BY hour
    UNION ALL SELECT 'by_day_type_hour', NULL, day_type, NULL, NULL, hour, round(avg(kwh), 8), count(*)
      FROM b GROUP BY day_type, hour
    UNION ALL SELECT 'by_season_hour', season, NULL, NULL, NULL, hour, round(avg(kwh), 8), count(*)
      FROM b GROUP BY season, hour
    UNION ALL SELECT 'by_weekday', NULL, NULL, NULL, dow, NULL, round(avg(kwh), 8), count(*) FROM b GROUP BY dow
    UNION ALL SELECT 'by_month', NULL, NULL, month, NULL, NULL, round(avg(kwh), 8), count(*) FROM b GROUP BY month
    """)
def profile_bundle(spark, sf):
    return rollups.profile_bundle(R.meter(spark, sf)).withColumn("mean_kwh", R6("mean_kwh"))


@query("portfolio_daily", "D33 C1", """
    SELECT date, sum(daily_kwh) AS total_kwh, count(DISTINCT user_id) AS n_users,
           round(avg(hdd), 8) AS hdd_mean, round(avg(cdd), 8) AS cdd_mean, round(avg(tmean), 8) AS tmean_mean,
           CAST(max(CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END) AS INTEGER) AS any_weekend
    FROM r_panel GROUP BY date""")
def portfolio_daily(spark, sf):
    return rollups.target_series(R.panel(spark, sf), extra=[
        R6(F.avg("hdd")).alias("hdd_mean"), R6(F.avg("cdd")).alias("cdd_mean"),
        R6(F.avg("tmean")).alias("tmean_mean"),
        F.max(C.is_weekend("date").cast("int")).alias("any_weekend")])


@query("portfolio_hourly", "D33 B14 C5", """
    SELECT date_trunc('hour', ts) AS datetime, sum(kwh) AS total_kwh, count(DISTINCT user_id) AS n_users
    FROM r_readings WHERE kwh IS NOT NULL AND kwh >= 0 AND user_id IN (SELECT user_id FROM r_user)
    GROUP BY 1""")
def portfolio_hourly(spark, sf):
    # The semi-join runs on (user, hour) sums, so a user with very many readings is already small.
    per_user = (R.readings(spark, sf).where(C.valid_reading())
                .groupBy("user_id", C.hour_start("ts").alias("datetime"))
                .agg(F.sum("kwh").alias("kwh")))
    scoped = per_user.join(R.user_dimension(spark, sf).select("user_id"), "user_id", "left_semi")
    return rollups.target_series(scoped, value="kwh", when=["datetime"])


@query("cluster_daily", "D33 C1", "SELECT date, cluster, y, n_users FROM r_cluster_daily")
def cluster_daily(spark, sf):
    return R.cluster_daily(spark, sf)


@query("region_hour_raw", "D50 B12 C1", """
    WITH g AS (SELECT s_suppkey AS user_id, CASE WHEN s_nationkey IN (0, 5, 10, 15, 20) THEN 'north'
                      WHEN s_nationkey IN (1, 6, 11, 16, 21) THEN 'south' ELSE 'other' END AS region FROM supplier)
    SELECT region, hour(ts) AS hour, round(avg(kwh), 8) AS mean_kwh, count(*) AS n_readings,
           count(DISTINCT user_id) AS n_users
    FROM r_meter JOIN g USING (user_id) WHERE kwh >= 0 GROUP BY ALL""")
def region_hour_raw(spark, sf):
    # Sum per (user, hour) first: the join then sees at most 24 rows per user.
    per_user = (R.meter(spark, sf).where(C.valid_reading()).groupBy("user_id", "hour")
                .agg(F.sum("kwh").alias("s"), F.count(F.lit(1)).alias("n")))
    groups = {"north": ["00", "05", "10", "15", "20"], "south": ["01", "06", "11", "16", "21"]}
    return (per_user.join(R.meter_province(spark, sf), "user_id")
            .groupBy(C.region_bucket("province", groups).alias("region"), "hour")
            .agg(R6(F.sum("s") / F.sum("n")).alias("mean_kwh"), F.sum("n").alias("n_readings"),
                 F.count(F.lit(1)).alias("n_users")))


@query("region_hour_preaggregated", "D50", """
    WITH p AS (SELECT user_id, hour(ts) AS hour, avg(kwh) AS m FROM r_meter GROUP BY ALL)
    SELECT n_regionkey AS region, hour, round(avg(m), 8) AS mean_of_user_means, count(*) AS n_users
    FROM p JOIN supplier ON user_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""")
def region_hour_preaggregated(spark, sf):
    """Read from the maintained (user, hour) sums: the readings are scanned only where their files changed."""
    p = maintained_profile(spark, sf)
    s, n = R.table(spark, sf, "supplier"), R.table(spark, sf, "nation")
    geo = s.join(broadcast_if_small(n), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("user_id"), F.col("n_regionkey").alias("region"))
    return (p.join(broadcast_if_small(geo), "user_id").groupBy("region", "hour")
            .agg(R6(F.avg(F.col("s") / F.col("n"))).alias("mean_of_user_means"), F.count(F.lit(1)).alias("n_users")))


_CELLS = "user_id bigint, hour int, s double, n bigint"


def maintained_profile(spark, sf):
    """(user_id, hour, s, n) merged over the parts of the source, refreshed first."""
    source = f"{sf}/lineitem.parquet"
    root = f"{checkpoint_dir(spark)}/profile-{hashlib.sha256(source.encode()).hexdigest()[:16]}"
    parts = maintained.source_parts(spark, source)

    def cells(part):
        m = R.meter(spark, sf) if not part else R.meter_of(spark.read.schema(R.SCHEMAS["lineitem"]).parquet(f"{source}/{part}"))
        return m.where(C.valid_reading()).groupBy("user_id", "hour").agg(F.sum("kwh").alias("s"), F.count(F.lit(1)).alias("n"))

    maintained.refresh(spark, root, parts, cells)
    held = maintained.state(spark, root, _CELLS)
    return held if len(parts) == 1 else maintained.merged(held, ["user_id", "hour"], ["s", "n"])


@query("period_scan", "A5 F1", """
    SELECT count(*) AS n_readings, sum(kwh) AS total_kwh, count(DISTINCT user_id) AS n_users
    FROM r_meter WHERE ts >= TIMESTAMP '1998-01-01' AND ts < TIMESTAMP '1999-01-01'""")
def period_scan(spark, sf):
    # The hour shift never crosses midnight, so the day filter below is exact and reaches the scan.
    li = R.table(spark, sf, "lineitem").where((F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
                                              & (F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")))
    return li.agg(F.count(F.lit(1)).alias("n_readings"), F.sum(F.col("l_quantity") / 8).alias("total_kwh"),
                  F.countDistinct("l_suppkey").alias("n_users"))


@query("semi_join_users", "C5 A9", """
    SELECT count(*) AS n_readings, round(avg(kwh), 8) AS mean_kwh FROM r_meter
    WHERE user_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""")
def semi_join_users(spark, sf):
    keep = R.table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("user_id"))
    return R.meter(spark, sf).join(broadcast_if_small(keep), "user_id", "left_semi").agg(
        F.count(F.lit(1)).alias("n_readings"), R6(F.avg("kwh")).alias("mean_kwh"))


@query("speedup_vs_slowest", "E20", """
    WITH t AS (SELECT l_returnflag AS method, l_linestatus AS experiment, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)
    SELECT experiment, method, v AS cost, round(max(v) OVER (PARTITION BY experiment) / v, 8) AS speedup FROM t""")
def speedup_vs_slowest(spark, sf):
    t = (R.table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("experiment"),
                                                F.col("l_returnflag").alias("method"))
         .agg(F.sum("l_quantity").alias("cost")))
    top = F.max("cost").over(Window.partitionBy("experiment"))
    return t.select("experiment", "method", "cost", R6(C.ratio(top, "cost")).alias("speedup"))


@query("latest_contract", "E1 B4 B7", """
    SELECT user_id, contract_id, postcode, province, tariff, tariff_clean, activity, p1_kw, start_date FROM r_user""")
def latest_contract(spark, sf):
    return R.user_dimension(spark, sf)


@query("first_row_per_key", "E2", """
    SELECT user_id, contract_id, tariff FROM r_contracts
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY contract_id) = 1""")
def first_row_per_key(spark, sf):
    c = R.contracts(spark, sf).select("user_id", "contract_id", "tariff")
    return ranks.latest_per_key(c, "user_id", order=[-F.col("contract_id")])


@query("tagged_union", "G1 A6", """
    SELECT 'meter' AS source, user_id, date, daily_kwh, NULL::BIGINT AS hours_recorded FROM r_daily
    UNION ALL SELECT 'readings', user_id, date, daily_kwh, hours_recorded FROM r_short_daily""")
def tagged_union(spark, sf):
    from loadloom.sources.readers import union_tables
    a = R.daily(spark, sf).select(F.lit("meter").alias("source"), "user_id", "date", "daily_kwh")
    b = R.short_daily(spark, sf).select(F.lit("readings").alias("source"), "user_id", "date", "daily_kwh", "hours_recorded")
    return union_tables(a, b)


@query("key_difference", "G2 G3 C6", """
    SELECT 'without_readings' AS side, s_suppkey AS key FROM supplier
      WHERE s_suppkey NOT IN (SELECT user_id FROM r_readings)
    UNION ALL SELECT 'in_both', key FROM (SELECT s_suppkey AS key FROM supplier INTERSECT SELECT user_id FROM r_readings)
    """)
def key_difference(spark, sf):
    s = R.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"))
    r = R.readings(spark, sf).select(F.col("user_id").alias("key")).distinct()
    only = s.join(r, "key", "left_anti").select(F.lit("without_readings").alias("side"), "key")
    both = s.intersect(r).select(F.lit("in_both").alias("side"), "key")
    return only.unionByName(both)


@query("hour_columns", "G4 D3", "SELECT user_id, " + ", ".join(
    f"round(max(CASE WHEN hour = {h} THEN CASE WHEN um > 0 THEN m / um ELSE 0 END END), 8) AS norm_h{h:02d}"
    for h in range(24)) + """ FROM (SELECT user_id, hour, m, avg(m) OVER (PARTITION BY user_id) AS um FROM
    (SELECT user_id, hour, avg(kwh) AS m FROM r_meter GROUP BY ALL)) GROUP BY user_id""")
def hour_columns(spark, sf):
    from loadloom.operators.features import hour_shape
    shape = hour_shape(rollups.profile(rollups.profile_grid(R.meter(spark, sf)), "hour"))
    return shape.select("user_id", *[R6(f"norm_h{h:02d}").alias(f"norm_h{h:02d}") for h in range(24)])


@query("cluster_pivot", "G5", "SELECT date, " + ", ".join(f"max(y) FILTER (WHERE cluster = {k}) AS \"y_cluster_{k}\"" for k in R.CLUSTERS)
       + " FROM r_cluster_daily GROUP BY date")
def cluster_pivot(spark, sf):
    p = R.cluster_daily(spark, sf).groupBy("date").pivot("cluster", list(R.CLUSTERS)).agg(F.first("y"))
    return p.select("date", *[F.col(str(c)).alias(f"y_cluster_{c}") for c in R.CLUSTERS])


@query("unpivot_models", "G6 J18", """
    SELECT date, y, 'naive' AS model, naive AS pred FROM r_forecast
    UNION ALL SELECT date, y, 'weekly', weekly FROM r_forecast
    UNION ALL SELECT date, y, 'rolling', round(rolling, 8) FROM r_forecast""")
def unpivot_models(spark, sf):
    f = R.forecast(spark, sf).withColumn("rolling", R6("rolling"))
    return f.unpivot(["date", "y"], ["naive", "weekly", "rolling"], "model", "pred")


@query("flag_names", "G7", """
    SELECT user_id, date, concat_ws(', ', CASE WHEN daily_kwh > 10 THEN 'high' END,
           CASE WHEN hours_recorded < 2 THEN 'single' END, CASE WHEN isodow(date) >= 6 THEN 'weekend' END) AS flags
    FROM r_daily""")
def flag_names(spark, sf):
    d = R.daily(spark, sf)
    flags = {"high": F.col("daily_kwh") > 10, "single": F.col("hours_recorded") < 2, "weekend": C.is_weekend("date")}
    names = F.array(*[F.when(c, n) for n, c in flags.items()])
    return d.select("user_id", "date", F.array_join(F.filter(names, lambda x: x.isNotNull()), ", ").alias("flags"))


@query("expand_reference_list", "G8", """
    WITH p AS (SELECT p_partkey, string_split(replace(p_type, ' ', '; '), ';') AS words FROM part),
    e AS (SELECT p_partkey, trim(unnest(words)) AS code, unnest(range(1, len(words) + 1)) AS pos FROM p),
    k AS (SELECT code, count(*) AS n FROM e WHERE code <> '' GROUP BY code)
    SELECT p_partkey, string_agg(code || ' (' || n || ')', ' | ' ORDER BY pos) AS labels
    FROM e JOIN k USING (code) WHERE code <> '' GROUP BY p_partkey""")
def expand_reference_list(spark, sf):
    from loadloom.operators.segments import expand_refs
    p = R.table(spark, sf, "part").select("p_partkey", F.regexp_replace("p_type", " ", "; ").alias("refs"))
    codes = p.select(F.explode(F.split("refs", ";")).alias("code")).select(F.trim("code").alias("code")).where("code <> ''")
    lookup = codes.groupBy("code").agg(F.count(F.lit(1)).alias("n")).select(
        "code", F.concat("code", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("label"))
    return expand_refs(p, "p_partkey", "refs", lookup).withColumnRenamed("text", "labels")


@query("ordered_label_concat", "G9", """
    SELECT user_id, date, string_agg(DISTINCT event_type, '; ' ORDER BY event_type) AS labels
    FROM (SELECT user_id, CAST(ts AS DATE) AS date, event_type FROM events) GROUP BY ALL""")
def ordered_label_concat(spark, sf):
    e = R.table(spark, sf, "events")
    return e.groupBy("user_id", F.to_date("ts").alias("date")).agg(
        F.array_join(F.array_sort(F.collect_set("event_type")), "; ").alias("labels"))


@query("custom_order", "F4", """
    SELECT o_orderstatus AS status, list_position(['P', 'O', 'F'], o_orderstatus) AS position, count(*) AS n
    FROM orders GROUP BY ALL ORDER BY 2""")
def custom_order(spark, sf):
    pos = F.array_position(F.array(*[F.lit(x) for x in "POF"]), F.col("o_orderstatus"))
    return (R.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status"), pos.alias("position"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy("position"))


@query("hash_sample", "F5")
def hash_sample(spark, sf):
    return ranks.hash_sample(R.user_dimension(spark, sf).select("user_id", "province"), "user_id", 50)


@query("rows_to_slices", "K3 J23", """
    SELECT date, y, unnest(['overall', 'month=' || month(date), 'dow=' || isodow(date)]) AS slice FROM r_portfolio""")
def rows_to_slices(spark, sf):
    d = F.col("date")
    keys = F.array(F.lit("overall"), F.concat(F.lit("month="), F.month(d).cast("string")),
                   F.concat(F.lit("dow="), C.iso_dow(d).cast("string")))
    return R.portfolio(spark, sf).select("date", "y", F.explode(keys).alias("slice"))


@query("share_entropy", "K2 D39", """
    WITH s AS (SELECT user_id, month(date) AS m, sum(daily_kwh) AS k FROM r_daily GROUP BY ALL),
    p AS (SELECT user_id, k / sum(k) OVER (PARTITION BY user_id) AS p FROM s)
    SELECT user_id, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 8) AS entropy
    FROM p GROUP BY user_id""")
def share_entropy(spark, sf):
    s = R.daily(spark, sf).groupBy("user_id", F.month("date").alias("m")).agg(F.sum("daily_kwh").alias("k"))
    p = s.withColumn("p", C.ratio("k", F.sum("k").over(Window.partitionBy("user_id"))))
    return p.groupBy("user_id").agg(R6(A.share_entropy("p")).alias("entropy"))


@query("group_apply", "K1", """
    SELECT cluster, date, y, round(avg(y) OVER (PARTITION BY cluster ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 8) AS trend FROM r_cluster_daily""")
def group_apply(spark, sf):
    """A function of each group, a centred trend per cluster series, as a window frame."""
    w = Window.partitionBy("cluster").orderBy("date").rowsBetween(-3, 3)
    return R.cluster_daily(spark, sf).select("cluster", "date", "y", R6(F.avg("y").over(w)).alias("trend"))
