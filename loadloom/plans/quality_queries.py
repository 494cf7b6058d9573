"""Quality audits: coverage, gaps, tails, anomalies, contracts and manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadloom.functions import columns as C
from loadloom.operators import checks, quality
from loadloom.plans import roles as R
from loadloom.plans.registry import query
from loadloom.sources.stage import stage

R8 = lambda c: F.round(c, 8)

_COVERAGE = """
    SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS total_records,
           count(DISTINCT CAST(ts AS DATE)) AS distinct_days,
           count(*) FILTER (WHERE kwh IS NULL) AS n_nulls, count(*) FILTER (WHERE kwh = 0) AS n_zeros,
           count(*) FILTER (WHERE kwh < 0) AS n_negatives,
           datediff('day', min(ts), max(ts)) AS span_days, datediff('day', min(ts), max(ts)) + 1 AS span_days_inclusive,
           round(100.0::DOUBLE * count(DISTINCT CAST(ts AS DATE)) / (datediff('day', min(ts), max(ts)) + 1), 1) AS coverage_pct,
           round(100.0::DOUBLE * count(*) FILTER (WHERE kwh = 0) / count(*), 2) AS zero_pct,
           round(100.0::DOUBLE * count(*) FILTER (WHERE kwh IS NULL) / count(*), 2) AS null_pct
    FROM r_readings GROUP BY user_id"""


@query("user_coverage", "D4 B36", _COVERAGE)
def user_coverage(spark, sf):
    return quality.coverage(R.readings(spark, sf))


@query("coverage_summary", "D5", f"""
    WITH c AS ({_COVERAGE})
    SELECT count(*) AS n_users, CAST(median(span_days_inclusive) AS DOUBLE) AS median_span_days,
           round(avg(span_days_inclusive), 0) AS mean_span_days, median(coverage_pct) AS median_coverage_pct,
           CAST(median(distinct_days) AS DOUBLE) AS median_distinct_days,
           count(*) FILTER (WHERE span_days_inclusive < 30) AS users_under_30_days,
           count(*) FILTER (WHERE span_days_inclusive < 365) AS users_under_a_year,
           count(*) FILTER (WHERE span_days_inclusive > 1825) AS users_over_5_years FROM c""")
def coverage_summary(spark, sf):
    return quality.coverage_summary(quality.coverage(R.readings(spark, sf)))


@query("global_summary", "D6", """
    SELECT count(*) AS n_records, count(DISTINCT user_id) AS n_users, min(ts) AS first_ts, max(ts) AS last_ts,
           sum(kwh) AS total_kwh, round(avg(kwh), 8) AS mean_kwh, count(*) FILTER (WHERE kwh IS NULL) AS n_nulls,
           count(*) FILTER (WHERE kwh < 0) AS n_negatives, count(*) FILTER (WHERE kwh = 0) AS n_zeros FROM r_readings""")
def global_summary(spark, sf):
    return quality.global_summary(R.readings(spark, sf)).withColumn("mean_kwh", R8("mean_kwh"))


@query("active_days_by_year", "B36", """
    SELECT user_id, year, count(*) AS active_days,
           round(100.0::DOUBLE * count(*) / any_value(CASE WHEN year IN (1996, 2000, 2004) THEN 366 ELSE 365 END), 2) AS active_pct
    FROM (SELECT user_id, year(date) AS year FROM r_daily) GROUP BY ALL""")
def active_days_by_year(spark, sf):
    return quality.active_days_by_year(R.daily(spark, sf))


@query("hours_histogram", "D7", """
    SELECT hours_recorded, count(*) AS n_user_days, count(DISTINCT user_id) AS n_users FROM r_short_daily GROUP BY 1""")
def hours_histogram(spark, sf):
    return quality.hours_histogram(R.short_daily(spark, sf))


_GAPS = """SELECT user_id, prev AS gap_start, date AS gap_end, CAST(date - prev - 1 AS INTEGER) AS gap_days FROM
    (SELECT user_id, date, lag(date) OVER (PARTITION BY user_id ORDER BY date) AS prev FROM {t}) WHERE date - prev > 1"""


@query("gaps", "E3", _GAPS.format(t="r_short_daily"))
def gaps(spark, sf):
    return quality.gaps(R.short_daily(spark, sf))


@query("gap_summary", "E3 D46", f"""
    WITH u AS (SELECT user_id, count(*) AS n, max(gap_days) AS m FROM ({_GAPS.format(t='r_daily')}) GROUP BY user_id)
    SELECT count(*) AS users_with_gaps, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_gaps,
           CAST(median(n) AS DOUBLE) AS median_gaps_per_user, max(m) AS max_gap_days,
           CAST(median(m) AS DOUBLE) AS median_max_gap_days FROM u""")
def gap_summary(spark, sf):
    return quality.gap_summary(quality.gaps(R.daily(spark, sf)))


@query("gap_classes", "B26 E3", f"""
    SELECT CASE WHEN gap_days <= 1 THEN '1 day' WHEN gap_days <= 7 THEN '2-7 days' WHEN gap_days <= 30 THEN '8-30 days'
           WHEN gap_days <= 90 THEN '31-90 days' ELSE 'over 90 days' END AS gap_class, count(*) AS n_gaps,
           count(DISTINCT user_id) AS n_users, CAST(sum(gap_days) AS BIGINT) AS total_days
    FROM ({_GAPS.format(t='r_daily')}) GROUP BY 1""")
def gap_classes(spark, sf):
    g = quality.gaps(R.daily(spark, sf)).withColumn("gap_class", C.gap_class("gap_days"))
    per_user = g.groupBy("gap_class", "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("gap_days").alias("d"))
    return per_user.groupBy("gap_class").agg(F.sum("n").alias("n_gaps"), F.count(F.lit(1)).alias("n_users"),
                                             F.sum("d").alias("total_days"))


@query("day_completeness_share", "B26 D7 E15", """
    WITH h AS (SELECT CASE WHEN hours_recorded >= 4 THEN 'complete' WHEN hours_recorded >= 3 THEN 'almost complete'
        WHEN hours_recorded >= 2 THEN 'partial' ELSE 'sparse' END AS completeness, count(*) AS n FROM r_short_daily GROUP BY 1)
    SELECT completeness, n, round(100.0::DOUBLE * n / sum(n) OVER (), 4) AS pct FROM h""")
def day_completeness_share(spark, sf):
    h = (R.short_daily(spark, sf).groupBy(C.day_completeness_class("hours_recorded", full=4).alias("completeness"))
         .agg(F.count(F.lit(1)).alias("n")))
    total = h.agg(F.sum("n").alias("_t"))
    return h.crossJoin(total).select("completeness", "n", C.pct("n", "_t", 4).alias("pct"))


@query("tail_counts", "D9 D10 C8", """
    WITH s AS (SELECT quantile_cont(kwh, 0.95) AS p95, quantile_cont(kwh, 0.99) AS p99, quantile_cont(kwh, 0.999) AS p999
               FROM r_readings WHERE kwh >= 0)
    SELECT round(p95, 8) AS p95, round(p99, 8) AS p99, round(p999, 8) AS p999, count(*) FILTER (WHERE kwh > p95) AS n_above_p95,
           count(*) FILTER (WHERE kwh > p99) AS n_above_p99, count(*) FILTER (WHERE kwh > p999) AS n_above_p999,
           count(*) FILTER (WHERE kwh > 100) AS n_above_fixed
    FROM r_readings, s GROUP BY p95, p99, p999""")
def tail_counts(spark, sf):
    t = quality.tail_counts(R.readings(spark, sf))
    return t.withColumns({p: R8(p) for p in ("p95", "p99", "p999")})


@query("approximate_quartiles", "D11")
def approximate_quartiles(spark, sf):
    return R.meter(spark, sf).groupBy("hour").agg(
        F.percentile_approx("kwh", [0.25, 0.5, 0.75], 10000).alias("quartiles"))


@query("sketch_quartiles", "D11", """
    SELECT month(date) AS month, p AS quartile, count(*) AS n, TRUE AS within_bound FROM r_meter, (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS p) GROUP BY ALL""")
def sketch_quartiles(spark, sf):
    """Quartiles of months merged from stored (user, month) sketches; ``within_bound`` is true where the exact rank misses by at most 2 %."""
    m = R.meter(spark, sf).select("user_id", F.month("date").alias("month"), "kwh")
    cells = stage(quality.sketch_cells(m, "kwh", ["user_id", "month"]))
    q = quality.sketch_quantiles(cells, ["month"], {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    asked = q.select("month", F.explode(F.array(*[F.struct(F.lit(p).alias("quartile"), F.col(c).alias("v")) for c, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))])).alias("a")).select("month", "a.*")
    # One row per month and quartile is broadcast; equal values hold a range of ranks.
    values = m.groupBy("month", "kwh").agg(F.count(F.lit(1)).alias("c"))
    at = values.join(F.broadcast(stage(asked)), "month").groupBy("month", "quartile").agg(
        F.sum("c").alias("n"), F.expr("sum(if(kwh < v, c, 0)) / sum(c)").alias("lo"), F.expr("sum(if(kwh <= v, c, 0)) / sum(c)").alias("hi"))
    return at.selectExpr("month", "quartile", "n", "lo - 0.02D <= quartile AND quartile <= hi + 0.02D AS within_bound")


@query("percentile_by_hour", "D9", """
    SELECT hour, round(quantile_cont(kwh, 0.1), 8) AS p10, round(quantile_cont(kwh, 0.5), 8) AS p50,
           round(quantile_cont(kwh, 0.9), 8) AS p90 FROM r_meter GROUP BY hour""")
def percentile_by_hour(spark, sf):
    from loadloom.operators.ranks import percentiles
    p = percentiles(R.meter(spark, sf).select("hour", "kwh"), "kwh", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, by=["hour"])
    return p.withColumns({c: R8(c) for c in ("p10", "p50", "p90")})


@query("affected_users", "D12 C8", """
    WITH h AS (SELECT user_id, count(*) AS total_records, count(*) FILTER (WHERE kwh < 0) AS n_negative,
        abs(coalesce(sum(kwh) FILTER (WHERE kwh < 0), 0)) AS kwh_negative, count(*) FILTER (WHERE kwh > 100) AS n_extreme_hours,
        coalesce(sum(kwh) FILTER (WHERE kwh > 100), 0) AS kwh_extreme_hours, coalesce(sum(kwh) FILTER (WHERE kwh >= 0), 0) AS kwh_total
      FROM r_readings GROUP BY user_id),
    d AS (SELECT user_id, count(*) FILTER (WHERE daily_kwh < 0) AS n_negative_days, count(*) FILTER (WHERE daily_kwh > 200) AS n_extreme_days,
        coalesce(sum(daily_kwh) FILTER (WHERE daily_kwh > 200), 0) AS kwh_extreme_days FROM r_short_daily GROUP BY user_id),
    g AS (SELECT sum(kwh_total) AS kwh_global FROM h)
    SELECT user_id, CASE WHEN n_negative > 0 AND n_extreme_hours > 0 THEN 'negative and extreme hours' WHEN n_negative > 0 THEN 'negative'
           WHEN n_extreme_hours > 0 THEN 'extreme hours' ELSE 'extreme days' END AS anomaly, total_records, n_negative, kwh_negative,
           n_extreme_hours, kwh_extreme_hours, coalesce(n_negative_days, 0) AS n_negative_days, coalesce(n_extreme_days, 0) AS n_extreme_days,
           coalesce(kwh_extreme_days, 0) AS kwh_extreme_days, kwh_negative + kwh_extreme_hours AS kwh_affected,
           round(100 * (kwh_negative + kwh_extreme_hours) / nullif(kwh_total, 0), 6) AS pct_user_kwh,
           round(100 * (kwh_negative + kwh_extreme_hours) / nullif(kwh_global, 0), 9) AS pct_global_kwh
    FROM h LEFT JOIN d USING (user_id), g
    WHERE n_negative > 0 OR n_extreme_hours > 0 OR coalesce(n_negative_days, 0) > 0 OR coalesce(n_extreme_days, 0) > 0""")
def affected_users(spark, sf):
    return quality.affected_users(R.readings(spark, sf), R.short_daily(spark, sf), 100.0, 200.0)


_SPIKE_SQL = """WITH v AS (SELECT user_id, event_id, kwh FROM r_readings WHERE kwh >= 0),
    s AS (SELECT user_id, avg(kwh) + {k} * stddev_samp(kwh) AS lim FROM v GROUP BY user_id HAVING count(*) >= {n})
    """


@query("spikes", "D45 C9", _SPIKE_SQL.format(k=3, n=20) + """
    SELECT count(*) AS n_spikes, count(DISTINCT user_id) AS n_users, round(avg(kwh), 8) AS mean_spike, max(kwh) AS max_spike
    FROM v JOIN s USING (user_id) WHERE kwh > lim""")
def spikes(spark, sf):
    return quality.spikes(R.readings(spark, sf), k_sd=3, min_n=20).withColumn("mean_spike", R8("mean_spike"))


@query("spike_rows", "C9", _SPIKE_SQL.format(k=4, n=20) + """
    SELECT user_id, event_id, kwh, round(lim, 8) AS "limit" FROM v JOIN s USING (user_id) WHERE kwh > lim""")
def spike_rows(spark, sf):
    v = R.readings(spark, sf).where(C.valid_reading()).select("user_id", "event_id", "kwh")
    s = (v.groupBy("user_id").agg(F.avg("kwh").alias("m"), F.stddev_samp("kwh").alias("s"), F.count(F.lit(1)).alias("n"))
         .where("n >= 20"))
    out = quality.over_user_threshold(v, s, F.col("m") + 4 * F.col("s"))
    return out.withColumn("limit", R8("limit"))


@query("user_maxima", "D46", """
    SELECT user_id, max(kwh) AS max_kwh, count(*) FILTER (WHERE kwh > 50) AS n_over_50, count(*) AS n FROM r_readings GROUP BY 1""")
def user_maxima(spark, sf):
    return R.readings(spark, sf).groupBy("user_id").agg(
        F.max("kwh").alias("max_kwh"), F.count_if(F.col("kwh") > 50).alias("n_over_50"), F.count(F.lit(1)).alias("n"))


@query("joiners_leavers", "D56 C7", """
    WITH u AS (SELECT user_id, min(date) AS a, max(date) AS b FROM r_daily GROUP BY 1),
    f AS (SELECT CAST(date_trunc('month', a) AS DATE) AS month, count(*) AS n_joined FROM u GROUP BY 1),
    l AS (SELECT CAST(date_trunc('month', b) AS DATE) AS month, count(*) AS n_left FROM u GROUP BY 1)
    SELECT month, coalesce(n_joined, 0) AS n_joined, coalesce(n_left, 0) AS n_left FROM f FULL JOIN l USING (month)""")
def joiners_leavers(spark, sf):
    return quality.joiners_leavers(R.daily(spark, sf))


@query("extreme_readings", "D19", """
    SELECT user_id, count(*) FILTER (WHERE kwh > 100) AS n_extreme_hourly,
           round(100.0::DOUBLE * count(*) FILTER (WHERE kwh > 100) / count(*), 8) AS pct_extreme_hourly,
           (100.0::DOUBLE * count(*) FILTER (WHERE kwh > 100) / count(*) > 0.1) OR count(*) FILTER (WHERE kwh > 100) > 50 AS has_sustained_extreme
    FROM r_readings WHERE kwh IS NOT NULL GROUP BY user_id""")
def extreme_readings(spark, sf):
    e = quality.extremes(R.readings(spark, sf), 100.0)
    return e.withColumn("pct_extreme_hourly", R8("pct_extreme_hourly"))


def _contract_rows(spark, sf):
    ro = checks.Rule
    k, dk, hrs = F.col("kwh"), F.col("daily_kwh"), F.col("hours_recorded")
    a = checks.contracts(R.readings(spark, sf), "hourly", ["user_id", "ts", "kwh", "year"], [
        ro("hourly_ts_not_null", "ts", "0 null", F.col("ts").isNull()),
        ro("hourly_user_not_missing", "user_id", "0 missing", F.col("user_id").isNull()),
        ro("hourly_kwh_not_null", "kwh", "0 null", k.isNull()),
        ro("hourly_kwh_non_negative", "kwh", "0 negative", k < 0),
        ro("hourly_kwh_extreme", "kwh", "0 above 100", k > 100, "warn")])
    b = checks.contracts(R.short_daily(spark, sf), "daily", ["user_id", "date", "daily_kwh", "hours_recorded"], [
        ro("daily_date_not_null", "date", "0 null", F.col("date").isNull()),
        ro("daily_user_not_missing", "user_id", "0 missing", F.col("user_id").isNull()),
        ro("daily_kwh_not_null", "daily_kwh", "0 null", dk.isNull()),
        ro("daily_hours_1_24", "hours_recorded", "1 to 24", (hrs < 1) | (hrs > 24)),
        ro("daily_kwh_non_negative", "daily_kwh", "0 negative", dk < 0),
        ro("daily_kwh_extreme", "daily_kwh", "0 above 200", dk > 200, "warn")])
    start, end = (F.try_to_date(c, "dd/MM/yyyy") for c in ("start_text", "end_text"))
    c = checks.contracts(R.contracts(spark, sf), "metadata", ["user_id", "postcode", "tariff", "start_text"], [
        ro("metadata_user_not_missing", "user_id", "0 missing", F.col("user_id").isNull()),
        ro("metadata_postcode_length", "postcode", "5 digits", F.length(F.col("postcode").cast("string")) > 5),
        ro("metadata_date_order", "end_text", "end not before start", end < start)])
    return a.unionByName(b).unionByName(c)


def _required_sql(table, cols, missing=()):
    return " UNION ALL ".join(
        f"SELECT '{table}_schema_{c}' AS check_id, '{table}' AS table_name, '{c}' AS column_name, 'required_column' AS check_type, "
        f"'present' AS expected, '{'missing' if c in missing else 'present'}' AS observed, "
        f"'{'fail' if c in missing else 'pass'}' AS status" for c in cols)


def _rule_sql(src, table, rules):
    return " UNION ALL ".join(
        f"SELECT '{i}', '{table}', '{col}', 'range_or_contract', '{exp}', CAST(count(*) FILTER (WHERE {bad}) AS VARCHAR), "
        f"CASE WHEN count(*) FILTER (WHERE {bad}) > 0 THEN '{sev}' ELSE 'pass' END FROM {src}"
        for i, col, exp, bad, sev in rules)


_CONTRACT_SQL = " UNION ALL ".join([
    _required_sql("hourly", ["user_id", "ts", "kwh", "year"], missing=("year",)),
    _rule_sql("r_readings", "hourly", [
        ("hourly_ts_not_null", "ts", "0 null", "ts IS NULL", "fail"),
        ("hourly_user_not_missing", "user_id", "0 missing", "user_id IS NULL", "fail"),
        ("hourly_kwh_not_null", "kwh", "0 null", "kwh IS NULL", "fail"),
        ("hourly_kwh_non_negative", "kwh", "0 negative", "kwh < 0", "fail"),
        ("hourly_kwh_extreme", "kwh", "0 above 100", "kwh > 100", "warn")]),
    _required_sql("daily", ["user_id", "date", "daily_kwh", "hours_recorded"]),
    _rule_sql("r_short_daily", "daily", [
        ("daily_date_not_null", "date", "0 null", "date IS NULL", "fail"),
        ("daily_user_not_missing", "user_id", "0 missing", "user_id IS NULL", "fail"),
        ("daily_kwh_not_null", "daily_kwh", "0 null", "daily_kwh IS NULL", "fail"),
        ("daily_hours_1_24", "hours_recorded", "1 to 24", "hours_recorded < 1 OR hours_recorded > 24", "fail"),
        ("daily_kwh_non_negative", "daily_kwh", "0 negative", "daily_kwh < 0", "fail"),
        ("daily_kwh_extreme", "daily_kwh", "0 above 200", "daily_kwh > 200", "warn")]),
    _required_sql("metadata", ["user_id", "postcode", "tariff", "start_text"]),
    _rule_sql("r_contracts", "metadata", [
        ("metadata_user_not_missing", "user_id", "0 missing", "user_id IS NULL", "fail"),
        ("metadata_postcode_length", "postcode", "5 digits", "length(CAST(postcode AS VARCHAR)) > 5", "fail"),
        ("metadata_date_order", "end_text", "end not before start",
         "strptime(end_text, ''%d/%m/%Y'') < strptime(start_text, ''%d/%m/%Y'')".replace("''", "'"), "fail")]),
])


@query("contract_checks", "D8 D48 A10 B27", _CONTRACT_SQL)
def contract_checks(spark, sf):
    return _contract_rows(spark, sf)


@query("manifest", "D47", """
    SELECT 'ingest' AS step, 'readings' AS artifact, count(*) AS n_rows, count(DISTINCT user_id) AS n_users,
           CAST(min(date) AS VARCHAR) AS date_min, CAST(max(date) AS VARCHAR) AS date_max, count(*) FILTER (WHERE kwh IS NULL) AS n_null_measure FROM r_readings
    UNION ALL SELECT 'ingest', 'daily', count(*), count(DISTINCT user_id), CAST(min(date) AS VARCHAR), CAST(max(date) AS VARCHAR),
           count(*) FILTER (WHERE daily_kwh IS NULL) FROM r_daily
    UNION ALL SELECT 'ingest', 'contracts', count(*), count(DISTINCT user_id), NULL, NULL, count(*) FILTER (WHERE p1_kw IS NULL) FROM r_contracts
    UNION ALL SELECT 'weather', 'weather', count(*), NULL, CAST(min(date) AS VARCHAR), CAST(max(date) AS VARCHAR),
           count(*) FILTER (WHERE prec IS NULL) FROM r_weather""")
def manifest(spark, sf):
    return checks.manifest([
        checks.manifest_row(R.readings(spark, sf), "ingest", "readings", "user_id", "date", "kwh"),
        checks.manifest_row(R.daily(spark, sf), "ingest", "daily", "user_id", "date", "daily_kwh"),
        checks.manifest_row(R.contracts(spark, sf), "ingest", "contracts", "user_id", None, "p1_kw"),
        checks.manifest_row(R.weather(spark, sf), "weather", "weather", None, "date", "prec")])


@query("gate_checks", "A10 B32", """
    SELECT 'min_users' AS check_id, CAST(100 AS BIGINT) AS expected, count(DISTINCT user_id) AS observed,
           CASE WHEN count(DISTINCT user_id) >= 100 THEN 'pass' ELSE 'fail' END AS status FROM r_readings
    UNION ALL SELECT 'no_null_kwh', 0, count(*) FILTER (WHERE kwh IS NULL), CASE WHEN count(*) FILTER (WHERE kwh IS NULL) = 0 THEN 'pass' ELSE 'fail' END FROM r_readings
    UNION ALL SELECT 'scope', 0, count(*) FILTER (WHERE NOT province IN ('01', '07', '12', '18', '23')),
           CASE WHEN count(*) FILTER (WHERE NOT province IN ('01', '07', '12', '18', '23')) = 0 THEN 'pass' ELSE 'fail' END FROM r_user
    UNION ALL SELECT 'daily_rows', (SELECT count(*) FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) FROM r_meter)), count(*),
           CASE WHEN count(*) = (SELECT count(*) FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) FROM r_meter)) THEN 'pass' ELSE 'fail' END FROM r_daily
    UNION ALL SELECT 'personal_columns', 0, 1, 'fail'""")
def gate_checks(spark, sf):
    readings = R.readings(spark, sf)
    cells = R.meter(spark, sf).select("user_id", "date").distinct().agg(F.count(F.lit(1)).alias("expected"))
    rows = R.daily(spark, sf).agg(F.count(F.lit(1)).alias("observed"))
    daily_rows = cells.crossJoin(rows).select(
        F.lit("daily_rows").alias("check_id"), "expected", "observed",
        F.when(F.col("expected") == F.col("observed"), "pass").otherwise("fail").alias("status"))
    hit = len(checks.personal_columns(readings))
    personal = readings.agg(F.lit(hit).cast("long").alias("observed")).select(
        F.lit("personal_columns").alias("check_id"), F.lit(0).cast("long").alias("expected"), "observed",
        F.when(F.col("observed") == 0, "pass").otherwise("fail").alias("status"))
    out = checks.gate_min_groups(readings, "user_id", 100, "min_users")
    for d in (checks.gate_no_nulls(readings, ["kwh"], "no_null_kwh"),
              checks.gate_scope(R.user_dimension(spark, sf), "province", ["01", "07", "12", "18", "23"]),
              daily_rows, personal):
        out = out.unionByName(d)
    return out


@query("column_audit", "D25 D27", """
    SELECT "column", type, n_rows, n_missing, round(100.0::DOUBLE * n_missing / n_rows, 2) AS pct_missing FROM (
      SELECT unnest(['user_id', 'contract_id', 'postcode', 'tariff', 'activity', 'p1_kw', 'start_text', 'end_text']) AS "column",
             unnest(['bigint', 'bigint', 'int', 'string', 'string', 'double', 'string', 'string']) AS type, n_rows,
             unnest([0, 0, 0, t, a, p, 0, e]) AS n_missing
      FROM (SELECT count(*) AS n_rows, count(*) FILTER (WHERE tariff IS NULL OR tariff = '') AS t,
                   count(*) FILTER (WHERE activity IS NULL) AS a, count(*) FILTER (WHERE p1_kw IS NULL) AS p,
                   count(*) FILTER (WHERE end_text IS NULL) AS e FROM r_contracts))""")
def column_audit(spark, sf):
    return checks.column_audit(R.contracts(spark, sf), placeholders=("", "unknown"))


@query("impact_overview", "B28 D46", """
    WITH r AS (SELECT count(*) AS n, count(DISTINCT user_id) AS u, count(*) FILTER (WHERE kwh IS NULL) AS nn,
        count(DISTINCT user_id) FILTER (WHERE kwh IS NULL) AS un, count(*) FILTER (WHERE kwh < 0) AS ng,
        count(DISTINCT user_id) FILTER (WHERE kwh < 0) AS ug, count(*) FILTER (WHERE kwh > 100) AS ne,
        count(DISTINCT user_id) FILTER (WHERE kwh > 100) AS ue FROM r_readings),
    p AS (SELECT unnest(['null', 'negative', 'extreme']) AS problem, unnest([nn, ng, ne]) AS n_readings, unnest([un, ug, ue]) AS n_users, n, u FROM r)
    SELECT problem, n_readings, n_users, round(100.0::DOUBLE * n_readings / n, 4) AS pct_readings, round(100.0::DOUBLE * n_users / u, 4) AS pct_users,
      CASE WHEN round(100.0::DOUBLE * n_readings / n, 4) >= 1 THEN 'high' WHEN round(100.0::DOUBLE * n_readings / n, 4) >= 0.1 THEN 'medium' ELSE 'low' END AS impact FROM p""")
def impact_overview(spark, sf):
    k = F.col("kwh")
    tests = {"null": k.isNull(), "negative": k < 0, "extreme": k > 100}
    per_user = R.readings(spark, sf).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(p) for p, c in tests.items()])
    one = per_user.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("u"),
                       *[F.sum(p).alias(p) for p in tests], *[F.count_if(F.col(p) > 0).alias(f"u_{p}") for p in tests])
    rows = one.select("n", "u", F.inline(F.array(*[
        F.struct(F.lit(p).alias("problem"), F.col(p).alias("n_readings"), F.col(f"u_{p}").alias("n_users")) for p in tests])))
    share = C.pct("n_readings", "n", 4)
    return rows.select("problem", "n_readings", "n_users", share.alias("pct_readings"),
                       C.pct("n_users", "u", 4).alias("pct_users"), C.impact_level(share).alias("impact"))
