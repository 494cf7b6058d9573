"""Hand-made fixtures for the operators, compared with known results or brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadloom.functions import aggregates as A
from loadloom.functions import columns as C
from loadloom.operators import calendars, checks, clusters, features, forecast_eval as E, quality, ranks, reconcile, segments, series, weather
from loadloom.sources import readers, writers

D = dt.date


def one(df):
    return df.first().asDict()


# --- sources --------------------------------------------------------------------


def test_csv_ingest_takes_user_from_name_and_skips_other_files(spark, tmp_path):
    a, b = "a" * 64, "0123456789abcdef" * 4
    (tmp_path / f"{a}.csv").write_text("index,fl,kWh,imp\n2020-01-01 00:00:00,0,1.5,0\n2020-01-01 01:00:00,0,NA,0\n")
    (tmp_path / f"{b}.csv").write_text("index,fl,kWh,imp\n2021-06-01 05:00:00,0,-2,0\n")
    (tmp_path / "manifest.csv").write_text("file,size\nx,1\n")
    rows = readers.read_readings_csv(spark, str(tmp_path)).collect()
    assert {r.user_id for r in rows} == {a, b}
    assert len(rows) == 3 and sum(r.kwh is None for r in rows) == 1
    assert {(r.year, r.month) for r in rows if r.user_id == b} == {(2021, 6)}


def test_dynamic_overwrite_replaces_only_its_partitions(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 2019), (2, 2020)], "v int, year int")
    writers.write_parquet(df, p, ["year"], files_per_partition=2)
    writers.write_parquet(spark.createDataFrame([(9, 2020)], "v int, year int"), p, ["year"], dynamic=True)
    assert {(r.v, r.year) for r in spark.read.parquet(p).collect()} == {(1, 2019), (9, 2020)}


def test_materialize_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "m")
    assert readers.materialize(spark, path, build).count() == 3
    assert readers.materialize(spark, path, build).count() == 3
    assert len(calls) == 1


# --- scalars -------------------------------------------------------------------------


def test_temperature_order_and_codes(spark):
    df = spark.createDataFrame([(5.0, 3.0, 9.0), (1.0, 12.0, 9.0), (1.0, 2.0, 3.0)], "lo double, mid double, hi double")
    lo, mid, hi, bad = C.ordered_temperatures("lo", "mid", "hi")
    rows = [tuple(r) for r in df.select(lo, mid, hi, bad).collect()]
    assert rows == [(3.0, 3.0, 9.0, True), (1.0, 12.0, 12.0, True), (1.0, 2.0, 3.0, False)]
    t = spark.createDataFrame([("0111.0",), ("NA",), ("",), ("12345",), ("97",), (None,)], "a string")
    assert [r[0] for r in t.select(C.activity_code("a")).collect()] == ["0111", None, None, None, "0097", None]
    n = spark.createDataFrame([(" 7 ",), ("NA",), ("123",), ("ab",)], "a string")
    assert [r[0] for r in n.select(C.norm_code("a")).collect()] == ["07", None, "123", "ab"]


def test_locale_numbers(spark):
    df = spark.createDataFrame([("1.234,56",), ("12,5%",), ("x",)], "t string")
    assert [r[0] for r in df.select(C.parse_es("t")).collect()] == [1234.56, 12.5, None]
    assert spark.range(1).select(C.fmt_es(F.lit(1234.5), 2)).first()[0] == "1.234,50"
    w = spark.createDataFrame([("1,5",), ("Ip",), ("bad",)], "t string")
    assert [r[0] for r in w.select(C.parse_decimal_comma("t")).collect()] == [1.5, None, None]


# --- ranks and percentiles ------------------------------------------------------------


def test_percentiles_match_numpy_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot", rng.choice([-5.5, 0.0, 0.25, 1e-9, 3.0, 1e6]) + rng.randint(0, 50)) for _ in range(3000)]
    rows += [("b", float(i)) for i in range(7)] + [("c", 2.0)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in ranks.percentiles(df, "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, ["g"]).collect()}
    for g in ("hot", "b", "c"):
        v = [x for k, x in rows if k == g and x is not None]
        assert np.allclose([got[g].p10, got[g].p50, got[g].p99], np.quantile(v, [0.1, 0.5, 0.99]))


@pytest.mark.parametrize("name,value", [
    ("near zero", "id / 5e9D"), ("near a million", "1000000D + id / 1e9D"), ("mostly one value", "CASE WHEN id % 10 = 0 THEN id ELSE 7 END"),
    ("signed", "(id - 100000) * 1D"), ("whole", "id * 3")])
def test_ranges_come_from_the_data(spark, name, value):
    """Values that lie close together, and one value with nine tenths of the rows, are cut into even ranges."""
    n = 200_000
    df = spark.range(n).selectExpr(f"{value} AS v")
    distinct = df.groupBy("v").agg(F.count("*").alias("n"))
    sizes = [r["count"] for r in ranks.value_ranges(distinct, "v", range_rows=5_000).groupBy("_range").count().collect()]
    assert len(sizes) >= sum(sizes) // 5_000 and max(sizes) <= max(15_000, 0.05 * sum(sizes))
    got = ranks.running_counts(df, "v", range_rows=5_000).orderBy("v").toPandas()
    assert (got.below == got.n.cumsum() - got.n).all() and (got.total == n).all() and (got.n_top == got.n.iloc[-1]).all()


def test_ranges_of_groups(spark):
    """One group with most of the rows next to many small ones; null is a group too."""
    df = spark.range(60_000).selectExpr("CASE WHEN id < 40000 THEN 'hot' WHEN id % 50 > 0 THEN concat('g', id % 50) END AS g", "id % 20011 AS v")
    got = ranks.running_counts(df, "v", ["g"], range_rows=2_000).toPandas().sort_values(["g", "v"])
    want = df.toPandas().groupby("g", dropna=False)["v"].value_counts().reset_index().sort_values(["g", "v"])
    assert len(got) == len(want) and (got.n.to_numpy() == want["count"].to_numpy()).all()
    below = want.groupby("g", dropna=False)["count"].cumsum() - want["count"]
    assert (got.below.to_numpy() == below.to_numpy()).all()
    assert (got.groupby("g", dropna=False).total.first() == df.toPandas().groupby("g", dropna=False).size()).all()


def test_scaled_ranks_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 20.0), (4, None)], "user_id int, x double")
    r = {x.user_id: (x.up, x.down) for x in ranks.scaled_ranks(df, "user_id", {"up": ("x", False), "down": ("x", True)}).collect()}
    assert r[1] == pytest.approx((1 / 2.5, 1.0))
    assert r[2] == r[3] == pytest.approx((1.0, 1 / 2.5))
    assert r[4] == (0.5, 0.5)


def test_latest_contract_parses_dates_before_sorting(spark):
    df = spark.createDataFrame([(1, 1, None, "15/06/2023"), (1, 2, "2.0TD", "31/01/2020"), (1, 3, "2.0TD", "01/12/2022")],
                               "user_id int, id int, tariff string, start string")
    out = ranks.latest_per_key(df, "user_id", prefer=[F.col("tariff").isNotNull()], order=[F.try_to_date("start", "dd/MM/yyyy"), F.col("id")])
    assert one(out)["id"] == 3


# --- quality ------------------------------------------------------------------------------


def test_gaps_and_runs(spark):
    d = spark.createDataFrame([(1, D(2020, 1, x)) for x in (1, 2, 4, 8)], "user_id int, date date")
    assert sorted(r.gap_days for r in quality.gaps(d).collect()) == [1, 3]
    flags = [True, True, False, True, True, True, True, True, False, True]
    r = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "k int, i int, f boolean")
    assert one(weather.longest_run(r, ["k"], "i", "f"))["longest_run"] == 5


def test_affected_users_kinds(spark):
    ts = dt.datetime(2020, 1, 1)
    rows = [(1, ts, -1.0), (1, ts, 150.0), (2, ts, -2.0), (3, ts, 1.0), (4, ts, 120.0), (5, ts, None)]
    h = spark.createDataFrame(rows, "user_id int, ts timestamp_ntz, kwh double")
    d = spark.createDataFrame([(3, 250.0)], "user_id int, daily_kwh double")
    got = {r.user_id: r.anomaly for r in quality.affected_users(h, d, 100, 200).collect()}
    assert got == {1: "negative and extreme hours", 2: "negative", 3: "extreme days", 4: "extreme hours"}


def test_spike_operators_agree_with_brute_force(spark):
    rng = random.Random(1)
    rows = [(u, i, float(rng.randint(0, 9)) + (500 if i == 7 else 0)) for u in (1, 2) for i in range(200)]
    df = spark.createDataFrame(rows, "user_id int, i int, kwh double")
    want = 0
    for u in (1, 2):
        v = np.array([k for x, _, k in rows if x == u])
        want += int((v > v.mean() + 4 * v.std(ddof=1)).sum())
    s = one(quality.spikes(df, 4, 168))
    assert (s["n_spikes"], s["n_users"]) == (want, 2)
    lim = df.groupBy("user_id").agg(F.avg("kwh").alias("m"), F.stddev_samp("kwh").alias("s"))
    assert quality.over_user_threshold(df, lim, F.col("m") + 4 * F.col("s")).count() == want


def test_contracts_report_missing_columns_and_bad_rows(spark):
    df = spark.createDataFrame([(1, -1.0), (2, None)], "user_id int, kwh double")
    rows = checks.contracts(df, "t", ["user_id", "absent"], [checks.Rule("neg", "kwh", "0", F.col("kwh") < 0),
                                                          checks.Rule("gone", "absent", "0", F.col("absent") < 0, "warn")])
    got = {r.check_id: r.status for r in rows.collect()}
    assert got == {"t_schema_user_id": "pass", "t_schema_absent": "fail", "neg": "fail", "gone": "warn"}
    with pytest.raises(checks.CheckFailed):
        checks.expect_no_fail(rows)


def test_personal_columns_are_refused(spark):
    with pytest.raises(checks.CheckFailed):
        checks.guard_personal_data(spark.createDataFrame([("x", 1)], "Email string, a int"))


def test_funnel_is_monotone(spark):
    df = spark.createDataFrame([(i, i % 2 == 0, None if i % 3 else True) for i in range(30)], "i int, a boolean, b boolean")
    rows = sorted(checks.funnel(df, [("a", F.col("a")), ("b", F.col("b"))]).collect(), key=lambda r: r.step_no)
    assert [r.n for r in rows] == [30, 15, 5]


# --- calendar and weather -----------------------------------------------------------------------


@pytest.mark.parametrize("year,date", [(2019, D(2019, 4, 21)), (2024, D(2024, 3, 31)), (2000, D(2000, 4, 23)), (1997, D(1997, 3, 30))])
def test_easter(spark, year, date):
    assert spark.createDataFrame([(year,)], "y int").select(calendars.easter("y")).first()[0] == date


def test_calendar_bridge_distance_and_scope(spark):
    keys = spark.createDataFrame([("28",), ("20",)], "province string")
    cal = calendars.calendar(keys, calendars.date_spine(spark, "2019-01-01", "2019-12-31"))
    rows = {(r.province, r.date): r for r in cal.collect()}
    assert len(rows) == 730
    assert rows["28", D(2019, 8, 15)].is_holiday and rows["28", D(2019, 8, 16)].is_bridge_day  # Thursday, then Friday
    assert rows["20", D(2019, 4, 18)].holiday_scope == "regional" and rows["28", D(2019, 4, 18)].holiday_scope == "none"
    assert rows["28", D(2019, 7, 1)].days_to_holiday == 30
    assert rows["28", D(2019, 4, 21)].is_easter_window and not rows["28", D(2019, 4, 23)].is_easter_window
    holidays = [d for (p, d), r in rows.items() if p == "28" and r.is_holiday]
    for (p, d), r in rows.items():
        if p == "28":
            assert r.days_to_holiday == min(30, min(abs((d - h).days) for h in holidays))


def test_daylight_is_close_to_twelve_hours_at_equinox(spark):
    df = spark.createDataFrame([(D(2020, 3, 20), 43.0), (D(2020, 6, 21), 43.0), (D(2020, 6, 21), None)], "d date, lat double")
    a, b, c = (r[0] for r in df.select(calendars.daylight_hours("d", "lat")).collect())
    assert abs(a - 12.1) < 0.2 and abs(b - 15.4) < 0.3 and c is None


def test_padding_and_imputation_leave_no_gap(spark):
    rows = [("01", "S", D(2020, 1, 1) + dt.timedelta(i), float(i)) for i in (0, 1, 4, 9)]
    df = spark.createDataFrame(rows, "province string, station string, date date, tmean double")
    spine = calendars.date_spine(spark, "2020-01-01", "2020-01-10")
    out = weather.impute_seasonal(weather.pad_daily(df, ["province", "station"], spine), ["province", "station"], ["tmean"])
    got = {r.date.day - 1: r for r in out.collect()}
    assert len(got) == 10 and all(r.tmean is not None for r in got.values())
    assert [i for i in range(10) if not got[i].tmean_imputed] == [0, 1, 4, 9]
    assert all(got[i].row_imputed == got[i].tmean_imputed for i in range(10))


def test_three_day_runs(spark):
    hot = [0, 9, 9, 0, 9, 9, 9, 0, 9, 9, 9, 9, 9]
    df = spark.createDataFrame([("S", D(2020, 7, 1) + dt.timedelta(i), float(h), 0.0) for i, h in enumerate(hot)],
                               "station string, date date, tmax double, tmin double")
    out = weather.extreme_days(df, mode="run3", hot=0.5).orderBy("date").collect()
    assert [int(r.is_heatwave) for r in out] == [0, 0, 0, 0, 1, 1, 1, 0, 1, 1, 1, 1, 1]


# --- features --------------------------------------------------------------------------------------


def test_regressions_survive_degenerate_users(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(80):
        h, c = float(rng.normal()), float(rng.normal())
        rows += [(1, 1 + 2 * h - 3 * c, h, c), (2, 5.0, h, c), (3, 2 * h, h, 0.0), (4, 3 * c, 1.0, c), (5, h, h, 2 * h), (6, h, 1.0, 2.0)]
    rows.append((7, 1.0, 1.0, 1.0))
    df = spark.createDataFrame(rows, "user_id int, y double, h double, c double")
    got = {r.user_id: r for r in features.ols2(df, "user_id", "y", "h", "c").collect()}
    assert got[1].beta_h == pytest.approx(2) and got[1].beta_c == pytest.approx(-3) and got[1].r2_joint == pytest.approx(1)
    assert got[2].beta_h == pytest.approx(0, abs=1e-9) and got[2].r2_joint is None
    assert got[3].beta_h == pytest.approx(2) and got[3].beta_c is None
    assert got[4].beta_h is None and got[4].beta_c == pytest.approx(3)
    assert got[5].beta_h == pytest.approx(1) and got[5].beta_c is None
    assert got[6].beta_h is None and got[6].beta_c is None and 7 not in got
    r = df.groupBy("user_id").agg(A.safe_corr("y", "h").alias("r"), A.safe_slope("y", "h").alias("s")).where("user_id IN (2, 6, 7)").collect()
    assert all(x.r is None for x in r)


def test_monthly_entropy_bounds(spark):
    rows = [(1, D(2020, m, 1), 10.0, 24) for m in range(1, 13)] + [(2, D(2020, 5, 1), 3.0, 24)]
    df = spark.createDataFrame(rows, "user_id int, date date, daily_kwh double, hours_recorded int")
    got = {r.user_id: r.monthly_entropy for r in features.monthly_behaviour(df).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == 0.0


# --- clusters -----------------------------------------------------------------------------------------


def squares(spark):
    pts = [(i, [x + dx, y + dy], 1 if x == 0 else 2, i % 2) for i, (x, y, dx, dy) in enumerate(
        (x, y, dx, dy) for x, y in ((0.0, 0.0), (10.0, 10.0)) for dx in (0.0, 1.0) for dy in (0.0, 1.0))]
    return spark.createDataFrame(pts, "user_id int, x array<double>, cluster int, other int")


def test_indices_on_two_squares(spark):
    r = one(clusters.internal_indices(squares(spark), "x"))
    assert r["dunn"] == pytest.approx(np.linalg.norm([10, 10]) / (2 * np.sqrt(0.5)))
    assert r["davies_bouldin"] == pytest.approx(2 * np.sqrt(0.5) / np.linalg.norm([10, 10]))
    assert r["calinski_harabasz"] == pytest.approx((2 * 4 * 50) / ((8 * 0.5) / 6))
    assert r["silhouette"] > 0.9


def test_indices_over_all_of_many_rows(spark):
    n, rng = 12_000, np.random.default_rng(1)
    y = np.append(rng.integers(0, 3, n - 1), 3)  # the last row is alone in its cluster
    x = rng.normal(size=(n, 2)) + 2.0 * y[:, None]
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "user_id int, x array<double>, cluster int")
    sil = []
    for lo in range(0, n, 1000):
        d = ((x[lo:lo + 1000, None, :] - x[None]) ** 2).sum(axis=2)
        sums = np.stack([d[:, y == c].sum(axis=1) for c in range(4)], axis=1)
        sizes = np.bincount(y)
        for i, c in enumerate(y[lo:lo + 1000]):
            inner = sums[i, c] / max(sizes[c] - 1, 1)
            outer = min(sums[i, o] / sizes[o] for o in range(4) if o != c)
            sil.append((outer - inner) / max(outer, inner) if sizes[c] > 1 else 0.0)
    assert one(clusters.internal_indices(df, "x"))["silhouette"] == pytest.approx(np.mean(sil))


def test_ari_and_jaccard(spark):
    s = squares(spark)
    assert one(clusters.ari(s.withColumn("b", 3 - F.col("cluster")), "cluster", "b"))["ari"] == pytest.approx(1.0)
    assert one(clusters.ari(s, "cluster", "other"))["ari"] < 0.1
    j = clusters.jaccard_by_cluster(s.withColumn("new", F.col("cluster") + 5), "cluster", "new").collect()
    assert all(r.jaccard == 1.0 for r in j)


def test_nearest_centroid_and_balance(spark):
    s = squares(spark)
    near = clusters.assign_nearest(s.withColumnRenamed("cluster", "given"), clusters.centroids(s, "x"), "x")
    assert near.where("given = cluster").count() == 8
    b = one(clusters.cluster_balance(s))
    assert (b["n_clusters"], b["min_pct"], b["balance_entropy"]) == (2, 50.0, pytest.approx(1.0))


def test_segment_rules_take_the_first_match(spark):
    df = spark.createDataFrame([("noise", 20.0, 0.7, 0.4), ("C1", 20.0, 0.7, 0.4), ("C2", 5.0, 0.2, 0.3)],
                               "label string, median_daily_kwh double, valley_share double, night_share double")
    got = {r.label: r.segment for r in segments.classify_segments(df).collect()}
    assert got == {"noise": "operational_anomaly", "C1": "intensive_night_use", "C2": "mixed_portfolio"}


# --- series and forecasts -----------------------------------------------------------------------------------


def test_series_features_do_not_leak(spark):
    base = [(D(2020, 1, 1) + dt.timedelta(i), float(i % 7 + i / 50), float(i % 5)) for i in range(400)]
    changed = [(d, 999.0 if i == 390 else y, w) for i, (d, y, w) in enumerate(base)]

    def build(rows):
        df = spark.createDataFrame(rows, "date date, y double, hdd double")
        df = series.add_lags(df, "y", "date", lags=(1, 2, 7, 14, 28, 365), means=(7, 14, 28), sds=(7, 28))
        df = series.add_differences(series.add_past_weather(df, ["hdd"], "date"), "y", "date")
        return [tuple(r[c] for c in df.columns if c != "y") for r in df.orderBy("date").collect()]

    a, b = build(base), build(changed)
    assert a[:391] == b[:391] and a[391:] != b[391:]


def test_tail_trim_drops_only_the_collapsed_end(spark):
    y = [10.0] * 40 + [1.0] + [10.0] * 30 + [1.0, 0.5, 0.2]
    df = spark.createDataFrame([(D(2020, 1, 1) + dt.timedelta(i), v) for i, v in enumerate(y)], "date date, y double")
    assert series.trim_tail(df, "y", "date").count() == len(y) - 3


def test_metric_null_and_zero_rules(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 12.0), (None, 1.0), (20.0, None), (0.0, 0.0)], "y double, pred double")
    m = one(E.point_metrics(df.withColumn("model", F.lit("m"))))
    assert m["n"] == 3 and m["mae"] == pytest.approx(1.0) and m["mape"] == pytest.approx(20.0)
    assert m["wape"] == pytest.approx(30.0) and m["cost"] == pytest.approx(3 * 0.095)
    i = spark.createDataFrame([(5.0, 4.0, 6.0), (9.0, 4.0, 6.0)], "y double, lo double, hi double")
    r = one(E.interval_metrics(i))
    assert r["coverage"] == 50.0 and r["width"] == 2.0 and r["winkler"] == pytest.approx(2 + 20 * 3 / 2)


@pytest.mark.parametrize("n,want", [(10, 10.0), (5, 5.0), (19, 18.0), (99, 90.0)])
def test_conformal_order_statistic(spark, n, want):
    df = spark.createDataFrame([(float(i),) for i in range(1, n + 1)], "r double")
    assert one(E.conformal(df, "r"))["q"] == want


def test_safety_factor_is_the_smallest_that_covers(spark):
    df = spark.createDataFrame([(float(i), 8.0) for i in range(1, 11)], "r double, q double")
    f = one(E.safety_factor(df, "r", "q", min_factor=1.0))["safety_factor"]
    assert f == pytest.approx(1.15)  # 9 of 10 residuals are within 9.2
    assert one(E.safety_factor(df, "r", "q", min_factor=1.5))["safety_factor"] == 1.5


def test_mint_is_coherent_and_matches_weighted_least_squares(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        a, b = rng.uniform(5, 10, 2)
        rows.append((i, a + b, a, b, a + b + rng.normal(0, 2), a + rng.normal(0, 0.5), b + rng.normal(0, 1)))
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "i double, t double, a double, b double, pt double, pa double, pb double")
    out = reconcile.mint(df, df, "t", "pt", ["a", "b"], ["pa", "pb"]).toPandas()
    assert np.allclose(out.mint_total, out.mint_pa + out.mint_pb)
    e = np.array([[r[1] - r[4], r[2] - r[5], r[3] - r[6]] for r in rows])
    assert np.allclose(reconcile.mint_matrix(np.cov(e.T)) @ np.array(rows[0][4:]), out[["mint_total", "mint_pa", "mint_pb"]].iloc[0])
    ident = reconcile.mint_matrix(np.eye(3), 0.0)
    assert np.allclose(ident @ ident, ident)


def test_stack_weights_are_a_convex_blend(spark):
    df = spark.createDataFrame([(float(i), float(i), 0.5 * i + 3) for i in range(1, 40)], "y double, a double, b double")
    w = reconcile.stack_weights(df, "y", ["a", "b"])
    assert sum(w.values()) == pytest.approx(1) and min(w.values()) >= 0 and w["a"] > w["b"]


def test_feature_modes():
    cols = ["lag1", "tmean", "tmean_lag1", "dow"]
    assert series.feature_set(cols, "none") == ["lag1", "dow"]
    assert "tmean" not in series.feature_set(cols, "operational") and "tmean" in series.feature_set(cols, "ex_post")


# --- evidence, residuals and the forecast assessment of clusters ---------------------


def test_evidence_takes_extremes_and_skips_missing_tables(spark):
    m = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", None), ("d", 1.0)], "model string, wape double")
    i = spark.createDataFrame([("season", "winter", 91.0), ("season", "summer", None), ("season", "autumn", 88.0)], "slice_type string, slice_value string, coverage double")
    assert [tuple(r) for r in E.evidence(m, i).collect()] == [("best_model", "b", 1.0), ("worst_model", "a", 3.0), ("worst_coverage", "season=autumn", 88.0)]
    scope = spark.createDataFrame([("test", 42.0)], "period string, pct_kwh double")
    full = E.evidence(m, i, m.where("model = 'a'"), scope, i)
    assert {tuple(r) for r in full.collect()} >= {("best_reconciliation", "a", 3.0), ("clustered_energy_pct", "test", 42.0), ("special_segment_coverage", "autumn", 88.0)}
    assert E.evidence(m.limit(0), i.limit(0)).count() == 0


def test_ablation_evidence_per_learner(spark):
    m = spark.createDataFrame([("none", "a", 9.0), ("operational", "a", 7.5), ("ex_post", "a", 7.0), ("none", "b", 5.0), ("ex_post", "b", 6.0)], "mode string, model string, wape double")
    got = {(r.finding, r.subject): r.value for r in E.ablation_evidence(m).collect()}
    assert got == {("weather_ablation", "a"): 2.0, ("operational_weather_cost", "a"): 0.5, ("weather_ablation", "b"): -1.0, ("operational_weather_cost", "b"): None}


def test_residual_series_and_week_slice(spark):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), float(h), None if h == 3 else h - 1.0) for h in range(24 * 9)]
    f = spark.createDataFrame(rows, "t timestamp_ntz, y double, p double")
    res = {r.t: r.residual for r in E.residual_series(f, ["p"], ["t"]).collect()}
    assert len(res) == len(rows) and res[rows[3][0]] is None and {v for v in res.values() if v is not None} == {1.0}
    week = E.time_slice(f, ["p"], "t", "2024-01-02 00:00:00").collect()
    assert len(week) == 2 * 24 * 7 and {r.series for r in week} == {"actual", "p"}
    assert min(r.t for r in week) == dt.datetime(2024, 1, 2) and max(r.t for r in week) == dt.datetime(2024, 1, 8, 23)
    assert {r.value for r in week if r.series == "actual"} == {float(h) for h in range(24, 24 * 8)}


def test_calibration_assessment_of_clusters(spark):
    # cluster 0 and 1 are covered on 8 of 10 days, cluster 2 always; cluster 3 has neither calibration nor alerts
    days = [(c, 10.0, 9.0, 8.0, 9.5 if c < 2 and d < 2 else 12.0) for c in range(4) for d in range(10)]
    iv = spark.createDataFrame(days, "cluster int, y double, pred double, lo double, hi double")
    cal = spark.createDataFrame([(0, 1.0, 2.0), (1, 2.0, 2.0), (2, 1.5, 2.0)], "cluster int, safety_factor double, qhat double")
    alerts = spark.createDataFrame([(0, "group", 80.0), (0, "diagnostic_month", 70.0), (1, "diagnostic_month", 60.0)], "cluster int, alert_level string, coverage double")
    got = {r.cluster: r for r in E.calibration_assessment(iv, cal, alerts).collect()}
    assert [got[c].recommendation for c in range(4)] == ["own calibration", "standard with follow-up", "standard", "standard"]
    assert [got[c].n_alerts for c in range(4)] == [2, 1, 0, 0] and [got[c].has_group_alert for c in range(4)] == [True, False, False, False]
    assert [got[c].coverage_test for c in range(4)] == [80.0, 80.0, 100.0, 100.0] and got[0].worst_coverage == 70.0 and got[3].safety_factor is None
    assert all(abs(r.wape - 10) < 1e-9 and r.n_test == 10 for r in got.values())
    calm = E.calibration_assessment(iv.where("cluster = 2").selectExpr("0 AS cluster", "y", "pred", "lo", "hi"), cal, alerts.limit(0)).first()
    assert calm.recommendation == "own monitoring" and calm.n_alerts == 0


def test_anomaly_share_equals_numpy(spark):
    r = np.random.default_rng(4)
    rows = [(int(c), float(a), float(b)) for c, (a, b) in zip(r.integers(0, 3, 200), r.normal(size=(200, 2)))]
    df = spark.createDataFrame([*rows, (0, None, 1.0), (7, 1.0, 1.0)], "cluster int, a double, b double")
    got = {x.cluster: x.anomaly_pct for x in clusters.anomaly_share(df, ["a", "b"]).collect()}
    for c in range(3):
        x = np.array([v[1:] for v in rows if v[0] == c])
        d = np.round(np.sqrt(((x - x.mean(0)) ** 2).sum(1)), 9)
        assert abs(got[c] - 100 * (d > np.quantile(d, 0.95)).mean()) < 1e-9
    assert got[7] == 0.0 and set(got) == {0, 1, 2, 7}
