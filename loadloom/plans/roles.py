"""Spark side of the input roles: the driver tables seen as meter data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadloom.functions import columns as C
from loadloom.operators import rollups, series
from loadloom.operators.ranks import latest_per_key
from loadloom.sources.readers import read_table
from loadloom.sources.stage import broadcast_if_small, stage


# Declared schemas of the input tables.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet", SCHEMAS[name])


def readings(spark, sf) -> DataFrame:
    """Thirty days of hourly-like readings with nulls and negatives."""
    return table(spark, sf, "events").selectExpr(
        "user_id", "event_id", "ts", "to_date(ts) AS date",
        """CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN NULL
                WHEN event_type = 'error' AND event_id % 10 = 1 THEN -floor(value * 64) / 64
                ELSE floor(value * 64) / 64 END AS kwh""")


def meter(spark, sf) -> DataFrame:
    """Seven years of readings per meter; the hour is derived from the order line."""
    return meter_of(table(spark, sf, "lineitem"))


def meter_of(lineitem: DataFrame) -> DataFrame:
    hour = "int((l_orderkey * 5 + l_linenumber) % 24)"
    return lineitem.selectExpr(
        "l_suppkey AS user_id", f"l_shipdate + make_dt_interval(0, {hour}) AS ts", "to_date(l_shipdate) AS date",
        f"{hour} AS hour", "l_quantity / 8 AS kwh")


def daily(spark, sf) -> DataFrame:
    return rollups.daily_rollup(meter(spark, sf))


def short_daily(spark, sf) -> DataFrame:
    return rollups.daily_rollup(readings(spark, sf))


def contracts(spark, sf) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, F.expr("o_custkey = c_custkey")).selectExpr(
        "o_custkey AS user_id", "o_orderkey AS contract_id", "int(c_nationkey * 1000 + o_custkey % 1000) AS postcode",
        """CASE o_orderpriority WHEN '1-URGENT' THEN '2.0TD' WHEN '2-HIGH' THEN '2.0DHA' WHEN '3-MEDIUM' THEN '3.0TD'
           WHEN '5-LOW' THEN '' END AS tariff""",
        "CASE WHEN o_orderkey % 7 <> 0 THEN concat(string((o_orderkey * 37) % 9900), '.0') END AS activity",
        "floor(c_acctbal / 8) / 64 AS p1_kw", "date_format(o_orderdate, 'dd/MM/yyyy') AS start_text",
        """CASE WHEN o_orderstatus = 'F' THEN
           date_format(date_add(to_date(o_orderdate), int(o_orderkey % 400 - 20)), 'dd/MM/yyyy') END AS end_text""")


def user_dimension(spark, sf) -> DataFrame:
    """Latest contract per user: known tariff first, then newest start date."""
    c = contracts(spark, sf).withColumn("start_date", F.try_to_date("start_text", "dd/MM/yyyy"))
    known = F.col("tariff").isNotNull() & (F.col("tariff") != "")
    one = latest_per_key(c, "user_id", prefer=[F.coalesce(known, F.lit(False))],
                         order=[F.col("start_date"), F.col("contract_id")])
    return one.select("user_id", "contract_id", "postcode", C.province_code("postcode").alias("province"),
                      "tariff", C.blank_to("tariff", "unknown").alias("tariff_clean"), "activity",
                      "p1_kw", "start_date")


def weather(spark, sf) -> DataFrame:
    """Daily weather per province with natural gaps and some missing cells."""
    meters = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.expr("l_suppkey = s_suppkey"))
    days = meters.groupBy(F.expr("lpad(string(s_nationkey), 2, '0') AS province"), F.expr("to_date(l_shipdate) AS date")).agg(
        *[F.expr(e) for e in (
            "avg(l_quantity) / 2 AS tmean", "max(l_quantity) / 2 + 2 AS tmax", "min(l_quantity) / 2 - 2 AS tmin",
            "sum(round(l_tax * 100)) / 4 AS prec", "avg(round(l_discount * 100)) * 10 AS rh",
            "double(max(l_linenumber) * 2) AS sun", "double(count(*)) AS wind")])
    return days.selectExpr("province", "concat('S', province) AS station", "date", "tmean", "tmax", "tmin",
                           "CASE WHEN day(date) % 7 <> 0 THEN prec END AS prec", "rh",
                           "CASE WHEN day(date) % 5 <> 0 THEN sun END AS sun", "wind")


def meter_province(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("user_id"),
        F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("province"))


def panel(spark, sf, days: DataFrame | None = None) -> DataFrame:
    """Daily energy with the previous day's provincial weather."""
    # The weather layer is written first: with its real size known, the large
    # user-day table is not shuffled for this join while the layer is small.
    layer = weather(spark, sf).select("province", F.date_add("date", 1).alias("date"), "tmean", "tmax", "tmin", "prec")
    w = broadcast_if_small(stage(layer))
    days = daily(spark, sf) if days is None else days
    return (days.join(meter_province(spark, sf), "user_id")
            .join(w, ["province", "date"], "left")
            .select("user_id", "date", "daily_kwh", "hours_recorded", "province", "tmean", "tmax",
                    "tmin", "prec", C.heating_degrees("tmean").alias("hdd"),
                    C.cooling_degrees("tmean").alias("cdd")))


def portfolio(spark, sf, days: DataFrame | None = None) -> DataFrame:
    return (rollups.target_series(daily(spark, sf) if days is None else days)
            .select("date", F.col("total_kwh").alias("y"), "n_users"))


def labels(spark, sf, days: DataFrame | None = None) -> DataFrame:
    s = table(spark, sf, "supplier")
    m = (daily(spark, sf) if days is None else days).groupBy("user_id").agg(F.avg("daily_kwh").alias("m"))
    return m.join(s, F.col("user_id") == F.col("s_suppkey")).select(
        "user_id", F.when(F.col("m") < 3, -1).otherwise((F.col("s_nationkey") % 4).cast("int")).alias("cluster"))


# The clusters that the label rule can give.
CLUSTERS = (-1, 0, 1, 2, 3)


def cluster_ids(spark, sf) -> list[int]:
    """Clusters of the label table, in order: one value per cluster, however many users there are."""
    return [r[0] for r in labels(spark, sf).select("cluster").distinct().orderBy("cluster").collect()]


def cluster_daily(spark, sf, days: DataFrame | None = None) -> DataFrame:
    d = (daily(spark, sf) if days is None else days).join(labels(spark, sf, days), "user_id")
    return (rollups.target_series(d, by=["cluster"])
            .select("date", "cluster", F.col("total_kwh").alias("y"), "n_users"))


def forecast(spark, sf, p: DataFrame | None = None) -> DataFrame:
    """Portfolio series (``p`` if it is written already) with three baseline predictions."""
    p = series.add_lags(portfolio(spark, sf) if p is None else p, y="y", order="date", lags=(1, 7), means=(7,))
    return p.select("date", "y", "n_users", F.col("lag1").alias("naive"), F.col("lag7").alias("weekly"),
                    F.col("roll7").alias("rolling"))


def cluster_forecast(spark, sf, c: DataFrame | None = None) -> DataFrame:
    p = series.add_lags(cluster_daily(spark, sf) if c is None else c, y="y", order="date", key=("cluster",), lags=(1,), means=(7,))
    return p.select("date", "cluster", "y", "n_users", F.col("lag1").alias("naive"), F.col("roll7").alias("pred"))
