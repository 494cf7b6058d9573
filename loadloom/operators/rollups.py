"""Roll-ups of readings to days, months, hourly profiles and series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadloom.functions.columns import day_type, iso_dow, season, valid_reading


def daily_rollup(df: DataFrame, user="user_id", ts="ts", value="kwh") -> DataFrame:
    """Energy per user and day from valid readings (hash aggregate, partial first)."""
    return (df.where(valid_reading(value, user))
            .groupBy(user, F.to_date(ts).alias("date"))
            .agg(F.sum(value).alias("daily_kwh"), F.avg(value).alias("mean_hourly_kwh"),
                 F.min(value).alias("min_hourly_kwh"), F.max(value).alias("max_hourly_kwh"),
                 F.stddev_samp(value).alias("sd_hourly_kwh"),
                 F.count(F.lit(1)).alias("hours_recorded")))


def monthly_rollup(daily: DataFrame, user="user_id", date="date") -> DataFrame:
    return (daily.groupBy(user, F.year(date).alias("year"), F.month(date).alias("month"))
            .agg(F.sum("daily_kwh").alias("monthly_kwh"), F.avg("daily_kwh").alias("mean_daily_kwh"),
                 F.max("daily_kwh").alias("max_daily_kwh"),
                 F.stddev_samp("daily_kwh").alias("sd_daily_kwh"),
                 F.sum("hours_recorded").cast("long").alias("total_hours"),
                 F.count(F.lit(1)).alias("days_recorded")))


def profile_grid(df: DataFrame, user="user_id", ts="ts", value="kwh") -> DataFrame:
    """Additive (sum, count) cube cells at user x season x weekday x hour.

    At most 4 * 7 * 24 rows per user, from one scan and one shuffle of partial
    aggregates; every profile below is a cheap re-aggregation of it.
    """
    return (df.where(valid_reading(value, user))
            .groupBy(user, season(F.month(ts)).alias("season"), iso_dow(ts).alias("dow"),
                     F.hour(ts).alias("hour"))
            .agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n")))


_PROFILE_KEYS = {
    "hour": ("hour",),
    "day_type": ("day_type", "hour"),
    "season": ("season", "hour"),
    "weekday": ("dow",),
}


def profile(grid: DataFrame, kind: str, user="user_id") -> DataFrame:
    """One mean profile: ``hour``, ``day_type``, ``season`` or ``weekday``."""
    grid = grid.withColumn("day_type", F.when(F.col("dow") >= 6, "weekend").otherwise("weekday"))
    return (grid.groupBy(user, *_PROFILE_KEYS[kind])
            .agg((F.sum("s") / F.sum("n")).alias("mean_kwh")))


def profile_bundle(df: DataFrame, user="user_id", ts="ts", value="kwh") -> DataFrame:
    """Five portfolio profiles, tagged and stacked, from one scan with GROUPING SETS."""
    cells = (df.where(valid_reading(value, user))
             .groupBy(season(F.month(ts)).alias("season"), day_type(ts).alias("day_type"),
                      F.month(ts).alias("month"), iso_dow(ts).alias("dow"), F.hour(ts).alias("hour"))
             .agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n")))
    sets = [["hour"], ["day_type", "hour"], ["season", "hour"], ["dow"], ["month"]]
    names = ["by_hour", "by_day_type_hour", "by_season_hour", "by_weekday", "by_month"]
    cols = ["season", "day_type", "month", "dow", "hour"]
    gid = F.grouping_id()
    tag = None
    for keys, name in zip(sets, names):
        mask = sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in keys)
        tag = F.when(gid == mask, name) if tag is None else tag.when(gid == mask, name)
    return (cells.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols])
            .agg(tag.alias("profile"), (F.sum("s") / F.sum("n")).alias("mean_kwh"),
                 F.sum("n").alias("n_readings"))
            .select("profile", *cols, "mean_kwh", "n_readings"))


def target_series(df: DataFrame, value="daily_kwh", when: Sequence = ("date",), by: Sequence[str] = (),
                  user="user_id", extra: Sequence = ()) -> DataFrame:
    """Total and users per period, optionally per group (a demand series).

    The input has one row per (user, period), so users are counted in the same pass as the total.
    """
    return (df.groupBy(*when, *by)
            .agg(F.sum(value).alias("total_kwh"), F.count(user).alias("n_users"), *extra))
