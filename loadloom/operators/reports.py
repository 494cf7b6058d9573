"""Report and serving tables built on the facts and dimensions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadloom.functions import columns as C
from loadloom.operators.ranks import percentiles


def scope_audit(users: DataFrame, key: str, codes: Iterable[str]) -> DataFrame:
    """Users per key, share of all users, and the totals inside and outside the scope."""
    n = users.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_users"))
    inside = C.in_scope(key, codes)
    t = n.agg(F.sum("n_users").alias("total_users"), F.coalesce(F.sum(F.when(inside, F.col("n_users"))), F.lit(0)).alias("scope_users"))
    return n.crossJoin(F.broadcast(t)).select(
        key, "n_users", inside.alias("in_scope"), C.pct("n_users", "total_users").alias("pct_total"), "scope_users", "total_users",
        (F.col("total_users") - F.col("scope_users")).alias("excluded_users"), C.pct("scope_users", "total_users").alias("scope_pct"))


def users_per_area(users: DataFrame, areas: DataFrame, key: str) -> DataFrame:
    """Users per listed area, zero where nobody lives."""
    n = users.groupBy(key).agg(F.count(F.lit(1)).alias("n_users"))
    return areas.select(key).distinct().join(n, key, "left").fillna(0, ["n_users"])


def small_cells(per_area: DataFrame, limit: int = 5) -> DataFrame:
    """How many areas have fewer users than the privacy limit, and how many users are in them."""
    small = (F.col("n_users") > 0) & (F.col("n_users") < limit)
    return per_area.agg(F.count(F.lit(1)).alias("n_areas"), F.count_if(small).alias("n_small_areas"),
                        F.coalesce(F.sum(F.when(small, F.col("n_users"))), F.lit(0)).alias("users_in_small_areas"),
                        F.min("n_users").alias("min_users"), F.max("n_users").alias("max_users"))


def share_rollup(df: DataFrame, category: str, value: Column | None = None, min_pct: float = 1.0, other="other") -> DataFrame:
    """Category counts where those under ``min_pct`` percent are merged into one."""
    n = df.groupBy(category).agg((F.count(F.lit(1)) if value is None else F.sum(value)).alias("n"))
    t = n.agg(F.sum("n").alias("_t"))
    name = F.when(F.lit(100.0) * F.col("n") / F.col("_t") < min_pct, other).otherwise(F.col(category))
    return (n.crossJoin(F.broadcast(t)).groupBy(name.alias(category), "_t").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_merged"))
            .select(category, "n", "n_merged", C.pct("n", "_t", 4).alias("pct")))


def energy_quartiles(users: DataFrame, value: str) -> DataFrame:
    """Users split at the exact quartiles, with their share of users and of energy."""
    q = percentiles(users, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    v = F.col(value)
    band = F.when(v <= F.col("q1"), "Q1").when(v <= F.col("q2"), "Q2").when(v <= F.col("q3"), "Q3").otherwise("Q4")
    g = (users.where(v.isNotNull()).crossJoin(F.broadcast(q)).groupBy(band.alias("segment"))
         .agg(F.count(F.lit(1)).alias("n_users"), F.sum(v).alias("kwh"), F.avg(v).alias("mean_kwh")))
    t = g.agg(F.sum("n_users").alias("_n"), F.sum("kwh").alias("_k"))
    return g.crossJoin(F.broadcast(t)).select("segment", "n_users", "kwh", "mean_kwh", C.pct("n_users", "_n", 4).alias("pct_users"),
                                              C.pct("kwh", "_k", 4).alias("pct_kwh"))


def group_means(df: DataFrame, by: Sequence[str], value: str, min_n: int = 10) -> DataFrame:
    """Mean per group, only for groups with at least ``min_n`` rows."""
    return (df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean")).where(F.col("n") >= min_n))


def complete_years(monthly: DataFrame, key="user_id") -> DataFrame:
    """Rows of (key, year) pairs that have all twelve months."""
    full = (monthly.groupBy(key, "year").agg(F.countDistinct("month").alias("m")).where(F.col("m") == 12).drop("m"))
    return monthly.join(full, [key, "year"], "left_semi")
