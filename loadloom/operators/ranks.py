"""Exact order statistics that never funnel a group through one task.

A rank over an unpartitioned (or badly skewed) window pulls all its rows into a
single task. Here equal values are first collapsed to counts and written; the
written rows are cut into ranges of about equal size by Spark's range
exchange, whose cut points come from the data. The number of the range is
written with the row, so a recomputed task sees the same ranges. A running
count then needs only (a) a window inside one range and (b) a prefix sum over
the few range totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadloom.sources.stage import broadcast_if_small, stage

RANGE_ROWS = 50_000


def value_ranges(counts: DataFrame, value: str, by: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """The written table with ``_range``: ascending numbers of runs of (by, value) of about ``range_rows`` rows.

    Rows must be distinct in (by, value). Up to ``range_rows`` rows are one range. A range is
    at most a few times ``range_rows``, since the exchange samples every input partition.
    """
    held = stage(counts)
    ranges = -(-held.count() // range_rows)
    if ranges <= 1:
        return held.withColumn("_range", F.lit(0))
    # Every partition is sampled in proportion, so 100 sampled rows a range bound its size.
    return stage(held.repartitionByRange(ranges, *by, value).withColumn("_range", F.spark_partition_id()))


def running_counts(df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(by, value, n, below, total, n_top) of every distinct non-null value.

    ``below`` counts the rows strictly below the value, ``total`` those of the
    group and ``n_top`` those at the group's largest value. ``weight`` names a
    column that already holds counts. The input runs once; the counts of its distinct values are written.
    """
    by = list(by)
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    counts = value_ranges(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(amount.cast("long").alias("n")), value, by, range_rows)
    totals = counts.groupBy(*by, "_range").agg(F.sum("n").alias("_bn"), F.max_by("n", value).alias("_bt"))
    group = Window.partitionBy(*by)
    ordered = group.orderBy("_range")
    offsets = totals.select(
        *by, "_range", F.coalesce(F.sum("_bn").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_bn").over(group).alias("total"), F.max(F.struct("_range", "_bt")).over(group)["_bt"].alias("n_top"))
    inside = (Window.partitionBy(*by, "_range").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    joined = null_safe_join(counts, offsets, by, ["_range"])
    return joined.select(
        *by, value, "n",
        (F.col("_offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("below"), "total", "n_top")


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], never_null: Sequence[str] = ()) -> DataFrame:
    """Equi-join that treats null keys as equal and keeps one copy of each key.

    Keys listed in ``never_null`` are compared plainly, so that a shuffle for the
    join also serves windows on them.
    """
    keys = [*on, *never_null]
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                         *[c for c in right.columns if c not in keys])
    cond = " AND ".join([f"{k} = _r_{k}" for k in never_null] + [f"{k} <=> _r_{k}" for k in on])
    return left.join(right, F.expr(cond)).drop(*[f"_r_{k}" for k in keys])


def percentiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (),
                weight: str | None = None) -> DataFrame:
    """Exact interpolated percentiles, one row per group, for unbounded groups.

    ``probs`` maps output column to probability. Matches ``percentile_cont``.
    """
    runs = running_counts(df, value, by, weight)
    aggs = []
    for name, p in probs.items():
        pos = f"((total - 1) * {float(p)}D)"
        low, high = (f"max({value}) FILTER (WHERE below <= {k} AND {k} < below + n)" for k in (f"floor{pos}", f"ceil{pos}"))
        aggs.append(F.expr(f"double({low}) + (double({high}) - double({low})) * max({pos} - floor{pos}) AS {name}"))
    return runs.groupBy(*by).agg(*aggs)


def order_statistic(df: DataFrame, value: str, rank: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """The ``rank``-th smallest value per group (1-based SQL text that may use ``total``), and the size ``n``."""
    runs = running_counts(df, value, by)
    k = f"least(greatest({rank}, 1), total)"
    return runs.groupBy(*by).agg(F.expr(f"max({value}) FILTER (WHERE below < {k} AND {k} <= below + n) AS {out}"),
                                 F.max("total").cast("long").alias("n"))


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, rank_min, rank_avg, rank_top) of each distinct value, ascending.

    ``rank_avg`` shares the mean rank among ties; ``rank_top`` is that of the largest value.
    """
    return running_counts(df, value, by).selectExpr(
        *by, value, "below + 1 AS rank_min", "below + (n + 1) / 2D AS rank_avg", "total - (n_top - 1) / 2D AS rank_top")


def scaled_ranks(df: DataFrame, key: str, scores: dict[str, tuple[str, bool]]) -> DataFrame:
    """Average-tie ranks divided by the top rank, in (0, 1]; null values get 0.5.

    ``scores`` maps each output column to (column, inverse). All columns are
    ranked together in long form and folded back by ``key``.
    """
    cols = sorted({c for c, _ in scores.values()})
    long = df.unpivot([key], [F.col(c).cast("double").alias(c) for c in cols], "_column", "_value")
    ranks = value_ranks(long.where("_value IS NOT NULL"), "_value", ["_column"]).selectExpr(
        "_column", "_value", "rank_avg / rank_top AS _up", "(rank_top - rank_avg + 1) / rank_top AS _down")
    # One row per distinct value: broadcast while its files are small, else a join whose hot values AQE can split.
    scored = long.join(broadcast_if_small(stage(ranks), 8 << 20), ["_column", "_value"], "left")
    folded = scored.groupBy(key).agg(*[
        F.expr(f"coalesce(max({'_down' if inverse else '_up'}) FILTER (WHERE _column = '{c}'), 0.5D) AS {out}")
        for out, (c, inverse) in scores.items()])
    return df.join(folded, key)


def latest_per_key(df: DataFrame, key: Sequence[str] | str, prefer: Sequence[Column] = (),
                   order: Sequence[Column] = ()) -> DataFrame:
    """One row per key: first by the ``prefer`` flags, then by ``order``.

    Uses ``max_by`` style aggregation over one struct, so a key with very many
    rows is reduced map-side instead of being sorted in one task. ``order`` must
    be expressions whose largest value wins and must end with a unique column.
    """
    key = [key] if isinstance(key, str) else list(key)
    sort_key = F.struct(*[p.cast("int").alias(f"p{i}") for i, p in enumerate(prefer)],
                        *[o.alias(f"o{i}") for i, o in enumerate(order)])
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), sort_key).alias("_row"))
    return best.select(*key, "_row.*")


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int,
                    rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group. Spark turns the filter into a partial group limit."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Repeatable sample of ``n`` rows: the smallest hashes of the key."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(n)
