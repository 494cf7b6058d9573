"""Series features. Every value at time t uses strictly earlier observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadloom.functions import columns as C


def add_lags(df: DataFrame, y: str, order: str, key: Sequence[str] = (), lags: Sequence[int] = (),
             means: Sequence[int] = (), sds: Sequence[int] = (), prefix: str = "") -> DataFrame:
    """Lags, rolling means and rolling deviations of ``y`` per series.

    Series are aggregates (one row per period and group), so a window group is
    bounded by the length of the calendar whatever the number of readings.
    Rolling frames end at the previous row and are null until they are full.
    """
    w = Window.partitionBy(*key).orderBy(order)
    out = {f"{prefix}lag{k}": F.lag(y, k).over(w) for k in lags}
    for n in means:
        f = w.rowsBetween(-n, -1)
        out[f"{prefix}roll{n}"] = F.when(F.count(y).over(f) == n, F.avg(y).over(f))
    for n in sds:
        f = w.rowsBetween(-n, -1)
        out[f"{prefix}roll{n}_sd"] = F.when(F.count(y).over(f) == n, F.stddev_samp(y).over(f))
    return df.select("*", *[c.alias(n) for n, c in out.items()])


def add_differences(df: DataFrame, y: str, order: str, key: Sequence[str] = (),
                    pairs: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Differences between two past lags, e.g. ``{"diff_7": (1, 8)}``."""
    pairs = pairs or {"diff_1": (1, 2), "diff_7": (1, 8), "yoy_diff": (1, 366)}
    w = Window.partitionBy(*key).orderBy(order)
    return df.select("*", *[(F.lag(y, a).over(w) - F.lag(y, b).over(w)).alias(n)
                            for n, (a, b) in pairs.items()])


def add_past_weather(df: DataFrame, cols: Sequence[str], order: str, key: Sequence[str] = ()) -> DataFrame:
    """Yesterday's weather, its 7-row mean, and the mean of all past values in the same month."""
    out = df
    for c in cols:
        out = add_lags(out, c, order, key, lags=(1,), means=(7,), prefix=f"{c}_")
    w = Window.partitionBy(*key, F.month(order)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return out.select("*", *[F.avg(c).over(w).alias(f"{c}_month_normal") for c in cols])


def add_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """Calendar parts, flags and cyclic encodings of a date."""
    d = F.col(date)
    doy, dow, month = F.dayofyear(d), C.iso_dow(d), F.month(d)
    s1, c1 = C.cyclic(doy, 365.25)
    s2, c2 = C.cyclic(doy, 365.25, 2)
    sw, cw = C.cyclic(dow, 7)
    sm, cm = C.cyclic(month, 12)
    return df.select(
        "*", dow.alias("dow"), month.alias("month"), F.weekofyear(d).alias("week"), doy.alias("doy"),
        (dow >= 6).cast("int").alias("is_weekend"), (dow == 5).cast("int").alias("is_friday"),
        (dow == 1).cast("int").alias("is_monday"), month.isin(6, 7, 8).cast("int").alias("is_summer"),
        month.isin(12, 1, 2).cast("int").alias("is_winter"),
        s1.alias("sin_doy"), c1.alias("cos_doy"), s2.alias("sin_doy2"), c2.alias("cos_doy2"),
        sw.alias("sin_dow"), cw.alias("cos_dow"), sm.alias("sin_month"), cm.alias("cos_month"))


def shifted_join(df: DataFrame, y: str, date: str, days: int, out: str, key: Sequence[str] = ()) -> DataFrame:
    """Value exactly ``days`` calendar days earlier (unlike a row lag, gaps do not move it)."""
    past = df.select(*key, F.date_add(date, days).alias(date), F.col(y).alias(out))
    return df.join(past, [*key, date], "left")


def frozen_seasonal(df: DataFrame, y: str, date: str, cutoff, period: int, out: str,
                    key: Sequence[str] = ()) -> DataFrame:
    """Repeat the last ``period`` days up to ``cutoff`` over everything after it."""
    cut = F.lit(cutoff).cast("date")
    last = (df.where((F.col(date) <= cut) & (F.col(date) > F.date_sub(cut, period)))
            .select(*key, F.pmod(F.datediff(date, cut) - 1, F.lit(period)).alias("_phase"), F.col(y).alias(out)))
    phased = df.withColumn("_phase", F.pmod(F.datediff(date, cut) - 1, F.lit(period)))
    joined = phased.join(last, [*key, "_phase"], "left").drop("_phase")
    return joined.withColumn(out, F.when(F.col(date) > cut, F.col(out)))


def trim_tail(df: DataFrame, y: str, date: str, key: Sequence[str] = (), lookback: int = 28,
              ratio: float = 0.35) -> DataFrame:
    """Drop the run of collapsed points at the end of each series.

    A point is collapsed when it lies below ``ratio`` times the median of the
    ``lookback`` earlier points; only the unbroken run up to the last point goes.
    """
    w = Window.partitionBy(*key).orderBy(date)
    past = w.rowsBetween(-lookback, -1)
    med = F.when(F.count(y).over(past) == lookback, F.percentile(y, F.lit(0.5)).over(past))
    bad = F.coalesce(F.col(y) < F.lit(ratio) * med, F.lit(False))
    later = Window.partitionBy(*key).orderBy(F.desc(date)).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("_good", (~bad).cast("int"))
    return (marked.withColumn("_keep", F.max("_good").over(later))
            .where(F.col("_keep") == 1).drop("_good", "_keep"))


def temporal_split(df: DataFrame, date: str, train_end, val_end, test_end=None) -> DataFrame:
    """Label every row train, val or test by date (null beyond the test end)."""
    d = F.col(date)
    test = d.isNotNull() if test_end is None else d <= F.lit(test_end).cast("date")
    return df.withColumn("split", F.when(d <= F.lit(train_end).cast("date"), "train")
                         .when(d <= F.lit(val_end).cast("date"), "val").when(test, "test"))


_EX_POST = ("tmean", "tmax", "tmin", "hdd", "cdd", "prec")


def feature_set(columns: Sequence[str], mode: str) -> list[str]:
    """Columns allowed as regressors under a weather mode.

    ``ex_post`` may use the weather of day t, ``operational`` only what was known
    before t, ``none`` no weather at all.
    """
    weather_now = [c for c in columns if c in _EX_POST]
    weather_past = [c for c in columns if any(c.startswith(f"{w}_") for w in _EX_POST)]
    base = [c for c in columns if c not in weather_now and c not in weather_past]
    if mode == "none":
        return base
    if mode == "operational":
        return base + weather_past
    if mode == "ex_post":
        return base + weather_past + weather_now
    raise ValueError(f"unknown weather mode {mode!r}")


def frozen_by_phase(df: DataFrame, y: str, time: str, cutoff: str, periods: dict[str, int], key: Sequence[str] = ()) -> DataFrame:
    """After the cutoff, the last value at or before it with the same phase, for each named period in hours.

    The lookup is one aggregate per period (the latest value of every phase), joined to the horizon by phase: no self-join
    on time, and a missing hour falls back to the same phase one period earlier. Rows up to the cutoff get null.
    """
    cut = F.lit(cutoff).cast("timestamp_ntz")
    hours = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / 3_600_000_000)
    out = df
    for name, period in periods.items():
        phase = F.pmod(hours, F.lit(period))
        last = (df.where((F.col(time) <= cut) & F.col(y).isNotNull()).groupBy(*key, phase.alias("_phase"))
                .agg(F.max_by(y, time).alias("_last")))
        joined = out.withColumn("_phase", phase).join(F.broadcast(last) if not key else last, [*key, "_phase"], "left")
        out = joined.withColumn(name, F.when(F.col(time) > cut, F.col("_last"))).drop("_phase", "_last")
    return out
