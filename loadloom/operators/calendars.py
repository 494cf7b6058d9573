"""Calendar dimension: date spine, holidays, Easter, bridge days and daylight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadloom.config import NATIONAL_HOLIDAYS, REGIONAL_HOLIDAYS

# Month and day of the yearly national holidays outside the listed years.
FIXED_NATIONAL = ((1, 1), (1, 6), (5, 1), (8, 15), (10, 12), (11, 1), (12, 6), (12, 8), (12, 25))


def date_spine(spark: SparkSession, start, end, name="date") -> DataFrame:
    one = spark.range(1)
    return one.select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias(name))


def spine_of(df: DataFrame, date="date") -> DataFrame:
    """Every day between the first and the last date of a table."""
    ends = df.agg(F.min(date).alias("a"), F.max(date).alias("b")).where("a IS NOT NULL")
    return ends.select(F.explode(F.sequence("a", "b")).alias(date))


def easter_sql(year: str) -> str:
    """SQL text of Easter Sunday (Gregorian) for a year expression, in integer arithmetic."""
    golden, century, rest = f"({year} % 19)", f"({year} div 100)", f"({year} % 100)"
    moon = f"(({century} - ({century} + 8) div 25 + 1) div 3)"
    epact = f"((19 * {golden} + {century} - {century} div 4 - {moon} + 15) % 30)"
    weekday = f"((32 + 2 * ({century} % 4) + 2 * ({rest} div 4) - {epact} - {rest} % 4) % 7)"
    late = f"(({golden} + 11 * {epact} + 22 * {weekday}) div 451)"
    n = f"({epact} + {weekday} - 7 * {late} + 114)"
    return f"make_date({year}, int({n} div 31), int({n} % 31 + 1))"


def easter(year: str) -> Column:
    return F.expr(easter_sql(year))


def national_holiday(date: str, easter_sunday: str) -> Column:
    """Listed days in the years with an official list, the yearly rule in all others."""
    years = ", ".join(sorted({d[:4] for d in NATIONAL_HOLIDAYS}))
    listed = ", ".join(f"DATE'{d}'" for d in NATIONAL_HOLIDAYS)
    fixed = ", ".join(str(m * 100 + d) for m, d in FIXED_NATIONAL)
    return F.expr(f"""CASE WHEN year({date}) IN ({years}) THEN {date} IN ({listed})
        ELSE month({date}) * 100 + day({date}) IN ({fixed}) OR datediff({date}, {easter_sunday}) = -2 END""")


def regional_labels(key: str, date: str, easter_sunday: str, rules: Sequence = REGIONAL_HOLIDAYS) -> Column:
    """Labels of the regional rules that make this day a holiday, in order, ``; ``-separated."""
    hits = []
    for codes, offsets, fixed, label in sorted(rules, key=lambda r: r[3]):
        days = [f"month({date}) * 100 + day({date}) = {m * 100 + d}" for m, d in fixed]
        days += [f"datediff({date}, {easter_sunday}) = {o}" for o in offsets]
        code_list = ", ".join(f"'{c}'" for c in codes)
        hits.append(f"CASE WHEN {key} IN ({code_list}) AND ({' OR '.join(days)}) THEN '{label}' END")
    return F.expr(f"concat_ws('; ', array_distinct(array({', '.join(hits)})))")


def calendar(keys: DataFrame, spine: DataFrame, rules: Sequence = REGIONAL_HOLIDAYS, key="province",
             cap: int = 30) -> DataFrame:
    """Calendar features at (key, date).

    Holidays are expressions of the date, so the grid is built by one cross join
    of keys and days and needs a single shuffle for the neighbour windows. It has
    keys x days rows (a few hundred thousand at most).
    """
    grid = keys.select(key).distinct().crossJoin(spine.withColumn("_easter", easter("year(date)")))
    grid = grid.select(key, "date", national_holiday("date", "_easter").alias("_n"),
                       regional_labels(key, "date", "_easter", rules).alias("_label"),
                       F.datediff("date", "_easter").between(-3, 1).alias("is_easter_window"))
    grid = grid.selectExpr(
        key, "date", "is_easter_window", "_n OR _label <> '' AS is_holiday", "_n AS is_holiday_national",
        "_label <> '' AS is_holiday_regional",
        """CASE WHEN _n AND _label <> '' THEN 'national_and_regional' WHEN _n THEN 'national'
           WHEN _label <> '' THEN 'regional' ELSE 'none' END AS holiday_scope""",
        "concat_ws('; ', CASE WHEN _n THEN 'National' END, nullif(_label, '')) AS holiday_label")
    # The look-ahead runs backwards over the dates, so both directions are running frames.
    last_holiday = "last(CASE WHEN is_holiday THEN date END, true)"
    running = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    w = f"PARTITION BY {key} ORDER BY date"
    return grid.selectExpr(
        "*", f"""least(datediff(date, {last_holiday} OVER ({w} {running})),
                       datediff({last_holiday} OVER ({w} DESC {running}), date), {cap}) AS days_to_holiday""",
        f"""weekday(date) < 5 AND NOT is_holiday AND (lag(is_holiday, 1, false) OVER ({w})
            OR lead(is_holiday, 1, false) OVER ({w})) AS is_bridge_day""")


def daylight_hours(date: str, latitude: str) -> Column:
    """Hours between sunrise and sunset from the sunrise equation.

    The declination is the yearly sine; with refraction it stays within about
    ten minutes of almanac tables at middle latitudes.
    """
    tilt = f"asin(sin(radians(23.44D)) * sin(2 * pi() * (dayofyear({date}) - 81) / 365.25D))"
    lat = f"radians({latitude})"
    x = f"(sin(radians(-0.833D)) - sin({lat}) * sin({tilt})) / (cos({lat}) * cos({tilt}))"
    return F.expr(f"CASE WHEN {latitude} IS NOT NULL THEN 24 / pi() * acos(greatest(-1D, least(1D, {x}))) END")
