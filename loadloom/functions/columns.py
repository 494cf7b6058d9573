"""Scalar column expressions. Each returns a ``Column`` and stays in codegen."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loadloom.config import ACTIVITY_SECTIONS, DEFAULT


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- validity and scope -----------------------------------------------------

def valid_reading(value="kwh", user="user_id") -> Column:
    """Non-null, non-negative measure that belongs to a known user."""
    v, u = _c(value), _c(user)
    return v.isNotNull() & (v >= 0) & u.isNotNull() & (u.cast("string") != "")


def complete_day(hours="hours_recorded", value="daily_kwh", full=DEFAULT.full_day_hours,
                 strict=False) -> Column:
    """A day with all its hours; ``strict`` also asks for positive energy."""
    v = _c(value)
    return (_c(hours) >= full) & v.isNotNull() & ((v > 0) if strict else (v >= 0))


def province_code(postcode) -> Column:
    """First two digits of the zero-padded postcode; null when it has over five digits."""
    text = _c(postcode).cast("string")
    return F.when(F.length(text) <= 5, F.substring(F.lpad(text, 5, "0"), 1, 2))


def norm_code(col, width=2) -> Column:
    """Trim, zero-pad digits, and turn blanks and ``NA`` into null."""
    t = F.trim(_c(col).cast("string"))
    digits = F.when(F.length(t) < width, F.lpad(t, width, "0")).otherwise(t)
    return (F.when(t.isin("", "NA"), None)
            .when(t.rlike("^[0-9]+$"), digits)
            .otherwise(t))


def in_scope(col, codes: Iterable[str]) -> Column:
    return F.coalesce(_c(col).isin(*codes), F.lit(False))


def blank_to(col, default) -> Column:
    c = _c(col)
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def residential_strict(tariff, tariffs=DEFAULT.residential_tariffs) -> Column:
    return F.coalesce(_c(tariff).isin(*tariffs), F.lit(False))


def residential_permissive(tariff, p1, tariffs=DEFAULT.residential_tariffs,
                           p1_max=DEFAULT.residential_p1_max) -> Column:
    t = _c(tariff)
    unknown = t.isNull() | (F.trim(t) == "")
    small = F.coalesce(_c(p1) <= p1_max, F.lit(False))
    return residential_strict(t, tariffs) | (F.coalesce(unknown, F.lit(True)) & small)


# --- calendar parts -----------------------------------------------------------

def season(month) -> Column:
    m = _c(month)
    return (F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring")
            .when(m.isin(6, 7, 8), "summer").when(m.isNotNull(), "autumn"))


def iso_dow(date) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(_c(date)) + 1


def is_weekend(date) -> Column:
    return F.weekday(_c(date)) >= 5


def day_type(date) -> Column:
    return F.when(is_weekend(date), "weekend").otherwise("weekday")


def tou_period(day_type_col, hour) -> Column:
    """Three-period household tariff: weekends and nights are the valley."""
    h = _c(hour)
    return (F.when(_c(day_type_col) != "weekday", "valley")
            .when(h.between(0, 7), "valley")
            .when(h.between(10, 13) | h.between(18, 21), "peak")
            .when(h.between(8, 9) | h.between(14, 17) | h.between(22, 23), "flat"))


def region_bucket(code, groups: dict[str, Sequence[str]], other="other") -> Column:
    c = _c(code)
    expr = None
    for label, codes in groups.items():
        expr = F.when(c.isin(*codes), label) if expr is None else expr.when(c.isin(*codes), label)
    return expr.otherwise(other)


def month_start(date) -> Column:
    return F.trunc(_c(date), "month")


def hour_start(ts: str) -> Column:
    """Start of the hour of a zone-less timestamp, independent of the session time zone."""
    return F.expr(f"make_timestamp_ntz(year({ts}), month({ts}), day({ts}), hour({ts}), 0, 0)")


def cyclic(col, period, harmonic=1) -> tuple[Column, Column]:
    angle = _c(col) * F.lit(2.0 * harmonic) * F.pi() / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


# --- weather arithmetic ---------------------------------------------------------

def _floor_zero(expr: Column) -> Column:
    """max(0, x) that keeps null, since ``greatest`` skips it."""
    return F.when(expr.isNotNull(), F.greatest(F.lit(0.0), expr))


def heating_degrees(t, base=DEFAULT.hdd_base) -> Column:
    return _floor_zero(F.lit(base) - _c(t))


def cooling_degrees(t, base=DEFAULT.cdd_base) -> Column:
    return _floor_zero(_c(t) - F.lit(base))


def thermal_range(tmax, tmin) -> Column:
    return _c(tmax) - _c(tmin)


def thermal_index(t, rh) -> Column:
    """Temperature-humidity discomfort index."""
    t, rh = _c(t), _c(rh)
    return t - (F.lit(0.55) - F.lit(0.0055) * rh) * (t - F.lit(14.5))


def clamp(col, lo=None, hi=None) -> Column:
    c = _c(col)
    out = c
    if lo is not None:
        out = F.greatest(F.lit(float(lo)), out)
    if hi is not None:
        out = F.least(F.lit(float(hi)), out)
    return F.when(c.isNotNull(), out)


def ordered_temperatures(tmin, tmean, tmax) -> tuple[Column, Column, Column, Column]:
    """Repaired (tmin, tmean, tmax) plus the flag that a repair was needed."""
    lo, mid, hi = _c(tmin), _c(tmean), _c(tmax)
    bad = F.coalesce((lo > mid) | (mid > hi) | (lo > hi), F.lit(False))
    new_lo, new_hi = F.least(lo, mid, hi), F.greatest(lo, mid, hi)
    new_mid = F.when(mid.isNotNull(), F.greatest(new_lo, F.least(new_hi, mid)))
    return new_lo, new_mid, new_hi, bad


# --- safe arithmetic and parsing ---------------------------------------------------

def ratio(a, b) -> Column:
    """a / b, null when b is zero or null."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def positive_ratio(a, b) -> Column:
    """a / b only where b > 0."""
    b = _c(b)
    return F.when(b > 0, _c(a).cast("double") / b)


def pct(part, whole, digits=2) -> Column:
    return F.round(F.lit(100.0) * ratio(part, whole), digits)


def parse_decimal_comma(col, null_tokens=("", "Ip", "Acum", "Varias")) -> Column:
    """Comma-decimal text to double; the listed tokens and bad text become null."""
    t = F.trim(_c(col))
    return F.when(~t.isin(*null_tokens), F.translate(t, ",", ".").try_cast("double"))


def parse_es(col) -> Column:
    """``1.234,56`` (optionally with a percent sign) to double."""
    t = F.regexp_replace(_c(col), r"[.%\s]", "")
    return F.translate(t, ",", ".").try_cast("double")


def fmt_es(col, digits=2) -> Column:
    """Double to ``1.234,56``."""
    return F.translate(F.format_number(_c(col), digits), ",.", ".,")


def fmt_es_pct(col, digits=1) -> Column:
    return F.concat(fmt_es(_c(col) * 100.0, digits), F.lit("%"))


# --- activity codes -----------------------------------------------------------------

def activity_code(col) -> Column:
    """Raw text to a four-digit activity code, or null."""
    t = F.trim(_c(col).cast("string"))
    known = ~F.upper(t).isin("", "NA", "NAN", "NULL", "DESCONOCIDO", "DESCONOCIDA")
    digits = F.regexp_replace(F.regexp_replace(t, r"\.0+$", ""), "[^0-9]", "")
    ok = known & F.length(digits).between(1, 4) & (digits.try_cast("int") > 0)
    return F.when(ok, F.lpad(digits, 4, "0"))


def activity_division(code) -> Column:
    return F.substring(_c(code), 1, 2).try_cast("int")


def _by_division(division, position: int) -> Column:
    d = _c(division)
    expr = None
    for row in ACTIVITY_SECTIONS:
        cond = d.between(row[1], row[2])
        expr = F.when(cond, row[position]) if expr is None else expr.when(cond, row[position])
    return expr


def activity_section(division) -> Column:
    return _by_division(division, 0)


def activity_label(division) -> Column:
    return F.coalesce(_by_division(division, 3), F.lit("Unknown"))


def activity_family(division) -> Column:
    return F.coalesce(_by_division(division, 4), F.lit("Unknown"))


# --- classes and statuses --------------------------------------------------------------

def gap_class(days) -> Column:
    d = _c(days)
    return (F.when(d <= 1, "1 day").when(d <= 7, "2-7 days").when(d <= 30, "8-30 days")
            .when(d <= 90, "31-90 days").when(d.isNotNull(), "over 90 days"))


def day_completeness_class(hours, full=24) -> Column:
    h = _c(hours)
    return (F.when(h >= full, "complete").when(h >= full * 20 // 24, "almost complete")
            .when(h >= full * 12 // 24, "partial").when(h.isNotNull(), "sparse"))


def threshold_class(value, steps: Sequence[tuple[float, str]], above: str) -> Column:
    """First label whose upper bound holds the value, else ``above``."""
    v = _c(value)
    expr = None
    for bound, label in steps:
        expr = F.when(v <= bound, label) if expr is None else expr.when(v <= bound, label)
    return expr.when(v.isNotNull(), above)


def check_status(n_bad, severity="fail") -> Column:
    return F.when(F.coalesce(_c(n_bad), F.lit(1)) > 0, severity).otherwise("pass")


def station_status(pct_missing) -> Column:
    return threshold_class(pct_missing, ((1, "ok"), (5, "review")), "weak")


def merge_status(pct_missing) -> Column:
    return threshold_class(pct_missing, ((0, "ok"), (1, "low"), (5, "review")), "fallback")


def impact_level(pct_affected, low=0.1, high=1.0) -> Column:
    p = _c(pct_affected)
    return F.when(p >= high, "high").when(p >= low, "medium").when(p.isNotNull(), "low")


def short_id(col, n=8) -> Column:
    return F.substring(_c(col).cast("string"), 1, n)


def profile_id(cluster, rank) -> Column:
    return F.format_string("C%d-P%02d", _c(cluster), _c(rank))


def night_rule(ratio_night, peak_hour, valley_share) -> Column:
    """Users whose load sits in the night or the tariff valley (null-safe)."""
    return F.coalesce((_c(ratio_night) > 1.5), F.lit(False)) \
        | F.coalesce(_c(peak_hour).between(0, 6), F.lit(False)) \
        | F.coalesce(_c(valley_share) >= 0.62, F.lit(False))


def intermittent_home(low_rate, zero_rate, max_month_share) -> Column:
    """True/false only when decided; null where every test is undecided."""
    return (_c(low_rate) >= 0.50) | (_c(zero_rate) >= 0.20) | (_c(max_month_share) >= 0.16)


def second_home(low_rate, morning_share, peak_share) -> Column:
    return (_c(low_rate) >= 0.35) & (_c(morning_share) >= 0.22) & (_c(peak_share) <= 0.28)
