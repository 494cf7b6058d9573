"""Aggregate column expressions composed from built-in aggregates.

They are null-safe and never raise on zero variance or empty input, so they can
be used in any ``groupBy().agg`` or over a window.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loadloom.functions.columns import _c, ratio

TINY = 1e-12


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


def sum_where(cond: Column, value) -> Column:
    return F.coalesce(F.sum(F.when(cond, _c(value))), F.lit(0.0))


def mean_where(cond: Column, value) -> Column:
    return F.avg(F.when(cond, _c(value)))


# --- guarded regression -------------------------------------------------------------

def _paired(*cols) -> list[Column]:
    """Null out every column on rows where any of them is null."""
    cols = [_c(c).cast("double") for c in cols]
    ok = cols[0].isNotNull()
    for c in cols[1:]:
        ok = ok & c.isNotNull()
    return [F.when(ok, c) for c in cols]


def safe_corr(x, y) -> Column:
    x, y = _paired(x, y)
    vx, vy = F.var_pop(x), F.var_pop(y)
    flat = (vx <= TINY) | (vy <= TINY)
    return F.when(~flat, F.try_divide(F.covar_pop(x, y), F.sqrt(vx) * F.sqrt(vy)))


def safe_slope(y, x) -> Column:
    y, x = _paired(y, x)
    vx = F.var_pop(x)
    return F.when(vx > TINY, F.try_divide(F.covar_pop(x, y), vx))


def safe_r2(y, x) -> Column:
    r = safe_corr(x, y)
    return r * r


# --- forecast metrics ----------------------------------------------------------------

def _both(y, p) -> Column:
    return _c(y).isNotNull() & _c(p).isNotNull()


def n_pairs(y, p) -> Column:
    return F.count_if(_both(y, p))


def mae(y, p) -> Column:
    return F.avg(F.abs(_c(y) - _c(p)))


def rmse(y, p) -> Column:
    e = _c(y) - _c(p)
    return F.sqrt(F.avg(e * e))


def mape(y, p) -> Column:
    """Mean absolute percentage error over rows with non-zero actuals."""
    return F.lit(100.0) * F.avg(F.abs(ratio(_c(y) - _c(p), _c(y))))


def smape(y, p) -> Column:
    half = (F.abs(_c(y)) + F.abs(_c(p))) / 2.0
    return F.lit(100.0) * F.avg(ratio(F.abs(_c(y) - _c(p)), half))


def wape(y, p) -> Column:
    ok = _both(y, p)
    return F.lit(100.0) * F.try_divide(
        F.sum(F.when(ok, F.abs(_c(y) - _c(p)))), F.sum(F.when(ok, F.abs(_c(y)))))


def cost(y, p, price) -> Column:
    """Energy deviation priced per MWh."""
    return F.sum(F.abs(_c(y) - _c(p))) * F.lit(price / 1000.0)


def cost_per_mwh(y, p, price) -> Column:
    ok = _both(y, p)
    return F.try_divide(cost(y, p, price), F.sum(F.when(ok, F.abs(_c(y)))) / 1000.0)


def pinball(y, q_pred, q) -> Column:
    d = _c(y) - _c(q_pred)
    return F.avg(F.when(d.isNotNull(), F.greatest(F.lit(q) * d, F.lit(q - 1.0) * d)))


def _inside(y, lo, hi) -> Column:
    return (_c(y) >= _c(lo)) & (_c(y) <= _c(hi))


def coverage(y, lo, hi) -> Column:
    return F.lit(100.0) * F.avg(_inside(y, lo, hi).cast("double"))


def mean_width(lo, hi) -> Column:
    return F.avg(_c(hi) - _c(lo))


def winkler(y, lo, hi, alpha=0.10) -> Column:
    y, lo, hi = _c(y), _c(lo), _c(hi)
    miss = F.when(y < lo, lo - y).when(y > hi, y - hi).otherwise(F.lit(0.0))
    score = (hi - lo) + F.lit(2.0 / alpha) * miss
    return F.avg(F.when(y.isNotNull(), score))


def share_entropy(share) -> Column:
    """Entropy of a set of shares divided by its maximum; zero for one category."""
    p = _c(share)
    pos = p > 0
    n = F.count_if(pos)
    h = -F.sum(F.when(pos, p * F.ln(p)))
    return F.when(n > 1, F.try_divide(h, F.ln(n))).otherwise(F.lit(0.0))
