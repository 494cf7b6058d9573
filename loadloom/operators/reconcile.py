"""Combining forecasts: blends, bottom-up, top-down and minimum-trace reconciliation.

Only moment matrices of a handful of models or clusters reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stack_weights(df: DataFrame, y: str, preds: Sequence[str], ridge=0.01) -> dict[str, float]:
    """Ridge regression of ``y`` on the predictions, clipped at zero and normalised.

    The ridge is relative to the mean diagonal of the Gram matrix. Equal weights
    are used when nothing positive is left.
    """
    cols = [y, *preds]
    ok = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    n = len(preds)
    aggs = [F.expr(f"sum(double({preds[i]}) * double({preds[j]})) AS g{i}_{j}") for i in range(n) for j in range(i, n)]
    aggs += [F.expr(f"sum(double({preds[i]}) * double({y})) AS b{i}") for i in range(n)]
    r = df.where(ok).agg(*aggs).first()
    gram = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    rhs = np.array([r[f"b{i}"] or 0.0 for i in range(n)])
    penalty = ridge * np.trace(gram) / n
    w = np.linalg.lstsq(gram + penalty * np.eye(n), rhs, rcond=None)[0]
    w = np.clip(w, 0, None)
    w = w / w.sum() if w.sum() > 0 else np.full(n, 1.0 / n)
    return dict(zip(preds, (float(x) for x in w)))


def blend(df: DataFrame, weights: dict[str, float], out="blend") -> DataFrame:
    return df.withColumn(out, F.expr(" + ".join(f"{w!r}D * {c}" for c, w in weights.items())))


def best_models(metrics: DataFrame, k: int, metric="mae") -> list[str]:
    """Names of the ``k`` best models of a validation board (one row per model)."""
    return [r["model"] for r in metrics.where(F.col(metric).isNotNull()).orderBy(metric, "model").limit(k).collect()]


def mean_ensemble(df: DataFrame, models: Sequence[str], out="ensemble") -> DataFrame:
    return df.withColumn(out, F.expr(f"({' + '.join(models)}) / {len(models)}"))


def from_user_mean(df: DataFrame, pred_mean: str, n_users: str, out="pred") -> DataFrame:
    """Total from a per-user prediction, never negative."""
    return df.withColumn(out, F.expr(f"CASE WHEN {pred_mean} IS NOT NULL THEN greatest(0D, {pred_mean}) * {n_users} END"))


def bottom_up(df: DataFrame, date="date", y="y", p="pred") -> DataFrame:
    """Cluster forecasts summed per date, only for dates where all parts are known."""
    return df.groupBy(date).agg(F.sum(y).alias("actual"), F.sum(p).alias("bottom_up"), F.count_if(F.col(p).isNull()).alias("_m")).where(
        "_m = 0").drop("_m")


def top_down(total: DataFrame, history_parts: DataFrame, history_total: DataFrame, pred: str, date="date", y="y", out="top_down") -> DataFrame:
    """Total forecast scaled by the parts' historical share of the total."""
    parts = history_parts.groupBy(date).agg(F.sum(y).alias("_p"))
    share = parts.join(history_total.select(date, F.col(y).alias("_t")), date).agg(F.try_divide(F.sum("_p"), F.sum("_t")).alias("share"))
    return total.crossJoin(F.broadcast(share)).withColumn(out, F.col(pred) * F.col("share"))


def scope_coverage(parts: DataFrame, total: DataFrame, periods: dict[str, str], date="date") -> DataFrame:
    """How much of the whole portfolio the clustered part covers, by period."""
    p = parts.groupBy(date).agg(F.sum("y").alias("ky"), F.sum("n_users").alias("kn"))
    j = p.join(total.selectExpr(date, "y AS ty", "n_users AS tn"), date)
    cells = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in periods.items())
    rows = j.selectExpr("*", f"explode(filter(array({cells}), x -> x IS NOT NULL)) AS period")
    return rows.groupBy("period").agg(
        F.min(date).alias("start_date"), F.max(date).alias("end_date"), F.count(F.lit(1)).alias("n_days"), F.avg("tn").alias("avg_users_all"),
        F.avg("kn").alias("avg_users_clustered"), F.sum("ty").alias("kwh_all"), F.sum("ky").alias("kwh_clustered"),
        F.expr("100D * try_divide(sum(ky), sum(ty)) AS pct_kwh"))


def inverse_variance(cal: DataFrame, a: str, b: str, y="y") -> DataFrame:
    """One row of weights from the calibration error variances."""
    v = cal.agg(F.var_samp(F.col(y) - F.col(a)).alias("va"), F.var_samp(F.col(y) - F.col(b)).alias("vb")).selectExpr(
        "CASE WHEN va > 0 THEN va ELSE 1D END AS va", "CASE WHEN vb > 0 THEN vb ELSE 1D END AS vb")
    return v.selectExpr("(1 / va) / (1 / va + 1 / vb) AS weight_a", "(1 / vb) / (1 / va + 1 / vb) AS weight_b")


def combine(df: DataFrame, weights: DataFrame, a: str, b: str, out="combined") -> DataFrame:
    return df.crossJoin(F.broadcast(weights)).withColumn(out, F.expr(f"weight_a * {a} + weight_b * {b}")).drop("weight_a", "weight_b")


def mint_matrix(cov: np.ndarray, shrink=0.5) -> np.ndarray:
    """Projection of (total, parts) base forecasts onto coherent ones for an error covariance."""
    diag = np.diag(cov).copy()
    diag[~(diag > 0)] = 1.0
    w = (1 - shrink) * cov + shrink * np.diag(diag)
    w[np.diag_indices_from(w)] += diag.mean() * 1e-6
    n = len(diag) - 1
    s = np.vstack([np.ones(n), np.eye(n)])
    wi_s = np.linalg.solve(w, s)
    return s @ np.linalg.solve(s.T @ wi_s, wi_s.T)


def mint(cal: DataFrame, target: DataFrame, actual_total: str, pred_total: str, actual_parts: Sequence[str],
         pred_parts: Sequence[str], shrink=0.5) -> DataFrame:
    """Minimum-trace reconciliation with a half-diagonal error covariance.

    The covariance of the residuals is one Spark aggregate; the (parts + 1)^2
    solve is done on the driver and applied as a projection.
    """
    pairs = [(actual_total, pred_total), *zip(actual_parts, pred_parts)]
    resid = [f"double({a}) - double({p}) AS e{i}" for i, (a, p) in enumerate(pairs)]
    m = len(pairs)
    e = cal.selectExpr(*resid).dropna()
    r = e.agg(*[F.covar_samp(f"e{i}", f"e{j}").alias(f"c{i}_{j}") for i in range(m) for j in range(i, m)]).first()
    cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(m)] for i in range(m)])
    proj = mint_matrix(cov, shrink)
    base = [p for _, p in pairs]
    out = ["mint_total", *[f"mint_{p}" for p in pred_parts]]
    exprs = [" + ".join(f"{float(proj[i, j])!r}D * {base[j]}" for j in range(m)) + f" AS {out[i]}" for i in range(m)]
    return target.selectExpr("*", *exprs)
