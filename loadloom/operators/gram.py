"""Linear models of many groups from one aggregate of second moments.

A group's Gram matrix (sums of products of an intercept, the features and the target) holds all that least
squares and the elastic net need of its rows. Matrices add up, so training sets that grow, refits after
every fold and choices on validation rows cost no further scan. The solves run as grouped rows in tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Penalties tried on the validation rows.
PENALTIES = (0.001, 0.01, 0.1)


def _entries(features: Sequence[str], y: str) -> list[tuple[int, int, str, str]]:
    names = ["1", *features, y]
    return [(i, j, a, b) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]


def gram(df: DataFrame, by: Sequence[str], features: Sequence[str], y: str) -> DataFrame:
    """(by, n, moments): the upper triangle, row by row, of the Gram matrix of (1, features, y) over complete rows.

    Products are summed map-side, so a group with most of the rows leaves each task as one row.
    """
    whole = df.dropna(subset=[*features, y])
    sums = [F.expr("double(count(1))" if a == b == "1" else f"sum(double({a}) * double({b}))") for _, _, a, b in _entries(features, y)]
    return whole.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("moments"))


def added(grams: DataFrame, by: Sequence[str]) -> DataFrame:
    """Gram matrices summed over coarser groups."""
    size = F.posexplode("moments").alias("i", "v")
    long = grams.select(*by, "n", size).groupBy(*by, "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    return long.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("moments"))


def running(grams: DataFrame, by: Sequence[str], step: str) -> DataFrame:
    """Gram matrices of all steps up to each one: (by, step, n, moments)."""
    long = grams.select(*by, step, "n", F.posexplode("moments").alias("i", "v"))
    w = Window.partitionBy(*by, "i").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    total = long.withColumns({"v": F.sum("v").over(w), "n": F.sum("n").over(w)})
    return total.groupBy(*by, step).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("moments"))


def unfolded(flat: Sequence[float], p: int) -> np.ndarray:
    out = np.zeros((p + 2, p + 2))
    out[np.triu_indices(p + 2)] = flat
    return out + np.triu(out, 1).T


def elastic_net(g: np.ndarray, penalty: float, mix: float = 0.5, rounds: int = 10_000, tol: float = 1e-12) -> np.ndarray:
    """(intercept, coefficients) by coordinate descent on a Gram matrix.

    Minimises the mean squared error over two, features and target scaled to unit deviation, plus ``penalty`` times
    ``mix`` of the absolute and 1 - ``mix`` of half the squared coefficients. A constant feature gets 0; with
    a constant target all are 0. Without penalty it is least squares, of least norm if features are dependent.
    """
    n = g[0, 0]
    mean = g[0, 1:] / n
    c = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(c), 0))
    live = sd > 1e-9 * np.sqrt(np.maximum(np.diag(g)[1:] / n, 1e-300))
    beta = np.zeros(len(mean) - 1)
    at = np.flatnonzero(live[:-1])
    if live[-1] and len(at):
        r = c[np.ix_(at, at)] / np.outer(sd[at], sd[at])
        q = c[at, -1] / (sd[at] * sd[-1])
        b = np.zeros(len(at))
        if penalty <= 0:
            b = np.linalg.pinv(r, rcond=1e-10) @ q
        for _ in range(rounds if penalty > 0 else 0):
            before = b.copy()
            for j in range(len(at)):
                rest = q[j] - r[j] @ b + r[j, j] * b[j]
                b[j] = np.sign(rest) * max(abs(rest) - penalty * mix, 0) / (r[j, j] + penalty * (1 - mix))
            if np.abs(b - before).max() < tol:
                break
        beta[at] = b * sd[-1] / sd[at]
    return np.concatenate([[mean[-1] - mean[:-1] @ beta], beta])


def squared_error(g: np.ndarray, coefficients: np.ndarray) -> float:
    """Sum of squared errors of a linear model on the rows behind a Gram matrix."""
    v = np.append(coefficients, -1.0)
    return max(0.0, float(v @ g @ v))


def fit_groups(grams: DataFrame, by: Sequence[str], split: str, p: int, penalties: Sequence[float] = PENALTIES, need: dict[str, int] | None = None) -> DataFrame:
    """(by, penalty, val_rmse, coefficients) of every group with enough rows in each split.

    ``grams`` has a Gram matrix per group and ``split`` (train, val and others, which only count towards ``need``). The penalty is the one with the
    smallest error on the validation matrix; the model is then fitted on train and validation together.
    """
    need = need or {"train": 200, "val": 30, "test": 5}
    kinds = dict(grams.dtypes)
    schema = ", ".join(f"{b} {kinds[b]}" for b in by) + ", penalty double, val_rmse double, coefficients array<double>"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {r[split]: r for _, r in pdf.iterrows()}
        if any(k not in rows or rows[k]["n"] < n for k, n in need.items()):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in [*by, "penalty", "val_rmse", "coefficients"]})
        train, val = unfolded(rows["train"]["moments"], p), unfolded(rows["val"]["moments"], p)
        errors = [(squared_error(val, elastic_net(train, x)), x) for x in penalties]
        error, best = min(errors)
        return pd.DataFrame([{**{b: pdf[b].iloc[0] for b in by}, "penalty": best, "val_rmse": float(np.sqrt(error / val[0, 0])), "coefficients": elastic_net(train + val, best).tolist()}])

    return grams.groupBy(*by).applyInPandas(solve, schema)


def fit_all(grams: DataFrame, keep: Sequence[str], p: int, penalty: float = 0.0) -> DataFrame:
    """(keep, n, coefficients) of every Gram matrix."""
    kinds = dict(grams.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keep), "n long", "coefficients array<double>"])

    def solve(batches):
        for b in batches:
            b["coefficients"] = [elastic_net(unfolded(g, p), penalty).tolist() for g in b.moments]
            yield b[[*keep, "n", "coefficients"]]

    return grams.select(*keep, "n", "moments").mapInPandas(solve, schema)


def predicted(features: Sequence[str], coefficients: str = "coefficients"):
    """The linear model's value as a column expression."""
    return F.expr(" + ".join([f"{coefficients}[0]", *(f"{coefficients}[{i + 1}] * double({c})" for i, c in enumerate(features))]))
