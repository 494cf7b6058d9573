"""The clustering run: candidate solutions over preprocessings, algorithms and k, with indices and stability, in shared scans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadloom.config import DEFAULT
from loadloom.operators import many_fits as M

STARTS, DRAW_STARTS, DRAWS, DRAW_FRACTION = 25, 10, 30, 0.8
_BOARD = ("solution string, preprocessing string, algo string, k int, n_clusters int, n_rows long, silhouette double, calinski_harabasz double, davies_bouldin double, "
          "dunn double, min_pct double, max_pct double, balance_entropy double, mean_jaccard double, min_jaccard double, bic double")


@dataclass
class Candidates:
    """Board rows, the written labels of every row (key, labels) and the fits in the order of ``labels``, of one preprocessing."""

    rows: list[dict]
    labelled: DataFrame
    fits: list[M.Fit]


def search(df: DataFrame, key: str, features: str, preprocessing: str, ks: Sequence[int] = DEFAULT.k_range, algos: Sequence[str] = ("kmeans", "mixture"),
           starts: int = STARTS, draws: int = 0, draw_starts: int = DRAW_STARTS, fraction: float = DRAW_FRACTION) -> Candidates:
    """Fit, label and rate every (algorithm, k) of one feature matrix.

    All k-means starts and all refits on subsamples iterate together, then all mixtures; every row gets one array
    of labels; indices and overlaps of all candidates come from a few scans of it. Without rows there are no candidates.
    """
    table = M.prepared(df, key, features, draws, fraction)
    specs = [M.Spec(k, s) for k in ks for s in range(starts)] + [M.Spec(k, s, b) for b in range(draws) for k in ks for s in range(draw_starts)]
    best = M.cheapest(M.fit_kmeans(table, specs))
    order = [(k, d) for d in (None, *range(draws)) for k in ks]
    by_algo = {"kmeans": [best[at] for at in order]}
    if "mixture" in algos:
        by_algo["mixture"] = M.fit_mixtures(table, by_algo["kmeans"])
    base = [(a, k, by_algo[a][i]) for a in algos for i, k in enumerate(ks)]
    if not all(len(f.centres) for _, _, f in base):
        return Candidates([], table.select(key, F.array().cast("array<int>").alias("labels")), [])
    fits = [f for _, _, f in base]
    refits = [(a, k, d, by_algo[a][i]) for a in algos for i, (k, d) in enumerate(order) if d is not None and len(by_algo[a][i].centres)]
    labelled = M.label_all(table, fits + [f for *_, f in refits], key)
    indices = M.all_indices(labelled.withColumn("labels", F.slice("labels", 1, len(fits))), [len(f.centres) for f in fits])
    at = {(a, k): i for i, (a, k, _) in enumerate(base)}
    pairs = [(at[a, k], len(fits[at[a, k]].centres), len(fits) + j, len(f.centres), d) for j, (a, k, d, f) in enumerate(refits)]
    stable = M.stability(M.draw_overlaps(labelled, pairs)) if pairs else {}
    rows = []
    for i, ((a, k, f), r) in enumerate(zip(base, indices)):
        jaccard = [m for m, _ in stable.get(i, {}).values()]
        rows.append(r | {"solution": f"{preprocessing}_{a}_k{k}", "preprocessing": preprocessing, "algo": a, "k": k,
                         "mean_jaccard": sum(jaccard) / len(jaccard) if jaccard else None, "min_jaccard": min(jaccard, default=None), "bic": float(f.cost) if a == "mixture" else None})
    return Candidates(rows, labelled, fits)


def board(spark: SparkSession, candidates: Sequence[Candidates]) -> DataFrame:
    """One row per candidate solution of all preprocessings."""
    names = [c.split(" ")[0] for c in _BOARD.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for c in candidates for r in c.rows], _BOARD)


def labels_of(candidates: Sequence[Candidates], solution: str, key: str) -> DataFrame:
    """(key, cluster) of one solution, from the labels that were written once."""
    for c in candidates:
        for i, r in enumerate(c.rows):
            if r["solution"] == solution:
                return c.labelled.select(key, F.col("labels")[i].alias("cluster"))
    raise ValueError(f"no solution {solution!r}")
