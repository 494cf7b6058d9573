"""Clusterings fitted together against numpy versions fitted one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadloom.operators import clusters, many_fits as M, solutions


def cloud(n=500, d=4, seed=2):
    r = np.random.default_rng(seed)
    hearts = 8 * np.eye(4, d)
    return np.round(hearts[np.arange(n) % 4] + r.normal(0, 1, (n, d)), 6)


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, x.tolist()) for i, x in enumerate(cloud())]
    return M.prepared(spark.createDataFrame(rows + [(9999, None)], "id long, v array<double>").repartition(5), "id", "v", draws=3)


def lloyd(x, centres, rounds=100):
    for _ in range(rounds):
        own = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        new = np.array([x[own == k].mean(0) if (own == k).any() else centres[k] for k in range(len(centres))])
        if ((new - centres) ** 2).sum(1).max() <= 1e-8:
            break
        centres = new
    return centres, ((x - centres[((x[:, None] - centres) ** 2).sum(2).argmin(1)]) ** 2).sum()


def test_kmeans_equals_separate_fits(spark, table):
    specs = [M.Spec(k, s, d) for k in (2, 4) for s in range(3) for d in (None, 0, 2)]
    starts = M.first_centres(table, specs)
    held = {r.id: (r.x, r.drawn) for r in table.collect()}
    ids = sorted(held)
    x, drawn = np.array([held[i][0] for i in ids]), np.array([held[i][1] for i in ids])
    assert len(ids) == 500 and 0.6 < drawn.mean() < 0.8
    for spec, centres, fit in zip(specs, starts, M.fit_kmeans(table, specs)):
        part = x if spec.draw is None else x[drawn[:, spec.draw]]
        assert len({tuple(c) for c in centres}) == spec.k and {tuple(c) for c in centres} <= {tuple(p) for p in part}
        want, cost = lloyd(part, centres)
        assert np.allclose(fit.centres, want, atol=1e-6) and fit.cost == pytest.approx(cost, rel=1e-9)


def test_more_clusters_than_distinct_rows(spark):
    df = spark.createDataFrame([(i, [float(i % 2)]) for i in range(6)], "id long, v array<double>")
    fits = M.fit_kmeans(M.prepared(df, "id", "v"), [M.Spec(3)])
    assert fits[0].cost == 0 and {c[0] for c in fits[0].centres} == {0.0, 1.0}
    none = M.fit_kmeans(M.prepared(df.limit(0), "id", "v"), [M.Spec(2)])
    assert len(none[0].centres) == 0
    assert solutions.search(df.limit(0), "id", "v", "raw", draws=2).rows == []


def numpy_mixture(x, labels, k, rounds):
    r = np.eye(k)[labels]
    likes = []
    for _ in range(rounds + 1):
        n = r.sum(0)
        mean = r.T @ x / n[:, None]
        var = np.array([(r[:, j, None] * (x - mean[j]) ** 2).sum(0) / n[j] for j in range(k)])
        z = np.log(n / n.sum()) - 0.5 * (((x[:, None] - mean) ** 2 / var).sum(2) + np.log(2 * np.pi * var).sum(1))
        top = z.max(1, keepdims=True)
        likes.append(float((top[:, 0] + np.log(np.exp(z - top).sum(1))).sum()))
        r = np.exp(z - top) / np.exp(z - top).sum(1, keepdims=True)
    return mean, var, likes


def test_mixture_equals_numpy_and_climbs(spark, table):
    starts = list(M.cheapest(M.fit_kmeans(table, [M.Spec(k, s) for k in (2, 3, 4) for s in range(6)])).values())
    x = np.array([r.x for r in table.select("x").collect()])
    for start, fit in zip(starts, M.fit_mixtures(table, starts)):
        mean, var, likes = numpy_mixture(x, start.labels(x) - 1, start.spec.k, fit.rounds - 1)
        assert np.allclose(fit.centres, mean, atol=1e-6) and np.allclose(fit.variances, var, atol=1e-6)
        assert np.allclose(fit.likelihoods, likes, rtol=1e-9)
        assert all(b >= a - 1e-9 * abs(a) for a, b in zip(fit.likelihoods, fit.likelihoods[1:]))
        p = M.posteriors(table, fit, "id").agg(F.min("posterior"), F.max("posterior"), F.count("*")).first()
        assert 1 / start.spec.k <= p[0] <= p[1] <= 1 and p[2] == 500
    assert min(M.fit_mixtures(table, starts), key=lambda f: f.cost).spec.k == 4


def test_indices_and_overlaps_equal_the_single_operators(spark, table):
    fits = M.fit_kmeans(table, [M.Spec(2), M.Spec(4), M.Spec(3, 0, 1)])
    labelled = M.label_all(table, fits, "id")
    got = M.all_indices(labelled, [2, 4, 3])
    for i, k in enumerate((2, 4, 3)):
        one = labelled.select("x", F.col("labels")[i].alias("cluster"))
        want = clusters.internal_indices(one, "x").first().asDict()
        for name in ("silhouette", "calinski_harabasz", "davies_bouldin", "dunn", "n_clusters", "n_rows"):
            assert got[i][name] == pytest.approx(want[name], rel=1e-9)
        size = clusters.cluster_balance(one).first()
        assert (got[i]["min_pct"], got[i]["max_pct"]) == (size.min_pct, size.max_pct) and got[i]["balance_entropy"] == pytest.approx(size.balance_entropy)
    overlaps = M.draw_overlaps(labelled, [(1, 4, 2, 3, 1)])
    pair = labelled.where(F.col("drawn")[1]).select(F.col("labels")[1].alias("ref"), F.col("labels")[2].alias("new"))
    want = {r.ref: r.jaccard for r in clusters.jaccard_by_cluster(pair, "ref", "new").collect()}
    assert {o["cluster"]: o["jaccard"] for o in overlaps} == pytest.approx(want)


def test_search_finds_the_four_clouds(spark, table):
    c = solutions.search(table.select("id", F.col("x").alias("v")), "id", "v", "raw", ks=(2, 3, 4, 5), starts=4, draws=4, draw_starts=2)
    ranked = clusters.leaderboard(solutions.board(spark, [c]))
    best = clusters.select_solution(ranked).first()
    assert best.k == 4 and best.passes_all and best.mean_jaccard > 0.95
    labels = solutions.labels_of([c], best.solution, "id").collect()
    assert len(labels) == 500 and len({(r.id % 4, r.cluster) for r in labels}) == 4


def test_scans_do_not_grow_with_starts_and_draws(spark, table, monkeypatch):
    seen = []
    real = M.summed
    monkeypatch.setattr(M, "summed", lambda *a, **k: seen.append(1) or real(*a, **k))
    fits = M.fit_kmeans(table, [M.Spec(3, s, d) for s in range(20) for d in (None, 0, 1, 2)])
    assert len(seen) == max(f.rounds for f in fits)
