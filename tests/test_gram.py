"""Linear models from second moments against fits on the rows themselves."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from loadloom.operators import forecast_eval as E, gram as G

FEATURES = ["a", "b", "c"]


def rows(n=400, seed=4):
    r = np.random.default_rng(seed)
    out = []
    for g in range(3):
        x = r.normal(g, 1 + g, (n, 3))
        x[:, 2] = x[:, 0] * 0.5 + r.normal(0, 0.1, n)
        y = 3 + x @ [1.5, -0.7 * g, 0.2] + r.normal(0, 0.3, n)
        out += [(g, "train" if i < 300 else "val" if i < 360 else "test", *map(float, x[i]), float(y[i])) for i in range(n)]
    out += [(3, "train", 1.0, 1.0, 1.0, 1.0)] * 250 + [(4, "train", 1.0, None, 1.0, 2.0)] + [(0, "train", None, 1.0, 1.0, 1.0), (0, "val", 1.0, 1.0, 1.0, None)]
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), "g int, split string, a double, b double, c double, y double").repartition(4)


def test_groups_equal_separate_fits(spark, table):
    grams = G.gram(table, ["g", "split"], FEATURES, "y")
    got = {r.g: r for r in G.fit_groups(grams, ["g"], "split", 3).collect()}
    assert set(got) == {0, 1, 2}  # group 3 has no validation rows, group 4 no complete row
    for g in got:
        part = table.where(F.col("g") == g).dropna()
        alone = G.fit_groups(G.gram(part, ["g", "split"], FEATURES, "y"), ["g"], "split", 3).first()
        assert np.allclose(alone.coefficients, got[g].coefficients, atol=1e-6) and alone.penalty == got[g].penalty
        vec = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(part)
        best = None
        for penalty in G.PENALTIES:
            sd = float(np.std([r.y for r in part.where("split = 'train'").collect()], ddof=1))
            m = LinearRegression(featuresCol="x", labelCol="y", elasticNetParam=0.5, regParam=penalty * sd, maxIter=2000, tol=1e-13).fit(vec.where("split = 'train'"))
            e = m.evaluate(vec.where("split = 'val'")).rootMeanSquaredError
            best = min(best or (e, penalty), (e, penalty))
        assert best[1] == got[g].penalty and best[0] == pytest.approx(got[g].val_rmse, rel=5e-3)


def test_least_squares_and_degenerate_columns():
    r = np.random.default_rng(0)
    x = r.normal(0, 1, (60, 3))
    y = x @ [1, 2, 0] + 4 + r.normal(0, 0.1, 60)
    full = lambda a, t: (lambda m: m.T @ m)(np.column_stack([np.ones(len(a)), a, t]))
    want = np.linalg.lstsq(np.column_stack([np.ones(60), x]), y, rcond=None)[0]
    g = full(x, y)
    assert np.allclose(G.elastic_net(g, 0), want, atol=1e-9)
    assert G.squared_error(g, want) == pytest.approx(((y - want[0] - x @ want[1:]) ** 2).sum(), rel=1e-6)
    assert np.allclose(G.unfolded(g[np.triu_indices(5)], 3), g)
    constant = np.column_stack([x[:, 0], np.full(60, 7.0), x[:, 0]])
    b = G.elastic_net(full(constant, y), 0)
    assert b[2] == 0 and b[1] == pytest.approx(b[3]) and np.isfinite(b).all()
    assert G.elastic_net(full(x, np.full(60, 5.0)), 0.1).tolist() == pytest.approx([5.0, 0, 0, 0])


def test_running_sums_equal_longer_training_sets(spark, table):
    t = table.withColumn("step", F.when(F.col("split") == "train", 1).when(F.col("split") == "val", 2).otherwise(3))
    run = {(r.g, r.step): r for r in G.running(G.gram(t, ["g", "step"], FEATURES, "y"), ["g"], "step").collect()}
    whole = {r.g: r for r in G.gram(t, ["g"], FEATURES, "y").collect()}
    summed = {r.g: r for r in G.added(G.gram(t, ["g", "step"], FEATURES, "y"), ["g"]).collect()}
    for g in range(3):
        assert run[g, 3].n == whole[g].n == 400 and np.allclose(run[g, 3].moments, whole[g].moments) and np.allclose(summed[g].moments, whole[g].moments)
        assert run[g, 1].n == 300


def test_rolling_refit_equals_separate_refits(spark):
    r = np.random.default_rng(9)
    days = np.arange("2020-01-01", "2021-06-01", dtype="datetime64[D]")
    x = r.normal(10, 2, (len(days), 2))
    y = 5 + x @ [2, 1] + r.normal(0, 1, len(days)) + np.arange(len(days)) * 0.01
    data = [(d.astype(object), float(v), float(p), float(q)) for d, v, (p, q) in zip(days, y, x)]
    df = spark.createDataFrame([*data[:100], (data[100][0], None, 1.0, 1.0), *data[101:]], "date date, y double, p double, q double")
    cuts = ["2020-12-31", "2021-01-30", "2021-03-01"]
    got = E.rolling_refit(df, "date", "y", ["p", "q"], cuts).toPandas().sort_values(["fold", "date"])
    ok = np.arange(len(days)) != 100
    for i, cut in enumerate(np.array(cuts, "datetime64[D]")):
        fit = lambda m: np.linalg.lstsq(np.column_stack([np.ones(m.sum()), x[m]]), y[m], rcond=None)[0]
        value = lambda b, m: b[0] + x[m] @ b[1:]
        window = ok & (days > cut - 90) & (days <= cut)
        res = np.sort(np.abs(y[window] - value(fit(ok & (days <= cut - 90)), window)))
        q = res[min(len(res), int(np.ceil((len(res) + 1) * 0.9 - 1e-9))) - 1]
        test = ok & (days > cut) & (days <= cut + 30)
        pred = value(fit(ok & (days <= cut)), test)
        part = got[got.fold == i + 1]
        assert len(part) == 30 and np.allclose(part.pred, pred, atol=1e-6) and np.allclose(part.hi - part.pred, q, atol=1e-6)
    assert E.rolling_refit(df.limit(0), "date", "y", ["p", "q"], cuts).count() == 0
