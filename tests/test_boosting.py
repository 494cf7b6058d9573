"""Boosting: both ways of growing agree, patience ends it, defined results at the edges."""

import numpy as np
import pandas as pd
import pytest

from loadloom.operators import boosting as B
from loadloom.operators import many_fits

F8 = [f"f{i}" for i in range(8)]


@pytest.fixture(scope="module")
def rows(spark):
    g = np.random.default_rng(5)
    x = g.normal(size=(600, 8))
    y = np.maximum(0, 6 + 2 * x[:, 0] + (x[:, 1] > 0) * x[:, 2] + 0.3 * g.normal(size=600))
    x[::37, 3] = np.nan
    df = spark.createDataFrame(pd.DataFrame(x, columns=F8).assign(y=y, i=range(600)))
    return df.where("i < 400"), df.where("i >= 400 AND i < 500"), df.where("i >= 500")


def test_scans_and_tasks_grow_the_same_trees(rows):
    train, val, test = rows
    settings = [B.Setting(0.3, 2, 3), B.Setting(0.2, 3, 6)]
    a, b = (B.fit(train, val, F8, "y", settings, rounds=6, patience=3, least=2, task_rows=n)[0] for n in (0, 10_000))
    assert a.setting == b.setting and len(a.trees) == len(b.trees)
    assert np.allclose([r[5] for r in a.board], [r[5] for r in b.board])
    p, q = (m.predict(test).orderBy("i").toPandas().pred for m in (a, b))
    assert np.allclose(p, q)


def test_first_tree_equals_brute_force(monkeypatch):
    monkeypatch.setattr(B, "ROW_SHARE", 2.0)
    monkeypatch.setattr(B, "COLUMN_SHARE", 1.0)
    g = np.random.default_rng(2)
    codes = g.integers(0, B.BINS, (300, 5))
    y = np.where(codes[:, 2] > 11, 2.0, 0.0) + 0.1 * g.normal(size=300)
    val = np.arange(300) % 4 == 0
    m = B.Member(B.Setting(0.5, 1, 5), False, y[~val].mean())
    rows = (codes, y, g.integers(-2**62, 2**62, 300), val, np.full((300, 1), m.base))
    errors = B.grow([m], B.Held(rows, 1), 5, 1, 1, 5)[m.setting]
    r, best = (y - m.base)[~val], None
    for j in range(5):
        for k in range(B.BINS):
            left = codes[~val, j] <= k
            if min(left.sum(), (~left).sum()) >= 5:
                gain = sum(r[s].sum() ** 2 / (s.sum() + 1) for s in (left, ~left))
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, j, k, 0.5 * r[left].sum() / (left.sum() + 1), 0.5 * r[~left].sum() / ((~left).sum() + 1))
    t = m.trees[0]
    assert (t.feature[0], t.cut[0]) == best[1:3] and np.allclose(t.value[1:], best[3:])
    after = m.base + np.where(codes[val, best[1]] <= best[2], best[3], best[4])
    assert np.allclose(errors, [np.sqrt(((y[val] - p) ** 2).mean()) for p in (m.base, after)])


def test_stops_by_patience_after_many_rounds_and_learns(rows):
    train, val, test = rows
    m = B.fit(train, val, F8, "y", [B.Setting(0.1, 3, 3), B.Setting(0.2, 3, 3)])[0]
    assert all(rounds < B.ROUNDS and rounds - best == B.PATIENCE for *_, best, rounds, _, _ in m.board)
    assert sum(r[-1] for r in m.board) == 1 and len(m.trees) >= B.LEAST
    p = m.predict(test).toPandas()
    assert ((p.y - p.pred) ** 2).mean() < 0.4 * p.y.var() and (p.pred >= 0).all()


def test_edges(spark, rows):
    train, val, test = rows
    with pytest.raises(ValueError):
        B.fit(train, val.where("false"), F8, "y")
    flat = lambda d: d.selectExpr("3.0D AS y", "CAST(NULL AS double) AS f0", "f1")
    m = B.fit(flat(train), flat(val), ["f0", "f1"], "y", [B.Setting(0.5, 2, 3)], patience=2, least=1)[0]
    assert np.allclose(m.predict(flat(test)).toPandas().pred, 3.0)
    only = B.fit(train, val, F8, "y", [B.Setting(0.3, 2, 3, (0,)), B.Setting(0.3, 2, 3, (3, 4))], rounds=3, least=1)
    assert {int(f) for t in only[1].trees for f in t.feature} <= {-1, 3, 4} and {int(f) for t in only[0].trees for f in t.feature} <= {-1, 0}
    assert m.predict(flat(test).where("false")).count() == 0


def test_a_round_draws_rows_by_hash_and_seed():
    """The rows of a round are those of a plain hash of row, seed and round: about ``ROW_SHARE``, whatever the slices."""
    g = np.random.default_rng(4)
    n, seed, round_, full = 2_000, 7, 3, 2**64 - 1
    codes, y, h = g.integers(0, B.BINS, (n, 2)), g.normal(size=n), g.integers(-2**62, 2**62, n)
    m = B.Member(B.Setting(0.1, 2, 3), True, 0.0, [B.Tree.empty(2)] * round_)
    rows = codes, y, h, np.arange(n) % 5 == 0, np.zeros((n, 1))

    def drawn(z):
        z ^= (seed * 1_000_003 + round_ + 1) * many_fits._MIX & full
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ z >> shift) * factor & full
        return ((z ^ z >> 31) >> 11) / 2**53 < B.ROW_SHARE

    take = np.array([drawn(int(v) & full) for v in h])
    whole, parts = ({0: np.zeros(2 * 2 * B.BINS + 2)} for _ in range(2))
    B._fold(whole, rows, [m], round_, 0, round_, seed)
    for at in range(0, n, 300):
        B._fold(parts, tuple(r[at:at + 300] for r in rows), [m], round_, 0, round_, seed)
    sums, counts = whole[0][:-2].reshape(2, 2, B.BINS)
    for j in range(2):
        assert counts[j].tolist() == np.bincount(codes[take, j], minlength=B.BINS).tolist()
        assert np.allclose(sums[j], np.bincount(codes[take, j], y[take], B.BINS))
    assert np.allclose(whole[0], parts[0]) and abs(take.mean() - B.ROW_SHARE) < 0.05
