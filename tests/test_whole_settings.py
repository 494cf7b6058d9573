"""Queries over learners and refits use the operators' own settings."""

import pytest

from __spark_entry__ import queries
from loadloom.config import DEFAULT
from loadloom.operators import gram, learners, many_fits

SF = "/root/testdata/sf0.001"


class Stop(Exception):
    pass


@pytest.mark.parametrize("name", ["gradient_boosting", "random_forest", "feature_importance", "weather_mode_ablation"])
def test_learners_search_the_whole_grid(spark, monkeypatch, name):
    def seen(*args, **kw):
        assert not kw.keys() & {"grid", "maxIter", "numTrees"}
        raise Stop
    monkeypatch.setattr(learners, "fit_regressor", seen)
    with pytest.raises(Stop):
        queries()[name](spark, SF)


def test_cluster_models_try_all_penalties(spark, monkeypatch):
    def seen(grams, by, split, p, **kw):
        assert not kw
        raise Stop
    monkeypatch.setattr(gram, "fit_groups", seen)
    with pytest.raises(Stop):
        queries()["cluster_models"](spark, SF)


def fitted_specs(spark, monkeypatch, name):
    found = []

    def seen(table, specs, **kw):
        assert not kw
        found.extend((s.k, s.start, s.draw) for s in specs)
        raise Stop
    monkeypatch.setattr(many_fits, "fit_kmeans", seen)
    with pytest.raises(Stop):
        queries()[name](spark, SF)
    return set(found)


def test_stability_uses_all_draws_and_starts(spark, monkeypatch):
    assert fitted_specs(spark, monkeypatch, "bootstrap_jaccard") == {(3, s, None) for s in range(25)} | {(3, s, b) for s in range(10) for b in range(30)}


@pytest.mark.parametrize("name", ["kmeans", "gaussian_mixture", "sensitivity_grid"])
def test_clusterings_try_the_whole_range(spark, monkeypatch, name):
    assert fitted_specs(spark, monkeypatch, name) == {(k, s, None) for k in DEFAULT.k_range for s in range(25)}


def test_solutions_are_rated_on_all_draws(spark, monkeypatch):
    want = {(k, s, None) for k in DEFAULT.k_range for s in range(25)} | {(k, s, b) for k in DEFAULT.k_range for s in range(10) for b in range(30)}
    assert fitted_specs(spark, monkeypatch, "chosen_solution") == want
