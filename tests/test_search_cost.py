"""What configurations share is fitted once, and a model scores each row once."""

import pytest
from test_training import table

from tidemark.operators import features, model


@pytest.fixture(scope="module")
def rows(spark):
    df = table(spark, 400).cache()
    return df, model.expanding_splits(model.settle(model.temporal_folds(features.partition_filter(df, "train"))))


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_numbers_of_trees_share_a_fit(spark, rows, kind, monkeypatch):
    own = {"depth": 2, "leaf": 1} if kind == "forest" else {"depth": 2, "rate": 0.3, "weight": 2.0}
    grid = [{"trees": n, **own} for n in (2, 5, 3)]
    alone = [model.fold_areas(kind, [p], rows[1])[0] for p in grid]
    asked, estimator = [], model.estimator
    monkeypatch.setattr(model, "estimator", lambda kind, p, *a: asked.append(p["trees"]) or estimator(kind, p, *a))
    got = model.fold_areas(kind, grid, rows[1])
    fitted = [n for n in asked if n == 5]
    assert set(asked[-3:]) == {5} and len(fitted) <= 6
    assert got[1] == alone[1]
    if kind == "boosted":  # the first trees of a fit are the fit of so many
        assert got == alone
    else:
        fit = model.fit_one(kind, grid[1], rows[0])
        trees = fit.stages[-1].trees
        two = model._first_trees(fit.stages[-1], 2)
        x = fit.transform(rows[0]).select("features").first().features
        assert len(two.trees) == 2
        assert abs(two.predictProbability(x)[1] - sum(t.predictProbability(x)[1] for t in trees[:2]) / 2) < 1e-12


def scores_no_row(df):
    return "UDF" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_thresholds_are_tuned_on_settled_scores(spark, rows, monkeypatch):
    seen, own = [], model.threshold_curve
    monkeypatch.setattr(model, "threshold_curve", lambda df: seen.append(scores_no_row(df)) or own(df))
    model.train_all(rows[0], ["forest"], {"forest": [{"trees": 2, "depth": 2, "leaf": 1}]})
    assert seen == [True]


def test_permuted_rows_are_scored_once(spark, rows, monkeypatch):
    seen, own = [], model.roc_auc
    monkeypatch.setattr(model, "roc_auc", lambda df, *by: seen.append(scores_no_row(df)) or own(df, *by))
    fit = model.fit_one("forest", {"trees": 2, "depth": 2, "leaf": 1}, rows[0])
    model.permutation_importance(fit, rows[0], repeats=2).collect()
    assert seen == [True, True]
