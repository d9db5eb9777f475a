"""Search, refit, prediction and importances on a small table whose classes two features decide."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate, features, model

GRIDS = {
    "logistic": [{"C": 1e-4, "l1": 1.0, "iter": 5}, {"C": 1.0, "l1": 0.0, "iter": 30}],
    "forest": [{"trees": n, "depth": d, "leaf": 1} for n in (3, 6) for d in (1, 4)],
    "boosted": [{"trees": n, "depth": 2, "rate": 0.3, "weight": 1.0} for n in (1, 8)],
}


def table(spark, n=900, seed=1):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, len(features.FEATURES)))
    y = (x[:, 0] + 0.7 * x[:, 4] + 0.3 * r.standard_normal(n) > 0.4).astype(int)
    rows = [(k, f"e{k % 5}", 1000 + k, "train" if k < 0.8 * n else "test", k % 31 == 0, int(y[k]), *map(float, x[k])) for k in range(n)]
    return spark.createDataFrame(rows, "id long, entity string, t long, partition string, excluded boolean, y int, " + ", ".join(f"{f} double" for f in features.FEATURES))


@pytest.fixture(scope="module")
def done(spark):
    df = table(spark).cache()
    return df, model.train_all(df, grids=GRIDS)


def area(y, s):
    """Pairs of a positive and a negative that are in order; ties for half."""
    pairs = [(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]]
    return float(np.mean(pairs)) if pairs else 0.5


def test_fold_areas_are_those_of_the_fitted_models(spark, done):
    """Each area is that of the Spark model fitted on the split's training rows, on its validation rows; the search reports the winner's."""
    df, trained = done
    folded = model.temporal_folds(features.partition_filter(df, "train"))
    splits = model.expanding_splits(folded)
    for t in trained:
        for i, got in enumerate(t.fold_auc, 1):
            own = splits.where(F.col("split") == i)
            fitted = model.fit_one(t.kind, t.params, own.where("role = 'train'").select("y", *features.FEATURES).coalesce(1))
            rows = model.score(fitted, own.where("role = 'validate'")).collect()
            # the rows' order decides which of them a forest draws; the other models have no such freedom
            assert abs(got - area(np.array([r.y for r in rows]), np.array([r.prob for r in rows]))) < (0.05 if t.kind == "forest" else 1e-3)
        assert t.cv_auc == sum(t.fold_auc) / 3


def test_search_finds_the_better_configuration(spark, done, monkeypatch):
    df, trained = done
    assert [t.kind for t in trained] == ["logistic", "forest", "boosted"]
    assert [t.tried for t in trained] == [2, 4, 2] and all(len(t.fold_auc) == 3 for t in trained)
    best = {t.kind: t.params for t in trained}
    assert best["logistic"]["C"] == 1.0 and best["forest"]["depth"] == 4 and best["boosted"]["trees"] == 8
    assert all(t.cv_auc > 0.8 for t in trained)
    splits = model.expanding_splits(model.temporal_folds(features.partition_filter(df, "train")))
    # of more rows than the bound a sample decides, and the winner's areas are those on all rows
    params, bounded = model.grid_search("boosted", GRIDS["boosted"], splits, search_rows=300)
    assert params in GRIDS["boosted"] and bounded == model.fold_areas("boosted", [params], splits)[0]
    # all groups meet on the first rung, and the best go on; without rungs every configuration is fitted in full
    grid = [{"trees": n, "depth": d, "rate": r, "weight": 1.0} for n in (2, 6) for d in (1, 3) for r in (1e-6, 0.3)]
    tried = []
    own = model.fold_areas
    monkeypatch.setattr(model, "fold_areas", lambda kind, some, *a: tried.append(list(some)) or own(kind, some, *a))
    params, areas = model.grid_search("boosted", grid, splits, rungs=(1,))
    assert [p["trees"] for p in tried[0]] == [1] * 4 and len(tried[1]) == 4 and {p["trees"] for p in tried[1]} == {2, 6}
    assert params in tried[1] and areas == max(own("boosted", tried[1], splits), key=sum)
    tried.clear()
    assert model.grid_search("boosted", grid, splits, rungs=())[0] in grid and tried == [grid]
    one_class = model.fold_areas("forest", GRIDS["forest"], splits.withColumn("y", F.lit(0)))
    assert one_class == [[0.5] * 3] * 4


def test_summary_and_predictions(spark, done):
    df, trained = done
    rows = {r.model: r for r in model.training_summary(spark, trained).collect()}
    assert json.loads(rows["boosted"].params) == GRIDS["boosted"][1] and rows["forest"].configs_tried == 4
    for t in trained:
        got = model.predict(t, df, "test", t.threshold).collect()
        assert len(got) == df.where("partition = 'test' AND NOT excluded").count()
        assert all(r.pred == int(r.prob >= t.threshold) for r in got) and area(np.array([r.y for r in got]), np.array([r.prob for r in got])) > 0.85
        # the threshold is the best one of 0.01 .. 0.99 on the last fold
        fold = model.temporal_folds(features.partition_filter(df, "train")).where("fold = 3")
        last = model.score(t.model, fold).collect()

        def f1(c):
            tp = sum(r.y for r in last if r.prob >= c)
            return round(2 * tp / max(1, sum(r.prob >= c for r in last) + sum(r.y for r in last)), 12)

        assert t.threshold == min((k / 100 for k in range(1, 100)), key=lambda c: (-f1(c), c))


def test_refit_is_the_same_on_all_rows(spark, done):
    df, _ = done
    train = features.partition_filter(df, "train")
    a, b = (model.score(model.fit_one("logistic", GRIDS["logistic"][1], x), df, "id").orderBy("id").collect() for x in (train, train.repartition(3)))
    assert all(abs(x.prob - z.prob) < 1e-6 for x, z in zip(a, b, strict=True))


def test_importances(spark, done):
    df, trained = done
    test = features.partition_filter(df, "test")
    forest = trained[1].model
    own = dict(model.builtin_importance(forest))
    assert abs(sum(own.values()) - 1) < 1e-9 and sorted(own, key=own.get)[-2:] == ["sentiment_score", "hour_of_day"]
    assert model.builtin_importance(trained[0].model) == []
    got = {r.feature: r for r in model.permutation_importance(forest, test, repeats=4).collect()}
    assert set(got) == set(features.FEATURES)
    assert sorted(got, key=lambda f: got[f].importance)[-2:] == ["sentiment_score", "hour_of_day"]
    base = evaluate.roc_auc(model.score(forest, test)).first().auc
    assert 0.1 < got["hour_of_day"].importance < base and got["hour_of_day"].std > 0
    assert model.permutation_importance(forest, test.limit(0), repeats=2).where("importance = 0").count() == 11


def test_models_are_saved_and_scored_on_another_table(spark, done, tmp_path):
    _, trained = done
    model.save(trained, str(tmp_path))
    other = table(spark, 400, seed=9)
    got = {r.model: r for r in model.cross_dataset_eval(spark, str(tmp_path), ["logistic", "forest", "boosted"], other, "test").collect()}
    for t in trained:
        rows = model.predict(t, other, "test", t.threshold).collect()
        tp, said = sum(r.y for r in rows if r.pred), sum(r.pred for r in rows)
        r = got[t.kind]
        assert abs(r.auc - area(np.array([x.y for x in rows]), np.array([x.prob for x in rows]))) < 1e-9
        assert abs(r.tuned_precision - tp / max(said, 1)) < 1e-9 and abs(r.tuned_recall - tp / sum(x.y for x in rows)) < 1e-9


def test_grids_are_listed(spark):
    rows = model.grids(spark, 9.0).collect()
    for kind, n in (("logistic", 10), ("forest", 36), ("boosted", 50)):
        assert [json.loads(r.params) for r in sorted(rows, key=lambda r: r.place) if r.model == kind] == model.param_grid(kind, 9.0)
        assert sum(r.model == kind for r in rows) == n
