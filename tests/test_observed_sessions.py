"""Models are fitted, scored, saved and loaded in a session that has observed something or tagged its jobs."""

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from test_oracles import SF
from test_training import table

from tidemark.operators import features, model
from tidemark.plans import learning

PARAMS = {"logistic": {"C": 1.0, "l1": 0.0, "iter": 10}, "forest": {"trees": 3, "depth": 3, "leaf": 1}, "boosted": {"trees": 2, "depth": 2, "rate": 0.3, "weight": 1.0}}


@pytest.fixture(scope="module")
def rows(spark):
    seen = Observation("rows")
    spark.range(3).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 3}
    spark.addTag("observed")
    yield table(spark, 300)
    spark.removeTag("observed")


def test_saved_models_score_another_table(spark, rows, tmp_path):
    trained = model.train_all(rows, ("logistic", "boosted"), {k: [PARAMS[k]] for k in ("logistic", "boosted")})
    model.save(trained, str(tmp_path))
    got = {r.model: r for r in model.cross_dataset_eval(spark, str(tmp_path), ["logistic", "boosted"], table(spark, 200, 2), "test").collect()}
    assert set(got) == {"logistic", "boosted"} and all(r.auc > 0.5 for r in got.values())


@pytest.mark.parametrize("kind", PARAMS)
def test_a_fitted_model_scores(spark, rows, kind):
    """As ``refit_best`` does: fitted without a search, scored at once."""
    fitted = model.fit_one(kind, PARAMS[kind], rows)
    assert not getattr(fitted.stages[-1], "hasSummary", False)
    assert model.score(fitted, rows).where("prob between 0 and 1").count() == 300


def test_refit_best_equals_a_fit_by_newton_steps(spark, rows):
    """The query itself: the same penalised likelihood solved by numpy, the last quarter of the training rows scored, every threshold tried."""
    got = learning.refit_best(spark, SF).collect()
    used = ["t", "id", "entity", "y", *features.FEATURES]
    train = sorted(tuple(r) for r in features.partition_filter(learning._dataset(spark, SF), "train").select(*used).collect())
    n, y = len(train), np.array([r[3] for r in train], float)
    x = np.array([r[4:] for r in train], float)
    x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0, ddof=1), 1)
    weight = n / 2 / np.where(y == 1, y.sum(), n - y.sum())
    # Spark ML's penalty is on features scaled by their weighted deviation
    spread = np.sqrt(np.maximum(np.average((x - np.average(x, 0, weight)) ** 2, 0, weight) * n / (n - 1), 0))
    x = np.column_stack([x[:, spread > 0] / spread[spread > 0], np.ones(n)])
    ridge = np.append(np.full(x.shape[1] - 1, 1 / learning.FIXED["C"]), 0)
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (p - y)) + ridge * b)
    last = np.minimum(np.arange(n) // (n // model.FOLDS), model.FOLDS - 1) == model.FOLDS - 1
    p, y = 1 / (1 + np.exp(-x[last] @ b)), y[last] == 1

    def f1(cut):
        return 2 * np.sum(y & (p >= cut)) / (np.sum(y) + np.sum(p >= cut))

    assert len(got) == 1
    best = got[0]
    assert (best.tp + best.fn, best.fp + best.tn) == (np.sum(y), np.sum(~y))
    assert abs(best.f1 - f1(best.threshold)) < 0.01 and abs(best.f1 - max(f1(i / 100) for i in range(1, 100))) < 0.01
