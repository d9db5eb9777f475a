"""Segmented running sums, percentiles and bootstrap sums against plain loops, with ties and hot groups."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import assess, evaluate, scan


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    return [("hot" if r.random() < 0.7 else r.choice(["a", "b", None]), r.choice([0.0, -1.5, 2.0, round(r.gauss(0, 3), 1), r.random()]), r.randrange(5)) for _ in range(900)]


def test_running_sums(spark, rows):
    df = spark.createDataFrame(rows, "g string, x double, n long").groupBy("g", "x").agg(F.sum("n").alias("n"))
    for by in (["g"], []):
        own = df if by else df.groupBy("x").agg(F.sum("n").alias("n"))
        got = scan.prefix_sums(own, by, ["x"], ["n"]).collect()
        assert len(got) == own.count()
        for r in got:
            assert r.n_before == sum(n for g, x, n in rows if x < r.x and (not by or g == r.g))


def test_percentiles(spark, rows):
    df = spark.createDataFrame([*rows, ("none", None, 1)], "g string, x double, n long")
    shares = [0.0, 0.137, 0.5, 0.9, 1.0]
    got = {r.g: r.cuts for r in scan.percentiles(df, "x", shares, ["g"]).collect()}
    assert set(got) == {"hot", "a", "b", None}
    for g, cuts in got.items():
        assert np.allclose(cuts, np.quantile([x for k, x, _ in rows if k == g], shares))
    assert np.allclose(scan.percentiles(df, "x", shares).first().cuts, np.quantile([x for _, x, _ in rows], shares))
    assert scan.percentiles(df.limit(0), "x", shares, ["g"]).collect() == []


def test_dates_by_their_median(spark):
    seconds = spark.createDataFrame([("1704067200",), ("1704067260",), ("7",), (None,), ("x",)], "w string")
    got = [r.parsed for r in assess.epoch_or_string_dates(seconds, "w").collect()]
    assert [str(x) for x in got[:3]] == ["2024-01-01 00:00:00", "2024-01-01 00:01:00", "1970-01-01 00:00:07"] and got[3:] == [None, None]
    texts = spark.createDataFrame([("2024-01-01",), (None,), ("x",)], "w string")
    assert [str(r.parsed) for r in assess.epoch_or_string_dates(texts, "w").collect()] == ["2024-01-01 00:00:00", "None", "None"]


def naive_bootstrap(rows, resamples, seed, threshold=0.5):
    bounds = evaluate.POISSON_ONE
    out = []
    for b in range(resamples):
        w = []
        for i, _, _ in rows:
            h = hashlib.md5(f"{i}:{b // 8}:{seed}".encode()).hexdigest()
            u = int(h[4 * (b % 8) : 4 * (b % 8) + 4], 16) / 65536
            w.append(sum(u >= x for x in bounds))
        tp = sum(k for k, (_, y, p) in zip(w, rows) if y and p >= threshold)
        fp = sum(k for k, (_, y, p) in zip(w, rows) if not y and p >= threshold)
        pos = sum(k for k, (_, y, _) in zip(w, rows) if y)
        neg = sum(w) - pos
        if not pos or not neg:
            out.append((b + 1, 0.0, 0.0, 0.0, 0.5))
            continue
        wins = sum(k * m * ((p > q) + (p == q) / 2) for k, (_, y, p) in zip(w, rows) if y for m, (_, z, q) in zip(w, rows) if not z)
        prec, rec = tp / (tp + fp) if tp + fp else 0.0, tp / pos
        out.append((b + 1, prec, rec, 2 * tp / (tp + fp + pos) if tp + fp + pos else 0.0, wins / (pos * neg)))
    return out


@pytest.mark.parametrize("scores", ["ties", "one", "many"])
def test_bootstrap(spark, scores):
    """A score that all rows share is dealt to several tasks, and its halves of wins still add up."""
    r = random.Random(5)
    score = {"ties": lambda: r.choice([0.1, 0.5, 0.5, 0.5, 0.9]), "one": lambda: 0.5, "many": r.random}[scores]
    rows = [(k, int(r.random() < 0.3), score()) for k in range(90)]
    df = spark.createDataFrame([*rows, (99, None, 0.3), (98, 1, None)], "id long, y int, prob double")
    want = naive_bootstrap(rows, 20, 7)
    for own in (df, df.repartition(9)):
        got = sorted(tuple(x) for x in evaluate.bootstrap(own, 20, 7).collect())
        assert len(got) == 20 and np.allclose(got, want, atol=1e-12)
    few = evaluate.bootstrap(df.where("id < 3"), 5).collect()
    assert all(0 <= x.auc <= 1 for x in few) and evaluate.bootstrap(df.limit(0), 5).collect() == []
