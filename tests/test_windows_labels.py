"""Hand-computed windows, labels and features, and both window forms against a plain count."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import assess, evaluate, features, label, model, windows
from tidemark.sources import records

T0 = 1_704_067_200  # Monday 2024-01-01 00:00 UTC


def mentions(spark, hours, entity="A"):
    rows = [(k, e, T0 + int(h * 3600)) for k, (e, h) in enumerate((entity, h) if not isinstance(h, tuple) else h for h in hours)]
    return spark.createDataFrame(rows, "id long, entity string, t long")


def counts(spark, hours, form="frame"):
    df = windows.window_counts(mentions(spark, hours), form=form)
    return [(r.backward_count, r.forward_count) for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("form", ["frame", "prefix"])
def test_counts(spark, form):
    assert counts(spark, [0, 12], form) == [(0, 1), (1, 0)]
    assert counts(spark, [0, 24], form) == [(0, 1), (0, 0)]  # the far end forward counts, backward does not
    got = counts(spark, [0, 4, 8, 12, 16], form)
    assert got[0][1] == 4 and got[-1][0] == 4
    assert counts(spark, [("A", 0), ("B", 1), ("A", 12), ("B", 13), ("A", 25), ("B", 26)], form)[:2] == [(0, 1), (0, 1)]
    assert counts(spark, [0, 12, 24, 24, 48.0003], form) == [(0, 3), (1, 2), (1, 0), (1, 0), (0, 0)]


def test_forms_agree_on_ties_and_hot_entities(spark):
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.6 else f"e{r.randrange(5)}", r.choice([0, 24, 48, r.random() * 200, r.randrange(100)])) for _ in range(800)]
    assert counts(spark, rows, "prefix") == counts(spark, rows)
    assert windows.window_counts(mentions(spark, rows).limit(0), form="prefix").collect() == []


def test_growth(spark):
    df = windows.windowed(mentions(spark, [0, 6, 12]))
    assert [r.posting_volume_growth for r in df.orderBy("id").collect()] == [1.0, 0.0, -1.0]
    back = windows.windowed(mentions(spark, [0, 1, 2]), "backward_only", 2).orderBy("id").collect()
    assert back[0].posting_volume_growth == 0 and [r.excluded for r in back] == [True, True, False]
    with pytest.raises(ValueError):
        windows.windowed(mentions(spark, [0]), "other")


def test_future_sentiment(spark):
    df = spark.createDataFrame(
        [(1, "A", T0, 0.5, False), (2, "A", T0, 0.9, False), (3, "A", T0 + 60, -0.5, False), (4, "A", T0 + 120, 0.1, False), (5, "A", T0 + 90, 0.7, True), (6, "B", T0, 0.3, False)],
        "id long, entity string, t long, polarity double, excluded boolean",
    )
    got = {r.id: (round(r.sentiment_polarity, 9), round(r.mean_future_sentiment, 9)) for r in windows.with_future_sentiment(df).collect()}
    assert got == {1: (0.5, -0.2), 2: (0.9, -0.2), 3: (-0.5, 0.1), 4: (0.1, 0.1), 5: (0.0, 0.0), 6: (0.3, 0.3)}


def test_labels_use_training_statistics_only(spark):
    growth = [0, 0, 0, 0, 4, 4, 4, 4, 6, 2]
    rows = [(k, T0 + k * 3600, float(g), 0.0, False) for k, g in enumerate(growth)]
    df = spark.createDataFrame(rows, "id long, t long, posting_volume_growth double, sentiment_change double, excluded boolean")
    split = label.temporal_split(df)
    stats = label.fit_stats(split).first()
    assert (stats.mu_volume, stats.sigma_volume, stats.sigma_sentiment, stats.train_size) == (2.0, 2.0, 0.0, 8)
    got = {r.id: (r.composite, r.surge_label) for r in label.apply_labelling(df, 1.0, 1.0, 0.0).collect()}
    assert got[8] == (2.0, 1.0) and got[9] == (0.0, 0.0)
    assert {r.surge_label for r in label.apply_labelling(df, 2.0, 1.0, 0.0).collect()} == {0.0}  # strictly above
    assert label.apply_labelling(df.limit(0)).collect() == []
    none = label.apply_labelling(df.withColumn("excluded", F.lit(True))).collect()
    assert all(r.surge_label is None and r.composite is None for r in none)


def test_distribution_and_sweep(spark):
    df = spark.createDataFrame([("train", 2.0), ("train", 0.1), ("test", None)], "partition string, composite double")
    got = {r.partition: r for r in label.class_distribution(df.withColumn("surge_label", label.label_of(F.col("composite")))).collect()}
    assert (got["all"].surge_rate, got["train"].imbalance_ratio, got["test"].total, got["test"].imbalance_ratio) == (50.0, 1.0, 0, 0.0)
    rates = [r.surge_rate for r in label.threshold_sweep(df).orderBy("threshold").collect()]
    assert rates == sorted(rates, reverse=True)
    no_hit = label.class_distribution(df.withColumn("surge_label", F.when(F.col("composite").isNotNull(), 0.0)))
    assert no_hit.where("partition = 'all'").first().imbalance_ratio == float("inf")


def test_features(spark):
    a = windows.acceleration()
    got = [r[0] for r in mentions(spark, [0, 6, 13, 20]).withColumn("a", a).orderBy("id").select("a").collect()]
    assert got[-1] == 0.5
    assert [r[0] for r in mentions(spark, [0, 6]).withColumn("a", a).orderBy("id").select("a").collect()] == [0.0, 1.0]
    gaps = [r[0] for r in mentions(spark, [0, 0, 3]).withColumn("g", windows.time_since_previous()).orderBy("id").select("g").collect()]
    assert gaps == [-1.0, 0.0, 3.0]
    with pytest.raises(ValueError, match="entity"):
        features.features_all(spark.createDataFrame([(1,)], "id long"))


def test_extraction(spark):
    rows = [("$AAPL up", None), ("$CEO and $THE", None), ("A Apple", None), ("$ABCDEF", None), ("éABC PLTR", "ABCé"), (None, "$A TSLA TSLA")]
    df = spark.createDataFrame(rows, "title string, body string")
    got = [r[0] for r in df.select(C.extract_entities(F.col("title"), F.col("body"), ("CEO", "THE"))).collect()]
    assert got == [["AAPL"], [], [], ["ABCDE"], ["PLTR"], ["A", "TSLA"]]
    listed = spark.createDataFrame([(1, " aapl, tsla,,aapl "), (2, "nan"), (3, None), (4, " ")], "id long, tickers string")
    assert [(r.id, r.entity) for r in records.explode_mentions(listed).collect()] == [(1, "AAPL"), (1, "TSLA"), (1, "AAPL")]


def test_bad_time_fails_the_load(spark):
    good = spark.createDataFrame([(1, 1704067200.9), (2, 0.0)], "id long, created_utc double")
    assert [r.epoch for r in records.parse_time(good).orderBy("id").collect()] == [1704067200, 0]
    with pytest.raises(Exception, match="creation time"):
        records.parse_time(spark.createDataFrame([(1, "soon")], "id long, created string")).collect()


def test_mcnemar(spark):
    rows = [(k, m, k % 2, p) for k in range(200) for m, p in (("a", k % 2), ("b", (k + (k < 30)) % 2), ("c", k % 2))]
    got = {(r.model_a, r.model_b): r for r in evaluate.mcnemar(spark.createDataFrame(rows, "id long, model string, y int, pred int")).collect()}
    assert len(got) == 3 and got["a", "c"].p_value == 1.0 and not got["a", "c"].significant
    assert (got["a", "b"].b, got["a", "b"].c, got["a", "b"].statistic) == (30, 0, 30.0) and got["a", "b"].significant
    assert abs(got["a", "b"].p_value - 4.3205e-8) < 2e-7 and abs(got["a", "b"].corrected_alpha - 0.05 / 3) < 1e-12
    few = [(k, m, 1, p) for k in range(22) for m, p in (("a", 1), ("b", int(k < 2)))] + [(99, "a", 1, 0), (99, "b", 1, 1)]
    p = evaluate.mcnemar(spark.createDataFrame(few, "id long, model string, y int, pred int")).first().p_value
    assert abs(p - 2 * (1 + 21) / 2**21) < 1e-12


def test_tiers_and_assessment(spark):
    df = spark.createDataFrame([(0.72,), (0.85,), (0.58,), (0.8,), (0.6,)], "auc double")
    assert [r[0] for r in df.select(evaluate.tier(F.col("auc"))).collect()] == ["target", "stretch", "below", "target", "below"]
    frame = spark.createDataFrame([("2024-01-01", "x", 1)] * 3, "posted string, text string, score int")
    assert assess.detect_columns(frame) == {"date": "posted", "text": "text", "engagement": ["score"], "sentiment": None}


def test_grids_and_folds(spark):
    assert [len(model.param_grid(k, 9.0)) for k in ("logistic", "forest", "boosted")] == [10, 36, 50]
    df = model.temporal_folds(mentions(spark, range(10)), 4)
    assert [r.fold for r in df.orderBy("t").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 3, 3]
    splits = model.expanding_splits(df)
    model.verify_temporal_order(splits)
    assert splits.where("role = 'train'").groupBy("split").count().orderBy("split").collect()[-1]["count"] == 6


def odd_mentions(spark):
    """Hot seconds, ends of days, long gaps, negative times and ties."""
    import random

    r = random.Random(6)
    day = 86_400
    ts = [r.choice([0, 1, day - 1, day, day + 1, 2 * day, -1, -day, 40 * day, 40 * day + 43_200, r.randrange(-day, 3 * day)]) for _ in range(500)]
    return spark.createDataFrame([(k, "hot" if k % 3 else f"e{k % 7}", t, round(r.uniform(-1, 1), 4)) for k, t in enumerate(ts)], "id long, entity string, t long, polarity double")


def test_both_forms_say_the_same(spark):
    m = odd_mentions(spark)
    for method in ("forward", "backward_only"):
        a, b = (label.through_sentiment(m, method, form=form) for form in ("frame", "prefix"))
        names = sorted(a.columns)
        assert sorted(b.columns) == names
        key = lambda r: r.id
        for x, y in zip(sorted(a.select(*names).collect(), key=key), sorted(b.select(*names).collect(), key=key), strict=True):
            assert all(p == q or abs(p - q) < 1e-8 for p, q in zip(x, y, strict=True)), (x, y)
    frame = m.withColumns({"g": windows.time_since_previous(), "a": windows.acceleration()})
    own = windows.with_acceleration(windows.with_gaps(m))
    want = {r.id: (r.g, r.a) for r in frame.collect()}
    assert {r.id: (r.time_since_previous, r.acceleration_12h) for r in own.collect()} == want


def test_split_point_is_the_interpolated_percentile(spark):
    m = odd_mentions(spark)
    ts = sorted(r.t for r in m.collect())
    for ratio in (0.0, 0.137, 0.5, 0.8, 1.0):
        at = ratio * (len(ts) - 1)
        lo, hi = ts[int(at)], ts[min(int(at) + (at > int(at)), len(ts) - 1)]
        assert abs(label.split_point(m, ratio).first().cut - (lo + (hi - lo) * (at - int(at)))) < 1e-6
    assert label.split_point(m.limit(0)).first().cut is None


def test_roc_of_many_scores_equals_counting_pairs(spark):
    import random

    r = random.Random(2)
    rows = [(k, f"m{k % 2}", int(r.random() < 0.4), round(r.random(), 2 if k % 3 else 9)) for k in range(1500)]
    df = spark.createDataFrame(rows, "id long, model string, y int, prob double")
    for by in ((), ("model",)):
        for got in evaluate.roc_auc(df, *by).collect():
            own = [(y, p) for _, m, y, p in rows if not by or m == got.model]
            pos, neg = [p for y, p in own if y], [p for y, p in own if not y]
            assert abs(got.auc - sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))) < 1e-9
    pos, neg = [p for _, _, y, p in rows if y], [p for _, _, y, p in rows if not y]
    for got in evaluate.roc_curve(df).collect():
        assert abs(got.fpr - sum(p >= got.threshold for p in neg) / len(neg)) < 1e-9 and abs(got.tpr - sum(p >= got.threshold for p in pos) / len(pos)) < 1e-9
