"""Queries: window counts, sentiment ahead, labels, sweep, features, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import features, label, model, windows
from .tables import EV, ORD, UPTO, counted, mentions_ev, mentions_ord, query, r6, upto

COUNTS = "SELECT id, entity, t, backward_count, forward_count FROM w"


@query(f"WITH {EV}, {counted()} SELECT id, entity, backward_count FROM w")
def backward_count_24h(spark, d):
    return windows.window_counts(mentions_ev(spark, d)).select("id", "entity", "backward_count")


@query(f"WITH {ORD}, {counted('od')} SELECT id, entity, forward_count FROM w")
def forward_count_24h(spark, d):
    """On whole-day stamps: the far end counts, the near end does not."""
    return windows.window_counts(mentions_ord(spark, d)).select("id", "entity", "forward_count")


@query(f"WITH {EV}, {counted()} {COUNTS}")
def window_counts_prefix(spark, d):
    return windows.window_counts(mentions_ev(spark, d), form="prefix").select("id", "entity", "t", "backward_count", "forward_count")


@query(f"WITH {ORD}, {counted('od')} {COUNTS}")
def window_counts_prefix_hot(spark, d):
    """Five entities hold all rows."""
    return windows.window_counts(mentions_ord(spark, d), form="prefix").select("id", "entity", "t", "backward_count", "forward_count")


@query(upto("g") + "SELECT id, round(posting_volume_growth, 6) AS growth FROM g")
def volume_growth(spark, d):
    return windows.windowed(mentions_ev(spark, d)).select("id", r6("posting_volume_growth", "growth"))


@query(upto("g") + "SELECT id, excluded FROM g")
def exclude_forward(spark, d):
    return windows.windowed(mentions_ev(spark, d)).select("id", "excluded")


@query(upto("w") + "SELECT id, backward_count < 2 AS excluded FROM w")
def exclude_backward(spark, d):
    return windows.windowed(mentions_ev(spark, d), "backward_only", 2).select("id", "excluded")


@query(
    upto("w", "b AS (SELECT *, avg(backward_count) OVER (PARTITION BY entity ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM w)")
    + "SELECT id, round(CASE WHEN prior IS NULL THEN 0.0 ELSE backward_count / greatest(prior, 1.0) - 1 END, 6) AS ratio FROM b"
)
def backward_surge_ratio(spark, d):
    return windows.windowed(mentions_ev(spark, d), "backward_only").select("id", r6("posting_volume_growth", "ratio"))


@query(upto("s") + "SELECT id, round(mean_future_sentiment, 6) AS mean_future_sentiment FROM s")
def mean_future_sentiment(spark, d):
    return label.through_sentiment(mentions_ev(spark, d)).select("id", r6("mean_future_sentiment", "mean_future_sentiment"))


@query(upto("s") + "SELECT id, round(sentiment_change, 6) AS sentiment_change FROM s")
def sentiment_change(spark, d):
    return label.through_sentiment(mentions_ev(spark, d)).select("id", r6("sentiment_change", "sentiment_change"))


@query(upto("s") + "SELECT round(avg(sentiment_polarity), 6) AS mean_polarity, round(avg(mean_future_sentiment), 6) AS mean_future, round(avg(sentiment_change), 6) AS mean_change FROM s")
def sentiment_summary(spark, d):
    df = label.through_sentiment(mentions_ev(spark, d))
    return df.agg(r6(F.avg("sentiment_polarity"), "mean_polarity"), r6(F.avg("mean_future_sentiment"), "mean_future"), r6(F.avg("sentiment_change"), "mean_change"))


GAP = "(t - lag(t) OVER (PARTITION BY entity ORDER BY t, id)) / 3600.0"
ACC = """count(*) OVER (PARTITION BY entity ORDER BY t RANGE BETWEEN 43199 PRECEDING AND 1 PRECEDING) /
  greatest(count(*) OVER (PARTITION BY entity ORDER BY t RANGE BETWEEN 86399 PRECEDING AND 43200 PRECEDING), 1)"""


@query(f"WITH {EV} SELECT id, round(coalesce({GAP}, -1.0), 6) AS gap FROM ev")
def time_since_previous(spark, d):
    return windows.with_gaps(mentions_ev(spark, d)).select("id", r6("time_since_previous", "gap"))


@query(f"WITH {EV} SELECT id, round({ACC}, 6) AS acceleration FROM ev")
def acceleration_12h(spark, d):
    return windows.with_acceleration(mentions_ev(spark, d)).select("id", r6("acceleration_12h", "acceleration"))


@query("SELECT o_orderkey AS id, count(DISTINCT o_orderpriority) AS entities_per_record FROM orders GROUP BY 1")
def entities_per_record(spark, d):
    return features.entities_per_record(mentions_ord(spark, d)).select("id", "entities_per_record").distinct()


@query(upto("p") + "SELECT id, partition, round(cut, 6) AS cut FROM p")
def temporal_split(spark, d):
    return label.temporal_split(label.through_sentiment(mentions_ev(spark, d))).select("id", "partition", r6("cut", "cut"))


STATS = ", ".join(f"round({c}, 6) AS {c}" for c in ("mu_volume", "sigma_volume", "mu_sentiment", "sigma_sentiment", "cut"))


@query(upto("f") + f"SELECT {STATS}, train_size, test_size FROM f")
def fit_stats(spark, d):
    df = label.fit_stats(label.temporal_split(label.through_sentiment(mentions_ev(spark, d))))
    return df.select(*[r6(c, c) for c in (*label.STATS, "cut")], "train_size", "test_size")


def _labelled(spark, d):
    return label.label_pipeline(mentions_ev(spark, d))


def _scored(spark, d):
    split = label.temporal_split(label.through_sentiment(mentions_ev(spark, d)))
    return label.scored(split, label.fit_stats(split))


@query(upto("z") + "SELECT id, round(z_volume, 6) AS z_volume, round(z_sentiment, 6) AS z_sentiment FROM z")
def zscore_train(spark, d):
    return _scored(spark, d).select("id", r6("z_volume", "z_volume"), r6("z_sentiment", "z_sentiment"))


@query(upto("z") + "SELECT id, round(composite, 6) AS composite FROM z")
def composite_score(spark, d):
    return _scored(spark, d).select("id", r6("composite", "composite"))


@query(upto("l") + "SELECT id, surge_label FROM l")
def surge_label(spark, d):
    return _labelled(spark, d).select("id", "surge_label")


@query(
    "WITH " + ",\n".join([*UPTO["w"], "g AS (SELECT *, true AS excluded FROM w)"])
    + "\nSELECT id, CAST(NULL AS DOUBLE) AS z_volume, CAST(NULL AS DOUBLE) AS composite, CAST(NULL AS DOUBLE) AS surge_label FROM g"
)
def label_degenerate(spark, d):
    """Without an included row in training nothing is labelled."""
    df = windows.window_counts(mentions_ev(spark, d)).withColumns({"posting_volume_growth": F.lit(0.0), "excluded": F.lit(True), "sentiment_change": F.lit(0.0)})
    return label.apply_labelling(df).select("id", "z_volume", "composite", "surge_label")


DIST = """SELECT coalesce(partition, 'all') AS partition, count(*) FILTER (WHERE surge_label = 1) AS surge_count, count(*) FILTER (WHERE surge_label = 0) AS no_surge_count,
  count(surge_label) AS total, round(CASE WHEN count(surge_label) > 0 THEN count(*) FILTER (WHERE surge_label = 1) * 100.0 / count(surge_label) ELSE 0 END, 6) AS surge_rate,
  round(CASE WHEN count(surge_label) = 0 THEN 0 WHEN count(*) FILTER (WHERE surge_label = 1) = 0 THEN 'Infinity'::DOUBLE
    ELSE count(*) FILTER (WHERE surge_label = 0) / count(*) FILTER (WHERE surge_label = 1) END, 6) AS imbalance_ratio
FROM l GROUP BY ROLLUP (partition)"""


@query(upto("l") + DIST)
def class_distribution(spark, d):
    df = label.class_distribution(_labelled(spark, d))
    return df.select("partition", "surge_count", "no_surge_count", "total", r6("surge_rate", "surge_rate"), r6("imbalance_ratio", "imbalance_ratio"))


SWEEP = """SELECT threshold, count(*) FILTER (WHERE composite > threshold) AS surge_count, count(*) FILTER (WHERE composite <= threshold) AS no_surge_count,
  round(count(*) FILTER (WHERE composite > threshold) * 100.0 / count(composite), 6) AS surge_rate FROM z, (VALUES (0.5::DOUBLE), (1.0), (1.5), (2.0), (2.5)) v(threshold) GROUP BY threshold"""


@query(upto("z") + SWEEP)
def threshold_sweep(spark, d):
    return label.threshold_sweep(_scored(spark, d)).select("threshold", "surge_count", "no_surge_count", r6("surge_rate", "surge_rate"))


@query(upto("z", f"sw AS ({SWEEP})") + "SELECT threshold, surge_rate BETWEEN 5 AND 10 AS viable FROM sw")
def sweep_viability(spark, d):
    return label.viability(label.threshold_sweep(_scored(spark, d))).select("threshold", "viable")


@query(upto("z", f"sw AS ({SWEEP})") + "SELECT *, surge_rate BETWEEN 5 AND 10 AS viable FROM sw")
def sweep_pipeline(spark, d):
    return label.sweep_pipeline(mentions_ev(spark, d)).select("threshold", "surge_count", "no_surge_count", r6("surge_rate", "surge_rate"), "viable")


LABELLED = """SELECT id, entity, backward_count, forward_count, excluded, round(posting_volume_growth, 6) AS growth, round(sentiment_change, 6) AS sentiment_change,
  partition, round(composite, 6) AS composite, surge_label FROM l"""


@query(upto("l") + LABELLED)
def label_pipeline(spark, d):
    df = _labelled(spark, d)
    return df.select("id", "entity", "backward_count", "forward_count", "excluded", r6("posting_volume_growth", "growth"), r6("sentiment_change", "sentiment_change"), "partition", r6("composite", "composite"), "surge_label")


@query(
    upto("f")
    + """SELECT id, round(CASE WHEN sigma_volume = 0 THEN 0 ELSE (posting_volume_growth - mu_volume) / sigma_volume END, 6) AS z_volume,
  round(CASE WHEN sigma_sentiment = 0 THEN 0 ELSE (sentiment_change - mu_sentiment) / sigma_sentiment END, 6) AS z_sentiment FROM p, f"""
)
def normalise_apply(spark, d):
    """Stored statistics on every row, excluded ones too."""
    df = label.temporal_split(label.through_sentiment(mentions_ev(spark, d)))
    df = df.drop("cut").crossJoin(F.broadcast(label.fit_stats(df)))
    z = lambda x, k: C.normalise(F.col(x), F.col(f"mu_{k}"), F.col(f"sigma_{k}"))
    return df.select("id", r6(z("posting_volume_growth", "volume"), "z_volume"), r6(z("sentiment_change", "sentiment"), "z_sentiment"))


@query(
    upto("f")
    + """SELECT id, round(0.7 * CASE WHEN sigma_volume = 0 THEN 0 ELSE (posting_volume_growth - mu_volume) / sigma_volume END
  + 0.3 * CASE WHEN sigma_sentiment = 0 THEN 0 ELSE (sentiment_change - mu_sentiment) / sigma_sentiment END, 6) AS composite FROM p, f"""
)
def composite_apply(spark, d):
    df = label.temporal_split(label.through_sentiment(mentions_ev(spark, d)))
    df = df.drop("cut").crossJoin(F.broadcast(label.fit_stats(df)))
    return df.select("id", r6(C.composite(F.col("posting_volume_growth"), F.col("sentiment_change"), {s: F.col(s) for s in label.STATS}, 0.7, 0.3), "composite"))


WORDS = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> ''))"
FEAT = f"""ft AS (SELECT *, CAST(hour(created) AS INT) AS hour_of_day, CAST(isodow(created) - 1 AS INT) AS day_of_week, CAST({WORDS.format("coalesce(title, '') || ' ' || coalesce(body, '')")} AS INT) AS word_count,
  CAST({WORDS.format("coalesce(title, '')")} AS INT) AS title_length, sentiment_polarity AS sentiment_score, backward_count AS entity_rate_24h, coalesce({GAP}, -1.0) AS time_since_previous,
  {ACC} AS acceleration_12h, CAST(1 AS BIGINT) AS entities_per_record FROM s),
fa AS (SELECT *, word_count * hour_of_day AS word_count_x_hour, acceleration_12h * greatest(time_since_previous, 0) AS accel_x_gap FROM ft)"""
FLOATS = ("sentiment_score", "time_since_previous", "acceleration_12h", "accel_x_gap")
ALL = ", ".join(f"round({f}, 6) AS {f}" if f in FLOATS else f for f in features.FEATURES)


def _features(spark, d):
    return features.features_all(label.through_sentiment(mentions_ev(spark, d), with_features=True))


@query(upto("s", FEAT) + f"SELECT id, {ALL} FROM fa")
def features_all(spark, d):
    return _features(spark, d).select("id", *[r6(f, f) if f in FLOATS else F.col(f) for f in features.FEATURES])


@query(upto("s", FEAT) + f"SELECT {ALL} FROM fa")
def feature_projection(spark, d):
    return features.feature_projection(_features(spark, d)).select(*[r6(f, f) if f in FLOATS else F.col(f) for f in features.FEATURES])


@query(upto("s", FEAT) + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg({f}), 6) AS mean, round(stddev_samp({f}), 6) AS std, round(min({f})::DOUBLE, 6) AS min, round(max({f})::DOUBLE, 6) AS max FROM fa WHERE NOT excluded" for f in features.FEATURES))
def feature_summary(spark, d):
    return features.feature_summary(_features(spark, d)).select("feature", *[r6(c, c) for c in ("mean", "std", "min", "max")])


@query(f"WITH {EV} SELECT id, t AS epoch FROM ev")
def epoch_seconds(spark, d):
    return mentions_ev(spark, d).select("id", F.col("t").alias("epoch"))


@query("SELECT event_id AS id, CAST(hour(ts) AS INT) AS hour_of_day FROM events")
def hour_of_day(spark, d):
    return mentions_ev(spark, d).select("id", C.hour_of_day(F.col("created")).alias("hour_of_day"))


@query("SELECT event_id AS id, CAST(isodow(ts) - 1 AS INT) AS day_of_week FROM events")
def day_of_week(spark, d):
    return mentions_ev(spark, d).select("id", C.day_of_week(F.col("created")).alias("day_of_week"))


@query(upto("s") + "SELECT id, sentiment_polarity AS sentiment_score FROM s")
def sentiment_score(spark, d):
    return label.through_sentiment(mentions_ev(spark, d)).select("id", F.col("sentiment_polarity").alias("sentiment_score"))


@query(upto("w") + "SELECT id, backward_count AS entity_rate_24h FROM w")
def entity_rate_24h(spark, d):
    return windows.window_counts(mentions_ev(spark, d)).select("id", F.col("backward_count").alias("entity_rate_24h"))


@query(upto("s", FEAT) + "SELECT id, word_count_x_hour FROM fa")
def word_count_x_hour(spark, d):
    m = mentions_ev(spark, d)
    return m.select("id", (C.word_count(F.col("title"), F.col("body")) * C.hour_of_day(F.col("created"))).alias("word_count_x_hour"))


@query(upto("s", FEAT) + "SELECT id, round(accel_x_gap, 6) AS accel_x_gap FROM fa")
def accel_x_gap(spark, d):
    m = label.through_sentiment(mentions_ev(spark, d), with_features=True)
    return m.select("id", r6(features.accel_x_gap(F.col("acceleration_12h"), F.col("time_since_previous")), "accel_x_gap"))


@query(upto("l") + "SELECT id, surge_label FROM l WHERE partition = 'test' AND NOT excluded")
def partition_filter(spark, d):
    return features.partition_filter(_labelled(spark, d), "test").select("id", "surge_label")


FOLDS = """n AS (SELECT *, row_number() OVER (ORDER BY t, id, entity) AS rn, count(*) OVER () AS total FROM {0}),
k AS (SELECT *, CAST(least((rn - 1) // (total // 4), 3) AS INT) AS fold FROM n)"""
SPLITS = "e AS (SELECT *, CASE WHEN fold = split THEN 'validate' ELSE 'train' END AS role FROM k, (VALUES (1), (2), (3)) v(split) WHERE fold <= split)"


@query(f"WITH {EV}, {FOLDS.format('ev')} SELECT id, fold FROM k")
def temporal_folds(spark, d):
    return model.temporal_folds(mentions_ev(spark, d)).select("id", "fold")


@query(f"WITH {ORD}, {FOLDS.format('od')} SELECT id, fold FROM k")
def temporal_folds_ties(spark, d):
    """Whole-day stamps: the order within a second decides."""
    return model.temporal_folds(mentions_ord(spark, d)).select("id", "fold")


@query(f"WITH {EV}, {FOLDS.format('ev')}, {SPLITS} SELECT id, split, role FROM e")
def expanding_splits(spark, d):
    return model.expanding_splits(model.temporal_folds(mentions_ev(spark, d))).select("id", "split", "role")


@query(
    f"WITH {EV}, {FOLDS.format('ev')}, {SPLITS} SELECT split, max(t) FILTER (WHERE role = 'train') AS last_train, min(t) FILTER (WHERE role = 'validate') AS first_validate,"
    " max(t) FILTER (WHERE role = 'train') <= min(t) FILTER (WHERE role = 'validate') AS ordered FROM e GROUP BY split"
)
def verify_temporal_order(spark, d):
    return model.temporal_order(model.expanding_splits(model.temporal_folds(mentions_ev(spark, d))))


@query(
    upto("l", "q AS (SELECT *, CAST(surge_label AS INT) AS y FROM l WHERE partition = 'train' AND NOT excluded)")
    + "SELECT id, round((SELECT count(*) FROM q) / (2.0 * greatest(count(*) OVER (PARTITION BY y), 1)), 6) AS weight FROM q"
)
def class_weights(spark, d):
    train = features.partition_filter(_labelled(spark, d), "train").withColumn("y", F.col("surge_label").cast("int"))
    return model.class_weights(train).select("id", r6("weight", "weight"))


@query(
    upto("s", FEAT, FOLDS.format("fa").replace("n AS", "nn AS").replace("FROM n)", "FROM nn)"))
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg({f}), 6) AS mean, round(stddev_samp({f}), 6) AS std FROM k WHERE fold < 3" for f in features.FEATURES)
)
def standard_scale(spark, d):
    """What the scaler of the last split is fitted on: its train part only."""
    df = model.temporal_folds(_features(spark, d)).where("fold < 3").drop("excluded")
    return features.feature_summary(df).select("feature", r6("mean", "mean"), r6("std", "std"))


@query(upto("s") + "SELECT id, row_number() OVER (ORDER BY t, id, entity) AS place FROM s")
def sort_chronological(spark, d):
    """The global order, as a place for each row."""
    out = model._ranked(mentions_ev(spark, d), F.col("t"))
    return out.select("id", (F.col("_rank") + 1).alias("place"))
