"""Queries: models by Spark ML, files and run logs. Trained results have no SQL; their rows are checked by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, features, label, model
from ..sources import records
from .tables import mentions_ev, mentions_ord, query, r6, table, upto

#: The configuration that ``refit_best`` refits without a search.
FIXED = {"C": 0.1, "l1": 0.0, "iter": 20}


def _labelled(mentions):
    """Labelled rows with features; the threshold makes both classes common."""
    df = features.features_all(label.apply_labelling(label.through_sentiment(mentions, with_features=True), tau=0.5))
    return records.settle(df.withColumn("y", F.col("surge_label").cast("int")))


def _dataset(spark, d):
    return _labelled(mentions_ev(spark, d))


def _other_dataset(spark, d):
    """Orders as mentions of their priority: another dataset, with statistics and labels of its own."""
    status = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("title"), F.lit("").alias("body"))
    return _labelled(mentions_ord(spark, d).join(status, "id"))


_folder = records.new_folder


def _train(spark, d, *kinds):
    df = _dataset(spark, d)
    return df, model.train_all(df, kinds)


GRIDS = """rt AS (SELECT count(*) FILTER (WHERE composite <= 0.5) / greatest(count(*) FILTER (WHERE composite > 0.5), 1) AS ratio FROM z WHERE partition = 'train' AND NOT excluded),
wt AS (SELECT row_number() OVER (ORDER BY k) - 1 AS k, count(*) OVER () AS n, weight FROM (SELECT min(k) AS k, weight FROM (SELECT 0 AS k, 1.0::DOUBLE AS weight UNION ALL SELECT 1, ratio / 2 FROM rt UNION ALL SELECT 2, ratio FROM rt) GROUP BY weight)),
lo AS (SELECT 'logistic' AS model, i * 2 + j AS place, C, l1, NULL AS trees, NULL AS depth, NULL AS leaf, NULL::DOUBLE AS rate, NULL::DOUBLE AS weight
  FROM (VALUES (0, 0.01::DOUBLE), (1, 0.1), (2, 1.0), (3, 10.0), (4, 100.0)) a(i, C), (VALUES (0, 0.0::DOUBLE), (1, 1.0)) b(j, l1)),
fo AS (SELECT 'forest', (i * 4 + j) * 3 + k, NULL, NULL, trees, depth, leaf, NULL, NULL FROM (VALUES (0, 50), (1, 100), (2, 200)) a(i, trees), (VALUES (0, 3), (1, 5), (2, 10), (3, NULL)) b(j, depth), (VALUES (0, 1), (1, 2), (2, 5)) c(k, leaf)),
bo AS (SELECT 'boosted', ((i * 3 + j) * 3 + r) * n + k AS at, NULL, NULL, trees, depth, NULL, rate, round(weight, 9)
  FROM (VALUES (0, 50), (1, 100), (2, 200)) a(i, trees), (VALUES (0, 3), (1, 5), (2, 7)) b(j, depth), (VALUES (0, 0.01::DOUBLE), (1, 0.1), (2, 0.3)) c(r, rate), wt WHERE ((i * 3 + j) * 3 + r) * n + k < 50)"""


@query(upto("z", GRIDS) + "SELECT * FROM lo UNION ALL SELECT * FROM fo UNION ALL SELECT * FROM bo")
def param_grids(spark, d):
    """The configurations of each model; the boosted ones' weights follow the classes of the training rows."""
    y = features.partition_filter(_dataset(spark, d), "train").agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
    p = F.from_json("params", "C double, l1 double, trees int, depth int, leaf int, rate double, weight double").alias("p")
    return model.grids(spark, y[0] / max(y[1], 1)).select("model", "place", p).select("model", "place", "p.*").withColumn("weight", F.round("weight", 9))


@query()
def train_logistic(spark, d):
    df, (t,) = _train(spark, d, "logistic")
    return model.predict(t, df)


@query()
def train_forest(spark, d):
    df, (t,) = _train(spark, d, "forest")
    return model.predict(t, df)


@query()
def train_boosted(spark, d):
    df, (t,) = _train(spark, d, "boosted")
    return model.predict(t, df)


@query()
def training_summary(spark, d):
    _, trained = _train(spark, d, "logistic", "forest")
    return model.training_summary(spark, trained).drop("seconds")


@query()
def grid_search_temporal(spark, d):
    df = model.temporal_folds(features.partition_filter(_dataset(spark, d), "train"))
    params, scores = model.grid_search("logistic", model.param_grid("logistic"), model.expanding_splits(df))
    return spark.createDataFrame([(params["C"], params["l1"], [float(x) for x in scores])], "C double, l1 double, fold_auc array<double>")


@query()
def cross_dataset_eval(spark, d):
    """Models of the events, saved, loaded and scored on the orders."""
    _, trained = _train(spark, d, "logistic", "boosted")
    path = _folder(spark)
    model.save(trained, path)
    return model.cross_dataset_eval(spark, path, ["logistic", "boosted"], _other_dataset(spark, d), "test")


@query()
def builtin_importance(spark, d):
    _, (t,) = _train(spark, d, "forest")
    return evaluate.importance_rank(spark.createDataFrame(model.builtin_importance(t.model), "feature string, importance double"))


@query()
def permutation_importance(spark, d):
    df, (t,) = _train(spark, d, "forest")
    test = features.partition_filter(df, "test")
    return evaluate.importance_rank(model.permutation_importance(t.model, test, features.FEATURES, repeats=10))


@query(upto("l") + "SELECT id, entity, partition, surge_label FROM l")
def write_labelled(spark, d):
    path = _folder(spark)
    records.write_labelled(label.label_pipeline(mentions_ev(spark, d)), path)
    return spark.read.parquet(path).select("id", "entity", "partition", "surge_label")


@query(upto("f") + "SELECT round(mu_volume, 6) AS mu_volume, round(sigma_volume, 6) AS sigma_volume, round(mu_sentiment, 6) AS mu_sentiment, round(sigma_sentiment, 6) AS sigma_sentiment FROM f")
def load_fit_stats(spark, d):
    """Saved as the JSON summary and read back."""
    path = _folder(spark)
    split = label.temporal_split(label.through_sentiment(mentions_ev(spark, d)))
    records.write_summary(label.fit_stats(split), path)
    return records.load_fit_stats(spark, path).select(*[r6(c, c) for c in label.STATS])


@query(
    upto("z")
    + """SELECT threshold, surge_count, no_surge_count, surge_count + no_surge_count AS total, round(CASE WHEN surge_count + no_surge_count = 0 THEN 0 ELSE surge_count * 100.0 / (surge_count + no_surge_count) END, 6) AS surge_rate,
  round(CASE WHEN surge_count + no_surge_count = 0 THEN 0 WHEN surge_count = 0 THEN 'Infinity'::DOUBLE ELSE no_surge_count / surge_count END, 6) AS imbalance_ratio,
  CASE WHEN surge_count + no_surge_count = 0 THEN false ELSE surge_count * 100.0 / (surge_count + no_surge_count) BETWEEN 5 AND 10 END AS viable
FROM (SELECT threshold, count(*) FILTER (WHERE composite > threshold) AS surge_count, count(*) FILTER (WHERE composite <= threshold) AS no_surge_count
  FROM z, (VALUES (0.5::DOUBLE), (1.0), (1.5), (2.0), (2.5)) v(threshold) GROUP BY threshold)"""
)
def write_sweep(spark, d):
    path = _folder(spark)
    records.write_sweep(label.sweep_pipeline(mentions_ev(spark, d)), path)
    back = spark.read.option("header", True).schema("threshold double, surge_count long, no_surge_count long, total long, surge_rate double, imbalance_ratio double, viable boolean").csv(path)
    return back.withColumns({c: F.round(c, 6) for c in ("surge_rate", "imbalance_ratio")})


@query("SELECT 'labelling' AS pipeline, CAST(count(*) AS VARCHAR) AS n_rows FROM events")
def run_log_query(spark, d):
    """A run's record is appended to the log, and the log is read as a table."""
    path = _folder(spark)
    n = table(spark, d, "events").count()
    records.append_run(spark, path, run_id="1", pipeline="labelling", timestamp="2024-01-01T00:00:00", git_sha="", config={"tau": 1.5}, outputs=["labelled"], summary={"n_rows": n}, notes=None)
    return records.read_runs(spark, path).select("pipeline", F.col("summary")["n_rows"].alias("n_rows"))


@query("""SELECT event_id AS id, event_type AS title, 'a "b"' || chr(10) || ', ' || props AS selftext FROM events""")
def load_records(spark, d):
    """Events written as CSV with quoted fields, read by the loader and converted to Parquet once."""
    path = _folder(spark)
    table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("title"), F.concat(F.lit('a "b"\n, '), "props").alias("selftext")).write.option("header", True).option("escape", '"').csv(path)
    df = records.load_records(spark, path, "id long, title string, selftext string", parquet=f"{_folder(spark)}.parquet")
    return df.select("id", "title", "selftext")


@query()
def train_single_lr(spark, d):
    """The logistic model alone, by its own entry point: best configuration, refit on all training rows."""
    _, (t,) = _train(spark, d, "logistic")
    return model.training_summary(spark, [t]).drop("seconds")


@query()
def refit_best(spark, d):
    """A fixed configuration refitted on all training rows; the last fold scored for threshold tuning, and the threshold."""
    train = records.settle(model.temporal_folds(features.partition_filter(_dataset(spark, d), "train")))
    done = model.score(model.fit_one("logistic", FIXED, train), train.where(F.col("fold") == model.FOLDS - 1))
    return evaluate.optimal_threshold(evaluate.threshold_curve(done))


@query()
def train_all(spark, d):
    """Three models trained, saved with their thresholds, and the saved metadata read back."""
    _, trained = _train(spark, d, "logistic", "forest", "boosted")
    path = _folder(spark)
    model.save(trained, path)
    return spark.read.schema("model string, threshold double").json(f"{path}/*/meta")


@query()
def predict(spark, d):
    """y, pred and prob on the test part at the tuned threshold."""
    df, (t,) = _train(spark, d, "forest")
    return model.predict(t, df, "test", t.threshold)


@query("SELECT count(*) AS n_runs, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT count(*) AS n FROM events UNION ALL SELECT count(*) FROM orders)")
def run_log_append(spark, d):
    """Two runs appended one after the other."""
    path = _folder(spark)
    for k, name in enumerate(("events", "orders")):
        n = table(spark, d, name).count()
        records.append_run(spark, path, run_id=str(k), pipeline=name, timestamp="", git_sha="", config={}, outputs=[], summary={"n_rows": n}, notes=None)
    return records.read_runs(spark, path).agg(F.count("*").alias("n_runs"), F.sum(F.col("summary")["n_rows"].cast("long")).alias("n_rows"))


@query("SELECT true AS ordered, count(*) AS n_rows FROM events")
def check_chronological(spark, d):
    """Rows in order of the global rank never step back in time: the largest second of each rank block is at most the next one's smallest."""
    ranked = model._ranked(mentions_ev(spark, d), F.col("t"))
    blocks = ranked.groupBy(F.floor(F.col("_rank") / 100_000).alias("b")).agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n"))
    from pyspark.sql import Window

    after = F.lead("lo").over(Window.orderBy("b"))  # a row for each 100,000
    return blocks.withColumn("fine", F.coalesce(F.col("hi") <= after, F.lit(True))).agg(F.min("fine").alias("ordered"), F.sum("n").alias("n_rows"))


@query("SELECT 'ts' AS date, 'none' AS sentiment, 'value' AS engagement, count(*) AS n_rows FROM events")
def detect_columns(spark, d):
    from ..operators.assess import detect_columns as detect

    df = table(spark, d, "events")
    found = detect(df)
    return df.agg(F.lit(found["date"]).alias("date"), F.lit(found["sentiment"] or "none").alias("sentiment"), F.lit(",".join(found["engagement"])).alias("engagement"), F.count("*").alias("n_rows"))


@query("SELECT count(*) AS n_rows FROM events")
def require_columns(spark, d):
    """A stage that lacks a column says so before any work; one that has all goes on."""
    from ..functions.columns import require_columns as require

    df = table(spark, d, "events")
    try:
        require(df, "event_id", "no_such_column", stage="a stage")
    except ValueError:
        return require(df, "event_id", "ts").agg(F.count("*").alias("n_rows"))
    raise AssertionError("a lacking column went unnoticed")
