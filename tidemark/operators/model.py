"""Temporal cross-validation and training with Spark ML."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from math import gcd
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .evaluate import classification_metrics, optimal_threshold, roc_auc, threshold_curve
from ..sources.records import settle
from .features import FEATURES, partition_filter

FOLDS = 4
#: Levels of a tree without a limit: as many as Spark ML grows.
DEEPEST = 30


def temporal_folds(df: DataFrame, k: int = FOLDS, t: str = "t") -> DataFrame:
    """Adds fold: k blocks in order of time, of n // k rows each; the last takes the rest.

    The global rank comes from range partitions and their sizes, so no task orders all rows
    and a second with very many rows is no heavier than others."""
    ranked = _ranked(df, F.col(t))
    total = F.broadcast(ranked.agg(F.count("*").alias("_total")))
    block = F.greatest(F.floor(F.col("_total") / k), F.lit(1))
    fold = F.least(F.floor(F.col("_rank") / block), F.lit(k - 1)).cast("int")
    return ranked.crossJoin(total).withColumn("fold", fold).drop("_rank", "_total")


def expanding_splits(folded: DataFrame, k: int = FOLDS) -> DataFrame:
    """A row for each split that uses it: train for splits after its fold, validate for its own; splits are 1 .. k - 1."""
    each = folded.withColumn("split", F.explode(F.sequence(F.lit(1), F.lit(k - 1)))).where(F.col("fold") <= F.col("split"))
    return each.withColumn("role", F.when(F.col("fold") == F.col("split"), "validate").otherwise("train"))


def temporal_order(splits: DataFrame) -> DataFrame:
    """split, last_train, first_validate, ordered."""
    out = splits.groupBy("split").agg(F.max(F.when(F.col("role") == "train", F.col("t"))).alias("last_train"), F.min(F.when(F.col("role") == "validate", F.col("t"))).alias("first_validate"))
    return out.withColumn("ordered", F.col("last_train") <= F.col("first_validate"))


def verify_temporal_order(splits: DataFrame) -> None:
    if not temporal_order(splits).where("not ordered").isEmpty():
        raise ValueError("a split trains on rows later than those it validates on")


def class_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """Adds weight: n / (2 n_class), from one row of counts."""
    counts = F.broadcast(df.agg(F.count("*").alias("_n"), F.count_if(F.col(label) == 1).alias("_p")))
    own = F.when(F.col(label) == 1, F.col("_p")).otherwise(F.col("_n") - F.col("_p"))
    return df.crossJoin(counts).withColumn("weight", F.col("_n") / (2.0 * F.greatest(own, F.lit(1)))).drop("_n", "_p")


def grids(spark: SparkSession, ratio: float = 1.0) -> DataFrame:
    """model, place, params (JSON): every configuration that is tried, in order."""
    rows = [(kind, k, json.dumps(p, sort_keys=True)) for kind in ("logistic", "forest", "boosted") for k, p in enumerate(param_grid(kind, ratio))]
    return spark.createDataFrame(rows, "model string, place int, params string")


def param_grid(kind: str, ratio: float = 1.0) -> list[dict]:
    """The configurations tried for logistic, forest or boosted; the last grid ends after 50."""
    if kind == "logistic":
        return [{"C": c, "l1": l1} for c, l1 in product((0.01, 0.1, 1.0, 10.0, 100.0), (0.0, 1.0))]
    if kind == "forest":
        return [{"trees": n, "depth": d, "leaf": m} for n, d, m in product((50, 100, 200), (3, 5, 10, None), (1, 2, 5))]
    weights = list(dict.fromkeys((1.0, ratio / 2, ratio)))
    return [{"trees": n, "depth": d, "rate": r, "weight": w} for n, d, r, w in product((50, 100, 200), (3, 5, 7), (0.01, 0.1, 0.3), weights)][:50]


def estimator(kind: str, params: dict, n: int, seed: int = 42):
    own = {"featuresCol": "features", "labelCol": "y", "weightCol": "weight"}
    if kind == "logistic":
        return LogisticRegression(**own, elasticNetParam=params["l1"], regParam=1 / (params["C"] * max(n, 1)), maxIter=params.get("iter", 200))
    if kind == "forest":
        return RandomForestClassifier(**own, numTrees=params["trees"], maxDepth=params["depth"] or DEEPEST, minInstancesPerNode=params["leaf"], seed=seed, maxMemoryInMB=512, cacheNodeIds=True)
    return GBTClassifier(**own, maxIter=params["trees"], maxDepth=params["depth"], stepSize=params["rate"], seed=seed, checkpointInterval=-1)


def _pipeline(kind: str, params: dict, n: int, features: Sequence[str], seed: int) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True),
        estimator(kind, params, n, seed),
    ])


def _weighted(df: DataFrame, kind: str, params: dict) -> DataFrame:
    if kind == "boosted":
        return df.withColumn("weight", F.when(F.col("y") == 1, params["weight"]).otherwise(1.0))
    return class_weights(df)


def fit_one(kind: str, params: dict, train: DataFrame, features: Sequence[str] = FEATURES, seed: int = 42) -> PipelineModel:
    fitted = _pipeline(kind, params, train.count(), features, seed).fit(_weighted(train, kind, params))
    return _without_summary(train.sparkSession, fitted)


def _without_summary(spark: SparkSession, model: PipelineModel) -> PipelineModel:
    """The model without its training summary, as it is after saving and loading.

    A summary holds the session, which goes with the model into every task that scores, and which cannot be
    serialized once an ``Observation`` was taken or a job tag was set in it."""
    for stage in model.stages:
        if getattr(stage, "hasSummary", False):
            stage._java_obj.setSummary(spark._jvm.scala.Option.empty())
    return model


def _first_trees(model, n: int):
    """The ensemble of the first n trees of a fitted one, by Spark ML's own class, which scores the default columns:
    boosting adds its trees one by one, and those of a forest are drawn alike."""
    if n >= model.getNumTrees:
        return model
    own, context = model._java_obj, SparkContext._active_spark_context
    jvm, gateway = context._jvm, context._gateway
    boosted = isinstance(model, GBTClassificationModel)
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel if boosted else jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel, n)
    for i, tree in enumerate(own.trees()[:n]):
        trees[i] = tree
    if boosted:
        weights = gateway.new_array(jvm.double, n)
        for i, weight in enumerate(model.treeWeights[:n]):
            weights[i] = weight
        made = jvm.org.apache.spark.ml.classification.GBTClassificationModel(own.uid(), trees, weights)
    else:
        made = jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(own.uid(), trees, own.numFeatures(), own.numClasses())
    return type(model)(made)


def probability() -> Column:
    return vector_to_array("probability")[1]


def score(model: PipelineModel, df: DataFrame, *keep: str) -> DataFrame:
    return model.transform(df).select(*keep, "y", probability().alias("prob"))


@dataclass
class Trained:
    kind: str
    params: dict
    cv_auc: float
    fold_auc: list[float]
    tried: int
    seconds: float
    threshold: float
    model: PipelineModel


#: Rows of all splits on which tree configurations are compared, at most; the winner is fitted and measured on all rows.
SEARCH_ROWS = 200_000
#: Rows in a partition of the splits that configurations are fitted on.
PART_ROWS = 100_000


#: Trees of the first rungs of a search, and the part of the groups that each keeps (two at least).
RUNGS, KEPT = (5, 20), 4


def grid_search(kind: str, grid: list[dict], splits: DataFrame, k: int = FOLDS, features: Sequence[str] = FEATURES, seed: int = 42, parallelism: int = 8, search_rows: int = SEARCH_ROWS, rungs: Sequence[int] = RUNGS) -> tuple[dict, list[float]]:
    """The configuration with the best mean area over the splits (the first wins ties), and its areas.

    Configurations are fitted and measured by Spark ML on each split, ``parallelism`` fits at a time. Those of trees are compared by
    successive halving: all groups that differ in more than the number of trees are fitted with the first rung's trees, the best of them
    with the next rung's, and those that are left with each number of trees of the grid; ``rungs=()`` fits every configuration in full.
    Of more than ``search_rows`` rows tree configurations are compared on a sample of about as many, by a hash of the rows' keys; the
    winner's areas are those of fits on all rows. The same search over the same rows is done once a session."""
    own = ("search", kind, json.dumps(list(grid)), k, tuple(features), seed, search_rows, tuple(rungs))
    return _once(splits, ["split", "role", "id", "entity", "y", *features], own, lambda: _search(kind, grid, splits, k, features, seed, parallelism, search_rows, rungs))


def _search(kind: str, grid: list[dict], splits: DataFrame, k: int, features: Sequence[str], seed: int, parallelism: int, search_rows: int, rungs: Sequence[int]) -> tuple[dict, list[float]]:
    sample, left = splits, list(grid)
    if kind != "logistic":
        share = search_rows / max(1, splits.count())
        if share < 1:
            steps = 1 << 60
            sample = splits.where(F.pmod(F.xxhash64("id", "entity", F.lit(seed)), F.lit(steps)) < max(1, int(share * steps)))
        for trees in rungs:
            # groups in the grid's order: one configuration of each, with the rung's trees at most
            groups: dict[str, list[dict]] = {}
            for p in left:
                groups.setdefault(json.dumps(p | {"trees": 0}, sort_keys=True), []).append(p)
            tried = [own[0] | {"trees": min(trees, *(p["trees"] for p in own))} for own in groups.values()]
            keep = max(2, len(groups) // KEPT)
            if keep >= len(groups):
                continue
            areas = fold_areas(kind, tried, sample, k, features, seed, parallelism)
            best = sorted(range(len(tried)), key=lambda i: (-sum(areas[i]), i))[:keep]
            left = [p for i, own in enumerate(groups.values()) if i in best for p in own]
    scores = fold_areas(kind, left, sample, k, features, seed, parallelism)
    best = max(range(len(left)), key=lambda i: (sum(scores[i]), -i))
    if sample is not splits:
        scores[best] = fold_areas(kind, [left[best]], splits, k, features, seed, parallelism)[0]
    return left[best], scores[best]


#: What was found for rows of this session, by what was done and the rows' content; the oldest goes first.
_FOUND: dict[tuple, object] = {}
MOST_FOUND = 32


def _once(df: DataFrame, columns: Sequence[str], what: tuple, make):
    """What ``make`` gives, which is made once for the same rows: searches and fits take long, and the rows' hash takes one pass."""
    rows = tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)"))).first())
    key = (df.sparkSession.sparkContext.applicationId, *what, *rows)
    if key not in _FOUND:
        while len(_FOUND) >= MOST_FOUND:
            _FOUND.pop(next(iter(_FOUND)))
        _FOUND[key] = make()
    return _FOUND[key]


def fold_areas(kind: str, grid: Sequence[dict], splits: DataFrame, k: int = FOLDS, features: Sequence[str] = FEATURES, seed: int = 42, parallelism: int = 8) -> list[list[float]]:
    """For each configuration the area of its fit on each split; 0.5 where a split lacks a class.

    A split's rows are scaled and weighted once. Configurations that differ in the number of trees alone are one fit of the most trees,
    measured at each number: the first trees of a boosted fit are the fit of so many trees, those of a forest are one of its kind."""
    each = splits.select("split", "role", "y", *features).persist()
    counts = {r["split"]: r for r in each.groupBy("split").agg(*[F.count_if((F.col("role") == r) & (F.col("y") == y)).alias(f"{r}{y}") for r in ("train", "validate") for y in (0, 1)]).collect()}
    groups: dict[str, list[int]] = {}
    for p, params in enumerate(grid):
        groups.setdefault(json.dumps(params | {"trees": 0}, sort_keys=True), []).append(p)
    fits = [(i, own) for i in range(1, k) for own in groups.values() if i in counts and min(counts[i][c] for c in ("train0", "train1", "validate0", "validate1"))]
    most = lambda own: max((grid[p] for p in own), key=lambda params: params.get("trees", 1))
    # the dearest first, so that none is left over at the end
    fits.sort(key=lambda f: -most(f[1]).get("trees", 1) * ((most(f[1]).get("depth", 1) or DEEPEST) ** 2) * f[0])

    def prepare(i: int) -> tuple[DataFrame, DataFrame]:
        own = each.where(F.col("split") == i).coalesce(max(1, (counts[i]["train0"] + counts[i]["train1"]) // PART_ROWS))
        train, validate = (own.where(F.col("role") == r) for r in ("train", "validate"))
        scaled = Pipeline(stages=_pipeline(kind, grid[0], 1, features, seed).getStages()[:-1]).fit(train)
        train, validate = (scaled.transform(df).select("y", "features") for df in (train, validate))
        both = (train if kind == "boosted" else class_weights(train)).persist(), validate.persist()
        for df in both:
            df.count()
        return both

    def one(fit: tuple[int, list[int]]) -> list[float]:
        i, own = fit
        train, validate = parts[i]
        params, n = most(own), counts[i]["train0"] + counts[i]["train1"]
        fitted = estimator(kind, params, n, seed).fit(_weighted(train, kind, params) if kind == "boosted" else train)
        fitted = _without_summary(each.sparkSession, PipelineModel([fitted])).stages[0]
        stages = [fitted if kind == "logistic" else _first_trees(fitted, grid[p]["trees"]) for p in own]
        return [BinaryClassificationEvaluator(labelCol="y", numBins=0).evaluate(stage.transform(validate)) for stage in stages]

    scores = [[0.5] * (k - 1) for _ in grid]
    with ThreadPool(parallelism) as pool:
        usable = sorted({i for i, _ in fits})
        parts = dict(zip(usable, pool.map(prepare, usable), strict=True))
        each.unpersist()
        for (i, own), areas in zip(fits, pool.map(one, fits, chunksize=1), strict=True):
            for p, auc in zip(own, areas, strict=True):
                scores[p][i - 1] = auc
    for df in (df for both in parts.values() for df in both):
        df.unpersist()
    return scores


def train_all(df: DataFrame, kinds: Sequence[str] = ("logistic", "forest", "boosted"), grids: dict | None = None, features: Sequence[str] = FEATURES, k: int = FOLDS, seed: int = 42) -> list[Trained]:
    """df: labelled rows with partition, excluded, y and the features. Search, refit on all train rows, tune the threshold on the last fold."""
    train = settle(temporal_folds(partition_filter(df, "train"), k))
    splits = expanding_splits(train, k)
    verify_temporal_order(splits)
    sums = train.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
    out = []
    for kind in kinds:
        began = time.time()
        grid = (grids or {}).get(kind) or param_grid(kind, sums[0] / max(sums[1], 1))
        params, folds = grid_search(kind, grid, splits, k, features, seed)
        own = ("fit", kind, json.dumps(params), tuple(features), seed)
        model = _once(train, ["id", "entity", "y", *features], own, lambda kind=kind, params=params: fit_one(kind, params, train, features, seed))
        # settled, or the model would score a row again for each threshold
        curve = threshold_curve(settle(score(model, train.where(F.col("fold") == k - 1))))
        best = optimal_threshold(curve).first()
        out.append(Trained(kind, params, sum(folds) / len(folds), folds, len(grid), time.time() - began, best["threshold"], model))
    return out


def training_summary(spark: SparkSession, trained: Sequence[Trained]) -> DataFrame:
    rows = [(t.kind, json.dumps(t.params, sort_keys=True), float(t.cv_auc), [float(x) for x in t.fold_auc], t.tried, float(t.seconds), float(t.threshold)) for t in trained]
    return spark.createDataFrame(rows, "model string, params string, cv_auc double, fold_auc array<double>, configs_tried int, seconds double, threshold double")


def save(trained: Sequence[Trained], path: str) -> None:
    """Each model in a folder of its name, with a row of metadata."""
    for t in trained:
        t.model.write().overwrite().save(f"{path}/{t.kind}/model")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(t.kind, float(t.threshold))], "model string, threshold double").write.mode("overwrite").json(f"{path}/{t.kind}/meta")


def predict(trained: Trained, df: DataFrame, partition: str = "test", threshold: float = 0.5, *keep: str) -> DataFrame:
    out = score(trained.model, partition_filter(df, partition), "id", "entity", *keep)
    return out.withColumn("pred", (F.col("prob") >= threshold).cast("int"))


def cross_dataset_eval(spark: SparkSession, path: str, kinds: Sequence[str], df: DataFrame, partition: str | None = None) -> DataFrame:
    """Saved models, with their own scalers, on another dataset: area and metrics at 0.5 and at the tuned threshold."""
    rows = partition_filter(df, partition) if partition else df.where(~F.col("excluded"))
    out = None
    for kind in kinds:
        least = spark.read.schema("model string, threshold double").json(f"{path}/{kind}/meta").first()["threshold"]
        done = settle(score(PipelineModel.load(f"{path}/{kind}/model"), rows))
        own = roc_auc(done)
        for name, cut in (("default", 0.5), ("tuned", least)):
            m = classification_metrics(done, (F.col("prob") >= cut).cast("int")).select("precision", "recall", "f1").toDF(*[f"{name}_{c}" for c in ("precision", "recall", "f1")])
            own = own.crossJoin(m)
        own = own.select(F.lit(kind).alias("model"), "*")
        out = own if out is None else out.unionByName(own)
    return out


def builtin_importance(model: PipelineModel, features: Sequence[str] = FEATURES) -> list[tuple[str, float]]:
    """Tree importances; none for linear models."""
    last = model.stages[-1]
    return [(f, float(x)) for f, x in zip(features, last.featureImportances.toArray(), strict=True)] if hasattr(last, "featureImportances") else []


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str] = FEATURES, repeats: int = 10, seed: int = 42) -> DataFrame:
    """feature, importance (mean drop of the area), std over repeats.

    Rows are ranked once, by a hash. A repeat shuffles by arithmetic on ranks: row r takes the values of row a * r + c modulo n,
    a bijection where a and n have no common divisor, so that no repeat sorts anything."""
    rows = df.select("id", "entity", "y", *[F.col(f).cast("double").alias(f) for f in features])
    ranked = settle(_ranked(rows, F.xxhash64("id", "entity", F.lit(seed))))
    n = ranked.count()
    if not n:
        return df.sparkSession.createDataFrame([(f, 0.0, 0.0) for f in features], "feature string, importance double, std double")
    draws, keys = random.Random(seed), []
    while len(keys) < repeats:
        factor, shift = draws.randrange(1, 1 << 20), draws.randrange(n)
        if gcd(factor, n) == 1:
            keys.append(F.struct(F.lit(len(keys)).alias("repeat"), F.lit(factor).cast("long").alias("a"), F.lit(shift).cast("long").alias("c")))
    # a row is sent, with all its values, to the row that takes them in each repeat
    sent = ranked.select(F.struct(*features).alias("_other"), "_rank", F.explode(F.array(*keys)).alias("k"))
    sent = sent.select("_other", F.col("k.repeat").alias("repeat"), ((F.col("k.a") * F.col("_rank") + F.col("k.c")) % n).alias("_rank"))
    turns = F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1)))
    mixed = ranked.join(sent, "_rank").withColumn("f", turns).withColumns(
        {name: F.when(F.col("f") == f, F.col("_other")[name]).otherwise(F.col(name)) for f, name in enumerate(features)}
    )
    turn = (F.col("f") * repeats + F.col("repeat")).alias("turn")
    # settled, or the model would score the rows in each pass over them
    areas = roc_auc(settle(score(model, mixed.select("y", turn, *features), "turn")), "turn")
    base = F.broadcast(roc_auc(settle(score(model, ranked))).select(F.col("auc").alias("base")))
    names = F.array(*[F.lit(f) for f in features])
    drops = areas.crossJoin(base).select(F.get(names, F.floor(F.col("turn") / repeats).cast("int")).alias("feature"), (F.col("base") - F.col("auc")).alias("drop"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("std"))


def _ranked(df: DataFrame, by: Column) -> DataFrame:
    """Adds _rank, 0 .. n - 1 in order of ``by``: place in the range partition plus the sizes of those before."""
    placed = df.withColumn("_by", by).repartitionByRange("_by", "id", "entity").sortWithinPartitions("_by", "id", "entity")
    placed = settle(placed.withColumn("_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = F.broadcast(sizes.withColumn("_before", before))  # a row for each partition
    out = placed.withColumn("_part", F.shiftright("_at", 33)).join(sizes, "_part")
    return out.withColumn("_rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_by", "_at", "_part", "_n", "_before")
