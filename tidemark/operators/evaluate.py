"""Evaluation statistics as aggregates over (id, y, prob) or (id, model, y, prob).

Ranks and curves are taken over distinct scores: rows are counted by score first, so the
ordered step sees one row for each distinct score and not one for each prediction. Where
most scores are distinct, as with model probabilities, running sums are taken within range
partitions of group and score and the totals of earlier ones added, so no task orders a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import prefix_sums

TIERS = ((0.80, "stretch"), (0.70, "target"), (0.60, "minimum"))


def _div(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def confusion(pred: Column, y: Column = None) -> dict[str, Column]:
    y = F.col("y") if y is None else y
    cell = lambda a, b: F.count_if((y == a) & (pred == b))
    return {"tn": cell(0, 0), "fp": cell(0, 1), "fn": cell(1, 0), "tp": cell(1, 1)}


def with_scores(cells: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall, f1 (0 where undefined) to rows of tn, fp, fn, tp."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = _div(tp, tp + fp), _div(tp, tp + fn)
    return cells.withColumns({"accuracy": _div(tp + tn, tp + tn + fp + fn), "precision": p, "recall": r, "f1": _div(2.0 * tp, 2 * tp + fp + fn)})


def confusion_matrix(df: DataFrame, pred: Column, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(k) for k, c in confusion(pred).items()])


def with_shares(cells: DataFrame) -> DataFrame:
    """Adds each cell's share of all rows, in percent."""
    total = sum((F.col(c) for c in ("tn", "fp", "fn", "tp")), F.lit(0))
    return cells.withColumns({f"{c}_pct": F.when(total > 0, F.col(c) * 100.0 / total).otherwise(0.0) for c in ("tn", "fp", "fn", "tp")})


def classification_metrics(df: DataFrame, pred: Column, *by: str) -> DataFrame:
    out = with_scores(confusion_matrix(df, pred, *by))
    return out.withColumns({"support_0": F.col("tn") + F.col("fp"), "support_1": F.col("tp") + F.col("fn")})


def _by_score(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by, "prob").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))


def _before(steps: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds <column>_before: the sum over the rows of the group with a lower score; scores are distinct within a group."""
    return prefix_sums(steps, by, ["prob"], columns)


def roc_auc(df: DataFrame, *by: str) -> DataFrame:
    """Exact area with ties averaged (Mann-Whitney); 0.5 where a class is missing."""
    pairs = _before(_by_score(df, *by), by, ["neg"]).withColumn("wins", F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    total = F.sum("pos") * F.sum("neg")
    return pairs.groupBy(*by).agg(F.when(total == 0, 0.5).otherwise(F.sum("wins") / total).alias("auc"))


def roc_curve(df: DataFrame, *by: str) -> DataFrame:
    """(threshold, fpr, tpr) for each distinct score, from the highest."""
    steps = _before(_by_score(df, *by), by, ["neg", "pos"])
    whole = steps.groupBy(*by).agg(F.sum("neg").alias("_neg"), F.sum("pos").alias("_pos"))
    both = steps.join(whole, list(by)) if by else steps.crossJoin(F.broadcast(whole))
    rate = lambda c: _div(F.col(f"_{c}") - F.col(f"{c}_before"), F.col(f"_{c}"))
    return both.select(*by, F.col("prob").alias("threshold"), rate("neg").alias("fpr"), rate("pos").alias("tpr"))


def threshold_curve(df: DataFrame, *by: str, steps: int = 100) -> DataFrame:
    """precision, recall and F1 at i / steps, i = 1 .. steps - 1.

    Rows are counted by the number of thresholds that they reach; each threshold then sums
    the few counts at and above it."""
    # i/steps are compared as doubles, exactly as a row-wise comparison would
    reached = F.size(F.filter(F.array(*[F.lit(i / steps) for i in range(1, steps)]), lambda t: F.col("prob") >= t))
    bins = df.groupBy(*by, reached.alias("k")).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    each = bins.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(steps - 1))))
    up = F.col("k") >= F.col("i")
    cells = each.groupBy(*by, "i").agg(
        F.sum(F.when(up, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(up, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~up, F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.when(~up, F.col("neg")).otherwise(0)).alias("tn"),
    )
    return with_scores(cells).withColumn("threshold", F.col("i") / float(steps)).drop("i")


def optimal_threshold(curve: DataFrame, *by: str, strategy: str = "max_f1", floor: float = 0.10) -> DataFrame:
    """The row with the best F1, the lowest threshold winning ties; ``precision_floor`` prefers rows at or above the floor."""
    first = [F.desc(F.col("precision") >= floor)] if strategy == "precision_floor" else []
    w = Window.partitionBy(*by).orderBy(*first, F.desc(F.round("f1", 12)), "threshold")
    return curve.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def tuned_vs_default(df: DataFrame, *by: str) -> DataFrame:
    """Metrics at 0.5 and at the tuned threshold, and the gain in F1."""
    curve = threshold_curve(df, *by)
    names = ["threshold", "precision", "recall", "f1"]
    tuned = optimal_threshold(curve, *by).select(*by, *[F.col(n).alias(f"tuned_{n}") for n in names])
    default = curve.where("threshold = 0.5").select(*by, *[F.col(n).alias(f"default_{n}") for n in names[1:]])
    both = tuned.join(default, list(by)) if by else tuned.crossJoin(default)
    return both.withColumn("f1_gain", F.col("tuned_f1") - F.col("default_f1"))


def mcnemar(predictions: DataFrame, alpha: float = 0.05) -> DataFrame:
    """predictions: (id, model, y, pred). Every pair of models by name: b, c, statistic, p, significance after Bonferroni.

    A record's models are gathered into one array, so that pairs need no self-join."""
    right = F.array_sort(F.collect_set(F.struct("model", (F.col("pred") == F.col("y")).alias("right"))))
    rows = predictions.groupBy("id").agg(right.alias("m"))
    pairs = rows.select(F.explode(F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b["model"] > a["model"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    out = pairs.groupBy(F.col("p.a.model").alias("model_a"), F.col("p.b.model").alias("model_b")).agg(
        F.count_if(F.col("p.a.right") & ~F.col("p.b.right")).alias("b"), F.count_if(~F.col("p.a.right") & F.col("p.b.right")).alias("c")
    )
    b, c = F.col("b").cast("double"), F.col("c").cast("double")
    n = b + c
    out = out.withColumn("statistic", F.when(n == 0, 0.0).otherwise((b - c) * (b - c) / n))
    # two-sided binomial for few, else the chi-square tail with one degree of freedom
    low, size = F.least("b", "c").cast("int"), (F.col("b") + F.col("c")).cast("int")
    choose = lambda k: F.factorial(size) / (F.factorial(k) * F.factorial(size - k))
    tail = F.aggregate(F.sequence(F.lit(0), low), F.lit(0.0), lambda s, k: s + choose(k))
    exact = F.least(F.lit(1.0), 2.0 * tail / F.pow(F.lit(2.0), size))
    # F.factorial is defined up to 20; larger sizes below 25 take the same sum by products
    exact = F.when(size <= 20, exact).otherwise(F.least(F.lit(1.0), 2.0 * _binomial_tail(low, size) / F.pow(F.lit(2.0), size)))
    out = out.withColumn("p_value", F.when(n == 0, 1.0).when(n < 25, exact).otherwise(_erfc(F.sqrt(F.col("statistic") / 2))))
    pairs_count = F.count("*").over(Window.partitionBy(F.lit(0)))  # a row for each pair of models
    return out.withColumn("corrected_alpha", F.lit(alpha) / pairs_count).withColumn("significant", F.col("p_value") < F.col("corrected_alpha"))


def _binomial_tail(low: Column, size: Column) -> Column:
    """Sum of C(size, k) for k = 0 .. low."""
    start = F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("s"))
    step = lambda acc, k: F.struct((acc["c"] * (size - k) / (k + 1)).alias("c"), (acc["s"] + acc["c"]).alias("s"))
    return F.aggregate(F.sequence(F.lit(0), low), start, step, lambda acc: acc["s"])


#: Published coefficients of the Chebyshev fit of log(erfc), from the constant on (Press et al., Numerical Recipes, erfcc).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, with a relative error below 1.2e-7 however small it gets."""
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(0.0)
    for c in reversed(ERFC):
        poly = poly * t + c
    return t * F.exp(poly - x * x)


def single_feature_auc(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, auc: a one-feature linear model ranks by the feature, upward where it rises with the class in training.

    df has partition, y and the features; the direction comes from train rows, the area from test rows."""
    long = df.select("partition", "y", *[F.col(f).cast("double").alias(f) for f in features]).unpivot(["partition", "y"], list(features), "feature", "prob")
    slope = long.where("partition = 'train'").groupBy("feature").agg((F.avg(F.when(F.col("y") == 1, F.col("prob"))) - F.avg(F.when(F.col("y") == 0, F.col("prob")))).alias("rise"))
    auc = roc_auc(long.where("partition = 'test'"), "feature")
    return auc.join(slope, "feature").select("feature", F.when(F.col("rise") < 0, 1 - F.col("auc")).otherwise(F.col("auc")).alias("auc"))


def baseline_comparison(baselines: DataFrame, models: DataFrame) -> DataFrame:
    """model, auc, best_feature, best_auc, improvement, beats_best, beats_chance, from (feature, auc) and (model, auc): each model
    against the best single feature (ties: the first by name) and against 0.5."""
    best = baselines.agg(F.min_by("feature", F.struct(-F.col("auc"), F.col("feature"))).alias("best_feature"), F.max("auc").alias("best_auc"))
    both = models.select("model", "auc").crossJoin(F.broadcast(best))  # one row
    return both.withColumns({"improvement": F.col("auc") - F.col("best_auc"), "beats_best": F.col("auc") > F.col("best_auc"), "beats_chance": F.col("auc") > 0.5})


def tier(auc: Column) -> Column:
    out = F.lit("below")
    for least, name in reversed(TIERS):
        out = F.when(auc > least, name).otherwise(out)
    return out


#: Upper bounds of a uniform number for 0, 1, .. 5 draws of a Poisson variable of mean 1; beyond the last are 6.
POISSON_ONE = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)
#: Rows whose weights a task holds at a time.
BLOCK = 256
CELLS = ("pos", "neg", "tp", "fp", "wins")


def poisson_weights(ids: Sequence[str], resamples: int, seed: int) -> np.ndarray:
    """A row for each id: its weight in each resample.

    Weights come from 16 bits each of an MD5 of id, block and seed, a block being eight resamples."""
    table = sum(np.arange(1 << 16) / 65536.0 >= b for b in POISSON_ONE).astype(np.int64)
    tails = [f":{k}:{seed}".encode() for k in range((resamples + 7) // 8)]
    draws = b"".join(hashlib.md5(i + tail, usedforsecurity=False).digest() for i in (x.encode() for x in ids) for tail in tails)
    return table[np.frombuffer(draws, ">u2").reshape(len(ids), -1)[:, :resamples]]


class ResampleSums:
    """Weighted counts of a stretch of rows that come in order of score, for all resamples at once.

    ``pos``, ``neg``, ``tp`` and ``fp`` are weights; ``wins`` counts positives above negatives, ties for half. The first and the last
    score are kept apart, for their rows may go on in another stretch; what lies between is one sum."""

    def __init__(self, resamples: int, threshold: float):
        self.zero, self.threshold = np.zeros(resamples, dtype=np.int64), threshold
        self.ties: list[list] = []  # score, pos, neg of the first and the last score
        self.inner: dict[str, np.ndarray] | None = None

    def add(self, score: float, pos: np.ndarray, neg: np.ndarray) -> None:
        if self.ties and self.ties[-1][0] == score:
            self.ties[-1][1:] = [self.ties[-1][1] + pos, self.ties[-1][2] + neg]
            return
        self.ties.append([score, pos, neg])
        if len(self.ties) == 3:
            score, pos, neg = self.ties.pop(1)
            now = self.inner or {c: self.zero for c in CELLS}
            up = score >= self.threshold
            self.inner = {
                "wins": now["wins"] + 2 * pos * now["neg"] + pos * neg,  # of half wins
                "pos": now["pos"] + pos, "neg": now["neg"] + neg, "tp": now["tp"] + pos * up, "fp": now["fp"] + neg * up,
            }

    def parts(self) -> Iterator[tuple[float, int, dict[str, np.ndarray]]]:
        """(score, place, cells): place 0 is the score's own rows, 1 what lies between it and the last score."""
        for score, pos, neg in self.ties:
            up = score >= self.threshold
            yield score, 0, {"pos": pos, "neg": neg, "tp": pos * up, "fp": neg * up, "wins": self.zero}
        if self.inner:
            yield self.ties[0][0], 1, self.inner


def bootstrap(df: DataFrame, resamples: int = 1000, seed: int = 42, threshold: float = 0.5) -> DataFrame:
    """b, precision, recall, f1, auc of each Poisson resample.

    Rows are range-partitioned by score once. A task draws its rows' weights as vectors and emits, for each resample,
    the sums of its first score, of its last and of what lies between; these few rows are combined in order of score.
    A score with very many rows is dealt to several tasks, and its sums meet again. Null scores and classes are left out."""
    rows = df.where(F.col("prob").isNotNull() & F.col("y").isNotNull()).select(F.col("prob").cast("double").alias("prob"), (F.col("y") == 1).alias("y"), F.col("id").cast("string").alias("id"))
    rows = rows.select("prob", "y", F.coalesce("id", F.lit("")).alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = ResampleSums(resamples, threshold)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                block = whole.slice(at, BLOCK)
                score, y = block.column(0).to_pylist(), block.column(1).to_numpy(zero_copy_only=False)
                weights = poisson_weights(block.column(2).to_pylist(), resamples, seed)
                for s, own in groupby(range(len(score)), key=score.__getitem__):
                    own = list(own)
                    up = weights[own][y[own]].sum(axis=0)
                    sums.add(s, up, weights[own].sum(axis=0) - up)
        b = pa.array(np.arange(1, resamples + 1, dtype=np.int32))
        for score, place, cells in sums.parts():
            fixed = [b, pa.array(np.full(resamples, score)), pa.array(np.full(resamples, place, dtype=np.int32))]
            yield pa.RecordBatch.from_arrays([*fixed, *[pa.array(cells[c]) for c in CELLS]], names=["b", "score", "place", *CELLS])

    placed = rows.repartitionByRange("prob", F.xxhash64("id")).sortWithinPartitions("prob")
    parts = placed.mapInArrow(run, "b int, score double, place int, " + ", ".join(f"{c} long" for c in CELLS))
    parts = parts.groupBy("b", "score", "place").agg(*[F.sum(c).alias(c) for c in CELLS])
    lower = F.coalesce(F.sum("neg").over(Window.partitionBy("b").orderBy("score", "place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ties = F.when(F.col("place") == 0, F.col("pos") * F.col("neg")).otherwise(0)
    parts = parts.select("b", *CELLS[:-1], ((2 * F.col("pos") * lower + ties + F.col("wins")) / 2.0).alias("wins"))
    cells = parts.groupBy("b").agg(*[F.sum(c).alias(c) for c in CELLS])
    cells = cells.withColumns({"fn": F.col("pos") - F.col("tp"), "tn": F.col("neg") - F.col("fp")})
    one = (F.col("pos") == 0) | (F.col("neg") == 0)
    out = with_scores(cells).withColumn("auc", F.when(one, 0.5).otherwise(F.col("wins") / (F.col("pos") * F.col("neg"))))
    return out.select("b", *[F.when(one, 0.0).otherwise(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "auc")


def bootstrap_ci(df: DataFrame, resamples: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """metric, low, high: the percentile interval of the resamples."""
    long = bootstrap(df, resamples, seed).unpivot(["b"], ["precision", "recall", "f1", "auc"], "metric", "value")
    half = (1 - level) / 2
    return long.groupBy("metric").agg(F.percentile("value", F.lit(half)).alias("low"), F.percentile("value", F.lit(1 - half)).alias("high"))


def importance_rank(df: DataFrame, *by: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("importance"), "feature")))


def best_model_summary(metrics: DataFrame, tau: float = 1.5, weight_sentiment: float = 0.5, tests: DataFrame | None = None, baselines: DataFrame | None = None) -> DataFrame:
    """One row from (model, auc): the best, its tier, whether any reaches the minimum, the recommended settings, and what it rests on,
    nested: models (model, auc, tier), tests (of ``mcnemar``) and baselines (of ``baseline_comparison``), each in order of model."""
    nested = lambda df, *columns: df.agg(F.sort_array(F.collect_list(F.struct(*columns))))  # noqa: E731  (a row for each model or pair)
    best = metrics.agg(F.max_by("model", F.struct("auc", F.col("model"))).alias("best_model"), F.max("auc").alias("best_auc"), F.max((F.col("auc") > TIERS[-1][0]).cast("int")).alias("any_minimum"))
    best = best.withColumns({"tier": tier(F.col("best_auc")), "recommended_tau": F.lit(tau), "recommended_weight_sentiment": F.lit(weight_sentiment)})
    best = best.crossJoin(nested(metrics, "model", "auc", tier(F.col("auc")).alias("tier")).toDF("models"))
    if tests is not None:
        best = best.crossJoin(nested(tests, *tests.columns).toDF("tests"))
    if baselines is not None:
        best = best.crossJoin(nested(baselines, *baselines.columns).toDF("baselines"))
    return best


def prediction_examples(df: DataFrame, n: int = 5, threshold: float = 0.5, context: Sequence[str] = ()) -> DataFrame:
    """The n most telling rows of each outcome: TP and FP by falling, FN and TN by rising probability; ``outcome_count`` is the number of
    rows with that outcome, ``context`` columns and probabilities have four digits.

    Each task keeps n rows of an outcome at most before any meet."""
    up = F.col("prob") >= threshold
    outcome = F.when((F.col("y") == 1) & up, "TP").when((F.col("y") == 0) & up, "FP").when(F.col("y") == 1, "FN").otherwise("TN")
    df = df.withColumn("outcome", outcome)
    counts = F.broadcast(df.groupBy("outcome").agg(F.count("*").alias("outcome_count")))  # four rows
    w = Window.partitionBy("outcome").orderBy(F.when(up, -F.col("prob")).otherwise(F.col("prob")), "id")
    best = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).join(counts, "outcome")
    return best.withColumns({c: F.round(c, 4) for c in ("prob", *context)})
