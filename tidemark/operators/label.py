"""Split by time, train-only standardisation, composite score, burst label, threshold sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import composite, normalise, require_columns
from ..sources.records import settle
from . import windows

TAUS = (0.5, 1.0, 1.5, 2.0, 2.5)
STATS = ("mu_volume", "sigma_volume", "mu_sentiment", "sigma_sentiment")


def split_point(df: DataFrame, ratio: float = 0.8, exact: bool = True) -> DataFrame:
    """One row ``cut``: the interpolated percentile of t over all rows, excluded ones too.

    Days are counted first; only the seconds of the one or two days that hold the two rows
    around the percentile are ordered. ``exact=False`` uses the bounded sketch instead.
    """
    if not exact:
        return df.agg(F.percentile_approx("t", ratio, 100_000).cast("double").alias("cut"))
    day = F.floor(F.col("t") / windows.DAY).alias("day")
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seconds = df.where(F.col("t").isNotNull()).groupBy("t").agg(F.count("*").alias("n"))
    days = seconds.groupBy(day).agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    days = days.select("day", upto(Window.orderBy("day")).alias("before"), (F.lit(ratio) * (total - 1)).alias("place"), (upto(Window.orderBy("day")) + F.col("n")).alias("after"))
    wanted = F.broadcast(days.where((F.col("before") <= F.ceil("place")) & (F.floor("place") < F.col("after"))).select("day", "before", "place"))  # two rows
    rows = seconds.withColumn("day", day).join(wanted, "day")
    first = F.col("before") + upto(Window.partitionBy("day").orderBy("t"))
    rows = rows.select("t", "n", "place", first.alias("first"))
    at = lambda k: F.max(F.when((F.col("first") <= k) & (k < F.col("first") + F.col("n")), F.col("t")))
    both = rows.agg(at(F.floor("place")).alias("lo"), at(F.ceil("place")).alias("hi"), F.max("place").alias("place"))
    return both.select((F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("place") - F.floor("place"))).cast("double").alias("cut"))


def temporal_split(df: DataFrame, ratio: float = 0.8, exact: bool = True) -> DataFrame:
    """Adds partition: train up to and including the cut, else test. The cut is one row."""
    cut = F.broadcast(split_point(df, ratio, exact))
    return df.crossJoin(cut).withColumn("partition", F.when(F.col("t") <= F.col("cut"), "train").otherwise("test"))


def fit_stats(split: DataFrame) -> DataFrame:
    """One row: means and population deviations on included train rows, sizes, cut."""
    used = (F.col("partition") == "train") & ~F.col("excluded")
    x, y = F.when(used, F.col("posting_volume_growth")), F.when(used, F.col("sentiment_change"))
    return split.agg(
        F.coalesce(F.avg(x), F.lit(0.0)).alias("mu_volume"),
        F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("sigma_volume"),
        F.coalesce(F.avg(y), F.lit(0.0)).alias("mu_sentiment"),
        F.coalesce(F.stddev_pop(y), F.lit(0.0)).alias("sigma_sentiment"),
        F.count_if(used).alias("train_size"),
        F.count_if((F.col("partition") == "test") & ~F.col("excluded")).alias("test_size"),
        F.max("cut").alias("cut"),
    )


def scored(split: DataFrame, stats: DataFrame, weight_volume: float = 0.5, weight_sentiment: float = 0.5) -> DataFrame:
    """Adds z_volume, z_sentiment, composite: null for excluded rows, and everywhere without an included train row.

    Null and never NaN: NaN compares greater than any threshold."""
    df = split.drop("cut").crossJoin(F.broadcast(stats.select(*STATS, "train_size")))
    counts = ~F.col("excluded") & (F.col("train_size") > 0)
    own = {s: F.col(s) for s in STATS}
    z = {
        "z_volume": normalise(F.col("posting_volume_growth"), own["mu_volume"], own["sigma_volume"]),
        "z_sentiment": normalise(F.col("sentiment_change"), own["mu_sentiment"], own["sigma_sentiment"]),
        "composite": composite(F.col("posting_volume_growth"), F.col("sentiment_change"), own, weight_volume, weight_sentiment),
    }
    return df.withColumns({k: F.when(counts, v) for k, v in z.items()}).drop(*STATS, "train_size")


def label_of(composite_score: Column, tau: float = 1.5) -> Column:
    """1.0 above tau (strictly), else 0.0; null stays null."""
    return (composite_score > tau).cast("double")


def apply_labelling(df: DataFrame, tau: float = 1.5, weight_volume: float = 0.5, weight_sentiment: float = 0.5, ratio: float = 0.8) -> DataFrame:
    require_columns(df, "t", "posting_volume_growth", "sentiment_change", "excluded", stage="labelling")
    split = temporal_split(df, ratio)
    out = scored(split, fit_stats(split), weight_volume, weight_sentiment)
    return out.withColumn("surge_label", label_of(F.col("composite"), tau))


def _distribution(grouped, label: Column) -> DataFrame:
    pos, neg = F.count_if(label == 1), F.count_if(label == 0)
    total = pos + neg
    return grouped.agg(
        pos.alias("surge_count"),
        neg.alias("no_surge_count"),
        total.alias("total"),
        F.when(total > 0, pos * 100.0 / total).otherwise(0.0).alias("surge_rate"),
        F.when(total == 0, 0.0).when(pos == 0, float("inf")).otherwise(neg / pos).alias("imbalance_ratio"),
    )


def class_distribution(labelled: DataFrame) -> DataFrame:
    """Counts, rate in percent and imbalance for all, train and test."""
    both = _distribution(labelled.rollup("partition"), F.col("surge_label"))
    return both.withColumn("partition", F.coalesce("partition", F.lit("all")))


def threshold_sweep(score: DataFrame, taus: Sequence[float] = TAUS) -> DataFrame:
    """The distribution for each tau, the composite being computed once. The list of taus is a literal."""
    each = score.select("composite", F.explode(F.array(*[F.lit(float(t)) for t in taus])).alias("threshold"))
    return _distribution(each.groupBy("threshold"), label_of(F.col("composite"), F.col("threshold")))


def viability(sweep: DataFrame, low: float = 5, high: float = 10) -> DataFrame:
    return sweep.withColumn("viable", F.col("surge_rate").between(low, high))


def stage_counts(windowed: DataFrame) -> DataFrame:
    """One row: mentions, excluded ones and their share in percent."""
    return windowed.agg(
        F.count("*").alias("mentions"),
        F.count_if("excluded").alias("excluded_count"),
        F.when(F.count("*") > 0, F.count_if("excluded") * 100.0 / F.count("*")).otherwise(0.0).alias("exclusion_rate"),
    )


def through_sentiment(mentions: DataFrame, method: str = "forward", min_count: int = 1, form: str = "prefix", with_features: bool = False) -> DataFrame:
    """Counts, growth, exclusion and sentiment ahead; ``with_features`` keeps the features that the same sweep gives."""
    if form == "frame":
        return windows.with_future_sentiment(windows.windowed(mentions, method, min_count, form), form=form)
    found = windows.all_windows(mentions, method, min_count)
    return found if with_features else found.drop("time_since_previous", "acceleration_12h")


def label_pipeline(mentions: DataFrame, tau: float = 1.5, weight_volume: float = 0.5, weight_sentiment: float = 0.5, method: str = "forward", min_count: int = 1, ratio: float = 0.8) -> DataFrame:
    """From mentions to labels. Windows are taken once and settled; statistics and labels read the settled rows."""
    return apply_labelling(settle(through_sentiment(mentions, method, min_count)), tau, weight_volume, weight_sentiment, ratio)


def sweep_pipeline(mentions: DataFrame, taus: Sequence[float] = TAUS) -> DataFrame:
    """From mentions to the distribution at each tau; only what the scores need is settled."""
    split = temporal_split(settle(through_sentiment(mentions).select("t", "posting_volume_growth", "sentiment_change", "excluded")))
    return viability(threshold_sweep(scored(split, fit_stats(split)), taus))
