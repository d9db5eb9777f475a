"""Prediction features that look backward only."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import require_columns
from . import windows

#: In this order.
FEATURES = (
    "hour_of_day", "day_of_week", "word_count", "title_length", "sentiment_score", "entity_rate_24h", "time_since_previous",
    "acceleration_12h", "entities_per_record", "word_count_x_hour", "accel_x_gap",
)


def entities_per_record(df: DataFrame) -> DataFrame:
    """Adds the count of a record's distinct entities: counted by record, then joined back."""
    counts = df.select("id", "entity").distinct().groupBy("id").agg(F.count("*").alias("entities_per_record"))
    return df.join(counts, "id")


def accel_x_gap(acceleration: Column, gap: Column) -> Column:
    """A gap below 0 (no previous row) counts as 0."""
    return acceleration * F.greatest(gap, F.lit(0.0))


def features_all(df: DataFrame) -> DataFrame:
    """All features; no window holds a whole entity. Windows that an earlier sweep has added are not taken again."""
    require_columns(df, "id", "entity", "t", "created", "title", "body", "backward_count", "sentiment_polarity", stage="features")
    if "time_since_previous" not in df.columns:
        df = windows.with_gaps(df)
    if "acceleration_12h" not in df.columns:
        df = windows.with_acceleration(df)
    df = entities_per_record(df)
    df = df.withColumns(
        {
            "hour_of_day": C.hour_of_day(F.col("created")),
            "day_of_week": C.day_of_week(F.col("created")),
            "word_count": C.word_count(F.col("title"), F.col("body")),
            "title_length": C.title_length(F.col("title")),
            "sentiment_score": F.col("sentiment_polarity"),
            "entity_rate_24h": F.col("backward_count"),
        }
    )
    return df.withColumns(
        {
            "word_count_x_hour": F.col("word_count") * F.col("hour_of_day"),
            "accel_x_gap": accel_x_gap(F.col("acceleration_12h"), F.col("time_since_previous")),
        }
    )


def feature_projection(df: DataFrame, *keep: str) -> DataFrame:
    return require_columns(df, *FEATURES, stage="feature projection").select(*keep, *FEATURES)


def assemble(df: DataFrame, output: str = "raw_features") -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol=output).transform(df)


def feature_summary(df: DataFrame) -> DataFrame:
    """feature, mean, std (sample), min, max over included rows; over all where there is no ``excluded``."""
    rows = df.where(~F.col("excluded")) if "excluded" in df.columns else df
    long = rows.select(*[F.col(f).cast("double").alias(f) for f in FEATURES]).unpivot([], list(FEATURES), "feature", "value")
    return long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def partition_filter(df: DataFrame, partition: str) -> DataFrame:
    return df.where((F.col("partition") == partition) & ~F.col("excluded"))
