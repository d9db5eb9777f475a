"""Fitness of candidate datasets: profiles, quality, viability, catalogue ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import percentiles

DATE_NAMES = ("created_utc", "created", "date", "timestamp", "datetime", "time", "created_at", "ts")
TEXT_NAMES = ("text", "body", "selftext", "title", "content", "tweet")
ENGAGEMENT_NAMES = ("score", "num_comments", "likes", "retweets", "upvotes", "value")
SENTIMENT_NAMES = ("sentiment", "polarity", "sentiment_polarity")
SWEEP_QUANTILES, SWEEP_DEVIATIONS = (0.90, 0.95, 0.99), (0.5, 1.0, 1.5)


def detect_columns(df: DataFrame, probe: int = 20) -> dict:
    """date, text, engagement and sentiment columns by name; a date also by part of a name or by parsing a few values."""
    low = {c.lower(): c for c in df.columns}
    first = lambda names: next((low[n] for n in names if n in low), None)
    date = first(DATE_NAMES) or next((c for n, c in low.items() if "date" in n or "time" in n), None)
    if date is None:
        for c, kind in df.dtypes:
            if kind == "string":
                few = df.select(c).where(F.col(c).isNotNull()).limit(probe)
                share = few.agg(F.avg(F.col(c).try_cast("timestamp").isNotNull().cast("int"))).first()[0]
                if share is not None and share >= 0.8:
                    date = c
                    break
    return {"date": date, "text": first(TEXT_NAMES), "engagement": [low[n] for n in ENGAGEMENT_NAMES if n in low], "sentiment": first(SENTIMENT_NAMES)}


def epoch_or_string_dates(df: DataFrame, column: str, out: str = "parsed") -> DataFrame:
    """A numeric column whose median is beyond 1e9 in size holds epoch seconds; any other is read as a date text."""
    number = F.col(column).cast("string").try_cast("double")
    median = percentiles(df.select(number.alias("_x")), "_x", [0.5]).select(F.col("cuts")[0].alias("_m"))
    seconds = F.timestamp_seconds(number).cast("timestamp_ntz")
    text = F.col(column).cast("string").try_cast("timestamp_ntz")
    median = median.agg(F.max("_m").alias("_m"))  # one row, also where no value is a number
    return df.crossJoin(F.broadcast(median)).withColumn(out, F.when(F.abs("_m") > 1e9, seconds).otherwise(text)).drop("_m")


def bull_bear_ratio(p: Column) -> Column:
    """Rows above 0.05 for each row below -0.05, two decimals; 999 without bears, 0 without either."""
    bull, bear = F.count_if(p > 0.05), F.count_if(p < -0.05)
    return F.when(bear > 0, F.round(bull / bear, 2)).when(bull > 0, 999.0).otherwise(0.0)


def missing_profile(df: DataFrame, columns: Sequence[str] = (), high: float = 30) -> DataFrame:
    """column, missing_pct, high_risk."""
    columns = list(columns or df.columns)
    wide = df.agg(*[F.coalesce(F.avg(F.col(c).isNull().cast("int")) * 100, F.lit(0.0)).alias(c) for c in columns])
    return wide.unpivot([], columns, "column", "missing_pct").withColumn("high_risk", F.col("missing_pct") > high)


def duplicate_rows(df: DataFrame) -> DataFrame:
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def temporal_coverage(df: DataFrame, ts: str, gap_days: int = 7) -> DataFrame:
    """First and last time, whole days between, gaps of more than ``gap_days`` days between consecutive rows.

    A gap of whole days lies between a day's last and a later day's first row, so the
    ordered step sees one row for each day."""
    days = df.where(F.col(ts).isNotNull()).groupBy(F.date_trunc("day", ts).alias("d")).agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    gap = F.unix_timestamp("a") - F.lag(F.unix_timestamp("b")).over(Window.orderBy("d"))
    days = days.withColumn("gap", gap)
    return days.agg(
        F.min("a").alias("first_date"),
        F.max("b").alias("last_date"),
        F.floor((F.unix_timestamp(F.max("b")) - F.unix_timestamp(F.min("a"))) / 86_400).alias("days"),
        F.count_if(F.col("gap") > gap_days * 86_400).alias("gaps"),
    )


def dataset_profile(df: DataFrame, name: str, date: str | None, text: str | None, engagement: Sequence[str], entity: str | None, sentiment: str | None) -> DataFrame:
    """One row on a dataset, in one pass over all rows."""
    missing = sum((F.avg(F.col(c).isNull().cast("int")) for c in df.columns), F.lit(0.0)) * 100 / len(df.columns)
    ready = bool(engagement) and bool(text) and bool(date)
    return df.agg(
        F.lit(name).alias("name"),
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        (F.floor((F.unix_timestamp(F.max(date)) - F.unix_timestamp(F.min(date))) / 86_400) if date else F.lit(None).cast("long")).alias("days"),
        missing.alias("missing_pct"),
        (F.count_distinct(entity) if entity else F.lit(0).cast("long")).alias("entities"),
        (bull_bear_ratio(F.col(sentiment)) if sentiment else F.lit(None).cast("double")).alias("bull_bear"),
        F.lit(bool(engagement)).alias("has_engagement"),
        F.lit(bool(text)).alias("has_text"),
        F.lit(bool(date)).alias("has_date"),
        F.lit(ready).alias("ready"),
    )


def dataset_comparison(*profiles: DataFrame) -> DataFrame:
    """Profiles with their rank by readiness, entities and rows, all falling."""
    both = profiles[0]
    for p in profiles[1:]:
        both = both.unionByName(p)
    w = Window.orderBy(F.desc("ready"), F.desc("entities"), F.desc("n_rows"), "name")  # a row for each dataset
    return both.withColumn("rank", F.row_number().over(w))


def entity_zscores(df: DataFrame, columns: Sequence[str], entity: str = "entity") -> DataFrame:
    """Adds z_max: the largest of the columns' z-scores within the entity (sample deviation; 0 where undefined).

    Statistics by entity are aggregated and joined back, which a hot entity does not burden."""
    stats = df.groupBy(entity).agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])
    z = [F.when(F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) == 0, 0.0).otherwise(F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}"), F.lit(0.0))) for c in columns]
    out = df.join(stats, entity).withColumn("z_max", F.greatest(*z) if len(z) > 1 else z[0])
    return out.drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def sentiment_deviation(df: DataFrame, sentiment: str, entity: str = "entity") -> DataFrame:
    """Adds deviation: distance from the entity's mean in its sample deviations; 0 where undefined."""
    stats = df.groupBy(entity).agg(F.avg(sentiment).alias("_m"), F.stddev_samp(sentiment).alias("_s"))
    d = F.abs(F.col(sentiment) - F.col("_m")) / F.col("_s")
    return df.join(stats, entity).withColumn("deviation", F.when(F.coalesce("_s", F.lit(0.0)) == 0, 0.0).otherwise(F.coalesce(d, F.lit(0.0)))).drop("_m", "_s")


def viability_sweep(scored: DataFrame, entity: str = "entity", least_pct: float = 2) -> DataFrame:
    """scored: entity, z_max, deviation. For each quantile and deviation: hits, share in percent, viable."""
    cuts = percentiles(scored, "z_max", SWEEP_QUANTILES, [entity])
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(q).alias("quantile"), F.lit(d).alias("sd")) for i, q in enumerate(SWEEP_QUANTILES) for d in SWEEP_DEVIATIONS])
    each = scored.join(cuts, entity).withColumn("g", F.explode(grid))
    hit = (F.col("z_max") >= F.get("cuts", F.col("g.i"))) & (F.col("deviation") >= F.col("g.sd"))
    out = each.groupBy(F.col("g.quantile").alias("quantile"), F.col("g.sd").alias("sd")).agg(F.count_if(hit).alias("hits"), (F.count_if(hit) * 100.0 / F.count("*")).alias("pct"))
    return out.withColumn("viable", F.col("pct") >= least_pct)


def polarity_agreement(a: Column, b: Column) -> list[Column]:
    """agreement: share of rows whose classes agree; note: good from 0.7, moderate from 0.5, else low."""
    share = F.avg((a == b).cast("int"))
    return [share.alias("agreement"), F.when(share >= 0.7, "good").when(share >= 0.5, "moderate").otherwise("low").alias("note")]


def dataset_verdict(facts: DataFrame) -> DataFrame:
    """facts: n_rows, high_missing, duplicate_rows, gaps, agreement. Adds risks and verdict."""
    risk = lambda test, name: F.when(test, F.lit(name))
    risks = F.array_compact(
        F.array(
            risk(F.col("n_rows") < 5000, "few rows"), risk(F.col("high_missing") > 0, "missing values"), risk(F.col("duplicate_rows") > 0, "duplicates"),
            risk(F.col("gaps") > 0, "gaps"), risk(F.col("agreement") < 0.5, "unreliable sentiment"),
        )
    )
    return facts.withColumn("risks", F.array_join(risks, ";")).withColumn("verdict", F.when(F.col("risks") == "", "suitable").otherwise("unsuitable"))


def assessment_flatten(df: DataFrame, column: str = "definitions") -> DataFrame:
    """One row for each definition; a dataset with none keeps one row."""
    return df.withColumn("definition", F.explode_outer(column)).drop(column)


def completeness_flags(columns: Column, title: Column, keywords: Sequence[str]) -> Column:
    """Whether a column's name, else the title, holds one of the keywords."""
    pattern = "|".join(keywords)
    named = F.lower(F.array_join(columns, "|")).rlike(pattern)
    return F.when(F.size(columns) > 0, named).otherwise(F.coalesce(F.lower(title).rlike(pattern), F.lit(False)))


def freshness_days(updated: Column, today: Column) -> Column:
    # greatest() skips nulls, so an unknown date is told apart first
    return F.when(updated.isNull(), -1).otherwise(F.greatest(F.datediff(today, updated), F.lit(0)))


def catalogue_dedupe(df: DataFrame) -> DataFrame:
    """The first hit (by search term's order) of each name."""
    w = Window.partitionBy("name").orderBy("hit")
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def catalogue_filter_rank(df: DataFrame, complete: bool = False, downloads: int = 0, freshness: int = -1, top: int = 0) -> DataFrame:
    """Hard filters, then a score, then the best ``top`` of each platform (0: all)."""
    if complete:
        df = df.where("complete")
    df = df.where(F.col("downloads") >= downloads)
    if freshness >= 0:
        df = df.where(F.col("freshness").between(0, freshness))
    score = F.when(F.col("complete"), 50.0).otherwise(20.0) + F.when(F.col("downloads") > 0, 10 * F.log10(F.col("downloads") + 1.0)).otherwise(5.0)
    score = score + F.when(F.col("n_rows") > 0, 10.0).otherwise(0.0)
    w = Window.partitionBy("platform").orderBy(F.desc(F.round("score", 9)), "name")
    df = df.withColumn("score", score).withColumn("rank", F.row_number().over(w))
    return df.where(F.col("rank") <= top) if top else df


def catalogue_flatten(df: DataFrame) -> DataFrame:
    """Column lists joined by a pipe, date ranges as a..b."""
    return df.withColumns({"columns": F.array_join("columns", "|"), "date_range": F.concat(F.col("first"), F.lit(".."), F.col("last"))}).drop("first", "last")
