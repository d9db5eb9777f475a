"""From records to labels: load, extract, explode, window, score, label; and the run's summary.

Each stage's counts are observed while its rows are written for the next stage, so no count
scans anything again. Records are scored once each, and only those with a mention that counts.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.columns import epoch_seconds, extract_entities, require_columns
from ..functions.sentiment import Rules, polarity_included_only, text_choice
from ..sources.records import explode_mentions, has_entity, settle
from . import label, windows


@dataclass
class Run:
    """What a run has so far: the rows of its last stage, counts by name, seconds by stage, configuration."""

    rows: DataFrame
    counts: dict[str, int]
    seconds: dict[str, float] = field(default_factory=dict)
    config: dict = field(default_factory=dict)


def _observed(df: DataFrame, name: str, **counts) -> tuple[DataFrame, Observation]:
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in counts.items()]), seen


def load_mentions(records: DataFrame, stop: Sequence[str] = ()) -> Run:
    """Mentions (id, entity, t, created) of records (id, title, body, created), settled; records without an entity go.

    Counts: loaded, excluded (without an entity), retained, exploded (mentions)."""
    began = time.time()
    require_columns(records, "id", "title", "body", "created", stage="load")
    found = records if "tickers" in records.columns else records.withColumn("tickers", F.array_join(extract_entities(F.col("title"), F.col("body"), stop), ","))
    has = has_entity(F.col("tickers"))
    found, loaded = _observed(found.select("id", "created", "tickers"), "load", loaded=F.count(F.lit(1)), retained=F.count_if(has))
    mentions, exploded = _observed(explode_mentions(found), "explode", exploded=F.count(F.lit(1)))
    rows = settle(mentions.select("id", "entity", epoch_seconds(F.col("created")).alias("t"), "created"))
    loaded, exploded = loaded.get, exploded.get
    counts = {"loaded": loaded["loaded"], "excluded": loaded["loaded"] - loaded["retained"], "retained": loaded["retained"], "exploded": exploded["exploded"]}
    return Run(rows, counts, {"load": time.time() - began})


def through_sentiment(run: Run, records: DataFrame, lexicon: DataFrame, rules: Rules | None = None, backend: str = "lexicon", method: str = "forward", min_count: int = 1) -> Run:
    """Windows, exclusion, polarity of included mentions and sentiment ahead, settled.

    Counts: windowed, excluded_count, included, and bulls and bears, the mentions of either sentiment."""
    began = time.time()
    grown, windowed = _observed(windows.windowed(run.rows, method, min_count), "window", windowed=F.count(F.lit(1)), excluded_count=F.count_if("excluded"))
    grown = settle(grown)
    windowed, after = windowed.get, time.time()
    text = text_choice(F.col("title"), F.col("body"))
    polar = polarity_included_only(grown, records, lexicon, text, backend, rules)
    rows, scored = _observed(windows.with_future_sentiment(polar), "sentiment", included=F.count_if(~F.col("excluded")), bulls=F.count_if(F.col("sentiment_polarity") > 0.05), bears=F.count_if(F.col("sentiment_polarity") < -0.05))
    rows = settle(rows)
    counts = run.counts | windowed | scored.get
    return Run(rows, counts, run.seconds | {"window": after - began, "sentiment": time.time() - after}, {"backend": backend, "method": method, "min_count": min_count})


def labelled(run: Run, tau: float = 1.5, weight_volume: float = 0.5, weight_sentiment: float = 0.5, ratio: float = 0.8) -> Run:
    """Split, standardisation, composite and label. Rows are not settled: statistics are two passes over the settled ones."""
    rows = label.apply_labelling(run.rows, tau, weight_volume, weight_sentiment, ratio)
    own = {"tau": tau, "weight_volume": weight_volume, "weight_sentiment": weight_sentiment, "ratio": ratio}
    return Run(rows, run.counts, run.seconds, run.config | own)


def run_pipeline(records: DataFrame, lexicon: DataFrame, stop: Sequence[str] = (), rules: Rules | None = None, tau: float = 1.5, **options) -> Run:
    """Load, window, sentiment and label with one call; ``options`` go to ``through_sentiment``."""
    return labelled(through_sentiment(load_mentions(records, stop), records, lexicon, rules, **options), tau)


def counts_row(run: Run) -> DataFrame:
    """The stages' counts as one row, with the share of mentions that are excluded, in percent."""
    rate = run.counts["excluded_count"] * 100.0 / run.counts["windowed"] if run.counts.get("windowed") else 0.0
    names = ", ".join(f"{k} long" for k in run.counts)
    return run.rows.sparkSession.createDataFrame([(*run.counts.values(), rate)], f"{names}, exclusion_rate double")


def summary(run: Run, fingerprint: DataFrame | None = None) -> DataFrame:
    """One nested row: stages (counts), exclusion_rate, fit, distributions (all, train, test), config, seconds, fingerprint."""
    fit = label.fit_stats(run.rows.withColumn("cut", F.lit(None).cast("double"))).drop("cut")
    named = label.class_distribution(run.rows)
    kinds = {k: F.max(F.when(F.col("partition") == k, F.struct("surge_count", "no_surge_count", "total", "surge_rate", "imbalance_ratio"))).alias(k) for k in ("all", "train", "test")}
    counts = counts_row(run)
    row = counts.select(F.struct(*run.counts).alias("stages"), "exclusion_rate").crossJoin(fit.select(F.struct("*").alias("fit")))
    row = row.crossJoin(named.agg(*kinds.values()).select(F.struct(*kinds).alias("distributions")))
    row = row.withColumn("config", F.struct(*[F.lit(v).alias(k) for k, v in run.config.items()]))
    row = row.withColumn("seconds", F.struct(*[F.lit(round(v, 3)).alias(k) for k, v in run.seconds.items()]) if run.seconds else F.lit(None))
    if fingerprint is not None:
        row = row.crossJoin(fingerprint.select(F.struct("*").alias("fingerprint")))
    return row
