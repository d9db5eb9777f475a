"""Queries: whole runs from documents to labels, their counts and their summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import label, pipeline
from ..sources import records
from . import texts
from .tables import FIT, GROWN, LAB, POSTS, SENT, SPLIT, ZED, counted, posts_doc, query, r6, table

MENTIONS = """mn AS (SELECT id, unnest(string_split(tickers, ',')) AS entity, CAST(floor(epoch(created)) AS BIGINT) AS t FROM x WHERE tickers <> '')"""
POLAR = "gp AS (SELECT g.*, CASE WHEN excluded THEN 0.0 ELSE coalesce(pl.polarity, 0.0) END AS polarity FROM g LEFT JOIN pl USING (id))"


def documents_sql(last: str) -> str:
    """The run as SQL, up to the given step."""
    steps = [POSTS, texts.EXTRACTED, MENTIONS, counted("mn"), GROWN, texts.tokens_sql(texts.LEXICON), texts.SUMMED, POLAR, SENT.replace("FROM g)", "FROM gp)"), SPLIT, FIT, ZED, LAB]
    counts = """ct AS (SELECT (SELECT count(*) FROM posts) AS loaded, (SELECT count(*) FROM x WHERE tickers = '') AS excluded, (SELECT count(*) FROM x WHERE tickers <> '') AS retained,
  (SELECT count(*) FROM mn) AS exploded, count(*) AS windowed, count(*) FILTER (WHERE excluded) AS excluded_count, count(*) FILTER (WHERE NOT excluded) AS included,
  count(*) FILTER (WHERE sentiment_polarity > 0.05) AS bulls, count(*) FILTER (WHERE sentiment_polarity < -0.05) AS bears, count(*) FILTER (WHERE excluded) * 100.0 / count(*) AS exclusion_rate FROM s)"""
    return "WITH " + ",\n".join([*steps, counts]) + "\n" + last


def run_documents(spark, d, **options) -> pipeline.Run:
    terms, rules = texts.scored_by(spark)
    return pipeline.run_pipeline(posts_doc(spark, d), terms, texts.STOP, rules, **options)


ROWS = ("id", "entity", "t", "backward_count", "forward_count", "excluded", "partition", "surge_label")
SIX = ("posting_volume_growth", "sentiment_polarity", "mean_future_sentiment", "sentiment_change", "z_volume", "z_sentiment", "composite")


@query(documents_sql("SELECT " + ", ".join(ROWS) + ", " + ", ".join(f"round({c}, 6) AS {c}" for c in SIX) + " FROM l"))
def label_documents(spark, d):
    """Documents in, labelled mentions out: entities are extracted and exploded, windows taken, each included document scored once."""
    return run_documents(spark, d).rows.select(*ROWS, *[r6(c, c) for c in SIX])


COUNTS = ("loaded", "excluded", "retained", "exploded", "windowed", "excluded_count", "included", "bulls", "bears")


@query(documents_sql(f"SELECT {', '.join(COUNTS)}, round(exclusion_rate, 6) AS exclusion_rate FROM ct"))
def stage_counts(spark, d):
    """Counts of every stage, observed while the stages are written."""
    return pipeline.counts_row(run_documents(spark, d)).select(*COUNTS, r6("exclusion_rate", "exclusion_rate"))


PARTS = ("all", "train", "test")
SPREAD = ("surge_count", "no_surge_count", "total", "surge_rate", "imbalance_ratio")
DIST = """ds AS (SELECT coalesce(partition, 'all') AS part, count(*) FILTER (WHERE surge_label = 1) AS surge_count, count(*) FILTER (WHERE surge_label = 0) AS no_surge_count, count(surge_label) AS total,
  round(CASE WHEN count(surge_label) > 0 THEN count(*) FILTER (WHERE surge_label = 1) * 100.0 / count(surge_label) ELSE 0 END, 6) AS surge_rate,
  round(CASE WHEN count(surge_label) = 0 THEN 0 WHEN count(*) FILTER (WHERE surge_label = 1) = 0 THEN NULL ELSE count(*) FILTER (WHERE surge_label = 0) / count(*) FILTER (WHERE surge_label = 1) END, 6) AS imbalance_ratio
  FROM l GROUP BY ROLLUP (partition))"""
FINGERPRINT = """fp AS (SELECT CAST(sum(('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, '~'), coalesce(text, '~'))), 1, 12))::BIGINT) AS VARCHAR) AS content_hash, count(*) AS n_rows FROM documents)"""


@query(
    documents_sql("SELECT ").removesuffix("\nSELECT ")
    + f",\n{DIST},\n{FINGERPRINT}\nSELECT "
    + ", ".join([*COUNTS, "round(exclusion_rate, 6) AS exclusion_rate", "train_size", "test_size", *[f"round({c}, 6) AS {c}" for c in label.STATS]])
    + ", "
    + ", ".join(f"(SELECT {c} FROM ds WHERE part = '{p}') AS {p}_{c}" for p in PARTS for c in SPREAD)
    + ", content_hash, n_rows, 1.5 AS tau, 'lexicon' AS backend, 'forward' AS method FROM ct, f, fp"
)
def write_summary(spark, d):
    """The run's nested summary written as JSON, read back and laid flat; seconds are there but differ from run to run."""
    path = records.new_folder(spark)
    run = run_documents(spark, d)
    records.write_summary(pipeline.summary(run, records.fingerprint(table(spark, d, "documents"), "doc_id", "text")), path)
    kinds = pipeline.summary(run, records.fingerprint(table(spark, d, "documents"), "doc_id", "text")).schema
    s = spark.read.schema(kinds).json(path).where("seconds is not null")
    return s.select(
        *[F.col(f"stages.{c}").alias(c) for c in COUNTS], r6("exclusion_rate", "exclusion_rate"), "fit.train_size", "fit.test_size", *[r6(f"fit.{c}", c) for c in label.STATS],
        *[(r6 if c in SPREAD[3:] else lambda x, name: F.col(x).alias(name))(f"distributions.{p}.{c}", f"{p}_{c}") for p in PARTS for c in SPREAD],
        "fingerprint.content_hash", "fingerprint.n_rows", "config.tau", "config.backend", "config.method",
    )
