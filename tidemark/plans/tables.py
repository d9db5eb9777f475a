"""The given tables as records, mentions and predictions, in Spark and in SQL; a registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import epoch_seconds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its function's name, with its SQL where there is one."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return keep


def r6(x: Column | str, name: str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6).alias(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stand_in(key: Column) -> Column:
    """A polarity in [-1, 1] that both engines compute alike."""
    return (F.pmod(key * 7919, F.lit(2001)) - 1000) / 1000.0


def mentions_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("entity"), F.col("ts").alias("created"), epoch_seconds(F.col("ts")).alias("t"),
        F.col("event_type").alias("title"), F.col("props").alias("body"), F.col("value").alias("score"), stand_in(F.col("event_id")).alias("polarity"),
    )


def mentions_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("entity"), F.col("o_orderdate").alias("created"),
        epoch_seconds(F.col("o_orderdate")).alias("t"), stand_in(F.col("o_orderkey")).alias("polarity"),
    )


def posts_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, cut = F.coalesce("text", F.lit("")), F.instr(F.coalesce("text", F.lit("")), "\n")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.when(cut > 0, F.expr("substring(text, 1, instr(text, '\n') - 1)")).otherwise(text).alias("title"),
        F.when(cut > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise("").alias("body"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, doc_id * 37)").alias("created"),
        "lang", "source", "n_chars",
    )


def scored_lab(spark: SparkSession, sf_dir: str, y: str = "quality") -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    most = F.broadcast(docs.agg(F.max("n_chars").alias("m")))
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").crossJoin(most)
    return rows.select(
        F.col("doc_id").alias("id"), F.col(y).alias("y"), (F.pmod(F.col("doc_id") * 7919, F.lit(1000)) / 1000.0).alias("prob_a"),
        (F.pmod(F.col("doc_id") * 104729, F.lit(1000)) / 1000.0).alias("prob_b"), (F.col("n_chars") / F.col("m").cast("double")).alias("prob_c"), "n_chars",
    )


def by_model(scored: DataFrame) -> DataFrame:
    """(id, y, model, prob) for the three probabilities."""
    return scored.select("id", "y", "prob_a", "prob_b", "prob_c").unpivot(["id", "y"], ["prob_a", "prob_b", "prob_c"], "model", "prob")


EV = """ev AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS entity, ts AS created, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_type AS title,
  props AS body, value AS score, ((event_id * 7919) % 2001 - 1000) / 1000.0 AS polarity FROM events)"""
ORD = """od AS (SELECT o_orderkey AS id, o_orderpriority AS entity, o_orderdate AS created, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS t,
  ((o_orderkey * 7919) % 2001 - 1000) / 1000.0 AS polarity FROM orders)"""


def counted(source: str = "ev", name: str = "w") -> str:
    over = "PARTITION BY entity ORDER BY t RANGE BETWEEN"
    return f"""{name} AS (SELECT *, count(*) OVER ({over} 86399 PRECEDING AND 1 PRECEDING) AS backward_count,
  count(*) OVER ({over} 1 FOLLOWING AND 86400 FOLLOWING) AS forward_count FROM {source})"""


GROWN = """g AS (SELECT *, forward_count / greatest(backward_count, 1) - 1.0 AS posting_volume_growth, forward_count < 1 AS excluded FROM w)"""
SENT = """o AS (SELECT *, CASE WHEN excluded THEN 0.0 ELSE polarity END AS sentiment_polarity FROM g),
a AS (SELECT *, avg(CASE WHEN NOT excluded THEN sentiment_polarity END) OVER (PARTITION BY entity ORDER BY t RANGE BETWEEN 1 FOLLOWING AND 86400 FOLLOWING) AS ahead FROM o),
s AS (SELECT *, CASE WHEN excluded THEN sentiment_polarity ELSE coalesce(ahead, sentiment_polarity) END AS mean_future_sentiment,
  abs(CASE WHEN excluded THEN sentiment_polarity ELSE coalesce(ahead, sentiment_polarity) END - sentiment_polarity) AS sentiment_change FROM a)"""
SPLIT = """c AS (SELECT quantile_cont(t, 0.8) AS cut FROM s),
p AS (SELECT s.*, c.cut, CASE WHEN t <= c.cut THEN 'train' ELSE 'test' END AS partition FROM s, c)"""
FIT = """f AS (SELECT coalesce(avg(posting_volume_growth) FILTER (WHERE partition = 'train' AND NOT excluded), 0) AS mu_volume,
  coalesce(stddev_pop(posting_volume_growth) FILTER (WHERE partition = 'train' AND NOT excluded), 0) AS sigma_volume,
  coalesce(avg(sentiment_change) FILTER (WHERE partition = 'train' AND NOT excluded), 0) AS mu_sentiment,
  coalesce(stddev_pop(sentiment_change) FILTER (WHERE partition = 'train' AND NOT excluded), 0) AS sigma_sentiment,
  count(*) FILTER (WHERE partition = 'train' AND NOT excluded) AS train_size, count(*) FILTER (WHERE partition = 'test' AND NOT excluded) AS test_size,
  max(cut) AS cut FROM p)"""
ZED = """z0 AS (SELECT p.*, CASE WHEN NOT excluded AND train_size > 0 THEN CASE WHEN sigma_volume = 0 THEN 0.0 ELSE (posting_volume_growth - mu_volume) / sigma_volume END END AS z_volume,
  CASE WHEN NOT excluded AND train_size > 0 THEN CASE WHEN sigma_sentiment = 0 THEN 0.0 ELSE (sentiment_change - mu_sentiment) / sigma_sentiment END END AS z_sentiment FROM p, f),
z AS (SELECT *, 0.5 * z_volume + 0.5 * z_sentiment AS composite FROM z0)"""
LAB = """l AS (SELECT *, CASE WHEN composite > 1.5 THEN 1.0 WHEN composite <= 1.5 THEN 0.0 END AS surge_label FROM z)"""
UPTO = {
    "w": [EV, counted()],
    "g": [EV, counted(), GROWN],
    "s": [EV, counted(), GROWN, SENT],
    "p": [EV, counted(), GROWN, SENT, SPLIT],
    "f": [EV, counted(), GROWN, SENT, SPLIT, FIT],
    "z": [EV, counted(), GROWN, SENT, SPLIT, FIT, ZED],
    "l": [EV, counted(), GROWN, SENT, SPLIT, FIT, ZED, LAB],
}


def upto(name: str, *more: str) -> str:
    return "WITH " + ",\n".join([*UPTO[name], *more]) + "\n"


POSTS = """posts AS (SELECT doc_id AS id, CASE WHEN contains(text, chr(10)) THEN substr(text, 1, strpos(text, chr(10)) - 1) ELSE coalesce(text, '') END AS title,
  CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS body, TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id * 37 AS BIGINT)) AS created,
  lang, source, n_chars FROM documents)"""
SCORED = """sc AS (SELECT l.doc_id AS id, l.quality AS y, l.toxic, ((l.doc_id * 7919) % 1000) / 1000.0 AS prob_a, ((l.doc_id * 104729) % 1000) / 1000.0 AS prob_b,
  d.n_chars / CAST((SELECT max(n_chars) FROM documents) AS DOUBLE) AS prob_c, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
bm AS (SELECT id, y, 'prob_a' AS model, prob_a AS prob FROM sc UNION ALL SELECT id, y, 'prob_b', prob_b FROM sc UNION ALL SELECT id, y, 'prob_c', prob_c FROM sc)"""
