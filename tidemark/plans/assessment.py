"""Queries: fitness of datasets and catalogue ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sentiment as S
from ..functions.columns import polarity_class
from ..operators import assess as A
from . import texts
from .tables import EV, POSTS, mentions_ev, posts_doc, query, r6, stand_in, table

KEYWORDS = ("score", "like", "value", "price")
#: A catalogue from the part table: one entry for each part.
CATALOGUE = """ct AS (SELECT p_name AS name, p_brand AS platform, p_partkey AS hit, p_size AS downloads, p_size % 3 = 0 AS complete,
  CAST(p_partkey % 90 AS INT) - 5 AS age, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_partkey END AS n_rows FROM part)"""


def _catalogue(spark, d):
    return table(spark, d, "part").select(
        F.col("p_name").alias("name"), F.col("p_brand").alias("platform"), F.col("p_partkey").alias("hit"), F.col("p_size").alias("downloads"), (F.col("p_size") % 3 == 0).alias("complete"),
        ((F.col("p_partkey") % 90).cast("int") - 5).alias("age"), F.when(F.col("p_partkey") % 4 == 0, 0).otherwise(F.col("p_partkey")).alias("n_rows"),
    )


@query("SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch FROM events")
def epoch_or_string_dates(spark, d):
    df = table(spark, d, "events").select(F.col("event_id").alias("id"), F.unix_timestamp("ts").alias("when"))
    return A.epoch_or_string_dates(df, "when").select("id", F.unix_timestamp("parsed").alias("epoch"))


def _holes(spark, d):
    """Events with values missing in some rows."""
    return mentions_ev(spark, d).select("id", "entity", F.when(F.col("id") % 3 != 0, F.col("score")).alias("score"), F.when(F.col("id") % 10 != 0, F.col("body")).alias("body"))


@query(
    f"WITH {EV}, h AS (SELECT avg(CASE WHEN id % 3 = 0 OR score IS NULL THEN 100.0 ELSE 0 END) AS score, avg(CASE WHEN id % 10 = 0 OR body IS NULL THEN 100.0 ELSE 0 END) AS body FROM ev)"
    " SELECT 'id' AS \"column\", 0.0::DOUBLE AS missing_pct, false AS high_risk UNION ALL SELECT 'entity', 0.0, false UNION ALL SELECT 'score', round(score, 6), score > 30 FROM h UNION ALL SELECT 'body', round(body, 6), body > 30 FROM h"
)
def missing_profile(spark, d):
    return A.missing_profile(_holes(spark, d)).select("column", r6("missing_pct", "missing_pct"), "high_risk")


@query("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def duplicate_rows(spark, d):
    return A.duplicate_rows(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"))


@query(
    """WITH e AS (SELECT ts, epoch(ts) AS t FROM events UNION ALL SELECT o_orderdate, epoch(o_orderdate) FROM orders),
q AS (SELECT ts, floor(t) - lag(floor(t)) OVER (ORDER BY t) AS gap, floor(t) AS t FROM e)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_date, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_date, CAST(floor((max(t) - min(t)) / 86400) AS BIGINT) AS days, count(*) FILTER (WHERE gap > 7 * 86400) AS gaps FROM q"""
)
def temporal_coverage(spark, d):
    """All events and all orders."""
    a = table(spark, d, "events").select("ts")
    b = table(spark, d, "orders").select(F.col("o_orderdate").alias("ts"))
    out = A.temporal_coverage(a.unionByName(b), "ts")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_date", "last_date")})


PROFILE = """SELECT 'events' AS name, count(*) AS n_rows, 5 AS n_columns, CAST(floor((max(floor(epoch(ts))) - min(floor(epoch(ts)))) / 86400) AS BIGINT) AS days, 0.0::DOUBLE AS missing_pct,
  count(DISTINCT user_id) AS entities, {ratio} AS bull_bear, true AS has_engagement, true AS has_text, true AS has_date, true AS ready FROM (SELECT *, ((event_id * 7919) % 2001 - 1000) / 1000.0 AS p FROM events)"""
RATIO = "CASE WHEN count(*) FILTER (WHERE p < -0.05) > 0 THEN round(count(*) FILTER (WHERE p > 0.05) / count(*) FILTER (WHERE p < -0.05), 2) WHEN count(*) FILTER (WHERE p > 0.05) > 0 THEN 999 ELSE 0 END"


def _profile(spark, d):
    df = table(spark, d, "events").select("ts", "user_id", "props", "value", stand_in(F.col("event_id")).alias("p"))
    return A.dataset_profile(df, "events", "ts", "props", ["value"], "user_id", "p")


@query(PROFILE.format(ratio=RATIO))
def dataset_profile(spark, d):
    return _profile(spark, d).withColumn("missing_pct", F.round("missing_pct", 6))


@query(
    "WITH pr AS (SELECT 'events' AS name, (SELECT count(*) FROM events) AS n_rows, (SELECT count(DISTINCT user_id) FROM events) AS entities, true AS ready UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), (SELECT count(DISTINCT o_custkey) FROM orders), false"
    " UNION ALL SELECT 'documents', (SELECT count(*) FROM documents), (SELECT count(DISTINCT source) FROM documents), false) SELECT name, CAST(row_number() OVER (ORDER BY ready DESC, entities DESC, n_rows DESC, name) AS INT) AS rank FROM pr"
)
def dataset_comparison(spark, d):
    o = A.dataset_profile(table(spark, d, "orders"), "orders", "o_orderdate", None, ["o_totalprice"], "o_custkey", None)
    t = A.dataset_profile(table(spark, d, "documents"), "documents", None, "text", [], "source", None)
    return A.dataset_comparison(_profile(spark, d), o, t).select("name", "rank")


ZS = """zs AS (SELECT *, CASE WHEN coalesce(stddev_samp(score) OVER e, 0) = 0 THEN 0 ELSE (score - avg(score) OVER e) / stddev_samp(score) OVER e END AS za,
  CASE WHEN coalesce(stddev_samp(len(body)) OVER e, 0) = 0 THEN 0 ELSE (len(body) - avg(len(body)) OVER e) / stddev_samp(len(body)) OVER e END AS zb,
  CASE WHEN coalesce(stddev_samp(polarity) OVER e, 0) = 0 THEN 0 ELSE abs(polarity - avg(polarity) OVER e) / stddev_samp(polarity) OVER e END AS deviation
  FROM ev WINDOW e AS (PARTITION BY entity)),
zm AS (SELECT *, greatest(coalesce(za, 0), coalesce(zb, 0)) AS z_max FROM zs)"""


def _zscores(spark, d):
    df = mentions_ev(spark, d).withColumn("n", F.char_length("body"))
    return A.sentiment_deviation(A.entity_zscores(df, ["score", "n"]), "polarity")


@query(f"WITH {EV}, {ZS} SELECT id, round(z_max, 6) AS z_max FROM zm")
def entity_zscore_max(spark, d):
    return _zscores(spark, d).select("id", r6("z_max", "z_max"))


@query(f"WITH {EV}, {ZS} SELECT id, round(deviation, 6) AS deviation FROM zm")
def sentiment_deviation(spark, d):
    return _zscores(spark, d).select("id", r6("deviation", "deviation"))


@query(
    f"""WITH {EV}, {ZS}, zr AS (SELECT entity, round(z_max, 9) AS z_max, round(deviation, 9) AS deviation FROM zm), q AS (SELECT entity, [quantile_cont(z_max, 0.9), quantile_cont(z_max, 0.95), quantile_cont(z_max, 0.99)] AS cuts FROM zr GROUP BY entity),
gr AS (SELECT i, quantile, sd FROM (VALUES (1, 0.9::DOUBLE), (2, 0.95), (3, 0.99)) a(i, quantile), (VALUES (0.5::DOUBLE), (1.0), (1.5)) b(sd)),
hh AS (SELECT quantile, sd, z_max >= cuts[i] AND deviation >= sd AS hit FROM zr JOIN q USING (entity), gr)
SELECT quantile, sd, count(*) FILTER (WHERE hit) AS hits, round(count(*) FILTER (WHERE hit) * 100.0 / count(*), 6) AS pct, count(*) FILTER (WHERE hit) * 100.0 / count(*) >= 2 AS viable FROM hh GROUP BY quantile, sd"""
)
def surge_viability_sweep(spark, d):
    """Scores to nine digits, so that both engines agree at the quantiles."""
    z = _zscores(spark, d).withColumns({"z_max": F.round("z_max", 9), "deviation": F.round("deviation", 9)})
    return A.viability_sweep(z).withColumn("pct", F.round("pct", 6))


@query(
    f"""WITH {POSTS}, {texts.tokens_sql(texts.LEXICON)}, {texts.SUMMED}, {texts.MEANS},
ag AS (SELECT avg(CASE WHEN {texts.AGREE.format('pl.polarity')} = {texts.AGREE.format('pm.polarity')} THEN 1.0 ELSE 0 END) AS agreement FROM pl JOIN pm ON pl.id = pm.id),
fa AS (SELECT count(*) AS n_rows, CAST(avg(CASE WHEN title = '' THEN 100.0 ELSE 0 END) > 30 AS INT) + CAST(avg(CASE WHEN body = '' THEN 100.0 ELSE 0 END) > 30 AS INT) AS high_missing FROM posts),
du AS (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM posts GROUP BY title, body)),
ga AS (SELECT count(*) FILTER (WHERE gap > 7 * 86400) AS gaps FROM (SELECT epoch(created) - lag(epoch(created)) OVER (ORDER BY created) AS gap FROM posts)),
ri AS (SELECT n_rows, high_missing, duplicate_rows, gaps, agreement, array_to_string(list_filter([CASE WHEN n_rows < 5000 THEN 'few rows' END, CASE WHEN high_missing > 0 THEN 'missing values' END,
  CASE WHEN duplicate_rows > 0 THEN 'duplicates' END, CASE WHEN gaps > 0 THEN 'gaps' END, CASE WHEN agreement < 0.5 THEN 'unreliable sentiment' END], lambda x: x IS NOT NULL), ';') AS risks FROM fa, du, ga, ag)
SELECT 'documents' AS name, n_rows, high_missing, duplicate_rows, gaps, round(agreement, 6) AS agreement, risks, CASE WHEN risks = '' THEN 'suitable' ELSE 'unsuitable' END AS verdict FROM ri"""
)
def dataset_verdict(spark, d):
    """Documents as records: missing titles and bodies, repeated texts, gaps, and whether two scorers agree on their sentiment."""
    posts = posts_doc(spark, d)
    terms, rules = texts.scored_by(spark)
    text = S.text_choice(F.col("title"), F.col("body"))
    both = S.lexicon_polarity(posts, terms, text, rules=rules).join(S.mean_lexicon_polarity(posts, terms, text, rules=rules).withColumnRenamed("polarity", "other"), "id")
    agreement = both.agg(A.polarity_agreement(polarity_class(F.col("polarity")), polarity_class(F.col("other")))[0])
    df = posts.select(*[F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("title", "body")])
    facts = df.agg(F.count("*").alias("n_rows")).crossJoin(A.missing_profile(df).agg(F.count_if("high_risk").alias("high_missing")))
    facts = facts.crossJoin(A.duplicate_rows(df)).crossJoin(A.temporal_coverage(posts, "created").select("gaps")).crossJoin(agreement)
    return A.dataset_verdict(facts).select(F.lit("documents").alias("name"), "n_rows", "high_missing", "duplicate_rows", "gaps", r6("agreement", "agreement"), "risks", "verdict")


@query("SELECT user_id AS id, event_type AS definition FROM (SELECT DISTINCT user_id, event_type FROM events WHERE user_id % 2 = 0) UNION ALL SELECT DISTINCT user_id, CAST(NULL AS VARCHAR) FROM events WHERE user_id % 2 = 1")
def assessment_flatten(spark, d):
    found = F.collect_set(F.when(F.col("user_id") % 2 == 0, F.col("event_type")))
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(found.alias("definitions"))
    return A.assessment_flatten(rows)


RANKED = """sr AS (SELECT *, CASE WHEN complete THEN 50.0 ELSE 20.0 END + CASE WHEN downloads > 0 THEN 10 * log10(downloads + 1.0) ELSE 5.0 END + CASE WHEN n_rows > 0 THEN 10.0 ELSE 0 END AS score FROM ct WHERE downloads >= 10),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY platform ORDER BY round(score, 9) DESC, name, hit) AS INT) AS rank FROM sr)"""


@query(f"WITH {CATALOGUE}, {RANKED} SELECT platform, rank, round(score, 6) AS score FROM rk WHERE rank <= 3")
def catalogue_filter_rank(spark, d):
    return A.catalogue_filter_rank(_catalogue(spark, d), downloads=10, top=3).select("platform", "rank", r6("score", "score"))


@query(f"WITH {CATALOGUE} SELECT hit, regexp_matches(lower(name || '|' || platform), 'score|like|value|price') AS by_column, regexp_matches(lower(name), 'score|like|value|price') AS by_title FROM ct")
def completeness_flags(spark, d):
    c = _catalogue(spark, d)
    return c.select("hit", A.completeness_flags(F.array("name", "platform"), F.lit(None).cast("string"), KEYWORDS).alias("by_column"), A.completeness_flags(F.array().cast("array<string>"), F.col("name"), KEYWORDS).alias("by_title"))


@query("SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01'), 0) END AS INT) AS freshness FROM orders")
def freshness_days(spark, d):
    updated = F.when(F.col("o_orderkey") % 5 != 0, F.to_date("o_orderdate"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), A.freshness_days(updated, F.to_date(F.lit("1998-01-01"))).alias("freshness"))


@query("SELECT user_id AS id, string_agg(event_type, '|' ORDER BY event_type) AS columns, strftime(min(a), '%Y-%m-%d') || '..' || strftime(max(b), '%Y-%m-%d') AS date_range FROM (SELECT user_id, event_type, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1, 2) GROUP BY 1")
def catalogue_flatten(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(
        F.array_sort(F.collect_set("event_type")).alias("columns"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last")
    )
    return A.catalogue_flatten(rows)


@query("SELECT o_custkey AS name, min(o_orderkey) AS hit FROM orders GROUP BY 1")
def catalogue_dedupe(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("hit"))
    return A.catalogue_dedupe(rows)
