"""Queries: loading, extraction, sentiment by lexicon."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import sentiment as S
from ..operators import pipeline as P
from ..sources import records as R
from .tables import POSTS, mentions_ev, posts_doc, query, r6, table, upto

#: A small stop-list for the invented prose.
STOP = ("THE", "OF", "AND", "TO", "IN", "IS", "DE", "LA", "EN", "MIT", "GNU")
KNOWN = ("THAT", "WITH", "WAS", "MIT", "GNU", "DER", "QUE")
#: Rules and lexicon as a table: frequent words of the invented prose with made-up values, phrases among them.
RULES = (
    *(("word", w, v) for w, v in (
        ("the", 0.5), ("of", -0.3), ("and", 0.2), ("is", 1.1), ("was", -0.9), ("with", 0.8), ("that", -0.4), ("de", 0.4), ("la", -0.2), ("que", 0.6),
        ("der", 0.3), ("die", -1.2), ("und", 0.7), ("el", 0.9), ("le", -0.5), ("on", 0.1), ("are", 1.4), ("license", -1.5), ("est", 0.65), ("ist", -0.75),
        ("of the", 1.3), ("in that", -1.7), ("de la", 0.55), ("und die", -0.35), ("released under the", 2.1),
    )),
    *(("negation", w, -0.74) for w in ("not", "no", "never", "nicht", "pas", "sin", "for")), ("negation", "hardly", -0.5), ("negation", "by", -0.6),
    *(("intensifier", w, 0.293) for w in ("very", "sehr", "très", "muy", "to")), ("intensifier", "slightly", -0.293), ("intensifier", "an", -0.2),
    *(("contrast", w, None) for w in ("but", "aber", "mais", "pero", "licensed", "or")),
)
LEXICON = tuple((w, v) for kind, w, v in RULES if kind == "word")
OTHER_LEXICON = tuple((w, -v / 2) if i % 3 == 0 else (w, v / 2) for i, (w, v) in enumerate(LEXICON))
TEXT = "coalesce(title, '') || ' ' || coalesce(body, '')"
ARRAY = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
#: DuckDB's \\b is ASCII only; tokens between anything but letters, digits and underscores say the same.
BARE_SQL = f"list_filter(regexp_split_to_array({TEXT}, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z]{{2,5}}'))"
FOUND_SQL = f"list_filter(list_distinct(list_concat(regexp_extract_all({TEXT}, '\\$([A-Z]{{1,5}})', 1), {BARE_SQL})), lambda x: NOT list_contains({ARRAY(STOP)}, x))"
EXTRACTED = f"x AS (SELECT *, array_to_string(list_sort({FOUND_SQL}), ',') AS tickers FROM posts)"


def _extracted(spark, d):
    return posts_doc(spark, d).withColumn("tickers", F.array_join(C.extract_entities(F.col("title"), F.col("body"), STOP), ","))


@query(f"WITH {POSTS}, {EXTRACTED} SELECT id, tickers FROM x")
def extract_entities(spark, d):
    return _extracted(spark, d).select("id", "tickers")


@query(f"WITH {POSTS}, {EXTRACTED} SELECT round(avg(CASE WHEN tickers = '' THEN 0 ELSE len(string_split(tickers, ',')) END), 6) AS mean_entities, round(avg(CASE WHEN tickers = '' THEN 100.0 ELSE 0 END), 6) AS none_pct FROM x")
def entity_extraction_stats(spark, d):
    n = F.size(C.extract_entities(F.col("title"), F.col("body"), STOP))
    return posts_doc(spark, d).agg(r6(F.avg(n), "mean_entities"), r6(F.avg(F.when(n == 0, 100.0).otherwise(0.0)), "none_pct"))


@query(f"WITH {POSTS}, {EXTRACTED} SELECT id FROM x WHERE trim(tickers) NOT IN ('', 'nan', 'None')")
def drop_no_entity(spark, d):
    return _extracted(spark, d).where(R.has_entity(F.col("tickers"))).select("id")


@query(f"WITH {POSTS}, {EXTRACTED} SELECT id, upper(trim(e)) AS entity, title FROM (SELECT id, title, unnest(string_split(tickers || ', ' || lower(tickers), ',')) AS e FROM x WHERE tickers <> '') WHERE trim(e) <> ''")
def explode_mentions(spark, d):
    """A supplied list with blanks, lower case and repeats."""
    listed = _extracted(spark, d).withColumn("tickers", F.when(F.col("tickers") != "", F.concat("tickers", F.lit(", "), F.lower("tickers"))).otherwise(""))
    return R.explode_mentions(listed).select("id", "entity", "title")


@query(f"WITH {POSTS}, {EXTRACTED} SELECT count(*) AS loaded, count(*) FILTER (WHERE tickers = '') AS excluded, count(*) FILTER (WHERE tickers <> '') AS retained, CAST(coalesce(sum(len(string_split(tickers, ','))) FILTER (WHERE tickers <> ''), 0) AS BIGINT) AS exploded FROM x")
def load_summary(spark, d):
    """Counted while the mentions are written, without a scan of its own."""
    run = P.load_mentions(posts_doc(spark, d), STOP)
    return spark.createDataFrame([run.counts], "loaded long, excluded long, retained long, exploded long")


@query("SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch FROM events")
def parse_time(spark, d):
    df = table(spark, d, "events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created"))
    return R.parse_time(df).select("id", "epoch")


@query("SELECT doc_id AS id, CASE WHEN text IS NULL OR doc_id % 7 < 2 THEN '' ELSE text END AS body FROM documents")
def clean_text(spark, d):
    text = F.when(F.col("doc_id") % 7 == 0, "[deleted]").when(F.col("doc_id") % 7 == 1, "[removed]").otherwise(F.col("text"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), C.clean_text(text).alias("body"))


@query(
    """WITH ln AS (SELECT trim(regexp_replace(unnest(string_split(text, chr(10))), '[^ -~]', '', 'g')) AS line FROM benchmark)
SELECT DISTINCT upper(line) AS term FROM ln WHERE line <> '' AND NOT starts_with(line, '#')"""
)
def stoplist_load(spark, d):
    """Whole lines of whole texts."""
    lines = table(spark, d, "benchmark").select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return R.stop_terms(lines.select(F.regexp_replace("line", "[^ -~]", "").alias("line")))


@query(
    """SELECT CAST(sum(('0x' || substr(md5(concat_ws('|', coalesce(event_id::VARCHAR, '~'), coalesce(user_id::VARCHAR, '~'), coalesce(event_type, '~'))), 1, 12))::BIGINT) AS VARCHAR) AS content_hash, count(*) AS n_rows,
  'event_id,event_type,user_id' AS column_names, 'ts' AS time_column, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS min_time, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS max_time, count(user_id) > 0 AS has_entities, true AS has_size FROM events"""
)
def dataset_fingerprint(spark, d):
    """The size is that of the files, which SQL does not see; here only whether it is known. A test compares it."""
    found = R.fingerprint(table(spark, d, "events"), "event_id", "user_id", "event_type", time="ts", entity="user_id")
    return found.withColumn("has_size", F.col("size_bytes") > 0).drop("size_bytes")


WORDS = "CAST(len(list_filter(regexp_split_to_array({}, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+'), lambda x: x <> '')) AS INT)"


@query(f"WITH {POSTS} SELECT id, {WORDS.format(TEXT)} AS word_count FROM posts")
def word_count(spark, d):
    return posts_doc(spark, d).select("id", C.word_count(F.col("title"), F.col("body")).alias("word_count"))


@query(f"WITH {POSTS} SELECT id, {WORDS.format('title')} AS title_length FROM posts")
def title_length(spark, d):
    return posts_doc(spark, d).select("id", C.title_length(F.col("title")).alias("title_length"))


@query(f"WITH {POSTS} SELECT id, CASE WHEN trim(body) <> '' THEN 'both' WHEN trim(title) <> '' THEN 'title' ELSE 'neutral' END AS source FROM posts")
def sentiment_text_choice(spark, d):
    p = posts_doc(spark, d)
    chosen = S.text_choice(F.col("title"), F.col("body"))
    return p.select("id", F.when(chosen.isNull(), "neutral").when(chosen == F.col("title"), "title").otherwise("both").alias("source"))


def lexicon(spark, rows=LEXICON):
    return spark.createDataFrame(list(rows), "token string, valence double")


def scored_by(spark):
    """Lexicon and rules, read from a table."""
    path = R.new_folder(spark)
    spark.createDataFrame(list(RULES), "kind string, term string, value double").write.parquet(path)
    said = spark.read.parquet(path)
    return S.lexicon_of(said), S.rules_of(said)


CHOSEN = "CASE WHEN trim(body) <> '' THEN title || ' ' || body WHEN trim(title) <> '' THEN title ELSE '' END"


def tokens_sql(rows, posts: str = "posts") -> str:
    words = ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in rows)
    of = lambda kind: {w: v for k, w, v in RULES if k == kind}
    at = lambda k: f"coalesce(CASE WHEN pos > {k} THEN l[pos - {k}] END, '')"
    value = lambda x, table: "CASE " + x + "".join(f" WHEN '{w}' THEN {v}" for w, v in table.items()) + " END"
    boost = " + ".join(f"coalesce({value(at(k), of('intensifier'))}, 0)" for k in (1, 2, 3))
    negated = f"coalesce({', '.join(value(at(k), of('negation')) for k in (1, 2, 3))}, 1)"
    return f"""lx(term, valence) AS (VALUES {words}),
tk AS (SELECT id, {CHOSEN} AS x, list_filter(regexp_split_to_array({CHOSEN}, '[^\\p{{L}}\\p{{N}}_'']+'), lambda x: x <> '') AS w FROM {posts}),
tl AS (SELECT *, list_transform(w, lambda x: lower(x)) AS l, regexp_matches(x, '[a-z]') AS mixed, least(length(regexp_replace(x, '[^!]+', '', 'g')), {S.MARKS}) AS marks FROM tk),
tc AS (SELECT *, list_max(list_transform(range(1, len(l) + 1), lambda j: CASE WHEN list_contains({ARRAY(of('contrast'))}, l[j]) THEN j ELSE 0 END)) AS last FROM tl),
tp AS (SELECT id, w, l, mixed, coalesce(last, 0) AS last, generate_subscripts(l, 1) AS pos FROM tc),
tn AS (SELECT tp.*, array_to_string(l[pos : pos + n - 1], ' ') AS term FROM tp, (VALUES (1), (2), (3)) v(n) WHERE pos + n - 1 <= len(l)),
tv AS (SELECT id, valence, {boost} + CASE WHEN mixed AND regexp_full_match(w[pos], '[A-Z]{{2,}}') THEN {S.EMPHASIS} ELSE 0 END AS boost,
  {negated} * CASE WHEN last = 0 OR pos = last THEN 1 WHEN pos < last THEN {S.BEFORE_CONTRAST} ELSE {S.AFTER_CONTRAST} END AS factor FROM tn JOIN lx USING (term))"""


SUMMED = f"""ts AS (SELECT id, sum((valence + sign(valence) * boost) * factor) AS s0 FROM tv GROUP BY id),
t1 AS (SELECT tl.id, s0 + sign(s0) * {S.EXCLAIMED} * marks AS s FROM tl JOIN ts USING (id)),
pl AS (SELECT tl.id, coalesce(s / sqrt(s * s + 15), 0.0) AS polarity FROM tl LEFT JOIN t1 USING (id))"""
MEANS = "pm AS (SELECT tl.id, coalesce(m, 0.0) AS polarity FROM tl LEFT JOIN (SELECT id, avg(greatest(least((valence + sign(valence) * boost) * factor, 1), -1)) AS m FROM tv GROUP BY id) q ON tl.id = q.id)"


def _text():
    return S.text_choice(F.col("title"), F.col("body"))


@query(f"WITH {POSTS}, {tokens_sql(LEXICON)}, {SUMMED} SELECT id, round(polarity, 6) AS polarity FROM pl")
def lexicon_polarity(spark, d):
    terms, rules = scored_by(spark)
    return S.lexicon_polarity(posts_doc(spark, d), terms, _text(), rules=rules).select("id", r6("polarity", "polarity"))


@query(f"WITH {POSTS}, {tokens_sql(LEXICON)}, {MEANS} SELECT id, round(polarity, 12) AS polarity FROM pm")
def mean_lexicon_polarity(spark, d):
    terms, rules = scored_by(spark)
    return S.mean_lexicon_polarity(posts_doc(spark, d), terms, _text(), rules=rules).select("id", F.round("polarity", 12).alias("polarity"))


MENTIONED = "mn AS (SELECT id, 'E' || (id % 5) AS entity, id % 3 = 0 AS excluded FROM posts UNION ALL SELECT id, 'F', id % 2 = 0 FROM posts WHERE id % 4 = 0)"


def _mentions(spark, d):
    p = posts_doc(spark, d)
    one = p.select("id", F.concat(F.lit("E"), (F.col("id") % 5).cast("string")).alias("entity"), (F.col("id") % 3 == 0).alias("excluded"))
    return one.unionByName(p.where("id % 4 = 0").select("id", F.lit("F").alias("entity"), (F.col("id") % 2 == 0).alias("excluded")))


@query(f"WITH {POSTS}, {tokens_sql(LEXICON)}, {SUMMED}, {MENTIONED} SELECT mn.id, entity, excluded, round(CASE WHEN excluded THEN 0.0 ELSE polarity END, 6) AS polarity FROM mn JOIN pl ON mn.id = pl.id")
def polarity_included_only(spark, d):
    terms, rules = scored_by(spark)
    df = S.polarity_included_only(_mentions(spark, d), posts_doc(spark, d), terms, _text(), rules=rules)
    return df.select("id", "entity", "excluded", r6("polarity", "polarity"))


AGREE = "CASE WHEN {0} > 0.05 THEN 1 WHEN {0} < -0.05 THEN -1 ELSE 0 END"


@query(
    f"WITH {POSTS}, {tokens_sql(LEXICON)}, {SUMMED}, {MEANS}, ag AS (SELECT avg(CASE WHEN {AGREE.format('pl.polarity')} = {AGREE.format('pm.polarity')} THEN 1.0 ELSE 0 END) AS a FROM pl JOIN pm ON pl.id = pm.id)"
    " SELECT round(a, 6) AS agreement, CASE WHEN a >= 0.7 THEN 'good' WHEN a >= 0.5 THEN 'moderate' ELSE 'low' END AS note FROM ag"
)
def polarity_agreement(spark, d):
    """The two scorers on the same texts."""
    from ..operators.assess import polarity_agreement as agreement

    terms, rules = scored_by(spark)
    p = S.lexicon_polarity(posts_doc(spark, d), terms, _text(), rules=rules)
    q = S.mean_lexicon_polarity(posts_doc(spark, d), terms, _text(), rules=rules).withColumnRenamed("polarity", "q")
    out = p.join(q, "id").agg(*agreement(C.polarity_class(F.col("polarity")), C.polarity_class(F.col("q"))))
    return out.withColumn("agreement", F.round("agreement", 6))


@query(upto("w") + "SELECT CASE WHEN count(*) FILTER (WHERE polarity < -0.05) > 0 THEN round(count(*) FILTER (WHERE polarity > 0.05) / count(*) FILTER (WHERE polarity < -0.05), 2) WHEN count(*) FILTER (WHERE polarity > 0.05) > 0 THEN 999 ELSE 0 END AS ratio FROM ev")
def bull_bear_ratio(spark, d):
    from ..operators.assess import bull_bear_ratio as ratio

    return mentions_ev(spark, d).agg(ratio(F.col("polarity")).alias("ratio"))


TAGS = "regexp_extract_all(text, '\\$([A-Z]{2,5})\\b', 1)"
WHOLE = "list_filter(regexp_split_to_array(coalesce(text, ''), '[^\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z]{2,5}'))"


@query(f"SELECT doc_id AS id, array_to_string(list_sort(list_distinct(list_concat({TAGS}, list_filter({WHOLE}, lambda x: list_contains({ARRAY(KNOWN)}, x))))), ',') AS entities FROM documents")
def known_entity_extract(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_join(C.known_entities(F.coalesce("text", F.lit("")), KNOWN), ",").alias("entities"))


@query(f"SELECT doc_id AS id, coalesce({TAGS}[1], list_filter({WHOLE}, lambda x: list_contains({ARRAY(KNOWN)}, x))[1], 'UNKNOWN') AS entity FROM documents")
def first_entity(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), C.first_entity(F.coalesce("text", F.lit("")), KNOWN).alias("entity"))


@query(f"WITH {POSTS}, {tokens_sql(LEXICON)}, {SUMMED} SELECT id, round(polarity, 6) AS polarity FROM pl")
def backend_select(spark, d):
    """An unknown name falls back to the default scorer, with a warning."""
    import warnings

    with warnings.catch_warnings(record=True):
        warnings.simplefilter("always")
        scorer = S.backend("no such backend")
    terms, rules = scored_by(spark)
    return scorer(posts_doc(spark, d), terms, _text(), rules=rules).select("id", r6("polarity", "polarity"))
