"""Queries: metrics, curves, tests and intervals over labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import apply_threshold as at_least
from ..operators import evaluate as E
from ..operators import features, label
from ..sources.records import settle
from .bursts import FEAT
from .tables import SCORED, by_model, mentions_ev, query, r6, scored_lab, upto

CELLS = """count(*) FILTER (WHERE y = 0 AND prob < 0.5) AS tn, count(*) FILTER (WHERE y = 0 AND prob >= 0.5) AS fp,
  count(*) FILTER (WHERE y = 1 AND prob < 0.5) AS fn, count(*) FILTER (WHERE y = 1 AND prob >= 0.5) AS tp"""
SCORES = """round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS "precision",
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1"""
AUC = """st AS (SELECT {0}prob, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM {1} GROUP BY {0}prob),
wn AS (SELECT *, pos * (coalesce(sum(neg) OVER (PARTITION BY {2} ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2.0) AS wins FROM st),
au AS (SELECT {0}CASE WHEN sum(pos) * sum(neg) = 0 THEN 0.5 ELSE sum(wins) / (sum(pos) * sum(neg)) END AS auc FROM wn GROUP BY {2})"""
MODEL_AUC = AUC.format("model, ", "bm", "model")
CURVE = """th AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(1, 100) r(i)),
cc AS (SELECT model, threshold, count(*) FILTER (WHERE y = 0 AND prob < threshold) AS tn, count(*) FILTER (WHERE y = 0 AND prob >= threshold) AS fp,
  count(*) FILTER (WHERE y = 1 AND prob < threshold) AS fn, count(*) FILTER (WHERE y = 1 AND prob >= threshold) AS tp FROM bm, th GROUP BY model, threshold),
cv AS (SELECT model, threshold, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS "precision", CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM cc)"""
BEST = """bt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY {0}round(f1, 12) DESC, threshold) AS r FROM cv) WHERE r = 1)"""
FOUR = ("threshold", "precision", "recall", "f1")


def _models(spark, d):
    return by_model(scored_lab(spark, d))


def _rounded(df, *by, names=FOUR):
    return df.select(*by, *[r6(c, c) for c in names])


@query(f"WITH {SCORED} SELECT id, CAST(prob_a >= 0.25 AS INT) AS pred FROM sc")
def apply_threshold(spark, d):
    return scored_lab(spark, d).select("id", at_least(F.col("prob_a"), 0.25).alias("pred"))


SHARES = ", ".join(f"round({c} * 100.0 / (tn + fp + fn + tp), 6) AS {c}_pct" for c in ("tn", "fp", "fn", "tp"))


@query(f"WITH {SCORED}, cm AS (SELECT model, {CELLS} FROM bm GROUP BY model) SELECT *, {SHARES} FROM cm")
def confusion_matrix(spark, d):
    df = E.with_shares(E.confusion_matrix(_models(spark, d), at_least(F.col("prob")), "model"))
    return df.withColumns({f"{c}_pct": F.round(f"{c}_pct", 6) for c in ("tn", "fp", "fn", "tp")})


@query(f"WITH {SCORED}, cm AS (SELECT model, {CELLS} FROM bm GROUP BY model) SELECT model, {SCORES}, tn + fp AS support_0, tp + fn AS support_1 FROM cm")
def classification_metrics(spark, d):
    df = E.classification_metrics(_models(spark, d), at_least(F.col("prob")), "model")
    return _rounded(df, "model", "support_0", "support_1", names=("accuracy", "precision", "recall", "f1"))


@query(f"WITH {SCORED}, {MODEL_AUC} SELECT model, round(auc, 6) AS auc FROM au")
def roc_auc(spark, d):
    return E.roc_auc(_models(spark, d), "model").select("model", r6("auc", "auc"))


@query(
    f"""WITH {SCORED}, {MODEL_AUC} SELECT model, round(prob, 6) AS threshold, round(sum(neg) OVER (PARTITION BY model ORDER BY prob DESC) / sum(neg) OVER (PARTITION BY model), 6) AS fpr,
  round(sum(pos) OVER (PARTITION BY model ORDER BY prob DESC) / sum(pos) OVER (PARTITION BY model), 6) AS tpr FROM st"""
)
def roc_curve_points(spark, d):
    return _rounded(E.roc_curve(_models(spark, d), "model"), "model", names=("threshold", "fpr", "tpr"))


@query(f'WITH {SCORED}, {CURVE} SELECT model, round(threshold, 6) AS threshold, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM cv')
def threshold_curve(spark, d):
    return _rounded(E.threshold_curve(_models(spark, d), "model"), "model")


@query(f'WITH {SCORED}, {CURVE}, {BEST.format("")} SELECT model, round(threshold, 6) AS threshold, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM bt')
def optimal_threshold(spark, d):
    return _rounded(E.optimal_threshold(E.threshold_curve(_models(spark, d), "model"), "model"), "model")


FLOOR = 'CASE WHEN "precision" >= 0.88 THEN 0 ELSE 1 END, '


@query(f'WITH {SCORED}, {CURVE}, {BEST.format(FLOOR)} SELECT model, round(threshold, 6) AS threshold, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM bt')
def optimal_threshold_floor(spark, d):
    curve = E.threshold_curve(_models(spark, d), "model")
    return _rounded(E.optimal_threshold(curve, "model", strategy="precision_floor", floor=0.88), "model")


@query(
    f'WITH {SCORED}, {CURVE}, {BEST.format("")} SELECT bt.model, round(bt.threshold, 6) AS tuned_threshold, round(bt.f1, 6) AS tuned_f1, round(cv.f1, 6) AS default_f1, round(bt.f1 - cv.f1, 6) AS f1_gain FROM bt JOIN cv ON bt.model = cv.model AND cv.threshold = 0.5'
)
def tuned_vs_default(spark, d):
    return _rounded(E.tuned_vs_default(_models(spark, d), "model"), "model", names=("tuned_threshold", "tuned_f1", "default_f1", "f1_gain"))


POLY = "0.0"
for _c in reversed(E.ERFC):
    POLY = f"({POLY} * t + ({_c}))"
MCNEMAR = f"""rt AS (SELECT id, model, (prob >= 0.5) = (y = 1) AS ok FROM bm),
pr AS (SELECT a.model AS model_a, b.model AS model_b, count(*) FILTER (WHERE a.ok AND NOT b.ok) AS b, count(*) FILTER (WHERE NOT a.ok AND b.ok) AS c
  FROM rt a JOIN rt b ON a.id = b.id AND a.model < b.model GROUP BY 1, 2),
p1 AS (SELECT *, CASE WHEN b + c = 0 THEN 0 ELSE (b - c) * (b - c) / (b + c) END AS statistic, 0.05 / count(*) OVER () AS corrected_alpha FROM pr),
p2 AS (SELECT *, sqrt(statistic / 2) AS x, 1 / (1 + 0.5::DOUBLE * sqrt(statistic / 2)) AS t FROM p1),
p3 AS (SELECT *, CASE WHEN b + c = 0 THEN 1 WHEN b + c < 25 THEN least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda k: factorial(CAST(b + c AS INT)) / (factorial(CAST(k AS INT)) * factorial(CAST(b + c - k AS INT))))) / pow(2, b + c))
  ELSE t * exp({POLY} - x * x) END AS p_value FROM p2),
mc AS (SELECT model_a, model_b, b, c, statistic, p_value, corrected_alpha, p_value < corrected_alpha AS significant FROM p3)"""


@query(f"WITH {SCORED}, {MCNEMAR} SELECT model_a, model_b, b, c, round(statistic, 6) AS statistic, round(p_value, 9) AS p_value, round(log10(p_value), 5) AS log10_p, round(corrected_alpha, 6) AS corrected_alpha, significant FROM mc")
def mcnemar_pairwise(spark, d):
    df = _mcnemar(spark, d)
    # beyond the smallest double p is 0, whose logarithm Spark takes as null
    log = F.when(F.col("p_value") == 0, float("-inf")).otherwise(F.log10("p_value"))
    return df.select("model_a", "model_b", "b", "c", r6("statistic", "statistic"), F.round("p_value", 9).alias("p_value"), F.round(log, 5).alias("log10_p"), r6("corrected_alpha", "corrected_alpha"), "significant")


def _mcnemar(spark, d):
    return E.mcnemar(_models(spark, d).select("id", "model", "y", at_least(F.col("prob")).alias("pred")))


#: Scores of two plain models over the features, which SQL can say as well.
PLAIN_MODELS = {"rate_and_gap": "entity_rate_24h - 0.25 * time_since_previous", "mood_and_rate": "0.5 * sentiment_score + 0.1 * acceleration_12h - 0.05 * entity_rate_24h"}
_long = lambda names: " UNION ALL ".join(f"SELECT partition, y, '{k}' AS name, round(CAST({x} AS DOUBLE), 9) AS prob FROM fy" for k, x in names.items())
BASELINES = ",\n".join([
    FEAT.replace("FROM s)", "FROM l)"), "fy AS (SELECT *, CASE WHEN composite > 0.5 THEN 1 ELSE 0 END AS y FROM fa WHERE NOT excluded)",
    f"lo AS ({_long({f: f for f in features.FEATURES})})", f"lm AS ({_long(PLAIN_MODELS)})",
    "sl AS (SELECT name, avg(prob) FILTER (WHERE y = 1) - avg(prob) FILTER (WHERE y = 0) AS rise FROM lo WHERE partition = 'train' GROUP BY name)",
    AUC.format("name, ", "(SELECT * FROM lo WHERE partition = 'test')", "name"),
    "fe AS (SELECT au.name, CASE WHEN rise < 0 THEN 1 - auc ELSE auc END AS auc FROM au JOIN sl ON au.name = sl.name)",
    AUC.format("name, ", "(SELECT * FROM lm WHERE partition = 'test')", "name").replace("st AS", "st2 AS").replace("FROM st)", "FROM st2)").replace("wn AS", "wn2 AS").replace("FROM wn ", "FROM wn2 ").replace("au AS", "au2 AS"),
    "be AS (SELECT name AS best_feature, auc AS best_auc FROM fe ORDER BY auc DESC, name LIMIT 1)",
])


@query(
    upto("l", BASELINES)
    + """SELECT name, 'feature' AS kind, round(auc, 6) AS auc, best_feature, round(best_auc, 6) AS best_auc, CAST(NULL AS DOUBLE) AS improvement, CAST(NULL AS BOOLEAN) AS beats_best, auc > 0.5 AS beats_chance FROM fe, be
UNION ALL SELECT name, 'model', round(auc, 6), best_feature, round(best_auc, 6), round(auc - best_auc, 6), auc > best_auc, auc > 0.5 FROM au2, be"""
)
def single_feature_baselines(spark, d):
    """Each of the eleven features alone, the best of them, and two plain models against it."""
    df = features.features_all(label.apply_labelling(settle(label.through_sentiment(mentions_ev(spark, d), with_features=True)), tau=0.5))
    df = df.where(~F.col("excluded")).withColumn("y", F.col("surge_label").cast("int"))
    rows = settle(df.select("partition", "y", *[F.round(F.col(f).cast("double"), 9).alias(f) for f in features.FEATURES], *[F.round(F.expr(x).cast("double"), 9).alias(k) for k, x in PLAIN_MODELS.items()]))
    alone = settle(E.single_feature_auc(rows, features.FEATURES))
    scores = rows.where("partition = 'test'").select("y", *PLAIN_MODELS).unpivot(["y"], list(PLAIN_MODELS), "model", "prob")
    compared = E.baseline_comparison(alone, E.roc_auc(scores, "model"))
    best = compared.select("best_feature", "best_auc").distinct()
    shown = lambda df, name, kind, own: df.select(F.col(name).alias("name"), F.lit(kind).alias("kind"), r6("auc", "auc"), "best_feature", r6("best_auc", "best_auc"), *own, (F.col("auc") > 0.5).alias("beats_chance"))
    none = [F.lit(None).cast("double").alias("improvement"), F.lit(None).cast("boolean").alias("beats_best")]
    return shown(alone.crossJoin(best), "feature", "feature", none).unionByName(shown(compared, "model", "model", [r6("improvement", "improvement"), "beats_best"]))


TIER = "CASE WHEN auc > 0.8 THEN 'stretch' WHEN auc > 0.7 THEN 'target' WHEN auc > 0.6 THEN 'minimum' ELSE 'below' END"


@query(f"WITH {SCORED}, {MODEL_AUC}, four AS (SELECT model || k AS model, auc + k / 8.0 AS auc FROM au, (VALUES (0), (1), (2)) v(k)) SELECT model, {TIER} AS tier FROM four")
def success_tiers(spark, d):
    df = E.roc_auc(_models(spark, d), "model").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return df.select(F.concat("model", F.col("k").cast("string")).alias("model"), E.tier(F.col("auc") + F.col("k") / 8.0).alias("tier"))


U = "(('0x' || substr(h, 1 + 4 * j, 4))::BIGINT / 65536.0::DOUBLE)"
POISSON = " + ".join(f"CAST({U} >= {x} AS INT)" for x in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582))
BOOT = f"""hs AS (SELECT y, prob_c AS prob, k, md5(concat_ws(':', id, k, 42)) AS h FROM sc, range(0, 125) r(k)),
wt AS (SELECT k * 8 + j + 1 AS b, y, prob, {POISSON} AS w FROM hs, range(0, 8) r(j)),
st AS (SELECT b, prob, sum(w) FILTER (WHERE y = 1) AS p0, sum(w) FILTER (WHERE y = 0) AS n0 FROM wt WHERE w > 0 GROUP BY b, prob),
s2 AS (SELECT b, prob, coalesce(p0, 0) AS pos, coalesce(n0, 0) AS neg FROM st),
wn AS (SELECT *, pos * (coalesce(sum(neg) OVER (PARTITION BY b ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2.0) AS wins FROM s2),
ce AS (SELECT b, coalesce(sum(pos) FILTER (WHERE prob >= 0.5), 0)::DOUBLE AS tp, coalesce(sum(neg) FILTER (WHERE prob >= 0.5), 0)::DOUBLE AS fp, coalesce(sum(pos) FILTER (WHERE prob < 0.5), 0)::DOUBLE AS fn,
  coalesce(sum(neg) FILTER (WHERE prob < 0.5), 0)::DOUBLE AS tn, sum(wins) AS wins FROM wn GROUP BY b),
bb AS (SELECT b, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS "precision", CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, wins / ((tp + fn) * (fp + tn)) AS auc FROM ce)"""


@query(f"WITH {SCORED}, {BOOT} " + " UNION ALL ".join(f"""SELECT '{m}' AS metric, round(quantile_cont("{m}", 0.025), 6) AS low, round(quantile_cont("{m}", 0.975), 6) AS high FROM bb""" for m in ("precision", "recall", "f1", "auc")))
def bootstrap_ci(spark, d):
    """1,000 resamples."""
    rows = scored_lab(spark, d).select("id", "y", F.col("prob_c").alias("prob"))
    return E.bootstrap_ci(rows, 1000).select("metric", r6("low", "low"), r6("high", "high"))


@query(f"WITH {SCORED}, {MODEL_AUC} SELECT model AS feature, CAST(row_number() OVER (ORDER BY auc DESC, model) AS INT) AS rank FROM au")
def importance_rank(spark, d):
    auc = E.roc_auc(_models(spark, d), "model").select(F.col("model").alias("feature"), F.col("auc").alias("importance"))
    return E.importance_rank(auc).select("feature", "rank")


@query(
    f"""WITH {SCORED}, {MODEL_AUC}, {MCNEMAR}, b AS (SELECT * FROM au ORDER BY auc DESC, model DESC LIMIT 1)
SELECT model AS best_model, round(auc, 6) AS best_auc, {TIER} AS tier, CAST(auc > 0.6 AS INT) AS any_minimum, 1.5 AS recommended_tau, 0.5 AS recommended_weight_sentiment,
  (SELECT string_agg(model || ' ' || printf('%.5f', auc) || ' ' || {TIER}, ';' ORDER BY model) FROM au) AS models,
  (SELECT string_agg(model_a || ' ' || model_b || ' ' || b || ' ' || c || ' ' || significant, ';' ORDER BY model_a, model_b) FROM mc) AS tests,
  (SELECT string_agg(model || ' ' || printf('%.5f', auc - (SELECT auc FROM au WHERE model = 'prob_c')) || ' ' || (auc > (SELECT auc FROM au WHERE model = 'prob_c')), ';' ORDER BY model) FROM au) AS baselines FROM b"""
)
def best_model_summary(spark, d):
    """With all that it rests on: each model's area and tier, the pairwise tests, and each model against the length of the text alone."""
    auc = settle(E.roc_auc(_models(spark, d), "model"))
    alone = auc.where("model = 'prob_c'").select(F.lit("n_chars").alias("feature"), "auc")
    s = E.best_model_summary(auc, tests=_mcnemar(spark, d), baselines=E.baseline_comparison(alone, auc))
    listed = lambda column, form, *names: F.array_join(F.transform(column, lambda x: F.format_string(form, *[x[n] for n in names])), ";").alias(column)
    return s.select(
        "best_model", r6("best_auc", "best_auc"), "tier", "any_minimum", "recommended_tau", "recommended_weight_sentiment", listed("models", "%s %.5f %s", "model", "auc", "tier"),
        listed("tests", "%s %s %d %d %s", "model_a", "model_b", "b", "c", "significant"), listed("baselines", "%s %.5f %s", "model", "improvement", "beats_best"),
    )


@query(
    f"""WITH {SCORED}, oc AS (SELECT id, prob_a AS prob, prob_c, n_chars, CASE WHEN y = 1 AND prob_a >= 0.5 THEN 'TP' WHEN y = 0 AND prob_a >= 0.5 THEN 'FP' WHEN y = 1 THEN 'FN' ELSE 'TN' END AS outcome FROM sc),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY outcome ORDER BY CASE WHEN prob >= 0.5 THEN -prob ELSE prob END, id) AS INT) AS rank, count(*) OVER (PARTITION BY outcome) AS outcome_count FROM oc)
SELECT outcome, outcome_count, rank, id, round(prob, 4) AS prob, n_chars, round(prob_c, 4) AS length_share FROM rk WHERE rank <= 5"""
)
def prediction_examples(spark, d):
    rows = scored_lab(spark, d).withColumnsRenamed({"prob_a": "prob", "prob_c": "length_share"})
    return E.prediction_examples(rows, context=["length_share"]).select("outcome", "outcome_count", "rank", "id", "prob", "n_chars", "length_share")
