"""Sentiment by rules, whole runs over a few records, fingerprints and the final summary, against values by hand."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions import sentiment as S
from tidemark.operators import evaluate, pipeline
from tidemark.sources import records

TABLE = [
    ("word", "good", 2.0), ("word", "bad", -1.5), ("word", "good grief", -1.0), ("word", "Ok", 0.5),
    ("negation", "not", None), ("negation", "hardly", -0.5), ("intensifier", "very", None), ("intensifier", "slightly", -0.3), ("contrast", "but", None),
]


def score(s):
    return s / math.sqrt(s * s + 15)


CASES = {
    "good": score(2), "GOOD": score(2), "so GOOD": score(2 + 0.733), "not good": score(2 * -0.74), "hardly a good": score(2 * -0.5),
    "not a very good": score((2 + 0.293) * -0.74), "not so far very good": score(2.293), "very very good": score(2 + 0.586), "slightly bad": score(-1.5 + 0.3),
    "good but bad": score(2 * 0.5 - 1.5 * 1.5), "bad but good but ok": score(-1.5 * 0.5 + 2 * 0.5 + 0.5 * 1.5), "good grief": score(2 - 1),
    "good!!": score(2 + 2 * 0.292), "bad!!!!!!": score(-1.5 - 4 * 0.292), "nothing!": 0.0, "": 0.0, "good's": 0.0,
}


def lexicon(spark):
    table = spark.createDataFrame(TABLE, "kind string, term string, value double")
    return S.lexicon_of(table), S.rules_of(table)


def test_rules(spark, monkeypatch):
    terms, rules = lexicon(spark)
    assert rules.negations == {"not": -0.74, "hardly": -0.5} and rules.contrasts == ("but",)
    df = spark.createDataFrame([(k, x) for k, x in enumerate(CASES)] + [(99, None)], "id long, text string")
    want = dict(enumerate(CASES.values())) | {99: 0.0}
    for most in (S.MOST_TERMS, 0):  # a large lexicon is joined without a look first
        monkeypatch.setattr(S, "MOST_TERMS", most)
        got = {r.id: r.polarity for r in S.lexicon_polarity(df, terms, F.col("text"), rules=rules).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want), {k: (list(CASES)[k], got[k], want[k]) for k in want if k < 99 and abs(got[k] - want[k]) > 1e-12}
    mean = {r.id: r.polarity for r in S.mean_lexicon_polarity(df, terms, F.col("text"), rules=rules).collect()}
    assert mean[0] == 1.0 and mean[3] == -1.0 and mean[4] == -1.0 and abs(mean[list(CASES).index("slightly bad")] + 1.0) < 1e-12 and mean[99] == 0.0
    assert S.lexicon_polarity(df.limit(0), terms, F.col("text"), rules=rules).collect() == []
    with pytest.raises(ValueError):
        S.rules_of(spark.range(1200).select(F.lit("negation").alias("kind"), F.col("id").cast("string").alias("term"), F.lit(1.0).alias("value")))


def test_a_run_from_records_to_labels(spark, tmp_path):
    hours = [0, 2, 5, 9, 30, 31, 80]
    texts = ["$AA good", "$AA bad $BB", "nothing here", "$AA very good", "$AA bad", "$BB $AA good", "$AA bad!"]
    rows = [(k, x, "", h * 3600) for k, (x, h) in enumerate(zip(texts, hours))]
    df = spark.createDataFrame(rows, "id long, title string, body string, s long").withColumn("created", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")
    terms, rules = lexicon(spark)
    run = pipeline.run_pipeline(df, terms, ("THE",), rules, tau=0.1)
    got = {(r.id, r.entity): r for r in run.rows.collect()}
    assert run.counts == {"loaded": 7, "excluded": 1, "retained": 6, "exploded": 8, "windowed": 8, "excluded_count": 4, "included": 4, "bulls": 2, "bears": 2}
    assert {k for k, r in got.items() if r.excluded} == {(1, "BB"), (5, "AA"), (5, "BB"), (6, "AA")}
    assert abs(got[0, "AA"].sentiment_polarity - score(2)) < 1e-12
    ahead = [score(-1.5), score(2.293)]
    assert abs(got[0, "AA"].mean_future_sentiment - sum(ahead) / 2) < 1e-8
    records.write_summary(pipeline.summary(run, records.fingerprint(df, "id", "title")), str(tmp_path / "s"))
    (part,) = [x for x in os.listdir(tmp_path / "s") if x.endswith(".json")]
    said = json.loads((tmp_path / "s" / part).read_text())
    assert said["stages"] == run.counts and said["config"]["tau"] == 0.1 and set(said["seconds"]) == {"load", "window", "sentiment"}
    assert said["distributions"]["all"]["total"] == 4 == said["fit"]["train_size"] + said["fit"]["test_size"] and said["fingerprint"]["n_rows"] == 7
    assert said["exclusion_rate"] == 50.0


def test_an_empty_run(spark):
    terms, rules = lexicon(spark)
    df = spark.createDataFrame([], "id long, title string, body string, created timestamp_ntz")
    run = pipeline.run_pipeline(df, terms, (), rules)
    assert run.rows.collect() == [] and set(run.counts.values()) == {0}
    assert pipeline.counts_row(run).first().exclusion_rate == 0.0


def test_fingerprint_of_files(spark, tmp_path):
    df = spark.range(100).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.when(F.col("id") < 0, "e").alias("entity"))
    df.repartition(3).write.parquet(str(tmp_path / "a"))
    df.coalesce(1).write.parquet(str(tmp_path / "b"))
    a, b = (records.fingerprint(spark.read.parquet(str(tmp_path / x)), "id", "ts", time="ts", entity="entity").first() for x in "ab")
    for got, x in ((a, "a"), (b, "b")):
        assert got.size_bytes == sum(os.path.getsize(tmp_path / x / f) for f in os.listdir(tmp_path / x) if f.endswith(".parquet"))
    assert a.content_hash == b.content_hash and a.n_rows == 100 and not a.has_entities and (a.min_time, a.max_time) == ("1970-01-01 00:00:00", "1970-01-01 01:39:00")
    memory = records.fingerprint(df, "id", "ts").first()
    assert memory.content_hash == a.content_hash and memory.size_bytes is None and memory.min_time is None
    assert records.fingerprint(df.limit(0), "id").first().n_rows == 0


def test_tail_of_the_normal_distribution(spark):
    xs = [0.0, 1e-3, 0.3, 1.0, 2.5, 5.0, 9.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(evaluate._erfc(F.col("x"))).collect()]
    assert all(abs(g / math.erfc(x) - 1) < 2e-7 for g, x in zip(got, xs))


def test_final_summary_holds_what_it_rests_on(spark):
    auc = spark.createDataFrame([("a", 0.65), ("b", 0.82), ("c", 0.5)], "model string, auc double")
    alone = spark.createDataFrame([("f", 0.6), ("g", 0.7), ("h", 0.7)], "feature string, auc double")
    compared = evaluate.baseline_comparison(alone, auc)
    got = {r.model: r for r in compared.collect()}
    assert got["b"].best_feature == "g" and abs(got["b"].improvement - 0.12) < 1e-12 and got["b"].beats_best and not got["a"].beats_best and not got["c"].beats_chance
    s = evaluate.best_model_summary(auc, baselines=compared).first()
    assert (s.best_model, s.tier, s.any_minimum, [(m.model, m.tier) for m in s.models]) == ("b", "stretch", 1, [("a", "minimum"), ("b", "stretch"), ("c", "below")])
    assert [x.model for x in s.baselines] == ["a", "b", "c"]


def test_settled_tables_are_cleared(spark):
    kept = records.settle(spark.range(3))
    folder = kept.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert os.path.isdir(folder) and kept.count() == 3
    assert records.clear_settled(spark) >= 1 and not os.path.exists(folder) and records.clear_settled(spark) == 0
