"""Registered queries do the whole job: all rows, all configurations, all features, whole texts."""

import datetime

import duckdb

from test_oracles import SF, canon
from tidemark import plans
from tidemark.operators import assess, features, model
from tidemark.sources import records


def same(spark, name, sql, *tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    out = c.execute(sql)
    names = [x[0] for x in out.description]
    df = plans.queries()[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert canon(df.select(*names).collect()) == canon(out.fetchall())


def test_coverage_is_over_all_events_and_orders(spark):
    sql = """WITH e AS (SELECT ts, epoch(ts) AS t FROM events UNION ALL SELECT o_orderdate, epoch(o_orderdate) FROM orders),
q AS (SELECT ts, floor(t) - lag(floor(t)) OVER (ORDER BY t) AS gap, floor(t) AS t FROM e)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_date, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_date,
  CAST(floor((max(t) - min(t)) / 86400) AS BIGINT) AS days, count(*) FILTER (WHERE gap > 7 * 86400) AS gaps FROM q"""
    same(spark, "temporal_coverage", sql, "events", "orders")


def test_coverage_counts_gaps(spark):
    day = lambda k, h=0: datetime.datetime(2024, 1, 1, h) + datetime.timedelta(days=k)
    rows = [(day(0),), (day(0, 9),), (day(7, 9),), (day(15),), (day(15),), (day(23, 1),), (None,)]
    r = assess.temporal_coverage(spark.createDataFrame(rows, "ts timestamp"), "ts").first()
    assert (r.first_date, r.last_date, r.days, r.gaps) == (day(0), day(23, 1), 23, 2)  # seven days sharp are no gap


SMALL = {
    "logistic": [{"C": c, "l1": 0.0, "iter": 2} for c in (0.1, 1.0, 10.0)],
    "forest": [{"trees": n, "depth": 2, "leaf": 1} for n in (1, 2)],
    "boosted": [{"trees": n, "depth": 2, "rate": 0.3, "weight": 1.0} for n in (1, 2)],
}


def test_queries_search_the_whole_grids(spark, monkeypatch):
    """Small grids stand in for param_grid(): each query tries every configuration of it."""
    asked, searched = [], []
    monkeypatch.setattr(model, "param_grid", lambda kind, ratio=1.0: asked.append(kind) or SMALL[kind])
    monkeypatch.setattr(model, "grid_search", lambda kind, grid, *a, **k: searched.append((kind, grid)) or (grid[0], [0.5]))
    rows = plans.queries()["training_summary"](spark, SF).collect()
    assert {r.model: r.configs_tried for r in rows} == {"logistic": 3, "forest": 2}
    assert plans.queries()["train_all"](spark, SF).count() == 3
    plans.queries()["grid_search_temporal"](spark, SF).collect()
    kinds = ["logistic", "forest", "logistic", "forest", "boosted", "logistic"]
    assert asked == kinds and searched == [(kind, SMALL[kind]) for kind in kinds]


def test_every_feature_is_permuted_ten_times(spark, monkeypatch):
    asked = []

    def shuffled(fitted, df, names=features.FEATURES, repeats=10, seed=42):
        asked.append((tuple(names), repeats))
        return spark.createDataFrame([(f, 0.0, 0.0) for f in names], "feature string, importance double, std double")

    monkeypatch.setattr(model, "param_grid", lambda kind, ratio=1.0: SMALL[kind])
    monkeypatch.setattr(model, "permutation_importance", shuffled)
    rows = plans.queries()["permutation_importance"](spark, SF).collect()
    assert asked == [(tuple(features.FEATURES), 10)] and len(rows) == 11


def test_bootstrap_takes_a_thousand_resamples(spark):
    sql = plans.oracle_sql()["bootstrap_ci"]
    assert "range(0, 125) r(k)" in sql and "range(0, 8) r(j)" in sql
    same(spark, "bootstrap_ci", sql, "documents", "labels")


def test_stop_terms_are_whole_lines(spark):
    sql = """SELECT DISTINCT upper(trim(regexp_replace(line, '[^ -~]', '', 'g'))) AS term FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark)
WHERE trim(regexp_replace(line, '[^ -~]', '', 'g')) NOT IN ('') AND NOT starts_with(trim(regexp_replace(line, '[^ -~]', '', 'g')), '#')"""
    same(spark, "stoplist_load", sql, "benchmark")


def test_csv_is_converted_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,title\n1,"two\nlines"\n2,NA\n')
    for _ in range(2):
        got = records.load_records(spark, str(tmp_path / "a.csv"), "id long, title string", parquet=str(tmp_path / "a.parquet"))
        assert sorted(map(tuple, got.collect())) == [(1, "two\nlines"), (2, "NA")] and all(f.endswith(".parquet") for f in got.inputFiles())
        (tmp_path / "a.csv").unlink(missing_ok=True)
