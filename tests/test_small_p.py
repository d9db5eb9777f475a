"""Pairwise tests over so many rows that p is below the smallest double."""

import duckdb
from pyspark.sql import functions as F
from test_oracles import canon

from tidemark import plans


def test_log_of_a_vanishing_p_equals_sql(spark, tmp_path):
    ids = spark.range(1, 9001).withColumnRenamed("id", "doc_id")
    # texts are short but for one, so that prob_c says 0 throughout, and prob_a and prob_b are about as often right
    docs = ids.withColumn("n_chars", F.when(F.col("doc_id") == 1, 10_000).otherwise(10).cast("long")).withColumn("text", F.lit("x"))
    labels = ids.withColumn("quality", (F.pmod(F.col("doc_id") * 7919, F.lit(1000)) >= 500).cast("int")).withColumn("toxic", F.lit(0))
    c = duckdb.connect()
    for name, df in (("documents", docs), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        c.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    out = c.execute(plans.oracle_sql()["mcnemar_pairwise"])
    names = [x[0] for x in out.description]
    want = out.fetchall()
    got = plans.queries()["mcnemar_pairwise"](spark, str(tmp_path)).select(*names).collect()
    assert any(dict(zip(names, r, strict=True))["log10_p"] == float("-inf") for r in want)
    assert canon(got) == canon(want)
