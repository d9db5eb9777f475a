"""Null ids, and different texts under one id: no clean document goes."""

import random

import corpus_pipeline
from tidemark.llm import minhash


def text(seed, n=60):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


ROWS = [
    (1, text(1)), (1, text(2)), (1, text(3)),  # equally large sets under one id
    (2, text(2) + " more"),  # near the second text of id 1
    (3, text(4)), (None, text(4) + " more"),  # null ids come last
    (None, text(5)), (None, text(5) + " more"), (None, text(6)), (None, text(6)),
    (4, text(7)), (4, text(7)),
    (0, text(3) + " more"),  # the smaller id stays
]


def test_pipeline_keeps_one_of_each_group(spark):
    df = spark.createDataFrame([(k, x, "en", "s", len(x)) for k, x in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    fifth = [x for x in got if x[0] is None and x[1].startswith(text(5))]
    assert len(fifth) == 1
    want = [(1, text(1)), (1, text(2)), (0, text(3) + " more"), (3, text(4)), *fifth, (None, text(6)), (4, text(7))]
    assert got == sorted(want, key=str)


def test_operator_tells_texts_of_one_id_apart(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    rows = minhash.near_duplicates(df).collect()
    assert len(rows) == len(ROWS)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in rows), key=str)
    first = [(None, None, True), (None, None, False)]
    want = [(1, 1, True), (1, 1, True), (1, 0, False), (2, 1, False), (3, 3, True), (None, 3, False), *first, (None, None, True), (None, None, True), (4, 4, True), (4, 4, True), (0, 0, True)]
    assert got == sorted(want, key=str)
