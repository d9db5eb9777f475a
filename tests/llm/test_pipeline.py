"""The pipeline on a small fixture, stage by stage, against brute force."""

import random

import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from test_bpe_packing import check_pieces
from test_langid import WORDS
from test_minhash import brute


def fixture():
    r = random.Random(3)
    rows = []
    for k in range(90):
        lang = r.choice(list(WORDS))
        words = [r.choice(WORDS[lang]) for _ in range(60)]
        if k % 9 == 0:
            words.insert(5, f"x{k}.01@mail.example.com")
        rows.append((k, " ".join(words), lang))
    rows += [(100 + k, rows[k][1], rows[k][2]) for k in range(10)]
    rows += [(200 + k, rows[k][1] + " more", rows[k][2]) for k in range(10, 20)]
    rows += [(300, None, "en"), (301, "", None), (302, "12 34 !!", "en"), (5, rows[5][1], "en")]
    return [(k, x, lang, "src", len(x or "")) for k, x, lang in rows]


def test_stages(spark, tmp_path):
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    (tmp_path / "sf").mkdir()
    df.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    docs, columns = spark.read.parquet(str(tmp_path / "sf" / "documents.parquet")), df.columns
    texts = {k: x for k, x, *_ in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path / "sf"))
        out.write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns
        if name == "language_id":
            assert sorted(r.doc_id for r in docs.collect()) == sorted(k for k, *_ in rows if k not in (300, 301, 302))
        elif name == "near_dedup":
            kept = {k for k, _, _, own in brute([x for x in texts.items() if x[0] not in (300, 301, 302)], 5) if own}
            assert sorted(r.doc_id for r in docs.collect()) == sorted(kept)
        elif name == "personal_data":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert all("@" not in x for x in texts.values()) and sum("<EMAIL>" in x for x in texts.values()) == sum(k % 9 == 0 for k in kept if k < 90)
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        else:
            tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
            check_pieces(docs.collect(), {k: [*tk.encode(x).ids, 0] for k, x in texts.items()})
    assert corpus_pipeline.run(spark, str(tmp_path / "sf")).groupBy().sum("length").first()[0] == docs.groupBy().sum("length").first()[0]


CLASHES = ["lang_pred", "score", "_score", "_node", "_key", "_digest", "row", "id", "spans", "base_spans", "_email", "_row", "_lang", "length", "start"]


def test_stages_with_odd_rows_and_clashing_columns(spark):
    rows = fixture()[:40] + [(None, "the of and to in", None, None, None), (7, None, None, None, None), (None, None, "en", "s", 0), (8, "x" * 50_000, "en", "s", 1), (9, "9 8", "fr", "", 3)]
    df = spark.createDataFrame([(*x, *CLASHES) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, "")
        got = out.collect()
        assert stage(spark, df.limit(0), "").collect() == []
        if name == "packing":
            assert sum(r.length for r in got if r.doc_id is None) == sum(r.doc_tokens for r in got if r.doc_id is None and r.start == 0)
            continue
        assert out.columns == df.columns and all(tuple(r)[5:] == tuple(CLASHES) for r in got)
        if name == "language_id":
            assert len(got) == len(rows) - 3
        elif name == "near_dedup":
            assert {(r.doc_id, r.text) for r in got} == {x[:2] for x in rows}
        else:
            assert len(got) == len(rows) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_personal_data_is_learned_from_all_texts(spark):
    """300 phones and 300 other numbers in 200,000 different texts: too few in any 50,000 for a threshold."""
    n = F.col("id")
    number = F.concat(F.lit("1 ("), (200 + n % 800).cast("string"), F.lit(") 555-"), (1000 + n % 9000).cast("string"))
    said = F.when(n % 667 == 1, F.concat(F.lit("call +"), number, F.lit(" now"))).when(n % 667 == 2, F.concat(F.lit("item #"), (1_000_000 + n * 37).cast("string"), F.lit(" sold")))
    docs = spark.range(0, 200_000, 1, 8).select(n.alias("doc_id"), F.concat(F.lit("text "), n.cast("string"), F.lit(" "), F.coalesce(said, F.lit("is clean"))).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(10**6, "call 1 (743) 555-3824 now"), (10**6 + 1, "item #3481920 sold")], docs.schema))
    got = corpus_pipeline.redact_personal_data(spark, docs, "").where("doc_id >= 1000000")
    assert {r.doc_id: r.text for r in got.collect()} == {10**6: "call <PHONE> now", 10**6 + 1: "item #3481920 sold"}
