import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid

WORDS = {
    "en": "the of and to in that is was with for on thing ing tion her".split(),
    "de": "der die und das nicht ist mit für auch schön über keit lich sch".split(),
    "fr": "le la de les que est une pour dans elle été où naître ment".split(),
    "es": "el los que una por con para ción año señor está más ado".split(),
}


def rows(n=600):
    r = random.Random(1)
    out = []
    for k in range(n):
        lang = r.choice(list(WORDS))
        out.append((k, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(5, 60))), lang))
    return out


def test_held_out_accuracy_and_edges(spark):
    data = [*rows(), (9001, None, "en"), (9002, "", None), (9003, "123 !? 45", "en"), (9004, "the of and " * 9000, None), (None, "der die das", "de")]
    df = spark.createDataFrame([(*x, 0.5) for x in data], "doc_id long, text string, lang string, score double")
    model = langid.fit(df.where(~langid.held_out(F.col("doc_id"))), per_language=60)
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    got = {r.doc_id: r for r in langid.predict(df.drop("score"), model).withColumn("h", langid.held_out(F.col("doc_id"))).collect()}
    assert all(got[k].h == (zlib.crc32(str(k).encode()) % 3 == 1) for k, _, _ in data if k is not None)
    tried = [(k, lang) for k, _, lang in data if k is not None and k < 9000 and got[k].h]
    assert sum(got[k].lang_pred == lang for k, lang in tried) / len(tried) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[k].lang_pred for k in (9001, 9002, 9003, 9004, None)] == ["und", "und", "und", "en", "de"]


def test_few_classes(spark):
    df = spark.createDataFrame([(1, "abc", "xx"), (2, None, None)], "doc_id long, text string, lang string")
    one = langid.fit(df)
    assert [tuple(r)[-2:] for r in langid.predict(df, one).collect()] == [("xx", 1.0), ("und", 0.0)]
    none = langid.fit(df.limit(0))
    assert langid.predict(df, none).first().lang_pred == "und"
    assert langid.predict(df.limit(0), one).collect() == []


def test_numerals_are_no_letters_and_columns_pass(spark):
    one = langid.fit(spark.createDataFrame([("abc", "xx")], "text string, lang string"))
    texts = ["²", "①②", "½", "Ⅷ", "_", "ª", "字", "7a"]
    df = spark.createDataFrame([(x, 7, "k", True) for x in texts], "text string, score int, _lang string, _LANG2 boolean")
    got = langid.predict(df, one)
    assert got.columns == ["text", "score", "_lang", "_LANG2", "lang_pred"]
    assert {r.text: r.lang_pred for r in got.collect()} == dict.fromkeys(texts[:5], "und") | dict.fromkeys(texts[5:], "xx")
    assert {r._lang for r in got.collect()} == {"k"}


def test_the_sample_is_bounded_under_copies(spark):
    data = rows(800) + [(k, "the of and to", "en") for k in range(5000)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    languages, sample = langid.sampled(df, "text", "lang", 60, 10)
    counts = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert languages == sorted(WORDS) and all(30 <= n <= 100 for n in counts.values())
    with pytest.raises(ValueError):
        langid.sampled(df, "text", "lang", 60, 3)


def test_machine_separates():
    r = np.random.default_rng(1)
    x = r.standard_normal((300, 20))
    y = np.where(x @ r.standard_normal(20) + 0.3 > 0, 1.0, -1.0)
    w, b = langid.support_vector_machine(x, y)
    assert (np.sign(x @ w + b) == y).mean() > 0.97


def test_machines_are_bounded(spark):
    df = spark.createDataFrame([(f"word{k} text", f"l{k % 40}") for k in range(80)], "text string, lang string")
    with pytest.raises(ValueError, match="780 machines for 40 languages"):
        langid.fit(df, most_machines=779)
    with pytest.raises(ValueError, match="more than 31 languages"):
        langid.fit(df, most_machines=30)
    families = {f"f{k}": tuple(f"l{j}" for j in range(10 * k, 10 * k + 10)) for k in range(4)}
    assert len(langid.fit(df, families=families, per_language=2, most_machines=186).machines) == 6 + 4 * 45


def test_votes_equal_the_plain_reading(spark):
    """The family with most machines' votes, then the language within it; margins decide ties, names equal ones."""
    r = np.random.default_rng(4)
    families = {"x": ["a", "b", "c"], "y": ["d", "e"], "z": ["f"]}
    pairs = [("x", "y"), ("x", "z"), ("y", "z"), ("a", "b"), ("a", "c"), ("b", "c"), ("d", "e")]
    for _ in range(5):
        machines = {p: (r.standard_normal(langid.BUCKETS), float(r.standard_normal())) for p in pairs}
        model = langid.Model(families, machines)
        texts = ["".join(r.choice(list("abcdefgh é")) for _ in range(30)) + "a" for _ in range(40)]

        def winner(names, x):
            won = {n: [0, 0.0] for n in names}
            for i, a in enumerate(names):
                for b in names[i + 1 :]:
                    m = machines[a, b][0] @ x + machines[a, b][1]
                    won[b if m > 0 else a][0] += 1
                    won[b if m > 0 else a][1] += min(abs(m), 9) / 1000
            return max(names, key=lambda n: (sum(won[n]), n))

        for text, (lang, score) in zip(texts, model.predict(texts), strict=True):
            x = langid.features(text)
            assert lang == winner(families[winner(["x", "y", "z"], x)], x) and 0 <= score <= 1
