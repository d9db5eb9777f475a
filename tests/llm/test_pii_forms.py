"""Forms that only the wide generators find are added, also where many documents hold them."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii


def corpus():
    r = random.Random(5)
    rows = []
    for k in range(1800):
        words = ["the", "of", "and", "near"] * 3
        a, b, name = r.randint(200, 999), r.randint(1000, 9999), f"u{r.randrange(10**5)}"
        number, item = f"1 ({a}) 555-{b}", r.choice((f"item #{r.randint(10**6, 10**7)} sold", f"order {r.randint(10**10, 10**11)} shipped", f"on 2024-{r.randint(10, 12)}-{r.randint(10, 28)} {r.randint(10, 23)} o'clock", f"sold 5 @ {r.randint(2, 9)}.50 each"))
        kind, form = ("base", "plain") if k % 3 == 0 else ("wide", "spelled") if k % 3 == 1 else ("none", "item")
        if form == "plain":
            words.insert(4, f"call +{number} now or write to {name}@mail.example.com")
        elif form == "spelled":
            words.insert(4, r.choice((f"call {number} now", f"write to {name} (at) mail (dot) example (dot) com now", f"my number is {number} now")))
        else:
            words.insert(4, item)
        rows.append((k, kind, " ".join(words)))
    return rows


@pytest.fixture(scope="module")
def found(spark):
    rows = corpus()
    df = spark.createDataFrame([(k, x) for k, _, x in rows], "doc_id long, text string")
    scorer = pii.fit(df)
    assert scorer is not None
    return rows, {r.doc_id: r.spans for r in pii.report(df, scorer).collect()}, {r.doc_id: r.spans for r in pii.report(df, None).collect()}


def test_frequent_forms_are_found(found):
    rows, got, plain = found
    for k, kind, x in rows:
        if kind == "wide":
            a = x.index("u", x.index("write to ") + 8) if "write to" in x else x.index("1 (")
            b = x.index(" now", a)
            assert not plain[k] and got[k] == f"{'email' if 'write' in x else 'phone'}:{a}:{b}", (x, got[k])


def test_other_numbers_are_not(found):
    rows, got, plain = found
    assert [x for k, kind, x in rows if kind == "none" and got[k]] == []
    assert all(set(plain[k].split(",")) <= set(got[k].split(",")) for k, kind, _ in rows if kind == "base")


@pytest.fixture(scope="module")
def rare(spark):
    """200,000 different texts, of which 300 hold a phone and 300 a number of another kind: few of each in any 50,000."""
    n = F.col("id")
    number = F.concat(F.lit("1 ("), (200 + n % 800).cast("string"), F.lit(") 555-"), (1000 + n % 9000).cast("string"))
    said = F.when(n % 667 == 1, F.concat(F.lit("call +"), number, F.lit(" now"))).when(n % 667 == 2, F.concat(F.lit("item #"), (1_000_000 + n * 37).cast("string"), F.lit(" sold")))
    docs = spark.range(0, 200_000, 1, 8).select(n.alias("doc_id"), F.concat(F.lit("text "), n.cast("string"), F.lit(" "), F.coalesce(said, F.lit("is clean"))).alias("text"))
    return docs.unionByName(spark.createDataFrame([(10**6, "call 1 (743) 555-3824 now"), (10**6 + 1, "item #3481920 sold")], docs.schema))


def test_all_texts_train(spark, rare):
    scorer = pii.fit(rare)
    assert scorer is not None
    got = {r.doc_id: r.spans for r in pii.report(rare.where("doc_id >= 1000000"), scorer).collect()}
    assert got == {10**6: "phone:5:21", 10**6 + 1: ""}


def test_a_repeated_text_trains_once(spark):
    """Fifteen different phones are too few for a class, however often their texts are repeated."""
    rows = [(f"call +1 (743) 555-{1000 + k} now",) for k in range(15)] * 40 + [(f"item #{1000000 + k} sold",) for k in range(400)]
    assert pii.fit(spark.createDataFrame(rows, "text string")) is None
