import hashlib
import random
import re

import pytest

from tidemark.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(d) <= 19 and luhn(d),
                "phone": 8 <= len(d) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def texts():
    r = random.Random(2)
    odd = ["1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "007.08.1.000255", "a@b.c_d@e.f x@y", "a@b.c@d.e", "+1 (743) 555-3824.", "+1 2 3",
           "4539 1488 0343 6467", "4539-1488-0343-6467 4539148803436468", "é😀 a.b@c.de 😀 10.0.0.1", "+49 (0)30 1234-5678 ) x", "+1-2-3-4-5-6-7-8-- "]
    pieces = ["a", "b.", "@", "c-d", ".", "1", "23", "255", "4539148803436467", "+", "(", ")", " ", "-", "é", "😀", "\n", "_", "x@y.z", "+1 55"]
    return odd + ["".join(r.choice(pieces) for _ in range(r.randint(0, 40))) for _ in range(600)]


def test_base_spans_equal_brute_force(spark):
    rows = list(enumerate([None, "", *texts(), "x" * 8_000, "1" * 8_000, "1 " * 20_000, "a@b.c " * 300, "+1 " + "2 " * 20_000, "1.2." * 1_000]))
    df = spark.createDataFrame([(k, x, 1) for k, x in rows], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in pii.report(df, None).collect()}
    assert len(got) == len(rows)
    for k, x in rows:
        want = brute(x)
        said = ",".join(f"{a}:{b}:{c}" for a, b, c in want)
        assert got[k].spans == said, x and x[:200]
        assert got[k].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [got[k][f"n_{x}"] for x in PATTERNS] == [sum(w[0] == x for w in want) for x in PATTERNS]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(9)
    rows = []
    for k in range(1200):
        words = ["the", "of", "and", "near"] * 3
        if k % 3 == 0:
            words.insert(4, f"call +1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)} now")
        if k % 3 == 1:
            words.insert(5, f"item #{r.randint(10**6, 10**7)} sold")
        rows.append((k, " ".join(words)))
    rows.append((5000, "call 1 (743) 555-3824 now"))
    rows.append((5001, "item #3481920 sold"))
    rows.append((5002, None))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_trees_add_spans_and_keep_base_ones(spark, corpus):
    scorer = pii.fit(corpus)
    assert scorer is not None and scorer.least < float("inf")
    got = {r.doc_id: r for r in pii.report(corpus, scorer).collect()}
    plain = {r.doc_id: r for r in pii.report(corpus, None).collect()}
    assert all(got[k].base_sha256 == plain[k].base_sha256 and set(plain[k].spans.split(",")) - {""} <= set(got[k].spans.split(",")) for k in plain)
    assert all(not got[k].spans for k in range(1200) if k % 3 != 0)  # numbers that are no personal data, and clean texts
    assert not got[5001].spans and not got[5002].spans
    assert got[5000].spans == "phone:5:21"  # no base form: it has no plus sign


def test_fit_without_two_classes_adds_nothing(spark, corpus):
    assert pii.fit(corpus.where("doc_id % 3 = 2")) is None
    assert pii.fit(corpus.limit(0)) is None
    assert pii.report(corpus.limit(0), None).collect() == []


def test_redact(spark):
    df = spark.createDataFrame([(1, "é a@b.cd, 10.0.0.1!", "k"), (2, None, "k"), (3, "clean", "k"), (4, "+10.20.30.40 x", "k")], "doc_id long, text string, spans string")
    got = {r.doc_id: (r.text, r.spans) for r in pii.redact(df, None).collect()}
    assert got == {1: ("é <EMAIL>, <IP>!", "k"), 2: (None, "k"), 3: ("clean", "k"), 4: ("<PHONE> x", "k")}


def test_long_runs_neither_recurse_nor_scan_twice(spark):
    df = spark.createDataFrame([(1, "x" * 300_000 + "@"), (2, "1" * 300_000 + ".@+"), (3, "+1" + "2 " * 100_000)], "doc_id long, text string")
    assert [r.spans for r in pii.report(df, None).collect()] == ["", "", ""]


def test_columns_pass_whatever_their_names(spark):
    names = ["_email", "_row", "_text", "_base", "_all", "_wide", "SPANS", "base_spans", "a.b"]
    df = spark.createDataFrame([(1, "x@y.zz", *names), (2, None, *names)], ["doc_id", "text", *names])
    out = pii.redact(df, None)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, "<EMAIL>", *names), (2, None, *names)]
    found = pii.find(df, None)
    assert found.columns == [c for c in df.columns if c not in ("SPANS", "base_spans")] + ["base_spans", "spans"]
    assert [len(r.spans) for r in found.orderBy("doc_id").collect()] == [1, 0]


def test_ip_forms_are_proposed(spark):
    df = spark.createDataFrame([("at 10[.]0[.]0[.]1 and 10 . 0 . 0 . 2, 1.2.3.4.5",)], "text string")
    wide = pii.wide_candidates(df, "text").first()._wide
    assert [(c.k, c.m) for c in wide if c.k == "ip"] == [("ip", "10[.]0[.]0[.]1"), ("ip", "10 . 0 . 0 . 2"), ("ip", "1.2.3.4")]
