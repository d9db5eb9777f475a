"""Filter audit and line dedup against brute force and their SQL."""

import hashlib
import random
from itertools import permutations

import duckdb
import numpy as np
import pytest

from tidemark.llm import filter_audit, linededup


def sql(query, **tables):
    c = duckdb.connect()
    for name, (columns, data) in tables.items():
        c.execute(f"create table {name} ({columns})")
        for r in data:
            c.execute(f"insert into {name} values ({', '.join('?' * len(r))})", list(r))
    out = c.execute(query)
    names = [d[0] for d in out.description]
    return [dict(zip(names, r, strict=True)) for r in out.fetchall()]


def alike(rows):
    return sorted((sorted((k, v) for k, v in r.items()) for r in rows), key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 1000])
def test_carry_save_counts(n):
    words = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    assert filter_audit.positional_counts(words).tolist() == [int((words >> k & 1).sum()) for k in range(32)]


def test_survival_words():
    words = filter_audit.survival_words(5)
    for failed in range(32):
        assert all(bool(words[failed] >> s & 1) == (not failed & s) for s in range(32))


def some_docs(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(150):
        n = rng.choice([0, 3, 99, 100, 101, 130])
        words = [rng.choice(["AB", "x", "É", f"w{j}", f"v{j}"]) if rng.random() < 0.3 else f"w{j}" for j in range(n)]
        text = rng.choice([" ", "\n", "\t \v", "\x1c", " "]).join(words) + rng.choice(["", "", "$", "|", "@", " "])
        rows.append((k, rng.choice([text, text, None, "", "same text $", "w " * 100]), rng.choice(["en", "de", "", None])))
    return rows


def test_audit_equals_sql(spark):
    docs = some_docs(1)
    labels = [(k, k % 2, k % 7 == 0) for k, _, _ in docs if k % 3] + [(4, 1, 1), (999, 1, 1), (6, None, None)]
    labels = [(k, q, None if t is None else int(t)) for k, q, t in labels]
    df = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, lang string, quality int")
    got = filter_audit.report(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = sql(filter_audit.oracle(), documents=("doc_id bigint, text varchar, lang varchar", docs), labels=("doc_id bigint, quality int, toxic int", labels))
    rows = [r.asDict() for r in got.collect()]
    assert alike(rows) == alike(want) and len(rows) == 600 * len({r[2] or "" for r in docs})


def test_audit_of_repeated_and_missing_ids(spark):
    """Null ids come after all others and have no label; rows of one id do not repeat each other."""
    rows = [(None, "a $", "x"), (None, "a $", "x"), (7, "a $", "x"), (7, "a $", "x"), (8, "a $", "x"), (None, "b", "x"), (None, "b", "x"), (3, None, "x"), (4, "", "x")]
    labels = [(7, 1, 1), (8, 1, 0), (None, 1, 1)]
    got = filter_audit.report(
        spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ).collect()

    failed = []
    for k, (i, t, _) in enumerate(rows):
        t = t or ""
        repeat = any((u or "") == t and j is not None and (i is None or j < i) for j, u, _ in rows[:k] + rows[k + 1 :])
        failed.append({"A"} | ({"D"} if "$" in t else set()) | ({"E"} if repeat else set()))
    for r in got:
        before, own = set(r.filter_order[: r.step - 1]), r.filter_order[r.step - 1]
        gone = [k for k, f in enumerate(failed) if own in f and not f & before]
        assert r.removed == len(gone) and r.redundant == sum(own in f for f in failed) - len(gone)
        assert r.kept == sum(not f & (before | {own}) for f in failed) and r.unique_fails == sum(f == {own} for f in failed)
        assert r.good_lost == sum(rows[k][0] in (7, 8) for k in gone) and r.toxic_lost == sum(rows[k][0] == 7 for k in gone)
    for own in "ABCDE":
        orders = ["".join(p) for p in permutations("ABCDE")]
        share = sum(own in f and not f & set(o[: o.index(own)]) for o in orders for f in failed)
        assert {r.shapley for r in got if r.filter_order[r.step - 1] == own} == {share}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.report(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def some_lines(seed, n=120):
    rng = random.Random(seed)
    pool = [f"{'Line Number' if k % 2 else 'zeile ÄÖÜ nr'} {k}" for k in range(12)] + ["", "short", "x" * 9, "x" * 10, "ÀÉÎ 45678", "ÀÉÎ 456789"]
    rows = []
    for k in range(n):
        own = [rng.choice(pool) if rng.random() < 0.7 else f"only in {k} {j}" for j in range(rng.choice([0, 1, 5, 70, 150]))]
        own = [rng.choice(["", " ", "\t\v"]) + rng.choice([x, x.upper(), x.lower()]) + rng.choice(["", "\r", " \f"]) for x in own]
        rows.append((k, rng.choice(["\n".join(own)] * 8 + [None, ""])))
    return rows


def test_lines_equal_sql(spark):
    rows = some_lines(2)
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], "doc_id long, text string, pos int, h1 string")
    want = sql(linededup.oracle(), documents=("doc_id bigint, text varchar", rows))
    assert alike(r.asDict() for r in linededup.report(df).collect()) == alike(want)
    assert any(r["n_dropped"] > 64 for r in want) and any("," in r["bitmap"] for r in want)


def test_no_hot_prefix_gives_the_same(spark, monkeypatch):
    """Hot lines are dealt by document as well; where none counts as hot, one range streams them."""
    df = spark.createDataFrame(some_lines(3), "doc_id long, text string")
    hot = alike(r.asDict() for r in linededup.report(df).collect())
    monkeypatch.setattr(linededup, "HOT", 1)
    assert alike(r.asDict() for r in linededup.report(df).collect()) == hot
    monkeypatch.setattr(linededup, "HOT", 1 << 30)
    assert alike(r.asDict() for r in linededup.report(df).collect()) == hot


def test_lines_of_repeated_and_missing_ids(spark):
    a, b = "a line that repeats", "b line that repeats"
    rows = [(5, f"{a}\n{b}"), (5, f"{b}\nx\n{a}"), (5, f"{b}\nx\n{a}"), (None, f"{a}\nkept line of none"), (None, f"kept line of none\n {b} "), (9, a.upper()), (9, None)]
    got = linededup.keep_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_lines, r.n_dropped, r.kept) for r in got) == [
        (0, 2, 1, "kept line of none"), (0, 2, 1, "kept line of none"), (5, 2, 0, f"{a}\n{b}"), (5, 3, 0, f"{b}\nx\n{a}"), (5, 3, 0, f"{b}\nx\n{a}"), (9, 1, 0, ""), (9, 1, 1, ""),
    ]
    assert linededup.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bitmap_positions(spark):
    df = spark.createDataFrame([([(0, 1 | 1 << 62), (3, -(1 << 63))],), ([],), (None,)], "d array<struct<word:int,bits:bigint>>")
    assert [r.p for r in df.select(linededup.positions(df.d).alias("p")).collect()] == [[0, 62, 255], [], []]


def test_long_document(spark):
    lines = [f"number {k:08d}" for k in range(20000)]
    rows = [(1, "\n".join(lines[::2])), (2, "\n".join(lines))]
    got = {r.doc_id: r for r in linededup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[2].n_lines, got[2].n_dropped) == (20000, 10000)
    assert got[2].kept_sha256 == hashlib.sha256("\n".join(lines[1::2]).encode()).hexdigest()
