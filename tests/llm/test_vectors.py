import math

import numpy as np

from pyspark.sql import functions as F

from tidemark.llm import ann, embdedup


def table(seed=0, n=500):
    r = np.random.default_rng(seed)
    rows, k = [], 0
    for _ in range(n // 5):
        base = r.standard_normal(16)
        for _ in range(r.integers(1, 9)):
            rows.append((k, [float(x) for x in (base + r.standard_normal(16) * r.choice([0.0, 0.05, 0.3])).astype(np.float32)], int(r.integers(0, 3)), "x"))
            k += 1
    hot = r.standard_normal(16)
    rows += [(k + i, [float(x) for x in hot + 0.02 * r.standard_normal(16)], 1, "x") for i in range(150)]
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [0.0] * 16, [nan] + [1.0] * 15, [inf] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [(90_000 + i, x, 1, "x") for i, x in enumerate(bad)] + [(90_010, [1.0] * 16, None, "x"), (90_011, [1.0] * 16, None, "x"), (90_012, [1.0, 2.0], 1, "x")]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int, score string"


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_links_and_components_equal_brute_force(spark):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    root = {r[0]: r[0] for r in rows}
    links = dict.fromkeys(root, 0)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    x = {k: np.array(v) / np.linalg.norm(v) for k, v, label, _ in rows if good(v) and label is not None}
    label = {r[0]: r[2] for r in rows}
    ids = sorted(x)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if label[a] == label[b] and len(x[a]) == len(x[b]) and x[a] @ x[b] >= 0.93:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    want = {k: (links[k], find(k), find(k) == k) for k in root}
    # without clumps, and with blocks so small that every bucket has one
    for kw in ({"bucket": 32, "block": 64}, {"bucket": 32, "block": 16, "rows_at_once": 1500}):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdedup.near_duplicates(df, 0.93, **kw).collect()}
        assert len(got) == len(rows)
        missed = [k for k in want if got[k] != want[k]]
        assert not missed, [(k, got[k], want[k]) for k in missed[:5]]
    assert embdedup.near_duplicates(df.limit(0)).collect() == []


def test_repeated_ids_are_vectors_of_their_own(spark):
    e = lambda a: [math.cos(a), math.sin(a)]
    rows = [(4, "b", e(0.0)), (4, "c", e(0.0)), (5, "b", e(0.01)), (6, "c", e(0.01)), (7, "a", e(0.0)), (8, "a", e(3.0))]
    rows += [(9, "d", e(0.0)), (9, "d", e(0.02)), (2, "d", e(0.01)), (None, "d", e(0.0)), (3, "f", e(0.0)), (3, "f", e(0.0))]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embdedup.near_duplicates(df).collect()), key=str)
    want = [(4, 1, 4, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 4, False), (7, 0, 7, True), (8, 0, 8, True)]
    want += [(9, 2, 2, False), (9, 2, 2, False), (2, 2, 2, True), (None, 0, None, True), (3, 1, 3, True), (3, 1, 3, True)]
    assert got == sorted(want, key=str)


def test_search_equals_brute_force(spark):
    rows = table(3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for kw in ({}, {"reach": 300, "window": 16, "curves": 6, "rows_at_once": 1500}):
        got = {}
        for r in ann.search(df, F.col("vec_id") % 10 == 0, k=4, **kw).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        x = {k: np.array(v) for k, v, *_ in rows if good(v)}
        queries = [k for k in x if k % 10 == 0]
        assert set(got) == {q for q in queries if any(len(x[q]) == len(v) for k, v in x.items() if k != q)}
        for q in got:
            near = sorted((float(np.sqrt(((x[q] - v) ** 2).sum())), k) for k, v in x.items() if k != q and len(v) == len(x[q]))[:4]
            assert [(r, k) for r, k, _ in sorted(got[q])] == [(i + 1, k) for i, (_, k) in enumerate(near)]
            assert all(abs(s - d) < 1e-12 for (_, _, s), (d, _) in zip(sorted(got[q]), near, strict=True))
    assert ann.search(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def recall(spark, rows, k=10, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0, k=k, **kw).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    hits = total = 0
    for q in range(0, len(rows), 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        want = set(np.lexsort((np.arange(len(x)), d))[:k].tolist())
        hits, total = hits + len(want & got[q]), total + k
    return hits / total


def test_recall_of_random_directions(spark):
    """Directions without any structure, the hardest case: windows reach a small part of the rows."""
    r = np.random.default_rng(2)
    x = r.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, [float(a) for a in v]) for k, v in enumerate(x)]
    assert recall(spark, rows) >= 0.9


def test_equal_vectors_are_found_by_smallest_id(spark):
    r = np.random.default_rng(3)
    rows = [(k, [float(a) for a in r.standard_normal(8)]) for k in range(700)]
    rows = [(k, rows[0][1] if 100 <= k < 600 else v) for k, v in rows]  # most rows are one vector
    assert recall(spark, rows, reach=64, curves=4) >= 0.97
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    near = {q: [r.vec_id for r in ann.search(df, F.col("vec_id") == q, reach=16, curves=2).orderBy("rank").collect()] for q in (0, 300)}
    assert near == {0: list(range(100, 110)), 300: [0, *range(100, 109)]}


def test_fewer_candidates_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ann.search(df, F.col("vec_id") < 3).collect()))
    assert got == [(1, 1, 1, 0.0), (1, 1, 1, 0.0), (1, 2, 2, 1.0), (1, 2, 2, 1.0), (2, 1, 1, 1.0), (2, 2, 1, 1.0)]


def test_hilbert_visits_neighbouring_cells():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    order = cells[np.argsort(ann.hilbert(cells, 3))]
    assert sorted(ann.hilbert(cells, 3)) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_clumps_around_any_centre(spark):
    """Near copies beside an outlier with the smallest id of their bucket: they are counted, not compared."""
    r = np.random.default_rng(8)
    centres = r.standard_normal((2, 16))
    rows = [(0, [float(x) for x in centres[0] + 0.35 * r.standard_normal(16)], "a")]
    rows += [(1 + k, [float(x) for x in centres[int(k % 3 == 0)] + 0.01 * r.standard_normal(16)], "a") for k in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    coded = embdedup._codes(
        df.select(F.col("vec_id").alias("node"), "label", F.size("embedding").alias("length"), F.lit(1).cast("long").alias("copies"), embdedup.as_bytes(F.col("embedding"), "float32").alias("data")),
        1, 2, 11, "float32",
    ).cache()
    clumps = [x.node for x in embdedup._clumps(coded, 0.93, 64, "float32").collect()]
    assert len(clumps) == len(set(clumps)) >= 900 - 2 * 64
    x = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.93
    got = {r.vec_id: (r.n_links, r.component_id) for r in embdedup.near_duplicates(df, block=64).collect()}
    assert all(got[k][0] == linked[k].sum() - 1 for k in range(len(rows)))
