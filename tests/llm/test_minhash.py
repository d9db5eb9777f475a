import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import minhash, shared


def brute(rows, words=2, percent=80):
    sets = {}
    for k, x in rows:
        w = (x or "").encode().lower().split()
        n = min(words, len(w))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((k, len(sets[k]), find(k), find(k) == k) for k in ids)


def corpus(seed=1, n=150):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, k = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "one two"), (6, "ONE\x0btwo")], 10
    rows += [(7, "Éa b"), (8, "éa b")]
    for _ in range(n):
        base = [r.choice(vocab) for _ in range(r.randint(1, 120))]
        for _ in range(r.choice([1, 1, 1, 2, 3, 12])):
            copy = list(base)
            for _ in range(int(len(copy) * r.choice([0, 0.01, 0.03, 0.05, 0.08]))):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            rows.append((k, " ".join(copy)))
            k += 1
    # a chain: neighbours are similar, its ends are not
    chain = [r.choice(vocab) for _ in range(100)]
    for step in range(12):
        rows.append((k + step, " ".join(chain)))
        for i in range(step * 4, step * 4 + 4):
            chain[i] = f"new{step}x{i}"
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(k, x, "clash") for k, x in rows], "doc_id long, text string, component_id string").repartition(5)
    for words in (2, 5):
        got = sorted(map(tuple, minhash.near_duplicates(df, words=words).collect()))
        assert got == brute(rows, words)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (3, None)], "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(df, words=2).collect()))
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_hot_bucket_is_searched_in_blocks(spark):
    r = random.Random(4)
    base = [[f"w{r.randrange(10**6)}" for _ in range(60)] for _ in range(40)]
    texts = [(k, " ".join(base[k // 10][: 60 - k % 3])) for k in range(400)]
    sketches = minhash.odd_sketches(minhash.signatures(minhash.shingle_sets([x for _, x in texts], 2)))
    bands = [7] + [0] * 21
    kind = "bucket long, mains long, size long, in_main boolean, node long, component long, n long, sketch array<long>, bands array<long>"
    docs = spark.createDataFrame(texts, "id long, text string")
    # the first node alone, and half of the bucket, are the main component
    for mains in (1, 205):
        rows = [(7, mains, 400, k < mains, k, min(k, max(0, k - mains + 1)), 60, sketches[k].tolist(), bands) for k, _ in texts]
        got = {tuple(sorted(x)) for x in minhash._crossing(spark.createDataFrame(rows, kind), docs, 0.8, 2, 80, block=64).collect()}
        want = {(a, b) for a in range(400) for b in range(max(a + 1, mains), a // 10 * 10 + 10)}
        if mains == 1:
            assert got == want
        else:  # one link for each two components
            assert {(max(0, a - mains + 1), b) for a, b in got} == {(max(0, a - mains + 1), b) for a, b in want}


def test_bands_keep_the_chance_of_a_miss():
    for percent in range(20, 101, 5):
        bands, rows = minhash.bands_for(percent / 100)
        assert bands * rows <= minhash.SAMPLES and (percent == 100 or (1 - (percent / 100) ** rows) ** bands <= 1e-5)
    with pytest.raises(ValueError):
        minhash.bands_for(0.01)


def test_texts_are_read_by_a_bitmap_and_the_ids(spark):
    texts = spark.range(0, 5000).selectExpr("id", "concat('t', id) AS text")
    ids = texts.where("id % 7 = 0").select("id")
    got = {r.id for r in minhash._texts_of(texts, ids.union(ids)).collect()}
    assert got >= set(range(0, 5000, 7)) and len(got) < 720
    assert minhash._texts_of(texts, ids.limit(0)).collect() == []


def test_hot_buckets_are_joined_like_others(spark):
    rows = [(k, 0 if k % 2 else k) for k in range(6000)]
    df = spark.createDataFrame(rows, "node long, bucket long")
    sizes = df.groupBy("bucket").agg(F.count("*").alias("size"))
    got = {(r.node, r.bucket, r.size) for r in shared.join_counted(df, sizes, "bucket").collect()}
    n = sum(b == 0 for _, b in rows)
    assert got == {(k, b, n if b == 0 else 1) for k, b in rows}


def test_overlaps_by_either_way():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 6000, 900).astype(np.uint64)) for _ in range(30)]
    for pairs in (3, 20_000):
        i = r.integers(0, 30, pairs)
        j = (i + r.integers(1, 30, pairs)) % 30
        want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
        assert minhash._overlaps(sets, i, j).tolist() == want


def test_sketch_estimate():
    r = np.random.default_rng(0)
    base = r.integers(0, 2**63, 2000).astype(np.uint64)
    for j in (0.8, 0.9, 0.95):
        shared = int(2000 * 2 * j / (1 + j))
        other = np.unique(np.concatenate([base[:shared], r.integers(0, 2**63, 2000 - shared).astype(np.uint64)]))
        a, b = minhash.odd_sketches(minhash.signatures([np.unique(base), other]))
        z = int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
        estimate = 1 + minhash.BITS / (4 * minhash.SAMPLES) * np.log(1 - 2 * z / minhash.BITS)
        assert abs(estimate - j) < 0.12 and z <= minhash.most_bits(0.8)
