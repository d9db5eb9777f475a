"""Periodic runs against brute force, and the query's planted repeats."""

import hashlib
import random
import time
import zlib
from itertools import pairwise

import pytest

from tidemark.llm import queries, runs


def brute(words):
    """Every maximal stretch with a smallest period q, six words and 4 q long at least."""
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        k = q
        while k < n:
            if words[k] != words[k - q]:
                k += 1
                continue
            end = k
            while end < n and words[end] == words[end - q]:
                end += 1
            piece = words[k - q : end]
            smallest = next(p for p in range(1, q + 1) if all(piece[i] == piece[i - p] for i in range(p, len(piece))))
            if len(piece) >= max(6, 4 * q) and smallest == q:
                out.append((k - q, len(piece), q))
            k = end
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    """Random words over few letters, with blocks repeated and nested."""
    words = []
    for _ in range(rng.randrange(1, 8)):
        block = [rng.choice("abcdef"[: rng.choice([1, 2, 3, 6])]) for _ in range(rng.randrange(1, 9))]
        words += block * rng.randrange(1, 8)
    if rng.random() < 0.3:
        words = words[: rng.randrange(1, 15)] * rng.randrange(2, 7)
    return words


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(3000):
        words = some_words(rng)
        assert runs.runs(words) == brute(words), words


def test_every_word_is_appended_alike():
    """The parts that are left out hold no run: the automaton over all words finds the same."""
    rng = random.Random(6)
    for _ in range(300):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(60))] + some_words(rng) + [f"w{rng.randrange(60)}" for _ in range(rng.randrange(60))]
        assert runs.runs(words) == brute(words)


def test_squares_of_every_segment():
    """The segments of an appended word's path are its suffixes by their last earlier ends, longest first."""
    rng = random.Random(7)
    for _ in range(200):
        words = [rng.randrange(2) for _ in range(rng.randrange(1, 40))]
        tree = runs.LastEnds()
        for k, w in enumerate(words):
            got = [x for x in tree.append(w) if x[0]]
            want = {}
            for length in range(1, k + 1):
                before = [e for e in range(length - 1, k) if words[e - length + 1 : e + 1] == words[k - length + 1 : k + 1]]
                if before:
                    want[max(before)] = length
            assert sorted(got) == sorted((n, e) for e, n in want.items())
            assert all(a[0] > b[0] for a, b in pairwise(got))


@pytest.mark.parametrize("words", [["a"] * 20000, ["a", "b"] * 10000, [w for k in range(2000) for w in ("x", "y", "z", str(k % 7))]])
def test_very_long_periodic_texts(words):
    began = time.time()
    found = runs.runs(words)
    assert found and max(n for _, n, _ in found) == len(words)
    assert time.time() - began < 20


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, words):
    found = brute(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in found)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(kept))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, " ".join(some_words(rng)) if k % 3 else "\t\v".join(f"é{rng.randrange(9)}" for _ in range(rng.randrange(90)))) for k in range(200)]
    rows += [(None, "a a a a a a b"), (None, None), (1000, ""), (1001, " \n "), (1002, "x x x x x x x x"), (1003, None), (1002, "a b " * 9), (1002, "a b " * 9)]
    spark.createDataFrame([(*r, "t", 1) for r in rows], "doc_id long, text string, TEXT_ string, n_runs int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op13_runs(spark, str(tmp_path)).collect()]
    words = lambda t: [x.decode() for x in (t or "").encode().split()]
    want = [expected(k, planted(k, words(t)) if k is not None else words(t)) for k, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows if k is not None) > 5


def test_empty_table_and_text(spark):
    docs = spark.createDataFrame([("k", "a b a b a b a b c")], "name string, body string")
    assert runs.periodic_runs(docs.limit(0), "name", "body").collect() == []
    row = runs.periodic_runs(docs, "name", "body", with_text=True).first()
    assert (row["name"], row.n_runs, row.start, row["length"], row.period, row.exponent_milli, row.collapsed) == ("k", 1, 0, 8, 2, 4000, "a b c")
