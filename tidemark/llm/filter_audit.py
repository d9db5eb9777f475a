"""Filter interaction audit: what each filter removes, in every order of the filters.

A document fails a set of filters. Of the 2^n subsets of n filters (32 for five) it survives
those that hold none it fails: its survival word has one bit for each subset. Summing the bits
position by position gives the survivors of every subset at once, and all that an audit asks
follows from these: after the steps of an order stand the survivors of the set of its first
filters, a step removes the difference of two sets, and averages over orders are Shapley shares.

The sums are carry-save: three words of one weight become a word of sums and a word of carries
of twice the weight, so that a batch of words shrinks to two words for each power of two.

Documents. A null text is empty; a text without words fails no share of words. Identity of
texts is by two 64-bit hashes and their length; a row repeats another if that has a smaller id
and the same text. Rows of one id do not repeat each other, and a null id is larger than all others.
Labels join by id: a row without an id, or without a label, has neither; of several label rows of
an id any counts. Other columns, whatever their names, are not read; an empty table gives no part.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, join_counted, materialize

#: Names of the filters in the order of their bits.
FILTERS = "ABCDE"
CAPITALS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
KINDS = ("all", "quality", "toxic")
#: Texts that a worker holds as Python objects at a time; parts whose words it holds before it sums them.
ROWS, PARTS = 256, 1000


def failures(text: str) -> int:
    """Bits of the filters A to D that the text fails."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: [\x20\x09-\x0D] and nothing else
    n, capitals = len(words), len(data) - len(data.translate(None, CAPITALS))
    marked = len(data.translate(None, MARKS)) < len(data)
    return (n < 100) | (100 * len(set(words)) < 80 * n) << 1 | (100 * capitals > 10 * len(text)) << 2 | marked << 3


def survival_words(n: int) -> list[int]:
    """For each set of failed filters, the word whose bit s tells whether subset s of the filters lets a document through."""
    return [sum(1 << s for s in range(1 << n) if not s & failed) for failed in range(1 << n)]


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit, by carry-save addition."""
    counts, weight = np.zeros(32, dtype=np.int64), 0
    level = words.astype(np.uint32)
    while len(level):
        carries = []
        while len(level) > 2:
            third = len(level) // 3
            a, b, c = level[:third], level[third : 2 * third], level[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate([half ^ c, level[3 * third :]])
        for word in level:
            counts += ((word >> np.arange(32, dtype=np.uint32)) & 1).astype(np.int64) << weight
        level, weight = np.concatenate(carries) if carries else level[:0], weight + 1
    return counts


def _failed(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """doc, part, h1, h2, size and failed (of A to D) for each row; texts are read once and stay behind."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("body"))
    rows = rows.select("doc", "part", F.xxhash64("body").alias("h1"), F.xxhash64(F.lit(1), "body").alias("h2"), F.length("body").alias("size"), "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                piece = whole.slice(at, ROWS)
                found = pa.array([failures(x) for x in piece.column(5).to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays([*piece.columns[:5], found], names=["doc", "part", "h1", "h2", "size", "failed"])

    return rows.mapInArrow(run, "doc long, part string, h1 long, h2 long, size int, failed int")


def _with_repeats(rows: DataFrame) -> DataFrame:
    """Adds bit E to ``failed`` of rows whose text a smaller id has; large groups of copies are joined by broadcast."""
    text = F.struct("h1", "h2", "size")
    rows = rows.select("doc", "part", "failed", text.alias("text"))
    groups = rows.groupBy("text").agg(F.count("*").alias("size"), F.min("doc").alias("first"))
    found = join_counted(rows, groups, "text")
    repeats = F.col("first").isNotNull() & (F.col("doc").isNull() | (F.col("doc") > F.col("first")))
    return found.select("doc", "part", F.when(repeats, F.col("failed") + 16).otherwise(F.col("failed")).alias("failed"))


def _with_labels(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Adds quality and toxic; rows without an id are not joined, so that they do not meet in one task."""
    said = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("doc"))
    said = said.agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c) for c in KINDS[1:]])
    none = {c: F.lit(False) for c in KINDS[1:]}
    known = rows.where("doc is not null").join(said, "doc", "left").fillna(False, KINDS[1:])
    return known.unionByName(rows.where("doc is null").withColumns(none)).select("part", *KINDS[1:], "failed")


def subset_survivors(rows: DataFrame, n: int = len(FILTERS)) -> DataFrame:
    """part, kind (all, quality, toxic), survivors (an array by subset) from part, quality, toxic and failed."""
    of = np.array(survival_words(n), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], np.ndarray] = {}

        def summed() -> pa.RecordBatch:
            keys = list(held)
            counts = [pa.array([int(held[k][s]) for k in keys], pa.int64()) for s in range(1 << n)]
            out = [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), *counts]
            held.clear()
            return pa.RecordBatch.from_arrays(out, names=["part", "kind", *[f"s{s}" for s in range(1 << n)]])

        for batch in batches:
            names = batch.column(0).dictionary_encode()
            codes, words = names.indices.to_numpy(), of[batch.column(3).to_numpy()]
            flags = [np.ones(len(codes), bool), *(batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))]
            order = np.argsort(codes, kind="stable")
            ends = np.searchsorted(codes[order], np.arange(len(names.dictionary) + 1))
            for k, name in enumerate(names.dictionary.to_pylist()):
                own = order[ends[k] : ends[k + 1]]
                for kind, flag in zip(KINDS, flags, strict=True):
                    counts = positional_counts(words[own[flag[own]]])
                    held[name, kind] = held.get((name, kind), 0) + counts
            if len(held) > PARTS:
                yield summed()
        if held:
            yield summed()

    columns = [f"s{s}" for s in range(1 << n)]
    counts = rows.mapInArrow(run, ", ".join(["part string", "kind string", *[f"{c} long" for c in columns]]))
    return counts.groupBy("part", "kind").agg(F.array(*[F.sum(c) for c in columns]).alias("survivors"))


def steps(filters: str = FILTERS) -> list[dict]:
    """Each order's steps: filter_order, step (from 1), own (the bit of the step's filter) and before (those of the filters before it)."""
    bits = {c: 1 << k for k, c in enumerate(filters)}
    return [
        {"filter_order": "".join(p), "step": k + 1, "own": bits[p[k]], "before": sum(bits[c] for c in p[:k])}
        for p in permutations(filters)
        for k in range(len(p))
    ]


def audit(survivors: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from the survivors of every subset."""
    n = len(filters)
    parts = survivors.groupBy("part").agg(*[F.max(F.when(F.col("kind") == k, F.col("survivors"))).alias(k) for k in KINDS])
    plan = F.from_json(F.lit(json.dumps(steps(filters))), "array<struct<filter_order string, step int, own int, before int>>")
    rows = parts.select("part", *KINDS, F.explode(plan).alias("s")).select("part", *KINDS, "s.*")
    own, before, every = F.col("own"), F.col("before"), F.lit((1 << n) - 1)
    after = before.bitwiseOR(own)
    gone = lambda kind: F.col(kind)[before] - F.col(kind)[after]
    # a set of k filters stands before a given filter in k! (n - 1 - k)! of all orders
    shares = [
        F.when(own == 1 << f, sum(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) * (F.col("all")[s] - F.col("all")[s | 1 << f]) for s in range(1 << n) if not s >> f & 1))
        for f in range(n)
    ]
    return rows.select(
        "part", "filter_order", "step",
        F.col("all")[after].alias("kept"), gone("all").alias("removed"),
        (F.col("all")[0] - F.col("all")[own] - gone("all")).alias("redundant"),
        (F.col("all")[every - own] - F.col("all")[every]).alias("unique_fails"),
        gone("quality").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.coalesce(*shares).alias("shapley"),
    )


def report(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The audit of the five filters over ``docs``, part by part.

    A: fewer than 100 words; B: fewer than 80 different words of 100; C: more than 10 capitals of 100
    code points; D: any of ``#$%&*|``; E: a smaller id has the same text, removed or not."""
    rows = materialize(_failed(docs, key, text, part))
    survivors = materialize(subset_survivors(_with_labels(_with_repeats(rows), labels, key)))
    discard(rows)
    return audit(survivors)


def oracle() -> str:
    """DuckDB SQL of ``report`` over ``documents``, with one row for each id, and ``labels``."""
    plan = ", ".join(f"('{s['filter_order']}', {s['step']}, {s['own']}, {s['before']})" for s in steps())
    return f"""
WITH said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS quality, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
body AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
cut AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM body),
failed AS (SELECT doc_id, part, (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS f FROM cut),
docs AS (SELECT part, f, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS bad
  FROM failed LEFT JOIN said USING (doc_id) GROUP BY part, f),
plan(filter_order, step, own, prior) AS (VALUES {plan}),
rows AS (SELECT part, filter_order, step, own,
  coalesce(sum(n) FILTER (WHERE f & (prior | own) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE f & own > 0 AND f & prior = 0), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE f & own > 0 AND f & prior > 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE f = own), 0) AS unique_fails,
  coalesce(sum(good) FILTER (WHERE f & own > 0 AND f & prior = 0), 0) AS good_lost, coalesce(sum(bad) FILTER (WHERE f & own > 0 AND f & prior = 0), 0) AS toxic_lost
  FROM docs, plan GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM rows"""
