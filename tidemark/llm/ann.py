"""Nearest neighbours by shifted space-filling curves.

Equal vectors are one node with its smallest ids. Nodes are projected on a few axes (turned
principal axes of a bounded sample), and the cell of each projection on a grid, shifted and
turned differently for every ordering, is numbered along a Hilbert curve. Spark
range-partitions the nodes by curve and key, which gives each node an exact rank. On every
curve a query meets the nodes whose rank is within ``reach`` of its own; ranks are cut into
windows of bounded size, and each window is a group that the queries around it visit. What
the windows find is merged and reranked by exact distance.

``reach`` decides the recall. For random directions, which hardly show in a few projections,
recall keeps at the same level when it grows with the power 0.75 of the number of nodes, so
that is the default (RECALL in the README); the work is queries times ``reach``, below the
square of the table. Curves are taken several at a time, so that about ``rows_at_once`` rows
are shuffled at once (one curve's, where that is more).

Defined results: vectors that are null, empty, zero or hold null or non-finite components
take no part, as queries or candidates; vectors of other lengths never meet; ties go to the
smaller id; fewer candidates than ``k`` give fewer rows; repeated ids give a candidate for
each row; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .embdedup import as_bytes, number_of, usable
from .shared import discard, materialize

FOUND = "query long, node long, first long, score double"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer cells (rows of coordinates below 2 ** bits).

    Skilling's transform ("Programming the Hilbert curve", 2004), over all rows at once."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for k in range(n):
            high = (x[k] & q) != 0
            turned = (x[0] ^ x[k]) & low
            x[0] = np.where(high, x[0] ^ low, x[0] ^ turned)
            if k:
                x[k] = np.where(high, x[k], x[k] ^ turned)
        q >>= 1
    for k in range(1, n):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(n):
            key = (key << 1) | ((x[k] >> b) & 1)
    return key


def _nearest(queries: pd.DataFrame, rows: pd.DataFrame, k: int, kind: str) -> pd.DataFrame:
    """The k nearest nodes of each query node by exact distance, itself included; ties to the smaller first id."""
    empty = pd.DataFrame({"query": [], "node": [], "first": [], "score": []}).astype({"query": "int64", "node": "int64", "first": "int64"})
    if not len(queries) or not len(rows):
        return empty
    x, nodes, first = number_of(rows["data"], kind), rows["node"].to_numpy(), rows["first"].to_numpy()
    norm = np.einsum("ij,ij->i", x, x)
    parts = []
    for at in range(0, len(queries), 256):
        part = queries.iloc[at : at + 256]
        y = number_of(part["data"], kind)
        rough = norm[None, :] - 2 * (y @ x.T) + np.einsum("ij,ij->i", y, y)[:, None]
        m = min(k, rough.shape[1])
        cut = np.partition(rough, m - 1, axis=1)[:, m - 1]
        slack = 1e-9 * (np.abs(norm).max() + np.abs(rough).max() + 1)
        for r, (q, v) in enumerate(zip(part["node"], y, strict=True)):
            near = np.flatnonzero(rough[r] <= cut[r] + slack)
            score = np.sqrt(((x[near] - v) ** 2).sum(axis=1))
            best = np.lexsort((first[near], score))[:k]
            parts.append(pd.DataFrame({"query": q, "node": nodes[near][best], "first": first[near][best], "score": score[best]}))
    return pd.concat([empty, *parts], ignore_index=True)


def _axes(nodes: DataFrame, sample: int, kind: str) -> dict[int, tuple]:
    """For each length: mean, principal axes and half-width of at most ``sample`` different vectors."""
    h = F.xxhash64("data")
    taken = nodes.select("length", "data").orderBy(h, "data").limit(sample).toPandas()
    out = {}
    for n, part in taken.groupby("length"):
        m = number_of(part["data"], kind)
        mean = m.mean(axis=0)
        _, _, turn = np.linalg.svd(m - mean, full_matrices=True)
        out[int(n)] = (mean, turn, np.abs((m - mean) @ turn.T).max() or 1.0)
    return out


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    curves: int = 24,
    axes: int = 8,
    bits: int = 7,
    reach: int | None = None,
    rows_at_once: int = 1_000_000,
    window: int = 16_384,
    sample: int = 4096,
    seed: int = 5,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance), for rows where ``is_query`` holds.

    ``sample`` bounds the vectors on which the axes are fitted; every row is indexed. ``reach``: by default
    0.2 n ** 0.75, 256 at least. ``window`` bounds a group's rows. ``axes * bits`` is at most 62.
    """
    element = vectors.schema[vector].dataType.elementType.simpleString()
    kind = "float32" if element == "float" else "float64"
    x = F.col(vector)
    rows = vectors.where(usable(x) & F.col(key).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), F.size(x).alias("length"), as_bytes(x, kind).alias("data"))
    rows = materialize(rows)
    # the k + 1 smallest ids of equal vectors are all that an answer can hold of them
    smallest = rows.withColumn("place", F.row_number().over(Window.partitionBy("data").orderBy("id"))).where(F.col("place") <= k + 1)
    nodes = smallest.groupBy("data").agg(F.max("length").alias("length"), F.array_sort(F.collect_list("id")).alias("ids"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("first", F.col("ids")[0]))
    asked = materialize(rows.where("query").select("id", "data").join(nodes.select("node", "data"), "data").select("id", F.col("node").alias("query")))
    queries = materialize(asked.select(F.col("query").alias("node")).distinct().join(nodes.select("node", "first", "length", "data"), "node"))
    total, many = nodes.count(), queries.count()
    reach = reach or max(256, int(0.2 * total**0.75))
    window = min(window, reach)
    # queries that visit one window are dealt to slices where there are very many
    slices = max(1, round(many / max(total, 1) * (2 * reach + window) / 65_536))
    axes_of = _axes(nodes, sample, kind)

    def keyed(some: range):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for n, part in pdf.groupby("length"):
                    n = int(n)
                    mean, turn, wide = axes_of.get(n, (np.zeros(n), np.eye(n), 1.0))
                    m = (number_of(part["data"], kind) - mean) @ turn.T
                    for c in some:
                        # each curve has axes and a shift of its own; the first one the leading axes
                        r = np.random.default_rng([seed, c])
                        mix = np.linalg.qr(r.standard_normal((n, n)))[0] if c else np.eye(n)
                        y = (m @ mix)[:, :axes] / (2.4 * wide) + 0.5 + r.uniform(-0.08, 0.08)
                        cell = np.clip(y * (1 << bits), 0, (1 << bits) - 1)
                        yield pd.DataFrame({"node": part["node"], "c": c, "length": n, "key": hilbert(cell, bits)})

        return run

    def meet(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        return _nearest(own, others, k + 1, kind)

    found, at_once = [], max(1, rows_at_once // max(total, 1))
    for start in range(0, curves, at_once):
        some = range(start, min(start + at_once, curves))
        ranked = materialize(_ranked(nodes.select("node", "length", "data").mapInPandas(keyed(some), "node long, c int, length int, key long"), max(1, total * len(some) // 200_000)))
        place = lambda shift: F.floor((F.col("rank") + shift) / window)
        around = ranked.select("node", "c", F.explode(F.sequence(place(-reach), place(reach))).alias("w")).join(queries, "node")
        around = around.withColumn("slice", F.pmod(F.xxhash64("node"), F.lit(slices)))
        others = ranked.select("node", "c", place(0).alias("w")).join(nodes.select("node", "first", "length", "data"), "node")
        others = others.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
        at = ["c", "length", "w", "slice"]
        here = around.toDF(*around.columns).groupBy(*at).cogroup(others.groupBy(*at)).applyInPandas(meet, FOUND)
        found.append(materialize(here))
        discard(ranked)
    # the same node may be found on several curves
    once = reduce(DataFrame.unionByName, found).groupBy("query", "node").agg(F.min("first").alias("first"), F.min("score").alias("score"))
    best = once.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("score", "first"))).where(F.col("place") <= k + 1)
    each = best.join(nodes.select("node", "ids"), "node").select("query", "score", (F.col("query") == F.col("node")).alias("own"), F.explode("ids").alias("vec_id"))
    lists = each.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id", "own"))), 1, k + 1).alias("near"))
    answer = asked.join(lists, "query")
    own = F.array_position(F.transform("near", lambda r: r["own"] & (r["vec_id"] == F.col("id"))), True) - 1
    near = F.slice(F.filter("near", lambda r, i: i != own), 1, k)
    answer = answer.select(F.col("id").alias("query_id"), F.posexplode(near).alias("at", "r"))
    return answer.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "r.vec_id", "r.score")


def _ranked(keyed: DataFrame, parts: int) -> DataFrame:
    """node, c, rank: the place in order of curve, length and key, from range partitions and their sizes."""
    order = ("c", "length", "key", "node")
    placed = materialize(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).cast("int")
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = F.broadcast(sizes.withColumn("before", before).drop("n"))  # one row for a partition of 200,000
    return placed.withColumn("part", part).join(sizes, "part").select("node", "c", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("rank"))
