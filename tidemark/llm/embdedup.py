"""Near-duplicate vectors by random-hyperplane signs in several tables, exact cosine and components.

A vector's sign against each of ``bits`` hyperplanes gives its bucket in a table. Vectors
of one bucket (and label) are compared exactly, in double precision, as a product of
matrices. ``bits`` follows the logarithm of the largest label's size so that buckets keep
their size, and the number of tables follows from the chance that a pair at the threshold
shares a bucket in none of them (``missed``).

Vectors of one label that are equal in every component are one node with a count. Large
buckets are dealt to blocks, and each pair of blocks meets in one group, so a task holds two
blocks at most. A pair that shares buckets in several tables counts in the first only. Groups
return each node's number of links and a spanning forest of them, never all pairs. Tables are
taken several at a time, so that about ``rows_at_once`` rows are shuffled at once (one table's,
where that is more).

Clumps: in a bucket of the first table with more than one block, the nodes within half the
threshold's angle of the bucket's first node are all linked with each other by the triangle
inequality. They are counted as such and never compared among themselves: blocks of one
clump do not meet, so a group of near copies costs its size, not the square of it.

Defined results: null labels, and vectors that are null, empty, zero or hold null or
non-finite components, link with nothing (n_links 0, own component, kept); vectors of other
lengths never meet; repeated ids each give a row, and each row is a vector of its own with its
own links (ids of a component may repeat, its smallest id names it); rows without an id link
with nothing; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, discard, join_counted, materialize


def usable(vector: Column) -> Column:
    """Whether a vector can be compared: not null, empty or zero, all components finite."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def tables_for(similarity: float, bits: int, missed: float) -> int:
    same = (1 - math.acos(similarity) / math.pi) ** bits
    return max(1, math.ceil(math.log(missed) / math.log(1 - same))) if same < 1 else 1


def _unit(data: pd.Series | list[bytes], kind: str) -> np.ndarray:
    x = number_of(data, kind)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codes(nodes: DataFrame, bits: int, tables: int, seed: int, kind: str) -> DataFrame:
    """Adds codes: the node's bucket in each table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for pdf in batches:
            codes = pd.Series([None] * len(pdf), dtype=object)
            for n, own in pdf.groupby("length").indices.items():
                if n not in planes:
                    planes[n] = np.random.default_rng([seed, n]).standard_normal((n, tables * bits))
                signs = (_unit(pdf["data"].iloc[own], kind) @ planes[n] > 0).reshape(len(own), tables, bits)
                packed = signs @ (1 << np.arange(bits, dtype=np.int64))
                for k, c in zip(own, packed, strict=True):
                    codes.iloc[k] = c
            yield pdf.assign(codes=codes)

    return nodes.mapInPandas(run, "node long, label string, length int, copies long, data binary, codes array<long>")


def as_bytes(vector: Column, kind: str) -> Column:
    """A vector as bytes of float32 or float64 components."""

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if x is None else (np.asarray(x, dtype=kind) + 0).tobytes())  # -0 becomes 0

    return of(vector)


def number_of(data: pd.Series | list[bytes], kind: str) -> np.ndarray:
    """Rows of equally long vectors, in double precision."""
    return np.frombuffer(b"".join(data), dtype=kind).reshape(len(data), -1).astype(np.float64)


def _compare(pdf: pd.DataFrame, similarity: float, kind: str) -> pd.DataFrame:
    """Links of block p against block q of one bucket: counts by node and a spanning forest."""
    t, p, q = (int(pdf[c].iloc[0]) for c in "tpq")
    own = pdf["own"].to_numpy()
    left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
    node, copies, clump = pdf["node"].to_numpy(), pdf["copies"].to_numpy(), pdf["clump"].to_numpy()
    count = np.zeros(len(pdf), dtype=np.int64)
    edges: list[tuple[int, int, int]] = []
    if len(left) and len(right):
        x, codes = _unit(pdf["data"], kind), np.stack(pdf["codes"].to_numpy())
        good = x[left] @ x[right].T >= similarity
        if p == q:
            good &= left[:, None] < right[None, :]
        good &= (clump[left][:, None] != clump[right][None, :]) | (clump[left][:, None] < 0)
        i, j = np.nonzero(good)
        i, j = left[i], right[j]
        for k in range(t):  # of an earlier table
            new = codes[i, k] != codes[j, k]
            i, j = i[new], j[new]
        np.add.at(count, i, copies[j])
        np.add.at(count, j, copies[i])
        root = list(range(len(pdf)))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((node[a], node[b], 0))
    out = [(node[k], node[k], count[k]) for k in np.flatnonzero(count)] + edges
    return pd.DataFrame(out, columns=["u", "v", "n"], dtype="int64")


#: Centres that are tried in a bucket at a time.
CENTRES = 16


def _clumps(coded: DataFrame, similarity: float, block: int, kind: str, most_rounds: int = 40) -> DataFrame:
    """(node, clump): nodes of large buckets of the first table that are within half the threshold's angle of a centre, their clump.

    In rounds: CENTRES nodes of each bucket that is still larger than a block, drawn by a hash, take the nodes near them. A clump that
    holds a share s of its bucket is met with chance 1 - (1 - s)^CENTRES; the rounds end when one takes less than a CENTRES-th of the nodes
    that are left, so each node is compared with CENTRES ln(n) centres at most, whatever lies in its bucket."""
    keys = ["label", "length", "code"]
    left = coded.select("node", F.struct("label", "length", F.col("codes")[0].alias("code")).alias("bucket"), "data")
    least = math.cos(math.acos(similarity) / 2) + 1e-9  # rounding never makes two members' cosine fall below the threshold

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of a part of a bucket and the bucket's centres: the first centre in reach of each node, -1 without one."""
        centre = pdf["centre"].to_numpy()
        rows, centres = pdf[~centre], pdf[centre].sort_values("node")
        clump = np.full(len(rows), -1, dtype=np.int64)
        if len(rows) and len(centres):
            hits = _unit(rows["data"], kind) @ _unit(centres["data"], kind).T >= least
            some = hits.any(axis=1)
            clump[some] = centres["node"].to_numpy()[hits[some].argmax(axis=1)]
        return rows[["node", *keys, "data"]].assign(clump=clump)

    found, tables = [], []
    for turn in range(most_rounds):
        draw = [F.min_by("node", F.xxhash64("node", F.lit(CENTRES * turn + k))) for k in range(CENTRES)]
        drawn = left.groupBy("bucket").agg(F.count("*").alias("size"), F.array_distinct(F.array(*draw)).alias("drawn")).where(F.col("size") > block)
        drawn = materialize(drawn)
        if drawn.isEmpty():
            break
        parts = F.ceil(F.col("size") / block).cast("int")
        centres = drawn.select("bucket", parts.alias("parts"), F.explode("drawn").alias("node")).join(left.select("node", "data"), "node")
        centres = centres.select("node", "bucket", "data", F.lit(True).alias("centre"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        rows = join_counted(left, drawn.select("bucket", "size"), "bucket").select("node", "bucket", "data", F.lit(False).alias("centre"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))
        group = rows.unionByName(centres).select("node", "bucket.*", "data", "centre", "part").groupBy(*keys, "part")
        tried = materialize(group.applyInPandas(near, "node long, label string, length int, code long, data binary, clump long"))
        tables.append(tried)
        found.append(tried.where("clump >= 0").select("node", "clump"))
        left = tried.where("clump < 0").select("node", F.struct(*keys).alias("bucket"), "data")
        taken, rest = tried.agg(F.count_if(F.col("clump") >= 0), F.count_if(F.col("clump") < 0)).first()
        if taken * CENTRES < rest:
            break
    if not found:
        return coded.select("node", F.col("node").alias("clump")).limit(0)
    out = materialize(reduce(DataFrame.unionByName, found))
    for x in tables:
        discard(x)
    return out


def near_duplicates(
    vectors: DataFrame,
    similarity: float = 0.93,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    missed: float = 1e-4,
    bucket: int = 256,
    block: int = 1024,
    rows_at_once: int = 1_000_000,
    seed: int = 11,
) -> DataFrame:
    """Per row: key, n_links (other vectors linked), component_id (smallest key reachable), kept."""
    element = vectors.schema[vector].dataType.elementType.simpleString()
    kind = "float32" if element == "float" else "float64"
    counts = usable(F.col(vector)) & F.col(label).isNotNull() & F.col(key).isNotNull()
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.when(counts, F.col(vector)).alias("x"))
    rows = materialize(rows.select("id", "label", F.size("x").alias("length"), as_bytes(F.col("x"), kind).alias("data")))
    nodes = rows.where("data is not null").groupBy("label", "data").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.max("length").alias("length"))
    nodes = materialize(nodes)
    # a node is named by its first id, unless an id has several; then by a number in the same order
    repeated = not nodes.groupBy("first").count().where("count > 1").isEmpty()
    if repeated:
        nodes = materialize(nodes.repartitionByRange("first", "label", "data").sortWithinPartitions("first", "label", "data").withColumn("node", F.monotonically_increasing_id()))
    else:
        nodes = nodes.withColumn("node", F.col("first"))
    largest, total = nodes.groupBy("label").count().agg(F.max("count"), F.sum("count")).first()
    largest = largest or 1
    bits = max(1, math.ceil(math.log2(max(2, largest) / bucket)))
    tables = tables_for(similarity, bits, missed)
    coded = materialize(_codes(nodes.select("node", "label", "length", "copies", "data"), bits, tables, seed, kind))
    clumps = _clumps(coded, similarity, block, kind)
    of_clump = clumps.join(coded.select("node", "copies"), "node").groupBy("clump").agg(F.sum("copies").alias("clump_copies"), F.count("*").alias("members"))
    clumps = materialize(clumps.join(of_clump.where("members > 1"), "clump").select("node", "clump", "clump_copies"))
    coded = materialize(coded.join(clumps.select("node", "clump"), "node", "left").withColumn("clump", F.coalesce("clump", F.lit(-1))))

    found, at_once = [], max(1, rows_at_once // max(total or 1, 1))
    keys = ["label", "length", "t", "code"]
    for start in range(0, tables, at_once):
        some = F.array(*[F.struct(F.lit(t).alias("t"), F.col("codes")[t].alias("code")) for t in range(start, min(start + at_once, tables))])
        place = coded.select("node", "label", "length", "clump", F.col("codes")[0].alias("first"), F.explode(some).alias("c")).select("*", "c.*").drop("c")
        # a bucket's blocks: those of each clump, and of nodes in none, follow one another
        parts = place.groupBy(*keys, "clump").agg(F.count("*").alias("size"), F.min("first").alias("lo"), F.max("first").alias("hi"))
        parts = parts.groupBy(*keys).agg(F.sum("size").alias("size"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sort_array(F.collect_list(F.struct("clump", F.ceil(F.col("size") / block).cast("int").alias("blocks")))).alias("parts"))
        # buckets with several nodes; one whose nodes agree in the first table has no pair of its own in a later one
        parts = parts.where("size > 1 and (t = 0 or lo < hi)").select(*keys, "parts", F.aggregate("parts", F.lit(0), lambda n, x: n + x["blocks"]).alias("blocks"))
        own = F.filter("parts", lambda x: x["clump"] == F.col("clump"))[0]["blocks"]
        before = F.aggregate(F.filter("parts", lambda x: x["clump"] < F.col("clump")), F.lit(0), lambda n, x: n + x["blocks"])
        dealt = place.drop("first").join(parts, keys).withColumns({"own_blocks": own, "before": before})
        # members of a clump do not meet each other
        all_blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
        others = F.when(F.col("clump") < 0, all_blocks).otherwise(F.filter(all_blocks, lambda b: (b < F.col("before")) | (b >= F.col("before") + F.col("own_blocks"))))
        dealt = (
            dealt.withColumn("own", (F.col("before") + F.pmod(F.xxhash64("node"), F.col("own_blocks"))).cast("int"))
            .withColumn("other", F.explode(others))
            .withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})
            .select("node", "t", "code", "own", "p", "q")
            .join(coded, "node")
        )
        group = dealt.groupBy(*keys, "p", "q")
        found.append(materialize(group.applyInPandas(lambda pdf: _compare(pdf, similarity, kind), "u long, v long, n long")))
    tables_found, found = found, reduce(DataFrame.unionByName, found)
    links = found.where("u = v").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    edges = found.where("u <> v").select("u", "v").unionByName(clumps.select(F.col("node").alias("u"), F.col("clump").alias("v")))
    component = connected_components(edges, "u", "v")
    nodes = nodes.join(links, "node", "left").join(component, "node", "left").join(clumps.select("node", "clump_copies"), "node", "left")
    total = F.coalesce("n", F.lit(0)) + F.coalesce("clump_copies", F.col("copies")) - 1
    nodes = nodes.select("node", "label", "data", "first", "copies", total.alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    if repeated:
        firsts = nodes.select(F.col("node").alias("component_id"), F.col("first").alias("of"))
        nodes = nodes.join(firsts, "component_id").withColumn("component_id", F.col("of"))
    same = F.struct("label", "data").alias("same")
    nodes = materialize(nodes.select(same, F.col("copies").alias("size"), "n_links", "component_id"))
    for x in (coded, clumps, *tables_found):
        discard(x)
    # copies of one vector do not meet in one task, and rows without a usable vector meet nothing
    own = join_counted(rows.where("data is not null").select("id", same), nodes, "same").select("id", "n_links", "component_id")
    none = rows.where("data is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = own.unionByName(none).select(F.col("id").alias(key), "n_links", "component_id")
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
