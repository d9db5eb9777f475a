"""Near-duplicate texts by MinHash bands, odd sketches and full shingle sets.

A text's words (A-Z lower-cased, split at ASCII white space) give its set of distinct
n-word shingles. MinHash samples of the set are used twice: groups of them are band keys,
and all of them are folded into an odd sketch, a bitmap in which each sample flips one bit.
Two sketches differ in few bits when the sets are similar, and the count of differing bits
estimates high similarities well; so pairs from a common band are first held against each
other by sketch, and only those within reach of the threshold on their full sets.

Pairs are never listed for a whole group. Texts with equal sets are one node. In each
bucket the members are first held against the bucket's smallest node; components of these
links are found; then buckets that still hold several components are searched in blocks of
bounded size for pairs that cross components, the members of the smallest node's component
never meeting each other. A pair left out is one whose ends are already connected, so
components are those of all candidate pairs.

Hot buckets and centres, 2,000 at most, are joined by broadcast (``join_counted``), so that
none of them meets in one task. Texts for the confirmation are read
where a bitmap of fixed size, made of the wanted ids, lets them pass, before they are joined
by id: one plan for any number of ids, which shuffles few other texts.

Defined results: null or empty text, or one without words, has n_shingles 0, is its own
component and is kept; with fewer words than a shingle has, the whole sequence is one
shingle; texts of any length are read whole; rows of one key and text count as one node (each
row is returned); rows without a key, and different texts under one key, are nodes of their
own by ``numbered``, null keys last in order; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, discard, join_counted, materialize

#: MinHash samples, bits of the odd sketch, samples in a band at most.
SAMPLES, BITS, ROWS = 256, 512, 4
WORD_CACHE = 50_000
#: Bits of the bitmap of wanted ids, in 2,000 pages of 4 KB: 8 MB are broadcast at most.
PAGE = 1 << 15
BITMAP = 2000 * PAGE
_words: dict[bytes, int] = {}


def bands_for(similarity: float, missed: float = 1e-5) -> tuple[int, int]:
    """Bands and samples in each, so that a pair at the threshold shares no band with probability ``missed`` at most.

    ROWS samples in a band, or fewer where the samples would not do."""
    for rows in range(ROWS, 0, -1):
        bands = max(1, math.ceil(math.log(missed) / math.log1p(-min(similarity**rows, 1 - 1e-12))))
        if bands * rows <= SAMPLES:
            return bands, rows
    raise ValueError(f"{SAMPLES} samples do not do for a similarity of {similarity}")


def least_estimate(similarity: float, deviations: float = 4.75) -> float:
    """The sketch estimate below which a pair at the threshold practically never falls.

    Samples that differ put two marks each into BITS bits; the variance of the count of
    odd bits follows from the chances that one bit, or two bits, are odd."""
    marks = 2 * SAMPLES * (1 - similarity)
    one, two = (1 - 2 / BITS) ** marks, (1 - 4 / BITS) ** marks
    odd = BITS / 4 * (1 - two) + BITS**2 / 4 * (two - one * one)
    of_sketch = math.sqrt(odd) / (2 * SAMPLES * one)
    return similarity - deviations * math.hypot(math.sqrt(similarity * (1 - similarity) / SAMPLES), of_sketch)


def most_bits(similarity: float) -> int:
    """The same as a count of differing bits: estimate = 1 + BITS / (4 SAMPLES) ln(1 - 2 z / BITS)."""
    return math.ceil(BITS / 2 * (1 - math.exp((least_estimate(similarity) - 1) * 4 * SAMPLES / BITS)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str | None], words: int, chunk: int = 100) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles; a chunk's words are in memory at a time."""
    return [s for at in range(0, len(texts), chunk) for s in _shingle_sets(texts[at : at + chunk], words)]


def _shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    split = [(x or "").encode("utf-8", "surrogatepass").lower().split() for x in texts]
    if len(_words) > WORD_CACHE:
        _words.clear()
    for w in {w for x in split for w in x if w not in _words}:
        _words[w] = xxhash.xxh3_64_intdigest(w)
    out = []
    for x in split:
        h = np.fromiter(map(_words.__getitem__, x), dtype=np.uint64, count=len(x))
        n = min(words, len(h))
        if n:
            s = h[: len(h) - n + 1]
            for k in range(1, n):
                s = _mix(s) + h[k : len(h) - n + 1 + k]
            h = np.unique(_mix(s + np.uint64(n)))
        out.append(h)
    return out


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x >> np.uint64(32)).astype(np.uint32)
    return x[:n] | np.uint32(1), x[n:]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples of non-empty sets: one row each, SAMPLES of 32 bits."""
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), SAMPLES), dtype=np.uint32)
    work = np.empty_like(values)
    for k, (factor, flip) in enumerate(zip(*_seeds(SAMPLES), strict=True)):
        np.bitwise_xor(values, flip, out=work)
        np.multiply(work, factor, out=work)
        out[:, k] = np.minimum.reduceat(work, starts)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Each sample flips one of BITS bits; returned as BITS / 64 words."""
    place = _mix(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    flat = (np.arange(len(samples))[:, None] * BITS + place.astype(np.int64)).ravel()
    odd = (np.bincount(flat, minlength=len(samples) * BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(samples), BITS), axis=1).view(np.int64)


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = samples[:, : bands * rows].reshape(len(samples), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), part.shape[:2])
    for k in range(rows):
        key = _mix(key) + part[:, :, k]
    return _mix(key).view(np.int64)


def fingerprint(docs: DataFrame, key: str, text: str, words: int, bands: int, rows: int) -> DataFrame:
    """key, n_shingles, digest of the set (d1, d2), band keys, odd sketch."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                sets = shingle_sets(part["text"].tolist(), words)
                digests = np.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], dtype="S16")
                digests = np.frombuffer(b"".join(d.ljust(16, b"\0") for d in digests.tolist()), dtype=np.int64).reshape(-1, 2)
                full = [k for k, s in enumerate(sets) if len(s)]
                samples = signatures([sets[k] for k in full]) if full else np.empty((0, SAMPLES), np.uint32)
                rest = pd.DataFrame({"bands": [[]] * len(part), "sketch": [[]] * len(part)})
                rest.loc[full, "bands"] = pd.Series(list(band_keys(samples, bands, rows)), index=full, dtype=object)
                rest.loc[full, "sketch"] = pd.Series(list(odd_sketches(samples)), index=full, dtype=object)
                yield pd.DataFrame(
                    {
                        key: part[key].to_numpy(),
                        "n_shingles": [len(s) for s in sets],
                        "d1": digests[:, 0],
                        "d2": digests[:, 1],
                        "bands": rest["bands"],
                        "sketch": rest["sketch"],
                    }
                )

    schema = f"{key} {kind}, n_shingles long, d1 long, d2 long, bands array<long>, sketch array<long>"
    return docs.select(key, F.col(text).cast("string").alias("text")).mapInPandas(run, schema)


def _in_reach(similarity: float) -> Column:
    """Of joined rows with n_a, n_c, s_a, s_c: whether sizes and sketches allow the threshold."""
    bits = sum((F.bit_count(F.col("s_a")[k].bitwiseXOR(F.col("s_c")[k])) for k in range(BITS // 64)), F.lit(0))
    least, most = F.least("n_a", "n_c"), F.greatest("n_a", "n_c")
    return (least >= most * F.lit(similarity)) & (bits <= most_bits(similarity))


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` (id, text) whose id is in ``ids`` (one column, id), and few others: a join by id follows."""
    place = F.pmod(F.xxhash64("id"), F.lit(BITMAP))
    page, bit = F.floor(place / PAGE).cast("int").alias("page"), (place % PAGE).alias("bit")
    pages = ids.select(page, bit).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1
    return texts.select("id", "text", page, bit).join(F.broadcast(pages), "page").where(is_set).select("id", "text")


def _links(pairs: DataFrame, texts: DataFrame, words: int, percent: int, group: int = 256) -> DataFrame:
    """Pairs (a, c) whose full sets reach the threshold. A centre's members are dealt to
    groups of about ``group``; in a task only the centre's set stays in memory."""
    sizes = pairs.groupBy("c").agg(F.count("*").alias("size"))
    dealt = join_counted(pairs, sizes, "c").select("a", "c", F.pmod(F.xxhash64("a"), F.ceil(F.col("size") / group)).alias("g"))
    wanted = _texts_of(texts, pairs.select(F.col("a").alias("id")))
    members = dealt.join(wanted, F.col("a") == F.col("id")).select("c", "g", "id", F.lit(1).alias("member"), "text")
    centres = dealt.select("c", "g").distinct()
    wanted = _texts_of(texts, pairs.select(F.col("c").alias("id")))
    centres = centres.join(wanted, F.col("c") == F.col("id")).select("c", "g", "id", F.lit(0).alias("member"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own = None, []
        for pdf in batches:
            sets = shingle_sets(pdf["text"].tolist(), words)
            found = []
            for c, g, a, member, s in zip(pdf["c"], pdf["g"], pdf["id"], pdf["member"], sets, strict=True):
                if not member:
                    own = [*own, s] if now == (c, g) else [s]
                    now = (c, g)
                    continue
                for o in own:
                    both = len(np.intersect1d(o, s, assume_unique=True))
                    if 100 * both >= percent * (len(o) + len(s) - both):
                        found.append((a, c))
                        break
            yield pd.DataFrame(found, columns=["a", "c"], dtype="int64")

    return (
        members.unionByName(centres)
        .repartition("c", "g")
        .sortWithinPartitions("c", "g", "member")
        .mapInPandas(run, "a long, c long")
        .distinct()
    )


def _by_group(rows: DataFrame, keys: list[str], make: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``make`` over each group of rows, groups being small; tasks stream over sorted groups."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            new = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
            cuts = np.flatnonzero(new)
            rest = pdf.iloc[cuts[-1] :]
            for i, j in zip(cuts, cuts[1:], strict=False):
                yield make(pdf.iloc[i:j])
        if rest is not None and len(rest):
            yield make(rest)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def _owned(pdf: pd.DataFrame, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) in a group of block p against block q of one bucket: pairs across
    components, in reach by size and sketch, whose first common band is this bucket."""
    p, q = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
    own = pdf["own"].to_numpy()
    left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
    if not len(left) or not len(right):
        return left[:0], right[:0]
    sketch = np.stack(pdf["sketch"].to_numpy()).view(np.uint64)
    bands = np.stack(pdf["bands"].to_numpy())
    n, component = pdf["n"].to_numpy(), pdf["component"].to_numpy()
    z = np.zeros((len(left), len(right)), dtype=np.int32)
    for k in range(BITS // 64):
        z += np.bitwise_count(sketch[left, k][:, None] ^ sketch[right, k][None, :])
    a, b = n[left][:, None], n[right][None, :]
    good = (z <= most_bits(similarity)) & (np.minimum(a, b) >= similarity * np.maximum(a, b))
    good &= component[left][:, None] != component[right][None, :]
    if p == q:
        good &= left[:, None] < right[None, :]
    x, y = np.nonzero(good)
    i, j = left[x], right[y]
    band = int(np.flatnonzero(bands[0] == pdf["bucket"].iloc[0])[0])
    keep = np.ones(len(i), dtype=bool)
    for t in range(band):
        keep &= bands[i, t] != bands[j, t]
    return i[keep], j[keep]


def _overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Intersection sizes of the pairs (i, j): pair by pair, or by products of the incidence
    matrix of all shingles that two sets share, whichever is less work."""
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    values = values[counts > 1]
    if len(i) * 2e-5 < len(sets) ** 2 * len(values) / 4e9:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], dtype=np.int64)
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for at in range(0, len(values), 4096):
        part = values[at : at + 4096]
        seen = np.zeros((len(sets), len(part)), dtype=np.float32)
        for k, s in enumerate(sets):
            place = np.searchsorted(part, s[(s >= part[0]) & (s <= part[-1])])
            s = s[(s >= part[0]) & (s <= part[-1])]
            seen[k, place[part[place] == s]] = 1
        total += seen @ seen.T
    return total[i, j].astype(np.int64)


def _crossing(rows: DataFrame, texts: DataFrame, similarity: float, words: int, percent: int, block: int = 256) -> DataFrame:
    """Links (a, c) across components, from rows (bucket, mains, size, in_main, node, component, n, sketch, bands).

    A bucket's members are dealt to blocks, those of its main component (``mains`` of ``size``)
    to blocks of their own; each pair of blocks meets in one group, but for two main ones. A
    first pass over the sketches finds the nodes that have any pair to settle there; only
    their texts are then sent to the group, which settles all its pairs on full sets and
    returns links, at most one for each two components.
    """
    mains, others = (F.ceil(x / block).cast("int") for x in (F.col("mains"), F.col("size") - F.col("mains")))
    own = F.when(F.col("in_main"), F.pmod(F.xxhash64("node"), mains)).otherwise(mains + F.pmod(F.xxhash64("node"), others)).cast("int")
    keys = ["bucket", "p", "q"]
    columns = [*keys, "own", "node", "component", "n", "sketch", "bands"]
    dealt = (
        rows.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.when(F.col("in_main"), mains).otherwise(0), mains + others - 1)))
        .withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})
        .select(*columns)
    )
    schema = "bucket long, p int, q int, own int, node long, component long, n long, sketch array<long>, bands array<long>"

    def open_nodes(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = _owned(pdf, similarity)
        return pdf.iloc[np.unique(np.concatenate([i, j]))][columns]

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = _owned(pdf, similarity)
        found = []
        if len(i):
            sets = shingle_sets(pdf["text"].tolist(), words)
            size = np.array([len(s) for s in sets])
            both = _overlaps(sets, i, j)
            node, component = pdf["node"].to_numpy(), pdf["component"].to_numpy()
            linked = 100 * both >= percent * (size[i] + size[j] - both)
            one = {}
            for a, b in zip(i[linked], j[linked], strict=True):
                one.setdefault(tuple(sorted((component[a], component[b]))), (node[a], node[b]))
            found = list(one.values())
        return pd.DataFrame(found, columns=["a", "c"], dtype="int64")

    nodes = materialize(_by_group(dealt, keys, open_nodes, schema))
    wanted = _texts_of(texts, nodes.select(F.col("node").alias("id")))
    links = materialize(_by_group(nodes.join(wanted, F.col("node") == F.col("id")).drop("id"), keys, settle, "a long, c long").distinct())
    discard(nodes)
    return links


def numbered(docs: DataFrame, key: str, text: str, number: str = "_node") -> DataFrame:
    """Adds ``number``: one for each different pair of key and text, in order of the keys, null ones last.

    The key itself, where each is there and has one text."""
    digest = F.xxhash64(F.col(text))
    texts = docs.groupBy(key).agg(F.min(digest).alias("lo"), F.max(digest).alias("hi"))
    if texts.where(F.col(key).isNull() | (F.col("lo") < F.col("hi"))).isEmpty():
        return docs.withColumn(number, F.col(key).cast("long"))
    order = (F.col("_key").asc_nulls_last(), F.col("_digest"))
    pairs = docs.select(F.col(key).alias("_key"), digest.alias("_digest")).distinct().repartitionByRange(*order)
    pairs = materialize(pairs.sortWithinPartitions(*order).withColumn(number, F.monotonically_increasing_id()))
    same = F.col(key).eqNullSafe(F.col("_key")) & (digest == F.col("_digest"))
    return materialize(docs.join(pairs, same).drop("_key", "_digest"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """Per row: key, n_shingles, component_id (smallest key reachable), kept (the row's node is its component's first).

    Links: 100 * intersection >= percent * union of the full shingle sets. ``key`` is an integer column.
    """
    docs = numbered(docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text")), key, "text")
    found = node_duplicates(docs.select("_node", "text"), words, percent)
    if not hasattr(docs, "_tidemark_path"):
        return found.select(F.col("node").alias(key), "n_shingles", "component_id", "kept")
    keys = docs.select(F.col("_node").alias("node"), key).distinct()
    sizes = found.groupBy("component_id").agg(F.count("*").alias("size"))
    firsts = keys.select(F.col("node").alias("component_id"), F.col(key).alias("_first")).join(sizes, "component_id")
    return join_counted(found.join(keys, "node"), firsts, "component_id").select(key, "n_shingles", F.col("_first").alias("component_id"), "kept")


def node_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of (_node, text): node, n_shingles, component_id (smallest node reachable), kept (node = component_id); a node has one text."""
    similarity = percent / 100
    docs = docs.select(F.col("_node").alias("id"), "text")
    prints = materialize(fingerprint(docs, "id", "text", words, *bands_for(similarity)))
    filled = prints.where("n_shingles > 0")
    firsts = filled.groupBy("d1", "d2").agg(F.min("id").alias("node"), F.count("*").alias("size"))
    firsts = materialize(firsts)
    nodes = filled.join(firsts, (filled["id"] == firsts["node"]) & (filled["d1"] == firsts["d1"]) & (filled["d2"] == firsts["d2"]))
    nodes = materialize(nodes.select("node", F.col("n_shingles").alias("n"), "sketch", "bands").dropDuplicates(["node", "n"]))

    # buckets with several nodes, and their members
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("size")).where("size > 1")
    shared = materialize(shared)
    members = materialize(join_counted(rows, shared, "bucket"))
    discard(shared)

    # round 1: every member against the bucket's first
    of = nodes.select("node", "n", "sketch")
    a, c = (of.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ac")
    stars = members.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("c")).distinct()
    stars = materialize(stars.join(a, "a").join(c, "c").where(_in_reach(similarity)).select("a", "c"))
    links = materialize(_links(stars, docs, words, percent))
    found = materialize(connected_components(links, "a", "c"))

    # round 2: pairs across components in buckets that hold several
    labelled = members.where("size > 2").join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    labelled = materialize(labelled)
    kinds = labelled.groupBy("bucket").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by("component", "node").alias("main"))
    kinds = materialize(kinds.where("lo < hi").select("bucket", "size", "main"))
    mixed = materialize(join_counted(labelled, kinds, "bucket").withColumn("in_main", F.col("component") == F.col("main")))
    mains = materialize(mixed.groupBy("bucket").agg(F.count("*").alias("size"), F.count_if("in_main").alias("mains")))
    rows = join_counted(mixed.select("bucket", "node", "component", "in_main"), mains, "bucket").join(nodes, "node")
    more = _crossing(rows, docs, similarity, words, percent)
    edges = materialize(found.select(F.col("node").alias("a"), F.col("component").alias("c")).unionByName(more))
    stars_found, found = found, materialize(connected_components(edges, "a", "c"))
    for used in (members, stars, links, labelled, kinds, mixed, mains, edges, more, nodes, stars_found):
        discard(used)

    # each set's component, then the rows of each set: large groups of copies do not meet in a task, and empty sets meet nothing
    placed = firsts.join(found, "node", "left").select(F.struct("d1", "d2").alias("set"), "size", F.coalesce("component", "node").alias("component_id"))
    placed = join_counted(filled.select("id", "n_shingles", F.struct("d1", "d2").alias("set")), placed, "set").select("id", "n_shingles", "component_id")
    placed = placed.unionByName(prints.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id")))
    return placed.select(F.col("id").alias("node"), "n_shingles", "component_id").withColumn("kept", F.col("node") == F.col("component_id"))
