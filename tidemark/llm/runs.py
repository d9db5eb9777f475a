"""Periodic runs of words: stretches that repeat a block at least four times.

Words are appended one by one to a suffix automaton. Its suffix links are a tree, kept in splay
trees as link-cut access needs it: access to an appended word's state recolours the path to the
root with the word's position, and passes the segments of the path that had one colour before,
which are few (O(log n) amortised). A segment's colour is the last earlier end of its longest
suffix: if that lies d words back and the suffix has L words, the L + d words that end here have
period d, and no smaller one, and reach as far left as that period does. L >= d is a square;
with L >= 3 d the stretch is as long as a run must be, and the appends that follow extend it.

Only parts of a text where a run can lie are appended: past its first block, each word of a run
with period q occurred at most q words before. Parts are found by these distances, for q up to
each power of two; parts that overlap are one, and a run is never cut.

Documents. A null or an empty text has no words and no run. Repeated rows, and rows without an
id, are judged each for itself; further columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: A run has this many words, and this many times its period, at least.
LEAST, TIMES = 6, 4
#: Texts that a worker holds as Python objects at a time.
ROWS = 64


class LastEnds:
    """A suffix automaton whose suffix-link tree knows the last end of each state's words."""

    def __init__(self) -> None:
        # per state: transitions, suffix link, longest length; 0 stands for no state, 1 is the root
        self.step: list[dict] = [{}, {}]
        self.link, self.length = [0, 0], [0, 0]
        # splay trees of the paths of one colour: children, parent (of a tree's root: the state above the path), colour (of a tree's root)
        self.above, self.below, self.up, self.colour = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.last, self.size = 1, 0

    def _state(self, step: dict, link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.above.append(0)
        self.below.append(0)
        self.up.append(link)
        self.colour.append(-1)
        return len(self.link) - 1

    def _splay(self, x: int) -> None:
        """Make ``x`` the root of its splay tree; the colour goes with the root."""
        above, below, up = self.above, self.below, self.up
        while True:
            p = up[x]
            if above[p] != x and below[p] != x or not p:
                return
            g = up[p]
            straight, inner = g and (above[g] == p or below[g] == p), above[p] == x
            if straight:
                if (above[g] == p) == inner:
                    self._rotate(p)
                else:
                    self._rotate(x)
            self._rotate(x)

    def _rotate(self, x: int) -> None:
        above, below, up = self.above, self.below, self.up
        p = up[x]
        g = up[p]
        if above[g] == p and g:
            above[g] = x
        elif below[g] == p and g:
            below[g] = x
        else:
            self.colour[x] = self.colour[p]
        if above[p] == x:
            c = above[p] = below[x]
            below[x] = p
        else:
            c = below[p] = above[x]
            above[x] = p
        if c:
            up[c] = p
        up[p], up[x] = x, g

    def append(self, word: int) -> list[tuple[int, int]]:
        """(L, end) for each segment of the new state's path: its longest suffix and where that ended last."""
        step, link, length = self.step, self.link, self.length
        here, self.size = self.size, self.size + 1
        p, new = self.last, self._state({}, 0, self.size)
        while p and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if not p:
            q = 1
        else:
            q = step[p][word]
            if length[q] != length[p] + 1:
                q = self._clone(p, q, word)
        link[new] = self.up[new] = q
        self.last = new
        # access: every segment above the new state loses what lies below, and joins its path
        found, deeper, x = [], new, q
        while x:
            self._splay(x)
            if self.colour[x] >= 0:
                found.append((length[x], self.colour[x]))
            rest = self.below[x]
            if rest:
                self.colour[rest] = self.colour[x]
            self.below[x] = deeper
            deeper, x = x, self.up[x]
        self.colour[deeper] = here
        return found

    def _clone(self, p: int, q: int, word: int) -> int:
        """A state for the words of ``q`` that also end here, above ``q`` on its path and of its colour."""
        step, link = self.step, self.link
        c = self._state(dict(step[q]), link[q], self.length[p] + 1)
        while p and step[p].get(word) == q:
            step[p][word] = c
            p = link[p]
        link[q] = c
        self._splay(q)
        a = self.above[c] = self.above[q]
        if a:
            self.up[a] = c
        self.above[q], self.up[c] = c, q
        return c


def parts(ids: np.ndarray) -> list[tuple[int, int]]:
    """Ranges (start, stop) of words outside which no run lies, apart from each other."""
    n = len(ids)
    if n < LEAST:
        return []
    order = np.argsort(ids, kind="stable")
    back = np.full(n, n, dtype=np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    found, reach = [], 1
    while reach // 2 * TIMES < n:
        # runs with a period of more than reach / 2, and of reach at most, have this many words past their first block
        least = max(LEAST - reach, (TIMES - 1) * (reach // 2 + 1))
        near = np.concatenate([[0], (back <= reach).view(np.int8), [0]])
        edges = np.flatnonzero(np.diff(near))
        starts, stops = edges[::2], edges[1::2]
        long = stops - starts >= least
        found += [(max(0, a - reach), b) for a, b in zip(starts[long].tolist(), stops[long].tolist(), strict=True)]
        reach *= 2
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def runs(words: Sequence) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, in order of start and period."""
    codes: dict = {}
    ids = [codes.setdefault(w, len(codes)) for w in words]
    out = []
    for start, stop in parts(np.array(ids, dtype=np.int64)) if len(codes) < len(ids) else []:
        ends: dict[tuple[int, int], int] = {}
        tree = LastEnds()
        for k in range(stop - start):
            for longest, end in tree.append(ids[start + k]):
                period = k - end
                if longest >= (TIMES - 1) * period:
                    ends[k + 1 - longest - period, period] = k
        out += [(start + a, b + 1 - a, q) for (a, q), b in ends.items() if b + 1 - a >= LEAST]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: Sequence[bytes], found: Sequence[tuple[int, int, int]]) -> list[bytes]:
    """The words, where each run keeps its first block alone."""
    if not found:
        return list(words)
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return [words[k] for k in np.flatnonzero(keep).tolist()]


FIELDS = ("start", "length", "period", "exponent_milli")


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """A row for each row: the key, n_runs, the longest run (ties: smallest start, then period), runs_sha256, collapsed_sha256.

    ``runs_sha256`` is of ``start,length,period`` and a line feed for each run, ``collapsed_sha256`` of the words
    that stay, joined by one space; ``with_text`` adds that text itself as ``collapsed``."""
    schema = StructType(
        [StructField(key, docs.schema[key].dataType), StructField("n_runs", LongType())]
        + [StructField(c, LongType()) for c in FIELDS]
        + [StructField(c, StringType()) for c in ("runs_sha256", "collapsed_sha256", *["collapsed"] * with_text)]
    )
    arrow = to_arrow_schema(schema)

    def judged(body: str) -> tuple:
        words = body.encode("utf-8", "surrogatepass").split()
        found = runs(words)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else None
        longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join(f"{a},{n},{q}\n" for a, n, q in found)
        rest = b" ".join(collapsed(words, found))
        hashes = (hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(rest).hexdigest())
        return (len(found), *longest, *hashes, *[rest.decode("utf-8", "replace")] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                piece = whole.slice(at, ROWS)
                rows = [judged(x) for x in piece.column(1).to_pylist()]
                columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(list(arrow)[1:])]
                yield pa.RecordBatch.from_arrays([piece.column(0).cast(arrow.field(0).type), *columns], schema=arrow)

    return docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text)).mapInArrow(run, schema)


def with_repeats(docs: DataFrame, hit: Column, start: Column, shorten: Column, text: str = "text") -> DataFrame:
    """``docs`` whose texts, where ``hit``, repeat a block to their end: word i >= a becomes word a + (i - a) % p.

    Of n words, a is ``start`` % n and p is 1 + (n - a) / ``shorten``, rounded down. Words are joined by one space;
    texts without words stay as they are."""
    words = F.when(hit, F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = docs.withColumns({"_words": words, "_start": start, "_shorten": shorten}).withColumn("_n", F.coalesce(F.size("_words"), F.lit(0)))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.pmod("_start", "_n")).cast("int"))
    rows = rows.withColumn("_p", (F.floor((F.col("_n") - F.col("_a")) / F.col("_shorten")) + 1).cast("int"))
    tail = F.col("_n") - F.col("_a")
    copies = F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), F.ceil(tail / F.col("_p")).cast("int")))
    whole = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), F.slice(copies, F.lit(1), tail)), " ")
    return rows.withColumn(text, F.when(F.col("_n") > 0, whole).otherwise(F.col(text))).select(*docs.columns)
