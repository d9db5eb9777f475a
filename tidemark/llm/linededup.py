"""Line dedup: lines that several documents share stay in the first of them only.

A line's key is the line without whitespace at its ends, A-Z lower-cased; keys of fewer than
``min_chars`` code points never drop. Lines become pairs of 64-bit hashes of their keys, which
are range-partitioned with a secondary sort by document and position: each range streams its
hashes in order, the first document of a hash keeps it, all others lose it. What comes back is
not text but a bitmap for each document, of the words of 64 lines that lose any.

Hashes are uniform, so the rows of a prefix of 16 bits are counted (65,536 sums at most, made
before the shuffle). A prefix with more than its share holds a hot line, and its rows are dealt
to ``SLOTS`` by document as well; the slots' first documents, which are SLOTS for each hash at
most, then meet once more.

Documents. Rows of one id are one document, so they never lose lines to each other, and rows of
one id and text share a bitmap. Rows without an id are one document too, which comes last. A
null or an empty text is one empty line. Extra columns are not read; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
#: Parts of a hot prefix; prefixes with more than 1/HOT of all rows are hot.
SLOTS, HOT = 256, 1000


def key_of(line: Column) -> Column:
    """The line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased and nothing else."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _pair(x: Column, a: str, b: str) -> list[Column]:
    """Two hashes of 64 bits, independent of each other."""
    return [F.xxhash64(x).alias(a), F.xxhash64(F.lit(1), x).alias(b)]


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, body and the hashes t1, t2 of the body; an id and these name a row's lines."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).alias("doc"), body.alias("body"), *_pair(body, "t1", "t2"))


def line_hashes(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """h1, h2, doc, t1, t2, pos of each line whose key has ``min_chars`` code points or more."""
    lines = _texts(docs, key, text).select("doc", "t1", "t2", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    found = lines.select("doc", "t1", "t2", "pos", key_of(F.col("line")).alias("k")).where(F.char_length("k") >= min_chars)
    return found.select(*_pair(F.col("k"), "h1", "h2"), "doc", "t1", "t2", "pos")


def _repeats(by: list[str]) -> Column:
    """Whether a row's document is not the first that its range streams for the hash; null ids come last."""
    so_far = Window.partitionBy(*by).orderBy(F.col("doc").asc_nulls_last(), "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first("doc").over(so_far)
    return ~F.col("doc").eqNullSafe(first)


def dropped_lines(lines: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """doc, t1, t2, pos of the lines to drop, from those of ``line_hashes``; and the tables that they are read from."""
    tables = [materialize(lines)]
    lines = tables[0]
    prefix = F.shiftrightunsigned("h1", 48)
    sums = lines.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n"))
    total = sums.agg(F.sum("n")).first()[0] or 0
    # at most HOT prefixes exceed total / HOT
    hot = [r.prefix for r in sums.where(F.col("n") > total / HOT).collect()]
    slot = F.when(prefix.isin(hot), F.pmod(F.xxhash64("doc", "t1"), F.lit(SLOTS))).otherwise(-1) if hot else F.lit(-1).cast("long")
    by = ["h1", "h2", "slot"]
    ranges = lines.withColumn("slot", slot).repartitionByRange(*by).sortWithinPartitions(*by, F.col("doc").asc_nulls_last(), "pos")
    streamed = ranges.withColumn("repeat", _repeats(by)).where("repeat or slot >= 0")
    if not hot:
        return streamed.select("doc", "t1", "t2", "pos"), tables
    # the first documents of each slot of a hot prefix meet: SLOTS documents for each hash at most
    tables.append(materialize(streamed))
    streamed = tables[1]
    last = streamed.where("not repeat").withColumn("again", _repeats(["h1", "h2"])).where("again")
    return streamed.where("repeat").select("doc", "t1", "t2", "pos").unionByName(last.select("doc", "t1", "t2", "pos")), tables


def drop_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """doc, t1, t2, dropped: for each document that loses lines, the words of 64 lines that lose any.

    ``dropped`` is an array of (word, bits) in order of ``word``; bit b of a word stands for line 64 * word + b.
    Repeated rows of one id and text share a row. The result is a settled table."""
    rows, tables = dropped_lines(line_hashes(docs, key, text, min_chars))
    word = F.shiftright("pos", 6).alias("word")
    words = rows.repartition("doc", "t1", "t2").groupBy("doc", "t1", "t2", word).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    out = materialize(words.groupBy("doc", "t1", "t2").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped")))
    for x in tables:
        discard(x)
    return out


def positions(dropped: Column) -> Column:
    """The line numbers of a bitmap, in order; null gives none."""
    of_word = lambda w: F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(F.getbit(w["bits"], b) == 1, w["word"] * 64 + b)), lambda x: x.isNotNull()
    )
    return F.coalesce(F.flatten(F.transform(dropped, of_word)), F.array().cast("array<int>"))


def keep_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """A row for each row: the key, n_lines, n_dropped, dropped (the bitmap, null if empty) and ``kept``, the text that stays."""
    bits = drop_bitmaps(docs, key, text, min_chars)
    all_rows = _texts(docs, key, text)
    on = all_rows["doc"].eqNullSafe(bits["doc"]) & (all_rows["t1"] == bits["t1"]) & (all_rows["t2"] == bits["t2"])
    rows = all_rows.join(bits, on, "left").select(all_rows["doc"], "body", "dropped")
    rows = rows.select("doc", "dropped", "body", F.split("body", "\n").alias("lines"), positions(F.col("dropped")).alias("gone"))
    rest = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.size("gone") == 0, F.col("body")).otherwise(F.array_join(F.transform(rest, lambda i: F.col("lines")[i]), "\n"))
    return rows.select(
        F.col("doc").alias(key), F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), "dropped", kept.alias("kept")
    )


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """The key, n_lines, n_dropped, kept_sha256 and ``bitmap``: ``dropped`` as ``word:bits`` joined by commas; no text."""
    out = keep_lines(docs, key, text, min_chars)
    bitmap = F.array_join(F.transform("dropped", lambda w: F.concat_ws(":", w["word"].cast("string"), w["bits"].cast("string"))), ",")
    return out.select(key, "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"), F.coalesce(bitmap, F.lit("")).alias("bitmap"))


def oracle(min_chars: int = 10) -> str:
    """DuckDB SQL of ``report`` over ``documents`` with one row for each id."""
    blanks = "' ' || " + " || ".join(f"chr({ord(c)})" for c in BLANKS[1:])
    return f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line FROM cut),
keyed AS (SELECT *, translate(trim(line, {blanks}), '{UPPER}', '{LOWER}') AS k FROM lines),
marked AS (SELECT *, length(k) >= {min_chars} AND doc_id > min(doc_id) OVER (PARTITION BY k) AS gone FROM keyed),
words AS (SELECT doc_id, pos // 64 AS word,
  bit_or(CASE WHEN pos % 64 = 63 THEN CAST(-9223372036854775808 AS BIGINT) ELSE CAST(1 AS BIGINT) << (pos % 64) END) AS bits FROM marked WHERE gone GROUP BY ALL),
bitmaps AS (SELECT doc_id, string_agg(word || ':' || bits, ',' ORDER BY word) AS bitmap FROM words GROUP BY doc_id),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id)
SELECT kept.*, coalesce(bitmap, '') AS bitmap FROM kept LEFT JOIN bitmaps USING (doc_id)"""
