"""WARC derivatives: metadata and plain-text conversion records from responses.

Each response gives a ``metadata`` record (what was found about the page) and a
``conversion`` record (its text). Both name the response by WARC-Refers-To and keep its
target, date and source headers; blocks carry SHA-256 digests, the metadata also the
response's payload digest. Of a WARC file's response the payload digest is that of its bytes
as they stand, the digest that the source gave is kept beside it, and the text is that of the
body with its chunks joined, decompressed and read in its character set. Record ids are derived from the response's id and the record
type, so a rerun or a retried task writes the same records.

Text: comments, scripts and styles go, block elements and line breaks end a line, other
tags vanish, all named, decimal and hex entities are decoded (once, a no-break space as a
blank), white space is collapsed.

Tags are cut out by a scan that never goes back: a start without an end is looked for once.

Defined results: a response without payload gives an empty conversion block; null ids and
targets stay empty headers; white-space-only text is the empty block; texts of any length
are kept whole; repeated responses give repeated derivatives; an empty table gives an
empty table; further columns of the input are ignored.
"""

from __future__ import annotations

import html as html_entities
import html.entities
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: In this order, as patterns that RE2 reads; the operator does the same by scanning. ENTITIES stands for all entities.
ENTITIES = "&"
HTML_STEPS = (
    (r"(?s)<!--.*?-->", " "),
    (r"(?is)<script\b.*?</script\s*>", " "),
    (r"(?is)<style\b.*?</style\s*>", " "),
    (r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|title|head|body|blockquote|pre)\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
    (ENTITIES, ""),
    (r"[ \t\r\f]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"^[ \n]+|[ \n]+$", ""),
)
COLUMNS = (
    "page_id", "record_type", "record_id", "refers_to", "target_uri", "record_date", "content_type", "source_headers",
    "payload_digest", "block_digest", "content_length", "block",
)


ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")


def decode_entities(text: str) -> str:
    """Each entity once, as HTML 5 reads it in text; no-break spaces that entities stand for become blanks."""
    return ENTITY.sub(lambda m: html_entities.unescape(m[0]).replace("\xa0", " "), text) if "&" in text else text


#: Starts and ends of what the first steps take out.
SPANS = tuple(
    (re.compile(begin, re.I | re.A), re.compile(end, re.I | re.A), new)
    for begin, end, new in (
        (r"<!--", r"-->", " "),
        (r"<script\b", r"</script[ \t\r\n\f]*>", " "),
        (r"<style\b", r"</style[ \t\r\n\f]*>", " "),
        (r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|title|head|body|blockquote|pre)\b", ">", "\n"),
        (r"<", r">", ""),
    )
)
LANG = re.compile(r"""\blang[ \t\r\n\f]*=[ \t\r\n\f]*["']?([A-Za-z-]+)""", re.I | re.A)
HREF = re.compile(r"\bhref\b", re.I | re.A)
CLOSE = re.compile(">")


def spans(text: str, begin: re.Pattern, end: re.Pattern):
    """(start, stop) of stretches from ``begin`` to the first ``end`` behind it. One start without an end is the last one looked at."""
    at = 0
    while (a := begin.search(text, at)) and (z := end.search(text, a.end())):
        yield a.start(), z.end()
        at = z.end()


def text_of(html: str) -> str:
    """The page's text, in time linear in the page."""
    for begin, end, new in SPANS:
        if "<" not in html:
            break
        out, at = [], 0
        for a, z in spans(html, begin, end):
            out += (html[at:a], new)
            at = z
        html = "".join([*out, html[at:]])
    html = re.sub(r"[ \t\r\f]+", " ", decode_entities(html))
    return re.sub(r" ?\n[ \n]*", "\n", html).strip(" \n")


def _tags(html: str, name: str):
    """Texts of the start tags of that name, without the closing sign."""
    for a, z in spans(html, re.compile(rf"<{name}\b", re.I | re.A), CLOSE):
        yield html[a : z - 1], z


def about(html: str) -> tuple[str, str, int]:
    """Title, language of the first html tag that names one, number of links with an address."""
    at = next((z for _, z in _tags(html, "title")), None)
    stop = len(html) if at is None or (k := html.find("<", at)) < 0 else k
    title = "" if at is None else html[at:stop].strip(" ")
    lang = next((m[1] for tag, _ in _tags(html, "html") if (m := LANG.search(tag))), "")
    return title, lang, sum(bool(HREF.search(tag)) for tag, _ in _tags(html, "a"))


def _page(html: Column) -> Column:
    """A struct of text, title, lang and links."""

    @F.pandas_udf("text string, title string, lang string, links int")
    def of(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in pages:
            yield pd.DataFrame([(text_of(x), *about(x)) for x in batch], columns=["text", "title", "lang", "links"])

    return of(F.coalesce(html, F.lit("")))


def plain_text(html: Column) -> Column:
    return _page(html)["text"]


def uuid_of(*parts: Column) -> Column:
    """urn:uuid of a name: the MD5 of its parts."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), *[x for k, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] * bool(k) + [F.substring(h, a, n)])], F.lit(">"))


def digest_of(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


#: Date and headers given to pages of a table, which has none.
PAGE_DATE, PAGE_HEADERS = "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"


def responses_from_pages(pages: DataFrame, date: str = PAGE_DATE, headers: str = PAGE_HEADERS) -> DataFrame:
    """Response records of a table of raw pages (page_id, url, html), which has no dates or headers of its own."""
    return pages.select(
        "page_id",
        uuid_of(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("record_date"),
        F.lit(headers).alias("source_headers"),
        F.col("html").alias("payload"),
    )


#: Columns that only responses of WARC files have, and the metadata lines that carry them.
FILE_LINES = {"source_payload_digest": "source-payload-digest", "complete": "complete"}


def derive(responses: DataFrame) -> DataFrame:
    """Two records for each response (page_id, record_id, target_uri, record_date, source_headers, payload).

    Where responses have ``payload_bytes``, the digest and the length are those of these bytes; ``source_payload_digest``
    and ``complete``, which is false for a record that its file cuts short, go into the metadata."""
    payload = F.coalesce("payload", F.lit(""))
    raw = F.coalesce("payload_bytes", F.lit(b"")) if "payload_bytes" in responses.columns else payload
    more = {c: line for c, line in FILE_LINES.items() if c in responses.columns}
    rows = responses.select(
        "page_id", F.coalesce("record_id", F.lit("")).alias("refers_to"), F.coalesce("target_uri", F.lit("")).alias("target_uri"),
        "record_date", F.coalesce("source_headers", F.lit("")).alias("source_headers"),
        digest_of(raw).alias("payload_digest"), F.octet_length(raw).alias("payload_length"),
        _page(payload).alias("page"), *more,
    ).select("*", "page.*")
    fields = F.concat(
        F.lit("title: "), "title", F.lit("\r\nlanguage: "), "lang", F.lit("\r\nlinks: "), F.col("links").cast("string"),
        F.lit("\r\npayload-length: "), F.col("payload_length").cast("string"), F.lit("\r\ntext-length: "), F.octet_length("text").cast("string"), F.lit("\r\n"),
        *[F.coalesce(F.concat(F.lit(f"{line}: "), F.col(c).cast("string"), F.lit("\r\n")), F.lit("")) for c, line in more.items()],
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    rows = rows.withColumn("r", F.explode(kinds)).select("*", "r.*")
    rows = rows.withColumn("record_id", uuid_of(F.col("record_type"), F.col("refers_to")))
    rows = rows.withColumns({"block_digest": digest_of(F.col("block")), "content_length": F.octet_length("block").cast("long")})
    return rows.select(*COLUMNS)


def _header(name: str) -> Column:
    """A header's line; line ends in the value, which would begin another header, become blanks."""
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(F.coalesce(F.col(FIELDS[name]), F.lit("")), r"[\r\n]+", " "))


#: Header lines of a record, in this order, and the columns that they carry.
FIELDS = {
    "WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target_uri", "WARC-Date": "record_date",
    "WARC-Block-Digest": "block_digest", "WARC-Payload-Digest": "payload_digest", "Content-Type": "content_type",
}


def record_text(records: DataFrame) -> DataFrame:
    """One column ``value``: the record as it stands in a file, without the two line ends that close it."""
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), *[_header(x) for x in FIELDS],
        F.concat(F.lit("X-Source-Headers: "), F.regexp_replace(F.regexp_replace("source_headers", r"\r\n", " | "), r"[\r\n]+", " ")),
        F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")),
    )
    return records.select(F.concat(head, F.lit("\r\n\r\n"), "block").alias("value"))


def write_files(records: DataFrame, path: str, compression: str = "none") -> None:
    """WARC files, one for each partition."""
    record_text(records).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


BREAK = b"\r\n\r\n"
FILE_SCHEMA = "headers map<string,string>, body binary, complete boolean"


def header_lines(head: bytes) -> dict[str, str]:
    """Values by lower-cased name; of repeated names the first counts."""
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def framed(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(headers, body, complete) of the records of (file, piece): the pieces of each file, in order, between the places where a record may begin.

    A record ends where its Content-Length says; what looks like the start of a record before that is part of its body.
    One that its file cuts short, or that has no length, is not complete."""
    held: list[bytes] = []  # the head and the body so far
    named, need, have, file = {}, None, 0, None

    def record():
        body = b"".join(held)
        cut = need if need is not None else len(body) - len(BREAK) * body.endswith(BREAK)
        return named, body[:cut], need is not None and len(body) >= need

    for own, piece in pieces:
        piece = piece[len(START) - len(BREAK) :] if piece.startswith(START[len(BREAK) :]) else piece
        if held and own == file and need is not None and have < need:
            held += [START, piece]
            have += len(START) + len(piece)
            continue
        if held:
            yield record()
        head, found, body = piece.partition(BREAK)
        # the piece begins after "WARC/1.", with the version's last digit and a line end
        file, held, named = own, [body] if found else [], header_lines(head[3:])
        length = named.get("content-length", "")
        need, have = int(length) if length.isdecimal() else None, len(body)
    if held:
        yield record()


#: What stands before every record but the first.
START = BREAK + b"WARC/1."


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC 1.0 and 1.1 files, gzip or plain: headers (map by lower-cased name), body (bytes), block (the same as text) and complete.

    Files are read in pieces that begin where a record may begin; the pieces of a file meet in order and are cut by Content-Length,
    one record at a time, so that a payload may hold anything. Bytes are kept as they are; ``block`` is UTF-8, else Latin-1."""
    raw = spark.read.option("lineSep", START.decode()).text(path).where(F.col("value") != "")
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"))
    rows = raw.select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.col("value").cast("binary").alias("value"))
    rows = rows.repartition("file").sortWithinPartitions("file", "at").select("file", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((f.as_py(), v.as_py()) for batch in batches for f, v in zip(batch.column(0), batch.column(1), strict=True))
        for named, body, complete in framed(pieces):
            columns = [pa.array([list(named.items())], pa.map_(pa.string(), pa.string())), pa.array([body], pa.binary()), pa.array([complete])]
            yield pa.RecordBatch.from_arrays(columns, names=["headers", "body", "complete"])

    found = rows.mapInArrow(run, FILE_SCHEMA)
    return found.select("headers", F.coalesce(F.expr("try_validate_utf8(cast(body as string))"), F.decode("body", "ISO-8859-1")).alias("block"), "body", "complete")


CHUNK = re.compile(rb"[ \t]*([0-9A-Fa-f]{1,15})[ \t]*(?:;[^\r\n]*)?\r\n")
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I | re.A)


def joined_chunks(body: bytes) -> bytes:
    """The body without the framing of chunks; a body that is not framed so stays as it is, one that breaks off gives what it holds."""
    out, at = [], 0
    while m := CHUNK.match(body, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(out)
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size + 2
    return b"".join(out) if out and at >= len(body) else body


def decompressed(body: bytes, coding: str) -> bytes:
    """The body without gzip or deflate; what cannot be decompressed stays as it is, a stream that breaks off gives what it holds."""
    for coding in reversed([x.strip().lower() for x in coding.split(",")]):
        for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
            try:
                body = zlib.decompressobj(bits).decompress(body)
                break
            except zlib.error:
                continue
    return body


def http_parts(body: bytes, content_type: str) -> tuple[str, bytes, str]:
    """HTTP headers, the payload as it stands, and its text."""
    head, found, payload = body.partition(BREAK)
    if not (content_type.startswith("application/http") and found):
        head, payload = b"", body
    named = header_lines(head)
    said = joined_chunks(payload) if "chunked" in named.get("transfer-encoding", "").lower() else payload
    said = decompressed(said, named.get("content-encoding", ""))
    charset = CHARSET.search(named.get("content-type", ""))
    for name in (charset[1] if charset else "utf-8", "utf-8"):
        try:
            return head.decode("utf-8", "replace"), payload, said.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return head.decode("utf-8", "replace"), payload, said.decode("latin-1")


def responses_from_records(records: DataFrame) -> DataFrame:
    """Input of ``derive`` from the response records of ``read_files``, ``page_id`` null: HTTP headers apart, the payload's bytes and its text,
    the digest that the source gave, and whether the record is complete."""

    @F.pandas_udf("source_headers string, payload_bytes binary, payload string")
    def parts(bodies: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        found = [http_parts(bytes(b), k) for b, k in zip(bodies, kinds, strict=True)]
        return pd.DataFrame(found, columns=["source_headers", "payload_bytes", "payload"])

    named = F.col("headers")
    return records.where(named["warc-type"] == "response").select(
        F.lit(None).cast("long").alias("page_id"), named["warc-record-id"].alias("record_id"), named["warc-target-uri"].alias("target_uri"),
        named["warc-date"].alias("record_date"), named["warc-payload-digest"].alias("source_payload_digest"), "complete",
        parts(F.coalesce("body", F.lit(b"")), F.coalesce(named["content-type"], F.lit(""))).alias("http"),
    ).select("*", "http.*").drop("http")


def _entities_sql(quote) -> str:
    """SQL for ``text`` of ``tagless`` (rn, t) with all entities decoded; the names are Python's table of HTML 5."""
    codes = [*range(0xA0), *range(0xFDD0, 0xFDF0), *(0x10000 * p + k for p in range(17) for k in (0xFFFE, 0xFFFF))]
    odd = {c: html_entities.unescape(f"&#{c};") for c in codes}
    odd = ", ".join(f"({c}, {quote(x)})" for c, x in odd.items() if x != chr(c))
    named = ", ".join(f"({quote(k)}, {quote(x)})" for k, x in html.entities.html5.items())
    pattern = quote(ENTITY.pattern)
    return f"""odd(code, said) AS (VALUES {odd}), named(name, said) AS (VALUES {named}),
ent AS (SELECT DISTINCT unnest(regexp_extract_all(t, {pattern})) AS m FROM tagless),
num AS (SELECT m, CASE WHEN lower(m[3]) = 'x' THEN try_cast('0x' || rtrim(m[4:], ';') AS BIGINT) ELSE try_cast(rtrim(m[3:], ';') AS BIGINT) END AS code FROM ent WHERE starts_with(m, '&#')),
longest AS (SELECT m, arg_max(said || m[2 + len(name):], len(name)) AS said FROM ent JOIN named ON starts_with(m[2:], name) AND len(name) BETWEEN 2 AND len(m) - 2 WHERE NOT starts_with(m, '&#') GROUP BY m),
said AS (SELECT ent.m, replace(CASE WHEN starts_with(ent.m, '&#') THEN CASE WHEN odd.code IS NOT NULL THEN odd.said
    WHEN num.code IS NULL OR num.code > 1114111 OR num.code BETWEEN 55296 AND 57343 THEN chr(65533) ELSE chr(num.code::INT) END
    ELSE coalesce(named.said, longest.said, ent.m) END, chr(160), ' ') AS x
  FROM ent LEFT JOIN num ON num.m = ent.m LEFT JOIN odd ON odd.code = num.code LEFT JOIN named ON named.name = ent.m[2:] LEFT JOIN longest ON longest.m = ent.m),
cells AS (SELECT rn, unnest(regexp_split_to_array(t, {pattern})) AS gap, unnest(list_concat(regexp_extract_all(t, {pattern}), [''])) AS m, generate_subscripts(regexp_split_to_array(t, {pattern}), 1) AS pos FROM tagless),
texts AS (SELECT rn, string_agg(gap || coalesce(x, ''), '' ORDER BY pos) AS text FROM cells LEFT JOIN said ON said.m = cells.m GROUP BY rn)"""


def oracle() -> str:
    """SQL for derive(responses_from_pages(pages))."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    literal = lambda x: quote(x).replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '")
    at = [x for x, _ in HTML_STEPS].index(ENTITIES)
    tagless, text = "payload", "text"
    for pattern, new in HTML_STEPS[:at]:
        tagless = f"regexp_replace({tagless}, {quote(pattern)}, {literal(new)}, 'g')"
    for pattern, new in HTML_STEPS[at + 1 :]:
        text = f"regexp_replace({text}, {quote(pattern)}, {literal(new)}, 'g')"
    uuid = lambda x: f"'<urn:uuid:' || substr({x}, 1, 8) || '-' || substr({x}, 9, 4) || '-' || substr({x}, 13, 4) || '-' || substr({x}, 17, 4) || '-' || substr({x}, 21, 12) || '>'"
    line = "chr(13) || chr(10)"
    lang = r"""(?i)\blang[ \t\r\n\f]*=[ \t\r\n\f]*["']?([A-Za-z-]+)"""
    return f"""
WITH src AS (SELECT row_number() OVER () AS rn, page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload,
  md5('response|' || coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '')) AS h FROM pages),
tagless AS (SELECT rn, {tagless} AS t FROM src),
{_entities_sql(quote)},
r AS (SELECT src.*, {text} AS text FROM src JOIN texts ON src.rn = texts.rn),
s AS (SELECT *, {uuid('h')} AS refers_to, 'sha256:' || sha256(payload) AS payload_digest,
  'title: ' || trim(regexp_extract(payload, '(?i)<title\\b[^>]*>([^<]*)', 1)) || {line} || 'language: ' ||
  coalesce(regexp_extract(list_filter(regexp_extract_all(payload, '(?i)<html\\b[^>]*>'), lambda x: regexp_matches(x, {quote(lang)}))[1], {quote(lang)}, 1), '') || {line} || 'links: ' ||
  len(list_filter(regexp_extract_all(payload, '(?i)<a\\b[^>]*>'), lambda x: regexp_matches(x, '(?i)\\bhref\\b'))) || {line} || 'payload-length: ' || strlen(payload) || {line} ||
  'text-length: ' || strlen(text) || {line} AS fields FROM r),
k AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type, fields AS block FROM s
  UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', text FROM s),
m AS (SELECT *, md5(record_type || '|' || refers_to) AS g FROM k)
SELECT page_id, record_type, {uuid('g')} AS record_id, refers_to, target_uri, {quote(PAGE_DATE)} AS record_date, content_type, {literal(PAGE_HEADERS)} AS source_headers, payload_digest,
  'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS content_length, block FROM m"""
