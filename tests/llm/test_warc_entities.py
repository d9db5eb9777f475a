"""All entities are decoded, and the query returns whole records."""

import hashlib
import html
import re

from tidemark.llm import warc
from tidemark.llm.queries import op6_warc

SF = "/root/testdata/sf0.001"


def test_all_entities_are_decoded(spark):
    rows = [
        (1, "u", "<p>&copy; 2024 &middot; caf&eacute; it&#x27;s &#8364; &#X41;</p>"),
        (2, "u", "a&nbsp;b&#160;c&#xa0;&nbsp;d &amp;copy; &amp;amp;lt; &lt;b&gt; &nosuch; & x &; &copy 1"),
        (3, "u", "<b>&lt;p&gt;</b>&quot;&#39;&hellip;&#0;&NotEqualTilde;"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.block for r in warc.derive(warc.responses_from_pages(df)).where("record_type = 'conversion'").collect()}
    assert got[1] == "© 2024 · café it's € A"
    assert got[2] == "a b c d &copy; &amp;lt; <b> &nosuch; & x &; © 1"
    assert got[3] == "<p>\"'…�≂̸"


def test_query_returns_whole_records_of_the_given_pages(spark):
    rows = op6_warc(spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == 2 * len(pages)
    for r in rows:
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert r.source_headers.startswith("HTTP/1.1 200 OK") and r.record_date
        if r.record_type == "conversion":
            text = pages[r.page_id] or ""
            for pattern, new in warc.HTML_STEPS[:5]:
                text = re.sub(pattern, new, text)
            text = html.unescape(text).replace("\xa0", " ")
            for pattern, new in warc.HTML_STEPS[-3:]:
                text = re.sub(pattern, new, text)
            assert r.block == text


ODD = [
    "&amp &ampx; &notit; &notin; &nosuch\xa0;x &#128; &#xD800; &#x110000; &#99999999999999999999; &#x1; &#13;y &#xfffe; &AElig &Aacutes; &gt&lt", "<script>a</script >b<SCRIPT x", "<style></style\n>x<style>", "<!-- a --> b <!-- c",
    "<a href=1><a\nHREF><a b><A x=href>", "<html><html class=x lang='pt-BR'><title class=t> T </title>", "<p\n>x<pre>y<p", "<é>x< b>y", "<title>only", "<aé href>", "",
]


def test_odd_pages_equal_sql(spark):
    import duckdb

    rows = [(k, f"u{k}", x) for k, x in enumerate(ODD)] + [(99, None, None)]
    records = warc.derive(warc.responses_from_pages(spark.createDataFrame(rows, "page_id long, url string, html string")))
    c = duckdb.connect()
    c.execute("create table pages (page_id bigint, url varchar, html varchar)")
    c.executemany("insert into pages values (?, ?, ?)", rows)
    out = c.execute(warc.oracle())
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(records.columns)
    assert sorted(map(tuple, records.select(*names).collect()), key=repr) == sorted(out.fetchall(), key=repr)


def test_unclosed_tags_take_linear_time():
    import time

    began = time.process_time()
    for part in ("<", "<script ", "<!--", "<title ", "<html lang ", "<a href ", "</script", "&", "<p "):
        x = part * (1_000_000 // len(part))
        warc.text_of(x)
        warc.about(x)
    assert time.process_time() - began < 30


def test_files_go_into_derivatives(spark, tmp_path):
    body = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<title>É</title>&eacute;\r\n\r\nx"
    record = lambda kind, k, block: (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{k}>\r\nWARC-Target-URI: http://u/{k}\r\nWARC-Date: d\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(record("warcinfo", 0, b"a: b") + record("response", 1, body.encode()) + record("response", 2, b"\xff\xfe"))
    records = warc.read_files(spark, str(tmp_path / "x.warc"))
    assert all(r.complete for r in records.collect()) and records.count() == 3
    assert bytes(records.where("headers['warc-record-id'] = '<2>'").first().body) == b"\xff\xfe"
    got = {(r.refers_to, r.record_type): r for r in warc.derive(warc.responses_from_records(records)).collect()}
    assert len(got) == 4 and got["<1>", "conversion"].block == "É\né\nx" and got["<1>", "metadata"].source_headers == "HTTP/1.1 200 OK\r\nContent-Type: text/html"


def test_line_ends_in_values_make_no_header(spark):
    page = spark.createDataFrame([(1, "http://a/\r\nWARC-Type: response", "x")], "page_id long, url string, html string")
    texts = [r.value for r in warc.record_text(warc.derive(warc.responses_from_pages(page))).collect()]
    assert all("WARC-Type: response" not in x.split("\r\n") for x in texts)
