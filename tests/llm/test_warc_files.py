"""WARC files: records cut by their length, digests of bytes, chunked and compressed bodies."""

import gzip
import hashlib
import zlib

from tidemark.llm import warc


def record(k, block, kind="response", length=None, version="1.0", **more):
    head = f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{k}>\r\nWARC-Target-URI: http://u/{k}\r\nWARC-Date: d\r\nContent-Type: application/http; msgtype=response\r\n"
    head += "".join(f"{a.replace('_', '-')}: {b}\r\n" for a, b in more.items())
    return (head + f"Content-Length: {len(block) if length is None else length}\r\n\r\n").encode() + block + b"\r\n\r\n"


def http(body, **headers):
    return ("HTTP/1.1 200 OK\r\n" + "".join(f"{a.replace('_', '-')}: {b}\r\n" for a, b in headers.items()) + "\r\n").encode() + body


def chunked(*parts):
    return b"".join(f"{len(p):x};x=1\r\n".encode() + p + b"\r\n" for p in parts) + b"0\r\n\r\n"


LATIN = "<title>Caf\xe9</title>na\xefve".encode("latin-1")
INNER = record(90, http(b"inner"), version="1.1")
PAGES = {
    1: http(b"one\r\n\r\nWARC/1.0 two\r\n\r\nWARC/1.1\r\nContent-Length: 99999\r\n\r\nthree\r\n\r\n"),
    2: http(LATIN, Content_Type="text/html; charset=ISO-8859-1"),
    3: http(chunked(b"Wiki", b"<p>pedia"), Transfer_Encoding="chunked"),
    4: http(gzip.compress("<b>zipped \xe9".encode()), Content_Encoding="gzip"),
    5: http(chunked(zlib.compress(b"defl"), b""), Transfer_Encoding="Chunked", Content_Encoding="deflate"),
    6: http(INNER + INNER), 7: http(b""), 8: b"\xff\xfe", 9: http(b"not chunked", Transfer_Encoding="chunked"), 10: http(b"not zipped", Content_Encoding="gzip"),
}


def derived(spark, path):
    records = warc.read_files(spark, str(path))
    return records.collect(), {(r.refers_to, r.record_type): r for r in warc.derive(warc.responses_from_records(records)).collect()}


def test_records_are_cut_by_their_length(spark, tmp_path):
    whole = record(0, b"a: b", "warcinfo") + b"".join(record(k, x, WARC_Payload_Digest=f"sha1:{k}") for k, x in PAGES.items())
    (tmp_path / "a.warc").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(record(100 + k, x)) for k, x in PAGES.items()))
    rows, got = derived(spark, tmp_path)
    assert {r.headers["warc-record-id"]: bytes(r.body) for r in rows if r.headers["warc-type"] == "response"} == {f"<{k + at}>": x for k, x in PAGES.items() for at in (0, 100)}
    assert all(r.complete for r in rows) and len(rows) == 1 + 2 * len(PAGES) and len(got) == 4 * len(PAGES)
    for k, x in PAGES.items():
        payload = x.partition(b"\r\n\r\n")[2] if x.startswith(b"HTTP") else x
        for at in (0, 100):
            r = got[f"<{k + at}>", "metadata"]
            assert r.payload_digest == "sha256:" + hashlib.sha256(payload).hexdigest() and f"payload-length: {len(payload)}\r\n" in r.block
            assert (f"source-payload-digest: sha1:{k}\r\n" in r.block) == (not at) and "complete: true\r\n" in r.block
    text = {k: got[f"<{k}>", "conversion"].block for k in PAGES}
    assert text[1].startswith("one\r\n\r\nWARC/1.0 two".replace("\r\n\r\n", "\n")) and text[1].endswith("three")
    assert text[2].replace("\n", "") == "Cafénaïve" and text[3] == "Wiki\npedia" and text[4] == "zipped é" and text[5] == "defl"
    assert text[7] == "" and text[9] == "not chunked" and text[10] == "not zipped" and text[6].count("inner") == 2


def test_splits_of_a_file_do_not_cut_records(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"".join(record(k, PAGES[1 + k % 10]) for k in range(200)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        rows, _ = derived(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r.headers["warc-record-id"]: bytes(r.body) for r in rows} == {f"<{k}>": PAGES[1 + k % 10] for k in range(200)}


def test_records_that_are_cut_short(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(1, http(b"whole")) + record(2, http(b"half"), length=1000))
    (tmp_path / "b.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <3>\r\n\r\nno length\r\n\r\n" + record(4, b"x"))
    rows, got = derived(spark, tmp_path)
    assert {r.headers["warc-record-id"]: r.complete for r in rows} == {"<1>": True, "<2>": False, "<3>": False, "<4>": True}
    assert "complete: false\r\n" in got["<2>", "metadata"].block and got["<2>", "conversion"].block == "half"
    assert got["<3>", "conversion"].block == "no length"
    assert warc.joined_chunks(b"5\r\nhel") == b"hel" and warc.decompressed(gzip.compress(b"x" * 99999)[:-30], "gzip")[:1] == b"x"
