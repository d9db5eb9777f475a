"""URL rules, WARC derivatives and licence scans: edge cases and their SQL."""

import hashlib
import random
import re

import duckdb

from tidemark.llm import licenses, urls, warc
from tidemark.llm.queries import URL_RULES


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sql(query, **tables):
    c = duckdb.connect()
    for name, (columns, data) in tables.items():
        c.execute(f"create table {name} ({columns})")
        for r in data:
            c.execute(f"insert into {name} values ({', '.join('?' * len(r))})", list(r))
    return c.execute(query)


URLS = [
    (1, "https://WWW.Example.com/en/1?x", None), (2, "http://example.com/en/", ""), (3, "http://a.b.net/es/x#y", "z"), (4, "http://net/fr", "z"),
    (5, "no scheme", None), (6, None, None), (7, "x://notexample.com/en/1", None), (8, "http://example.com?/en/", None), (9, "http://blog.example.com/en/q", None),
    (9, "http://blog.example.com/en/q", None), (10, "://Ünet/es/1", ""), (11, "http://host.net/fr/a://b", ""),
]


def test_rules_equal_sql(spark):
    df = spark.createDataFrame([(*r, "h") for r in URLS], "page_id long, url string, html string, host string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, URL_RULES).collect()}
    out = sql(urls.oracle(URL_RULES), pages=("page_id bigint, url varchar, html varchar", URLS))
    names = [d[0] for d in out.description]
    want = {tuple(dict(zip(names, r, strict=True))[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in out.fetchall()}
    assert got == want
    assert (1, "www.example.com", "/en/1", "www.example.com/en/", "allow") in got and (8, "example.com", "", None, "allow") in got
    assert urls.judge(df.limit(0), URL_RULES).collect() == []


def test_blocks_reach_aliases_and_allow_has_precedence(spark):
    canonical = '<head><LINK href="{}" rel="canonical"></head>'
    refresh = "<meta http-equiv='refresh' content='0; url={}'>"
    rows = [
        (1, "http://example.com/en/bad", ""),
        (2, "http://alias.org/a", canonical.format("http://example.com/en/bad#top")),
        (3, "http://alias.org/b", refresh.format("/a")),  # a chain
        (4, "http://clean.org/", canonical.format("https://clean.org")),
        (5, "http://www.example.com/en/x", canonical.format("http://both.org/x")),  # explicitly allowed
        (6, "http://both.org/x", canonical.format("http://bad.net/es/1")),
        (7, "http://bad.net/es/1", ""),
        (8, "http://moved.org/", None),
        (9, None, canonical.format("http://example.com/en/bad")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    more = spark.createDataFrame([("http://moved.org", "http://x.net/fr/1")], "from string, to string")
    got = {r.page_id: r.verdict for r in urls.judge(df, URL_RULES, more).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "block", 9: "allow"}


def test_random_graph_equals_union_find(spark):
    """Chains, cycles, a large star and several components, against a union-find over the same edges."""
    r = random.Random(8)
    hosts = ["example.com/en", "www.example.com/en", "a.net/es", "b.net/fr", "c.org", "d.com", "e.org"]
    addresses = [f"http://{r.choice(hosts)}/{k}" for k in range(900)]
    pages = [(k, u, "") for k, u in enumerate(addresses)]
    edges = [(addresses[0], addresses[k]) for k in range(1, 300)]  # a star
    edges += [(addresses[k], addresses[k + 1]) for k in range(300, 360)] + [(addresses[r.randrange(400, 900)], addresses[r.randrange(400, 900)]) for _ in range(230)]
    html = {}
    for k, (a, b) in enumerate(edges):
        if k % 2 and a not in html:
            html[a] = f"<p><link rel='canonical' href='{b}'>" if k % 4 == 1 else f'<META http-equiv="refresh" content="1;url={b}">'
    pages = [(k, u, html.get(u, "")) for k, u, _ in pages]
    root = {u: u for u in addresses}

    def find(u):
        while root[u] != u:
            u = root[u]
        return u

    for a, b in edges:
        root[find(b)] = find(a)
    fits = lambda u: max(((len(h + p), a) for a, h, p in URL_RULES for host, path in [u[7:].split("/", 1)] if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)), default=(0, None))[1]
    own = {u: fits(u) for u in addresses}
    said = {}
    for u in addresses:
        said.setdefault(find(u), set()).add(own[u])
    want = {k: own[u] or ("block" if "block" in said[find(u)] and "allow" not in said[find(u)] else "allow") for k, u, _ in pages}
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    more = spark.createDataFrame([*edges, (None, "http://x/"), ("http://x/", None), ("http://x/", "y")], "from string, to string")
    got = {x.page_id: x.verdict for x in urls.judge(df, URL_RULES, more).collect()}
    assert got == want and "block" in {v for k, v in got.items() if own[addresses[k]] is None}


def test_unclosed_links_are_read_once(spark):
    import time

    part = "<link rel=canonical "
    pages = [(1, "http://a/", part * 50_000), (2, "http://b/", part * 50_000 + "href=http://example.com/en/x>"), (3, "http://c/" + "://" * 100_000, "<meta http-equiv=refresh " * 40_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    began = time.time()
    assert {r.page_id: r.verdict for r in urls.judge(df, URL_RULES).collect()} == {1: "allow", 2: "block", 3: "allow"}
    assert time.time() - began < 60


PAGES = [
    (1, "http://a/", '<html lang="en"><head><title> T &amp; U</title><script>x<p></script></head><body><p>A<b>b</b> c&lt;d&amp;lt;<br>e</p><!-- <p> --></body></html>'),
    (2, None, None), (3, "http://b/", ""), (3, "http://b/", ""), (4, "u", " \n <p> \n "), (None, "v", "é" * 20_000 + "<p>x"),
]


def test_derivatives(spark, tmp_path):
    df = spark.createDataFrame([(*r, "x") for r in PAGES], "page_id long, url string, html string, block string")
    records = warc.derive(warc.responses_from_pages(df))
    rows = records.collect()
    assert len(rows) == 2 * len(PAGES)
    text = {r.page_id: r.block for r in rows if r.record_type == "conversion"}
    assert text[1] == "T & U\nAb c<d&lt;\ne" and text[2] == text[3] == text[4] == "" and text[None].endswith("é\nx")
    for r in rows:
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.content_length == len(r.block.encode())
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", r.record_id)
    out = sql(warc.oracle(), pages=("page_id bigint, url varchar, html varchar", PAGES))
    names = [d[0] for d in out.description]
    assert sorted(out.fetchall(), key=repr) == rows_of(records.select(*names))
    warc.write_files(records, str(tmp_path / "w"))
    back = warc.read_files(spark, str(tmp_path / "w")).collect()
    assert len(back) == len(rows) and all(r.complete for r in back)
    assert {(r.headers["warc-record-id"], r.headers["warc-refers-to"], r.block) for r in back} == {(r.record_id, r.refers_to, r.block) for r in rows}
    assert warc.derive(warc.responses_from_pages(df.limit(0))).collect() == []


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""
DOCS = [
    (1, "Hello there. Released under the MIT License."), (2, None), (3, ""), (4, "x\nLicensed under the Apache License, Version 2.0.\ny"),
    (5, MIT), (6, "Released under the MIT License. " + MIT), (7, "Licensed under CC BY-NC 4.0! Licensed under CC BY-NC 4.0. All rights reserved"),
    (8, "not released under the MIT License"), (9, "word " * 30_000 + ". Released under the MIT License"), (10, "ÉA. Released under the MIT License."),
]


def test_licences_equal_sql(spark):
    df = spark.createDataFrame([(*r, "x") for r in DOCS], "doc_id long, text string, licences string")
    by_id = {r.doc_id: (r.n_sentences, r.n_rules, r.licences) for r in licenses.scan(df).collect()}
    assert by_id[1] == (1, 1, "MIT") and by_id[2] == by_id[3] == by_id[8] == (0, 0, "") and by_id[4] == (1, 1, "Apache-2.0")
    assert by_id[5] == (3, 1, "MIT") and by_id[6] == (4, 1, "MIT") and by_id[7] == (3, 3, "CC-BY-NC-4.0,proprietary")
    out = sql(licenses.oracle(), documents=("doc_id bigint, text varchar", DOCS))
    names = [d[0] for d in out.description]
    assert sorted(out.fetchall(), key=repr) == rows_of(licenses.scan(df).select(*names))
    twice = df.unionByName(df.where("doc_id = 1"))
    assert licenses.scan(twice).where("doc_id = 1").count() == 2
    assert licenses.scan(df.limit(0)).collect() == []
