"""Licences in their own words, wrapped and unwrapped, by Spark and by SQL."""

import textwrap

import duckdb
import pytest

from tidemark.llm import licenses

MIT = """MIT License

Copyright (c) 2024 A. Body

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE = """Copyright 2024 A. Body

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
BSD = """Copyright (c) 2024, A. Body. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE."""
NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
GPL = """This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."""
TEXTS = {
    "MIT": MIT, "Apache-2.0": APACHE, "BSD-2-Clause": BSD.format(""), "BSD-3-Clause": BSD.format(NAMES),
    "GPL-3.0-or-later": GPL.format(":", ",", 3), "GPL-2.0-or-later": GPL.format(";", ";", 2),
}


def wrapped(text, width, prefix="", end="\n"):
    lines = [line for p in text.split("\n\n") for line in [*textwrap.wrap(p.strip(), width), ""]]
    return end.join(prefix + line for line in lines)


def forms(text):
    yield text
    for width in range(40, 100, 7):
        yield wrapped(text, width)
    yield wrapped(text, 72, " * ")
    yield wrapped(text, 72, "   ", "\r\n")
    yield "Some words before\n" + wrapped(text, 78) + "words behind"


DOCS = [(name, x) for name, text in TEXTS.items() for x in forms(text)]
OTHERS = [
    ("MIT", "x\nReleased under the MIT License\ny"), ("MIT", "Hello. Released under the\nMIT License!"),
    ("", "Released under the\n\nMIT of all"), ("", "released under the mit licensees"), ("Apache-2.0,MIT", "Released under the MIT License\nLicensed under the Apache License, Version 2.0.\nz"),
    ("", MIT[30:400]), ("", None), ("", ""), ("", "." * 50_000), ("", "!" * 50_000 + "x"), ("", " \n" * 20_000),
]


def twin():
    """SQL of its own, without the long pattern: runs of lines within a sentence that equal a known one and lie in no longer such run."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rules = licenses.FULL_RULES + licenses.RULES
    known = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in (licenses.SENTENCES | licenses.FULL_SENTENCES).items())
    marked = "line"
    for k, (_, ids) in enumerate(rules):
        marked = f"replace({marked}, {quote(''.join(f';{i};' for i in ids))}, '#{k}#')"
    names = "[" + ", ".join(quote(n) for n, _ in rules) + "]"
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
a AS (SELECT doc_id, regexp_split_to_array(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[.!?]+\s+|\n\s*\n') AS parts FROM documents),
b AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM a),
c AS (SELECT doc_id, pos, list_transform(string_split(part, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[^\p{{L}}\p{{N}}.+-]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')) AS w FROM b),
f AS (SELECT *, unnest(range(1, len(w) + 1)) AS lo FROM c),
g AS (SELECT *, unnest(range(lo, least(len(w), lo + 24) + 1)) AS hi FROM f),
h AS (SELECT doc_id, pos, lo, hi, id FROM g JOIN known ON array_to_string(w[lo:hi], ' ') = sentence),
o AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.doc_id = h.doc_id AND x.pos = h.pos AND x.lo <= h.lo AND x.hi >= h.hi AND x.hi - x.lo > h.hi - h.lo)),
l AS (SELECT doc_id, count(*) AS n, string_agg(';' || id || ';', '' ORDER BY pos, lo) AS line FROM o GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0), coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({marked}, '#([0-9]+)#', 1), lambda k: {names}[k::INT + 1]))), ','), '') FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id"""


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(k, x) for k, (_, x) in enumerate(DOCS + OTHERS)], "doc_id long, text string")
    return {r.doc_id: r for r in licenses.scan(df).collect()}


def test_texts_as_they_are_and_wrapped(rows):
    for k, (name, x) in enumerate(DOCS + OTHERS):
        assert rows[k].licences == name, (rows[k], x)


def test_equal_to_sql(rows):
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", [(k, x) for k, (_, x) in enumerate(DOCS + OTHERS)])
    assert {k: (n, x) for k, n, x in c.execute(twin()).fetchall()} == {k: (r.n_sentences, r.licences) for k, r in rows.items()}
