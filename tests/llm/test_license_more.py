"""Further licences in their own words, SPDX expressions, and licences that a text cuts short."""

import textwrap

import pytest

from tidemark.llm import licenses

GNU = """This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.

This {} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Copyright (c) 2024 A. Body

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_CUT = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy'
UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software."
WHOLE = {
    "LGPL-2.1-or-later": GNU.format("library", ";", "Lesser", "2.1", "library"),
    "LGPL-3.0-or-later": GNU.format("program", ":", "Lesser", "3", "program"),
    "AGPL-3.0-or-later": GNU.format("program", ":", "Affero", "3", "program"),
    "MPL-2.0": MPL, "ISC": ISC, "Apache-2.0": APACHE_CUT, "Unlicense": UNLICENSE,
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)",
}
SPDX = {
    "// SPDX-License-Identifier: BSD-3-Clause": ("BSD-3-Clause", 1),
    "# SPDX-License-Identifier: GPL-3.0-only\nint x;": ("GPL-3.0-only", 1),
    "/* SPDX-License-Identifier: (GPL-2.0-only OR BSD-2-Clause) */": ("BSD-2-Clause,GPL-2.0-only", 2),
    "SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0": ("GPL-2.0+", 1),
    "SPDX-License-Identifier: MIT OR Apache-2.0": ("Apache-2.0,MIT", 2),
    "SPDX-License-Identifier: MIT": ("MIT", 1),
    "SPDX-License-Identifier: MIT AND NoSuch-1.0": ("", 0),
    "SPDX-License-Identifier: LGPL-2.1-or-later AND (MPL-2.0 OR ISC)": ("ISC,LGPL-2.1-or-later,MPL-2.0", 3),
    "see SPDX-License-Identifier: MIT": ("", 0),
}


@pytest.fixture(scope="module")
def found(spark):
    rows, at = [], {}
    for name, x in WHOLE.items():
        for form in (x, "\n\n".join(textwrap.fill(p, 60) for p in x.split("\n\n")), "\n#\n".join("\n".join("# " + y for y in textwrap.fill(p, 72).split("\n")) for p in x.split("\n\n"))):
            at[len(rows)] = name
            rows.append((len(rows), f"Some words first.\n\n{form}\n\nand words after."))
    for x, (name, _) in SPDX.items():
        at[len(rows)] = name
        rows.append((len(rows), x))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return rows, at, got


def test_each_licence_is_found_alone(found):
    rows, at, got = found
    for k, text in rows[: 3 * len(WHOLE)]:
        assert got[k].licences == at[k], (at[k], got[k], text)


def test_spdx_expressions(found):
    rows, _, got = found
    for k, text in rows[3 * len(WHOLE) :]:
        assert (got[k].licences, got[k].n_rules) == SPDX[text], text


def test_sql_knows_whole_sentences(spark, found):
    import duckdb

    rows = [(k, x) for k, x in found[0] if k % 3 == 0 and k < 3 * len(WHOLE) or k >= 3 * len(WHOLE) and " OR " not in x and " WITH " not in x]
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", rows)
    out = c.execute(licenses.oracle())
    names = [d[0] for d in out.description]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(out.fetchall())
