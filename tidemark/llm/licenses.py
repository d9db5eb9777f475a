"""Licence scans by sentence rules.

A text is normalised and cut into sentences, and known sentences are replaced by their
identifiers. Licences are rules over the identifiers' order: a rule is a list of
identifiers that must follow one another, and an earlier rule in the list claims what it
matches before later ones see it. All of it is column expressions over one row at a time.

Normalised: A-Z lower-cased, everything but letters, digits, ``.``, ``+`` and ``-`` made a
blank, blanks collapsed, ends of lines stripped of blanks and ``.``. Sentences end at blank
lines and after ``.``, ``!`` or ``?`` before white space. A single line end is a blank within
a known sentence, and may also begin or end one, so wrapped licences and notices on lines
of their own both count; of several known sentences from one place the longest counts.

Defined results: null, empty and licence-free texts have no sentences and no licences
(empty strings, n_sentences 0); the same rule matched twice counts twice in ``n_rules`` and
once in ``licences``; texts of any length are read whole; repeated rows give the same row
again; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences, normalised, and their identifiers.
SENTENCES = {
    "released under the mit license": "MIT-NOTICE",
    "licensed under the mit license": "MIT-NOTICE",
    "this project is licensed under the mit license": "MIT-NOTICE",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "MIT-GRANT",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT-NOTICE-KEPT",
    "the software is provided as is without warranty of any kind express or implied": "NO-WARRANTY",
    "licensed under the apache license version 2.0": "APACHE-2-NOTICE",
    "licensed under the apache license version 2.0 the license": "APACHE-2-NOTICE",
    "you may not use this file except in compliance with the license": "APACHE-2-COMPLIANCE",
    "you may obtain a copy of the license at": "APACHE-2-COPY",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "APACHE-2-AS-IS",
    "this work is licensed under the gnu general public license version 3": "GPL-3-NOTICE",
    "licensed under the gnu general public license version 3": "GPL-3-NOTICE",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "GPL-GRANT",
    "either version 3 of the license or at your option any later version": "GPL-3-OR-LATER",
    "this work is licensed under the gnu general public license version 2": "GPL-2-NOTICE",
    "licensed under cc by-nc 4.0": "CC-BY-NC-4-NOTICE",
    "licensed under cc by 4.0": "CC-BY-4-NOTICE",
    "licensed under cc by-sa 4.0": "CC-BY-SA-4-NOTICE",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD-CONDITIONS",
    "redistributions of source code must retain the above copyright notice": "BSD-SOURCE",
    "redistributions in binary form must reproduce the above copyright notice": "BSD-BINARY",
    "spdx-license-identifier mit": "MIT-NOTICE",
    "spdx-license-identifier apache-2.0": "APACHE-2-NOTICE",
    "all rights reserved": "ALL-RIGHTS-RESERVED",
}
#: Rules in order: licence and the identifiers that must follow one another.
RULES = (
    ("MIT", ("MIT-NOTICE", "MIT-GRANT", "MIT-NOTICE-KEPT", "NO-WARRANTY")),
    ("MIT", ("MIT-GRANT", "MIT-NOTICE-KEPT", "NO-WARRANTY")),
    ("Apache-2.0", ("APACHE-2-NOTICE", "APACHE-2-COMPLIANCE", "APACHE-2-COPY", "APACHE-2-AS-IS")),
    ("BSD-2-Clause", ("BSD-CONDITIONS", "BSD-SOURCE", "BSD-BINARY")),
    ("GPL-3.0-or-later", ("GPL-GRANT", "GPL-3-OR-LATER")),
    ("MIT", ("MIT-NOTICE",)),
    ("Apache-2.0", ("APACHE-2-NOTICE",)),
    ("GPL-3.0", ("GPL-3-NOTICE",)),
    ("GPL-2.0", ("GPL-2-NOTICE",)),
    ("CC-BY-NC-4.0", ("CC-BY-NC-4-NOTICE",)),
    ("CC-BY-SA-4.0", ("CC-BY-SA-4-NOTICE",)),
    ("CC-BY-4.0", ("CC-BY-4-NOTICE",)),
    ("proprietary", ("ALL-RIGHTS-RESERVED",)),
)
#: Whole sentences of the licences' own texts, besides those above, which notices and the SQL use.
FULL_SENTENCES = {
    "mit license": "MIT-NOTICE",
    "the mit license": "MIT-NOTICE",
    "the mit license mit": "MIT-NOTICE",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MIT-GRANT",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "NO-WARRANTY",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MIT-NO-LIABILITY",
    "apache license version 2.0 january 2004": "APACHE-2-NOTICE",
    "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license": "APACHE-2-GRANT",
    "you may obtain a copy of the license at http www.apache.org licenses license-2.0": "APACHE-2-COPY",
    "you may obtain a copy of the license at https www.apache.org licenses license-2.0": "APACHE-2-COPY",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "APACHE-2-AS-IS",
    "see the license for the specific language governing permissions and limitations under the license": "APACHE-2-SEE",
    "gnu general public license version 3 29 june 2007": "GPL-3-NOTICE",
    "gnu general public license version 2 june 1991": "GPL-2-NOTICE",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL-3-OR-LATER-GRANT",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL-2-OR-LATER-GRANT",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license": "GPL-3-GRANT",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license": "GPL-2-GRANT",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD-SOURCE",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD-BINARY",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD-NAMES",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSD-DISCLAIMER",
}
#: Rules for these, before the others.
FULL_RULES = (
    ("MIT", ("MIT-NOTICE", "MIT-GRANT", "MIT-NOTICE-KEPT", "NO-WARRANTY", "MIT-NO-LIABILITY")),
    ("MIT", ("MIT-GRANT", "MIT-NOTICE-KEPT", "NO-WARRANTY", "MIT-NO-LIABILITY")),
    ("Apache-2.0", ("APACHE-2-GRANT", "APACHE-2-COPY", "APACHE-2-AS-IS", "APACHE-2-SEE")),
    ("Apache-2.0", ("APACHE-2-GRANT", "APACHE-2-COPY", "APACHE-2-AS-IS")),
    ("Apache-2.0", ("APACHE-2-NOTICE", "APACHE-2-COMPLIANCE", "APACHE-2-COPY", "APACHE-2-AS-IS", "APACHE-2-SEE")),
    *(
        (name, (*first, "BSD-CONDITIONS", "BSD-SOURCE", "BSD-BINARY", *names, *last))
        for first in (("ALL-RIGHTS-RESERVED",), ())
        for name, names in (("BSD-3-Clause", ("BSD-NAMES",)), ("BSD-2-Clause", ()))
        for last in (("BSD-DISCLAIMER",), ())
    ),
    ("GPL-3.0-or-later", ("GPL-3-OR-LATER-GRANT",)),
    ("GPL-2.0-or-later", ("GPL-2-OR-LATER-GRANT",)),
    ("GPL-3.0", ("GPL-3-GRANT",)),
    ("GPL-2.0", ("GPL-2-GRANT",)),
)
#: Identifiers of the SPDX list that an ``SPDX-License-Identifier`` line may name.
SPDX = (
    "0BSD", "AFL-3.0", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-1.0", "Artistic-2.0", "BlueOak-1.0.0",
    "BSD-1-Clause", "BSD-2-Clause", "BSD-2-Clause-Patent", "BSD-3-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause", "BSL-1.0", "CC-BY-3.0", "CC-BY-4.0",
    "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "CECILL-2.1",
    "CPL-1.0", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2", "GFDL-1.3-only", "GFDL-1.3-or-later", "GPL-1.0-only", "GPL-1.0-or-later", "GPL-2.0",
    "GPL-2.0+", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0+", "GPL-3.0-only", "GPL-3.0-or-later", "HPND", "ICU", "ISC", "LGPL-2.0-only",
    "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1+", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "LPPL-1.3c", "MIT",
    "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "MS-RL", "MulanPSL-2.0", "NCSA", "ODbL-1.0", "OFL-1.1", "OpenSSL", "OSL-3.0", "PostgreSQL", "PSF-2.0",
    "Python-2.0", "Ruby", "Unicode-3.0", "Unlicense", "UPL-1.0", "Vim", "W3C", "WTFPL", "X11", "Zlib", "ZPL-2.1",
)
SPDX_LINE = "spdx-license-identifier"
#: Names that the same licence's own sentences use.
SPDX_IDS = {x.lower(): {"MIT": "MIT-NOTICE", "Apache-2.0": "APACHE-2-NOTICE"}.get(x, f"SPDX-{x}") for x in SPDX}
#: The grant of the GNU licences, for each name, version and subject.
GNU = {"gnu general public license": ("GPL", ("2", "3")), "gnu lesser general public license": ("LGPL", ("2.1", "3")), "gnu library general public license": ("LGPL", ("2",)), "gnu affero general public license": ("AGPL", ("3",))}
GNU_GRANT = "this {} is free software you can redistribute it and or modify it under the terms of the {} as published by the free software foundation {}"
GNU_VERSIONS = {
    "or-later": ("either version {} of the license or at your option any later version", "either version {} or at your option any later version"),
    "only": ("version {} of the license", "version {}", "either version {} of the license"),
}


def _gnu() -> dict[str, str]:
    """Sentence to identifier, such as LGPL-2.1-or-later-GRANT."""
    return {
        GNU_GRANT.format(subject, name, form.format(v)): f"{short}-{v if '.' in v else v + '.0'}-{which}-GRANT"
        for name, (short, versions) in GNU.items()
        for v in versions
        for which, forms in GNU_VERSIONS.items()
        for form in forms
        for subject in ("program", "library", "file", "software")
    }


#: Sentences of further licences.
MORE_SENTENCES = {
    "this source code form is subject to the terms of the mozilla public license v": "MPL-2-NOTICE",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0": "MPL-2-COPY",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0": "MPL-2-COPY",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC-GRANT",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC-GRANT",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0BSD-GRANT",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISC-DISCLAIMER",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "ISC-NO-LIABILITY",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "BSD-ADVERTISING",
    "this is free and unencumbered software released into the public domain": "UNLICENSE-NOTICE",
    "distributed under the boost software license version 1.0": "BSL-1-NOTICE",
    "boost software license version 1.0 august 17th 2003": "BSL-1-NOTICE",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZLIB-GRANT",
    "you may obtain a copy": "APACHE-2-COPY-CUT",
    "gnu lesser general public license version 3 29 june 2007": "LGPL-3-NOTICE",
    "gnu lesser general public license version 2.1 february 1999": "LGPL-2.1-NOTICE",
    "gnu affero general public license version 3 19 november 2007": "AGPL-3-NOTICE",
    "mozilla public license version 2.0": "MPL-2-TITLE",
    "isc license": "ISC-TITLE",
}
#: Rules for these, the longest first; a part of a licence that no other has is enough.
MORE_RULES = (
    ("BSD-4-Clause", ("BSD-CONDITIONS", "BSD-SOURCE", "BSD-BINARY", "BSD-ADVERTISING")),
    ("MPL-2.0", ("MPL-2-NOTICE", "MPL-2-COPY")),
    ("ISC", ("ISC-TITLE", "ISC-GRANT", "ISC-DISCLAIMER", "ISC-NO-LIABILITY")),
    ("ISC", ("ISC-GRANT", "ISC-DISCLAIMER", "ISC-NO-LIABILITY")),
    ("ISC", ("ISC-GRANT", "ISC-DISCLAIMER")),
    ("0BSD", ("0BSD-GRANT", "ISC-DISCLAIMER", "ISC-NO-LIABILITY")),
    ("0BSD", ("0BSD-GRANT", "ISC-DISCLAIMER")),
    ("Apache-2.0", ("APACHE-2-GRANT", "APACHE-2-COPY")),
    ("Apache-2.0", ("APACHE-2-GRANT", "APACHE-2-COPY-CUT")),
    ("Apache-2.0", ("APACHE-2-NOTICE", "APACHE-2-COMPLIANCE", "APACHE-2-COPY")),
)
LAST_RULES = (
    ("MIT", ("MIT-GRANT",)), ("Apache-2.0", ("APACHE-2-GRANT",)), ("MPL-2.0", ("MPL-2-NOTICE",)), ("MPL-2.0", ("MPL-2-COPY",)), ("MPL-2.0", ("MPL-2-TITLE",)),
    ("ISC", ("ISC-GRANT",)), ("ISC", ("ISC-TITLE",)), ("0BSD", ("0BSD-GRANT",)), ("Unlicense", ("UNLICENSE-NOTICE",)), ("BSL-1.0", ("BSL-1-NOTICE",)), ("Zlib", ("ZLIB-GRANT",)),
    ("LGPL-3.0", ("LGPL-3-NOTICE",)), ("LGPL-2.1", ("LGPL-2.1-NOTICE",)), ("AGPL-3.0", ("AGPL-3-NOTICE",)),
    *((i.removesuffix("-GRANT"), (i,)) for i in sorted(set(_gnu().values()))),
    *((x, (SPDX_IDS[x.lower()],)) for x in SPDX if SPDX_IDS[x.lower()].startswith("SPDX-")),
)
ALL_RULES = FULL_RULES[:2] + MORE_RULES[:1] + FULL_RULES[2:] + MORE_RULES[1:] + RULES + LAST_RULES


def all_sentences() -> dict[str, str]:
    """Every known sentence; the names of licences that older ones gave win."""
    return _gnu() | MORE_SENTENCES | SENTENCES | FULL_SENTENCES


#: The SQL's sentence ends.
BREAK = r"\n+|[.!?]+[\s]+"
OTHER = r"[^\p{L}\p{N}.+-]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text with a line feed before and after it, at single line ends, and two at sentence ends."""
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), r"(?:\G|(?<![.!?]))[.!?]++\s+|\n\s*\n", "\n\n")
    out = F.concat(F.lit("\n"), F.regexp_replace(out, r"[^\p{L}\p{N}.\n+-]+", " "), F.lit("\n"))
    return F.regexp_replace(out, r"(?:\G|(?<![ .]))[ .]*+\n[ .]*+", "\n")


def _pattern(known: dict[str, str], names: dict[str, str]) -> str:
    """The known sentences between line ends, the longest first, and SPDX expressions over known names."""
    plain = lambda ks: [re.sub(r"[.+]", r"\\\g<0>", k).replace(" ", r"[ \n]") for k in sorted(ks, key=lambda k: (-len(k), k))]
    words = plain(known)
    if names:
        name = "(?:" + "|".join(plain(names)) + ")(?: with [a-z0-9.+-]+)?"
        words = [f"{SPDX_LINE} {name}(?: (?:and|or) {name})*", *words]
    return r"(?<=\n)(?:" + "|".join(words) + r")(?=\n)"


def _marked(ids: Column, rules: tuple) -> Column:
    """The identifiers as ``;A;;B;`` with each rule's matches, in order of the rules, replaced by ``#k;``."""
    line = F.concat(F.lit(""), F.array_join(F.transform(ids, lambda i: F.concat(F.lit(";"), i, F.lit(";"))), ""))
    return reduce(lambda x, kr: F.replace(x, F.lit("".join(f";{i};" for i in kr[1][1])), F.lit(f"#{kr[0]}#")), enumerate(rules), line)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", sentences: dict[str, str] | None = None, rules: tuple = ALL_RULES, spdx: dict[str, str] | None = None) -> DataFrame:
    """Per row: key, n_sentences (known ones), sentence_ids (in order), n_rules, licences (sorted, distinct); comma-joined.

    An ``SPDX-License-Identifier`` line gives an identifier for each name of its expression (``and``, ``or``, ``with`` an exception,
    brackets); a line with an unknown name gives none. ``spdx`` maps lower-cased names to identifiers."""
    known = all_sentences() if sentences is None else sentences
    names = (SPDX_IDS if sentences is None else {}) if spdx is None else spdx
    found = F.regexp_extract_all(normalised(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(_pattern(known, names)), F.lit(0))
    table = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    ids, of_name = table(known), table(names or {"": ""})
    named = lambda s: F.split(F.regexp_replace(F.substring(s, len(SPDX_LINE) + 2, 1 << 20), " with [a-z0-9.+-]+", ""), " (?:and|or) ")
    of = lambda s: F.when(F.startswith(s, F.lit(f"{SPDX_LINE} ")) & ~F.map_contains_key(ids, s), F.transform(named(s), lambda x: of_name[x])).otherwise(F.array(ids[s]))
    rows = docs.select(key, F.flatten(F.transform(F.transform(found, lambda s: F.translate(s, "\n", " ")), of)).alias("ids"))
    rows = rows.withColumn("hits", F.regexp_extract_all(_marked(F.col("ids"), rules), F.lit("#([0-9]+)#"), F.lit(1)))
    licences = F.array(*[F.lit(name) for name, _ in rules])
    claimed = F.transform("hits", lambda k: F.get(licences, k.cast("int")))
    return rows.select(
        key,
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.size("hits").cast("long").alias("n_rules"),
        F.array_join(F.array_sort(F.array_distinct(claimed)), ",").alias("licences"),
    )


def oracle() -> str:
    """SQL for all sentences and rules, where a sentence stands on one line; SPDX lines of one name."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    marked = "line"
    for k, (_, ids) in enumerate(ALL_RULES):
        marked = f"replace({marked}, {quote(''.join(f';{i};' for i in ids))}, '#{k}#')"
    names = "[" + ", ".join(quote(n) for n, _ in ALL_RULES) + "]"
    sentences = {f"{SPDX_LINE} {k}": i for k, i in SPDX_IDS.items()} | all_sentences()
    known = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in sentences.items())
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
cut AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), {quote(BREAK)}) AS parts FROM documents),
cells AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM cut),
norm AS (SELECT doc_id, pos, regexp_replace(regexp_replace(translate(part, '{UPPER}', '{LOWER}'), {quote(OTHER)}, ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') AS sentence FROM cells),
found AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM norm JOIN known USING (sentence) GROUP BY doc_id),
lined AS (SELECT doc_id, ids, array_to_string(list_transform(ids, lambda i: ';' || i || ';'), '') AS line FROM found),
hit AS (SELECT doc_id, ids, list_transform(regexp_extract_all({marked}, '#([0-9]+)#', 1), lambda k: {names}[k::INT + 1]) AS names FROM lined)
SELECT d.doc_id, coalesce(len(ids), 0)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(len(names), 0)::BIGINT AS n_rules, coalesce(array_to_string(list_sort(list_distinct(names)), ','), '') AS licences
FROM documents d LEFT JOIN hit h ON d.doc_id = h.doc_id"""
