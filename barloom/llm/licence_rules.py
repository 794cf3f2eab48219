"""Licence scans by sentence rules.

A text is cut into sentences twice: at line ends and sentence ends, and with lines joined, for wrapped notices. Sentences
are normalised (lower case, words and digits only) and known ones become identifiers, in text order. A rule is a sequence of
identifiers; it matches where they occur in this order, with anything between. Where one rule begins with all of another, the
longer one takes its span, up to the next place where both could begin, and the shorter one must match elsewhere. Reserved rights
alone count as a licence only where no other is found. All of it is DataFrame expressions on the row: nothing is shuffled and
nothing joined. Identifiers are shown of the reading that knows more sentences, of the lines if both know as many.

Defined results: null and empty texts have no sentences and no licences; the result has a row per row of the
input; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Names of licences as notices write them, and sentences of licence texts.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"),
    "MIT": ("MIT License", "MIT licence", "MIT"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause License", "New BSD License", "BSD License"),
    "ISC": ("ISC License",),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "CC0-1.0": ("CC0 1.0", "CC0", "Creative Commons Zero v1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
SUBJECTS = ("", "This work is ", "This file is ", "This software is ", "This project is ", "This program is ", "The code is ")
VERBS = ("Licensed under ", "Released under ", "Distributed under ", "Available under ", "Published under ")
ARTICLES = ("", "the ", "a ", "the terms of the ")
#: What may follow the name of a licence in a notice.
HEADERS = (' (the "License")', ' (the "License"); you may not use this file except in compliance with the License.')
FILES = ("LICENSE", "LICENSE.md", "LICENSE.txt", "[LICENSE](LICENSE)", "[LICENSE](LICENSE.md)", "[LICENSE.md](LICENSE.md)")
FOLLOWING = (*HEADERS, *(f" - see the {file} file for details" for file in FILES))
#: Identifiers of SPDX lines besides the licences' own.
SPDX = {
    "BSD-2-Clause": (), "BSD-3-Clause": (), "MIT": (), "ISC": (), "Apache-2.0": (), "MPL-2.0": (), "CC0-1.0": (), "CC-BY-4.0": (),
    "CC-BY-SA-4.0": (), "CC-BY-NC-4.0": (), "CC-BY-ND-4.0": (), "CC-BY-NC-SA-4.0": (), "CC-BY-NC-ND-4.0": (), "Unlicense": (),
    **{x: (f"{x}-only", f"{x}-or-later", f"{x}+") for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")},
}
EITHER = ("MIT OR Apache-2.0", "Apache-2.0 OR MIT")
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the Software.",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
    "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission.",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-urls": "https://www.apache.org/licenses/LICENSE-2.0",
    "spdx": "SPDX-License-Identifier",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
    "later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
    "later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
    "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved.",
}
RULES = {
    "MIT": [("mit-grant", "mit-notice", "as-is")],
    "ISC": [("isc-grant",)],
    "BSD-2-Clause": [("bsd-grant", "bsd-source", "bsd-binary")],
    "BSD-3-Clause": [("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")],
    "Apache-2.0": [("apache-use", "apache-copy"), ("apache-use", "apache-obtain", "apache-url"), ("apache-use", "apache-obtain", "apache-urls")],
    "GPL-3.0": [("gpl-free", "gpl-hope")],
    "GPL-2.0": [("gpl2-free", "gpl-hope")],
    "Unlicense": [("unlicense",)],
}
#: What reserved rights mean where nothing else is said.
ALONE = ("reserved", "Proprietary")


def plain(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip()


def known() -> dict[str, str]:
    """Normalised sentence -> identifier: the sentences above, every way to write a notice with a name, and SPDX lines."""
    begun = [f"{s}{v}{a}" for s in SUBJECTS for v in VERBS for a in ARTICLES]
    named = [(licence, name) for licence, names in NAMES.items() for name in names]
    out = {plain(f"{begin}{name}"): f"notice-{licence}" for licence, name in named for begin in begun}
    # The longer notices, as they are commonly written; every form more makes the plan larger.
    begun = [f"{s}Licensed under {a}" for s in ("", "This project is ", "This software is ") for a in ARTICLES[:2]]
    out |= {plain(f"{begin}{name}{end}"): f"notice-{licence}" for licence, name in named for begin in begun for end in FOLLOWING}
    short = {plain(x): f"id-{licence}" for licence, others in SPDX.items() for x in (licence, *others)} | {plain(x): "id-either" for x in EITHER}
    # Without a blank after the colon the line is one sentence.
    out |= short | {f"spdx license identifier {x}": f"spdx-{ident}" for x, ident in short.items()}
    return out | {plain(text): key for key, text in SENTENCES.items()}


def rules() -> list[tuple[str, tuple[str, ...]]]:
    named = [(licence, (f"notice-{licence}",)) for licence in NAMES]
    # An identifier counts right after the words that announce it.
    announced = [(x, (f"{begin}id-{of}",)) for x in SPDX for of in ((x, "either") if x in ("MIT", "Apache-2.0") else (x,)) for begin in ("spdx>>", "spdx-")]
    return named + announced + [(licence, rule) for licence, several in RULES.items() for rule in several]


def longer_rules() -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """(short, long) where the short rule is how the long one begins; both of some licence."""
    every = [rule for _, rule in rules()]
    return [(a, b) for a in every for b in every if len(a) < len(b) and b[: len(a)] == a and len(a) > 1]


def span(rule: tuple[str, ...]) -> str:
    """A pattern of a rule's span in a chain whose places where it begins are written '#'."""
    return "#" + "".join(f"[^#]*>{x}>" for x in rule[1:])


def like(rule: tuple[str, ...]) -> str:
    return "%" + "%".join(f">{x}>" for x in rule) + "%"


def sentences(text: Column) -> Column:
    """Normalised sentences of a text whose sentences end where lines do."""
    low = F.translate(text, UPPER, LOWER)
    return F.split(F.regexp_replace(F.regexp_replace(low, "[.!?:][ \t]+", "\n"), "[^a-z0-9\n]+", " "), " ?\n ?")


def identified(text: Column) -> Column:
    """Identifiers of the known sentences, in text order."""
    table = known()
    found = F.filter(F.transform(sentences(text), lambda s: F.trim(s)), lambda s: s.isin(list(table)))
    pairs = F.str_to_map(F.lit(",".join(f"{sentence}:{ident}" for sentence, ident in table.items())), F.lit(","), F.lit(":"))
    return F.transform(found, lambda s: F.element_at(pairs, s))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_known, sentence_ids (joined by '>'), licences (sorted, joined by ' AND '; empty if none)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    # Lines joined, but for blank lines: the other reading of line ends.
    wrapped = F.regexp_replace(F.regexp_replace(whole, r"\n[ \t]*\n\s*", ". "), r"\s*\n\s*", " ")
    held = docs.select("doc_id", identified(whole).alias("lines"), identified(wrapped).alias("joined"))
    more = F.when(F.size("joined") > F.size("lines"), F.col("joined")).otherwise(F.col("lines"))
    shown = held.select(
        "doc_id",
        F.size(more).cast("long").alias("n_known"),
        F.array_join(more, ">").alias("sentence_ids"),
        *(F.concat(F.lit(">"), F.array_join(c, ">>"), F.lit(">")).alias(c) for c in ("lines", "joined")),
    )
    shorter = {a: b for a, b in longer_rules()}

    def matches(chain: Column, rule: tuple[str, ...]) -> Column:
        if rule in shorter:
            # What is left when the longer rule has taken its spans.
            chain = F.regexp_replace(F.replace(chain, F.lit(f">{rule[0]}>"), F.lit("#")), span(shorter[rule]), "@")
            return chain.rlike(span(rule))
        return chain.like(like(rule))

    matched = [F.when(matches(F.col("lines"), rule) | matches(F.col("joined"), rule), F.lit(licence)) for licence, rule in rules()]
    licences = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*matched)))), " AND ")
    reserved = F.col("lines").contains(f">{ALONE[0]}>") | F.col("joined").contains(f">{ALONE[0]}>")
    found = shown.withColumn("licences", licences).withColumn("reserved", reserved)
    return found.select(
        "doc_id", "n_known", "sentence_ids", F.when((F.col("licences") == "") & F.col("reserved"), F.lit(ALONE[1])).otherwise(F.col("licences")).alias("licences")
    )


def oracle() -> str:
    """The same by plain SQL."""

    def quoted(x):
        return "'" + x.replace("'", "''") + "'"

    table = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in known().items())
    shorter = {a: b for a, b in longer_rules()}
    ruled = ", ".join(f"({quoted(n)}, {quoted(like(rule))})" for n, rule in rules() if rule not in shorter)
    nested = ", ".join(
        f"({quoted(n)}, {quoted(f'>{rule[0]}>')}, {quoted(span(shorter[rule]))}, {quoted(span(rule))})" for n, rule in rules() if rule in shorter
    )

    def cut(text):
        low = f"translate({text}, '{UPPER}', '{LOWER}')"
        ended = f"regexp_replace({low}, '[.!?:][ ' || chr(9) || ']+', chr(10), 'g')"
        return f"string_split(regexp_replace({ended}, '[^a-z0-9' || chr(10) || ']+', ' ', 'g'), chr(10))"

    wrapped = "regexp_replace(regexp_replace(text, '\\n[ \\t]*\\n[ \\t\\n\\v\\f\\r]*', '. ', 'g'), '[ \\t\\n\\v\\f\\r]*\\n[ \\t\\n\\v\\f\\r]*', ' ', 'g')"
    return f"""
WITH known(sentence, ident) AS (VALUES {table}), rule(licence, pattern) AS (VALUES {ruled}),
nested(licence, begins, longer, shorter) AS (VALUES {nested}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, way, unnest(parts) AS part, generate_subscripts(parts, 1) AS k
   FROM (SELECT r, 0 AS way, {cut("text")} AS parts FROM d UNION ALL SELECT r, 1, {cut(wrapped)} FROM d)),
i AS (SELECT r, way, count(*) AS n, string_agg(ident, '>' ORDER BY k) AS ids, '>' || string_agg(ident, '>>' ORDER BY k) || '>' AS chain
   FROM s JOIN known ON trim(part, ' ') = sentence GROUP BY r, way),
found AS (SELECT r, licence FROM i JOIN rule ON chain LIKE pattern
   UNION SELECT r, licence FROM i JOIN nested ON regexp_matches(regexp_replace(replace(chain, begins, '#'), longer, '@', 'g'), shorter)),
l AS (SELECT r, string_agg(DISTINCT licence, ' AND ' ORDER BY licence) AS licences FROM found GROUP BY r),
alone AS (SELECT DISTINCT r FROM i WHERE contains(chain, '>{ALONE[0]}>')),
best AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY r ORDER BY n DESC, way) = 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_known, coalesce(ids, '') AS sentence_ids,
  coalesce(licences, CASE WHEN alone.r IS NOT NULL THEN '{ALONE[1]}' END, '') AS licences
FROM d LEFT JOIN best ON d.r = best.r LEFT JOIN l ON d.r = l.r LEFT JOIN alone ON d.r = alone.r
"""
