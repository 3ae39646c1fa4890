"""License scans by sentence rules, in DataFrame functions only.

A text is cut into sentences, over the ends of wrapped lines where need be, each is
normalised and looked up among known licence sentences. The identifiers found, in order, are matched against rules: a
rule holds where its sentences stand in the text in the rule's order, with
whatever else between them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import keyed, table

# Licence sentences, by identifier, and the rules over them.
SENTENCES = {
    "mit-notice": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license."],
    "mit-title": ["The MIT License (MIT)", "MIT License"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "as-is": ["The software is provided \"as is\", without warranty of any kind.", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."],
    "apache2-notice": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");"],
    "apache2-comply": ["You may not use this file except in compliance with the License."],
    "apache2-copy": ["You may obtain a copy of the License at"],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3."],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."],
    "bsd-redistribute": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "mpl2-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "cc-by-nc4-notice": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by4-notice": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa4-notice": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0-notice": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "all-rights": ["All rights reserved."],
}
RULES = [
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-grant", "mit-condition", "as-is"]),
    ("MIT", ["mit-title", "mit-grant"]),
    ("Apache-2.0", ["apache2-notice"]),
    ("Apache-2.0", ["apache2-comply", "apache2-copy"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-3.0", ["gpl-free", "gpl-hope"]),
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-endorse"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("ISC", ["isc-grant", "as-is"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4-notice"]),
    ("CC-BY-4.0", ["cc-by4-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
]
# Sentences and rules of the whole licence texts, beside the short forms above. A name may be in both.
WHOLE_SENTENCES = {
    "cc-by-nc4-notice": ["This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by4-notice": ["This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "cc-by-sa4-notice": ["This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-condition": ["The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."],
    "as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "apache2-notice": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "apache2-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "bsd-endorse": [f"Neither the name of {who} may be used to endorse or promote products derived from this software without specific prior written permission." for who in ("the author nor the names of its contributors", "the author nor the names of contributors", "the University nor the names of its contributors", "the copyright holders nor the names of its contributors", "the copyright holders nor the names of their contributors")],
    "isc-permission": [f"Permission to use, copy, modify, {many} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies." for many in ("and", "and/or")],
    "isc-as-is": [f"THE SOFTWARE IS PROVIDED \"AS IS\" AND {who} ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS." for who in ("THE AUTHOR DISCLAIMS", "THE AUTHORS DISCLAIM", "ISC DISCLAIMS", "INTERNET SYSTEMS CONSORTIUM DISCLAIMS")],
    "apache2-express": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "gpl-free": [f"{what} is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version." for what in ("This program", "This file", "This software", "This library")],
    "gpl2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl2-only": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."],
    "lgpl21-free": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "lgpl3-free": [f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version." for what in ("library", "program")],
    "lgpl-hope": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "agpl3-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "mpl2-copy": [f"If a copy of the MPL was not distributed with this file, You can obtain one at {at}://mozilla.org/MPL/2.0/." for at in ("http", "https")],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-as-is": [f"THIS SOFTWARE IS PROVIDED BY {who} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED." for who in ("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT HOLDER AND CONTRIBUTORS", "THE AUTHOR AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS", "THE AUTHOR")],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "boost-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty."],
    "gpl2-title": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "gpl3-title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl21-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "lgpl3-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "agpl3-title": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "apache2-title": ["Apache License Version 2.0, January 2004"],
    "mpl2-title": ["Mozilla Public License Version 2.0"],
    "epl2-title": ["Eclipse Public License - v 2.0"],
    "epl2-notice": [f"This program and the accompanying materials are made available under the terms of the Eclipse Public License {v} which {verb} available at {at}://www.eclipse.org/legal/epl-2.0/" for v in ("2.0", "v2.0") for verb in ("is", "accompanies this distribution, and is") for at in ("http", "https")],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
}
WHOLE_RULES = [
    ("ISC", ["isc-permission", "isc-as-is"]),
    ("ISC", ["isc-permission", "as-is"]),
    ("Apache-2.0", ["apache2-copy", "apache2-express"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]),
    ("GPL-2.0-only", ["gpl2-only", "gpl-hope"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-hope"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "lgpl-hope"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "gpl-hope"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope"]),
    ("MPL-2.0", ["mpl2-notice", "mpl2-copy"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "+bsd-as-is"]),
    ("BSL-1.0", ["boost-grant"]),
    ("Unlicense", ["unlicense", "unlicense-anyone"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("GPL-2.0", ["gpl2-title"]),
    ("GPL-3.0", ["gpl3-title"]),
    ("LGPL-2.1", ["lgpl21-title"]),
    ("LGPL-3.0", ["lgpl3-title"]),
    ("AGPL-3.0", ["agpl3-title"]),
    ("Apache-2.0", ["apache2-title"]),
    ("MPL-2.0", ["mpl2-title"]),
    ("EPL-2.0", ["epl2-title"]),
    ("EPL-2.0", ["epl2-notice"]),
]


def normalise(sentence: str) -> str:
    """Lower case; only a-z, 0-9 and single spaces. found_sentences() does the same to a text's sentences."""
    return re.sub("[^a-z0-9]+", " ", "".join(c.lower() if c.isascii() else c for c in sentence)).strip(" ")


def sentence_table(sentences: dict[str, list[str]] = SENTENCES) -> dict[str, str]:
    """Identifier of each normalised sentence; one that its own stops cut is known by its longest part."""
    return {max(map(normalise, re.split(r"[.!?][ \t]+", s)), key=len): name for name, forms in sentences.items() for s in forms}


#: What a scan looks for: the short forms and the whole texts.
KNOWN = {name: SENTENCES.get(name, []) + WHOLE_SENTENCES.get(name, []) for name in {**SENTENCES, **WHOLE_SENTENCES}}


#: Words that a licence sentence starts with; a line without any needs no further look.
def _hint(known: dict[str, str]) -> str:
    starts = sorted({" ".join(s.split(" ")[:2]) for s in known})
    return "(^|[^a-z0-9])(" + "|".join(s.replace(" ", "[^a-z0-9]+") for s in starts) + ")([^a-z0-9]|$)"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _pattern(known: dict[str, str]) -> str:
    """The known sentences between ends (P or L), each over any number of lines; the shortest that ends first."""
    forms = sorted(known, key=lambda s: (s.count(" "), s))
    return "(?<=[PL] )(?:" + "|".join(s.replace(" ", " (?:L )?") for s in forms) + ")(?= [PL])"


#: Where a licence names its holder: what stands before and after, and the form that is known. A name has at most so many words, ends of lines and full stops counted.
HOLDERS = [
    ("neither the name of", "nor the names of its contributors", "the copyright holder"),
    ("this software is provided by", "as is and any express or implied warranties", "the copyright holders and contributors"),
]
HOLDER_WORDS = 40
#: A tag of markup, in lower case.
_TAG = "</?[a-z][a-z0-9]{0,9}(?:[ \t\n][^<>]{0,300})?/?>"


def found_sentences(text: Column, known: dict[str, str]) -> Column:
    """array<string>: identifiers of the known sentences in text, in order.

    A sentence ends at . ! or ? before white space or a line's end, and at a line
    without words; a known one also where any line ends, so that lines of their
    own are found, and hard-wrapped sentences over several lines. A tag of markup
    ends a line.
    """
    table_ = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    plain = F.regexp_replace(_lower(F.coalesce(text, F.lit(""))), rf"\r\n?|{_TAG}", "\n")
    # P and L, which lower case has left free: the end of a sentence, and of a line within one
    plain = F.regexp_replace(plain, r"[.!?][ \t]+|[.!?][ \t]*\n|\n[^a-z0-9]*\n", " P ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\n", " L "), "[^a-z0-9PL]+", " ")
    marked = F.concat(F.lit("P "), F.trim(plain), F.lit(" P"))
    for before, after, usual in HOLDERS:
        lines = [x.replace(" ", " (?:L )?") for x in (before, after)]
        marked = F.regexp_replace(marked, f"{lines[0]} (?:[a-z0-9PL]+ ){{1,{HOLDER_WORDS}}}?{lines[1]}(?= )", f"{before} {usual} {after}")
    whole = F.regexp_extract_all(marked, F.lit(_pattern(known)), F.lit(0))
    return F.transform(whole, lambda s: F.element_at(table_, F.replace(s, F.lit(" L "), F.lit(" "))))


def rule_holds(found: Column, rule: list[str]) -> Column:
    """Whether the rule's identifiers stand in found in this order; one with + must follow the one before it at once.

    Each is looked for after the one before it, so one with + follows the first
    place where the others hold.
    """
    at = F.lit(0)
    for name in rule:
        rest = F.slice(found, at + 1, F.greatest(F.size(found) - at, F.lit(0)))
        if name.startswith("+"):
            at = F.when(at.isNotNull() & (F.get(rest, F.lit(0)) == name[1:]), (at + 1).cast("int"))
            continue
        place = F.array_position(rest, name)
        at = F.when(at.isNotNull() & (place > 0), (at + place).cast("int"))
    return at.isNotNull()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, list[str]] = KNOWN, rules: list[tuple[str, list[str]]] = RULES + WHOLE_RULES) -> DataFrame:
    """(doc_id, sentence_ids, licenses, n_sentences), one row per row of docs.

    sentence_ids are the known sentences in order, repeats included, joined by
    '>'; licenses are the names of the rules that hold, sorted, joined by ','.
    Null and empty texts, and texts without a known sentence, give empty strings
    and 0. A null id stays null; repeated rows give repeated rows.
    """
    known = sentence_table(sentences)
    rows = keyed(docs, id_col, text_col)
    hinted = F.coalesce(_lower(F.col("text")).rlike(_hint(known)), F.lit(False))
    rows = rows.select("doc_id", F.when(hinted, found_sentences(F.col("text"), known)).otherwise(F.array().cast("array<string>")).alias("found"))
    holds = [F.when(rule_holds(F.col("found"), rule), F.lit(name)) for name, rule in rules]
    names = F.array_sort(F.array_distinct(F.array_compact(F.array(*holds))))
    matched = F.when(F.size("found") > 0, names).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", F.array_join("found", ">").alias("sentence_ids"), F.array_join(matched, ",").alias("licenses"), F.size("found").cast("long").alias("n_sentences"))


def op1_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(n)})" for s, n in sentence_table(KNOWN).items())
    in_order = lambda rule: ">" + "".join(f"{name[1:]}>" if name[0] == "+" else f"(?:.*>)?{name}>" for name in rule)
    rules = " UNION ALL ".join(f"SELECT doc_id, {quote(name)} AS license FROM g WHERE regexp_matches('>' || ids || '>', {quote(in_order(rule))})" for name, rule in RULES + WHOLE_RULES)
    return rf"""
WITH known(sentence, name) AS (VALUES {known}),
s AS (
  SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS place
  FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_replace(coalesce(text, ''), '(?i){_TAG}', chr(10), 'g'), '([.!?])[ \t]+', '\1' || chr(10), 'g'), '[\n\r]+') AS parts FROM documents)),
f AS (
  SELECT doc_id, place, name
  FROM s JOIN known ON known.sentence = trim(regexp_replace(translate(raw, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'))),
g AS (SELECT doc_id, string_agg(name, '>' ORDER BY place) AS ids, count(*) AS n FROM f GROUP BY doc_id),
r AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM ({rules}) GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.ids, '') AS sentence_ids, coalesce(r.licenses, '') AS licenses, coalesce(g.n, 0) AS n_sentences
FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN r USING (doc_id)
"""


ORACLE_SQL = _oracle()
