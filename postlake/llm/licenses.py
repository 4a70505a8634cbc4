"""Licence recognition by sentence rules, in DataFrame functions only.

A text is normalised, with marks where sentences and lines end; known licence sentences are looked for between marks, on one line
or wrapped over several, and the identifiers found, in text order, are matched against ordered rules. Sentence table and rules are parameters of fixed size, so they are literals of the plan:
nothing is joined or shuffled, and each row is worked on where it is read.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences, as published with the licences, and their identifiers.
SENTENCES: dict[str, str] = {
    "Licensed under the Apache License, Version 2.0.": "Apache2",
    'Licensed under the Apache License, Version 2.0 (the "License");': "Apache2-Head",
    "you may not use this file except in compliance with the License.": "Apache2-May",
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.': "Apache2-Head-May",
    "You may obtain a copy of the License at": "Apache2-Copy",
    "Released under the MIT License.": "MIT-Named",
    "Licensed under the MIT License.": "MIT-Named",
    "This project is licensed under the MIT License.": "MIT-Named",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "MIT-Notice",
    "This work is licensed under the GNU General Public License, version 3.": "GPL3",
    "This work is licensed under the GNU General Public License, version 2.": "GPL2",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "GPL3-Later",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "GPL2-Later",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.": "GPL-Warranty",
    "Licensed under the GNU Lesser General Public License, version 3.": "LGPL3",
    "Licensed under the GNU Affero General Public License, version 3.": "AGPL3",
    "Licensed under the Mozilla Public License, Version 2.0.": "MPL2",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL2",
    "Licensed under the Eclipse Public License, Version 2.0.": "EPL2",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "BSD-Head",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "BSD-Source",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.": "BSD-Binary",
    "Licensed under the BSD 3-Clause License.": "BSD3-Named",
    "Licensed under the BSD 2-Clause License.": "BSD2-Named",
    "Licensed under CC BY 4.0.": "CC-BY4",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA4",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC4",
    "Licensed under CC BY-ND 4.0.": "CC-BY-ND4",
    "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA4",
    "Licensed under CC BY-NC-ND 4.0.": "CC-BY-NC-ND4",
    "Released into the public domain under CC0 1.0.": "CC0",
    "This is free and unencumbered software released into the public domain.": "Unlicense",
    "All rights reserved.": "AllRights",
}
#: Rules in order: a licence and the identifiers that must follow one another (others may lie between the sentences, not between their identifiers).
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-2.0", ("Apache2-Head", "Apache2-May")),
    ("Apache-2.0", ("Apache2-Head-May",)),
    ("Apache-2.0", ("Apache2",)),
    ("MIT", ("MIT-Named",)),
    ("MIT", ("MIT-Notice",)),
    ("GPL-3.0-or-later", ("GPL3-Later",)),
    ("GPL-2.0-or-later", ("GPL2-Later",)),
    ("GPL-3.0", ("GPL3",)),
    ("GPL-2.0", ("GPL2",)),
    ("LGPL-3.0", ("LGPL3",)),
    ("AGPL-3.0", ("AGPL3",)),
    ("MPL-2.0", ("MPL2",)),
    ("EPL-2.0", ("EPL2",)),
    ("BSD-2-Clause", ("BSD-Head", "BSD-Source", "BSD-Binary")),
    ("BSD-3-Clause", ("BSD3-Named",)),
    ("BSD-2-Clause", ("BSD2-Named",)),
    ("CC-BY-NC-SA-4.0", ("CC-BY-NC-SA4",)),
    ("CC-BY-NC-ND-4.0", ("CC-BY-NC-ND4",)),
    ("CC-BY-NC-4.0", ("CC-BY-NC4",)),
    ("CC-BY-SA-4.0", ("CC-BY-SA4",)),
    ("CC-BY-ND-4.0", ("CC-BY-ND4",)),
    ("CC-BY-4.0", ("CC-BY4",)),
    ("CC0-1.0", ("CC0",)),
    ("Unlicense", ("Unlicense",)),
]
# Sentences of full licence texts as published, which the SQL doesn't know. The name of the holder in the third BSD clause is read as x.
FULL_TEXTS: dict[str, str] = {
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:': "MIT-Permission",
    "Neither the name of x nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "BSD-Name",
    "Neither the name of x nor the names of their contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "BSD-Name",
    "Neither the name of x nor the names of any contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "BSD-Name",
    "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.": "BSD-Name",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.': "BSD-Warranty",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.': "MIT-Warranty",
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.": "MIT-Liability",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "ISC-Permission",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "ISC-Permission",
    "This software is provided 'as-is', without any express or implied warranty.": "Zlib-Warranty",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:": "Zlib-Permission",
    'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:': "BSL-Permission",
    "Distributed under the Boost Software License, Version 1.0.": "BSL-Named",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": "LGPL21-Later",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "AGPL3-Later",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.": "Unlicense-Anyone",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.': "Apache2-Warranty",
    "See the License for the specific language governing permissions and limitations under the License.": "Apache2-See",
    "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.": "MPL2-Copy",
}
FULL_RULES = [
    ("MIT", ("MIT-Permission",)),
    ("ISC", ("ISC-Permission",)),
    ("Zlib", ("Zlib-Permission",)),
    ("BSL-1.0", ("BSL-Permission",)),
    ("BSL-1.0", ("BSL-Named",)),
    ("LGPL-2.1-or-later", ("LGPL21-Later",)),
    ("AGPL-3.0-or-later", ("AGPL3-Later",)),
    ("Unlicense", ("Unlicense-Anyone",)),
    ("BSD-3-Clause", ("BSD-Head", "BSD-Source", "BSD-Binary", "BSD-Name")),
]
_BSD2 = next(k for k, (licence, _) in enumerate(RULES) if licence == "BSD-2-Clause")
ALL_RULES = RULES[:_BSD2] + FULL_RULES + RULES[_BSD2:]
HOLDER = r"(?<=[|/])neither[ /]the[ /]names?[ /]of(?:[ /|][a-z0-9]++){1,15}?[ /|]nor[ /]the[ /]names?[ /]of(?=[ /])"
#: Sentences end at a line's end, or at . ! ? ; or : before white space.
SENTENCE_END = r"\n|(?:[.!?;:])[ \t\r]+"


def normal(sentence: str) -> str:
    """What the plan does to a sentence, for the table: a-z and 0-9 in lower case, all else one space."""
    return re.sub(r"[^A-Za-z0-9]+", " ", sentence).strip(" ").lower()


def table(sentences: dict[str, str]) -> dict[str, str]:
    return {normal(part): f"{name}" if len(parts) == 1 else f"{name}.{k}" for s, name in sentences.items() for parts in [[p for p in re.split(SENTENCE_END, s) if normal(p)]] for k, part in enumerate(parts)}


def expanded(sentences: dict[str, str], rules: list[tuple[str, tuple[str, ...]]]) -> list[tuple[str, tuple[str, ...]]]:
    """Rules over the identifiers of table(), where a known sentence that the splitter cuts has several."""
    ids = table(sentences)
    parts: dict[str, list[str]] = {}
    for s, name in sentences.items():
        parts.setdefault(name, [ids[normal(p)] for p in re.split(SENTENCE_END, s) if normal(p)])
    return [(licence, tuple(x for name in names for x in parts[name])) for licence, names in rules]


def marked(text: Column) -> Column:
    """The normalised text with | where a sentence or a paragraph ends and / where only a line ends; its words are parted by a blank or a mark."""
    t = F.regexp_replace(F.translate(text, "|/", "##"), r"(?i)(?<![^\n])[^a-z0-9\n]*(?:(?:rem|dnl)(?=[ \t]))?", "")  # indents, bullets and comment prefixes
    t = F.regexp_replace(F.regexp_replace(t, r"[.!?;:](?=[ \t\r\n])", "|"), r"\n[^A-Za-z0-9]*\n", "|")
    t = F.lower(F.regexp_replace(F.translate(t, "\n", "/"), "[^A-Za-z0-9|/]+", " "))
    t = F.regexp_replace(F.regexp_replace(t, r"[ /]*\|[ /|]*", "|"), " ?/ ?", "/")
    return F.regexp_replace(F.concat(F.lit("|"), F.trim(t), F.lit("|")), HOLDER, "neither the name of x nor the names of")


def sentence_ids(text: Column, known: dict[str, str]) -> Column:
    """Identifiers of the known sentences of a text, in order, as an array: whole lines or sentences, or wrapped over lines of a paragraph."""
    lookup = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    longest_first = "|".join(s.replace(" ", "[ /]") for s in sorted(known, key=lambda s: (-len(s), s)))
    found = F.regexp_extract_all(marked(text), F.lit(f"(?<=[|/])(?:{longest_first})(?=[|/])"), F.lit(0))
    return F.transform(found, lambda s: F.try_element_at(lookup, F.translate(s, "/", " ")))


def _uncovered(line: Column, names: tuple[str, ...], licence: str, rules: list[tuple[str, tuple[str, ...]]]) -> Column:
    """The line without longer sequences of other licences that hold these names, so that a text isn't a shorter licence too."""
    inner = f" {' '.join(names)} "
    longer = [f" {' '.join(other)} " for name, other in rules if name != licence and len(other) > len(names) and inner in f" {' '.join(other)} "]
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(" ")), longer, line)


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, tuple[str, ...]]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses, first_license) per row.

    sentence_ids: identifiers in text order, joined by a blank; licenses: the licences whose rule's identifiers follow one another there, in the order
    of the rules, joined by a comma (not where they are part of a longer rule's); first_license: the first of them, or null. Null and empty texts have none; repeated rows give repeated results; null
    ids stay null; an empty table gives no rows; other columns are not read.
    """
    sentences, rules = sentences or SENTENCES | FULL_TEXTS, rules or ALL_RULES
    known = table(sentences)
    # A text without the longest word of any known sentence has no known sentence, and is not split.
    longest = sorted({max(s.split(" "), key=lambda w: (len(w), w)) for s in known})
    low = F.lower(F.col("text"))
    gate = reduce(or_, [F.contains(low, F.lit(w)) for w in longest])
    ids = F.when(gate, sentence_ids(F.col("text"), known)).otherwise(F.array().cast("array<string>"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", ids.alias("ids"))
    line = F.concat(F.lit(" "), F.array_join("ids", " "), F.lit(" "))
    full = expanded(sentences, rules)
    found = F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(_uncovered(line, names, licence, full), F.lit(f" {' '.join(names)} ")), F.lit(licence)) for licence, names in full])))
    return own.withColumn("found", found).select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", " ").alias("sentence_ids"), F.array_join("found", ",").alias("licenses"), F.try_element_at("found", F.lit(1)).alias("first_license")
    )


def oracle(sentences: dict[str, str] | None = None, rules: list[tuple[str, tuple[str, ...]]] | None = None) -> str:
    """The same in DuckDB SQL over documents."""
    sentences, rules = sentences or SENTENCES, rules or RULES
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = table(sentences)
    values = ", ".join(f"({q(s)}, {q(i)})" for s, i in known.items())
    cases = ", ".join(f"({k}, {q(licence)}, {q(' ' + ' '.join(names) + ' ')})" for k, (licence, names) in enumerate(expanded(sentences, rules)))
    return f"""
WITH known(s, id) AS (VALUES {values}), rules(k, licence, ids) AS (VALUES {cases}),
d AS (SELECT row_number() OVER () AS r, doc_id, text AS t FROM documents),
parts AS (SELECT r, unnest(regexp_split_to_array(t, '{SENTENCE_END}')) AS p, generate_subscripts(regexp_split_to_array(t, '{SENTENCE_END}'), 1) AS n FROM d),
ids AS (SELECT r, count(*) AS n_sentences, string_agg(id, ' ' ORDER BY n) AS sentence_ids FROM parts JOIN known ON s = lower(trim(regexp_replace(p, '[^A-Za-z0-9]+', ' ', 'g'), ' ')) GROUP BY r),
hits AS (SELECT r, licence, min(k) AS k FROM ids JOIN rules ON contains(' ' || sentence_ids || ' ', rules.ids) GROUP BY r, licence),
found AS (SELECT r, string_agg(licence, ',' ORDER BY k) AS licenses, arg_min(licence, k) AS first_license FROM hits GROUP BY r)
SELECT doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(sentence_ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses, first_license
FROM d LEFT JOIN ids USING (r) LEFT JOIN found USING (r)"""
