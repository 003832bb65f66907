"""Licence scans by sentence-rule recognition.

Texts are cut into sentences and normalised (lower case, runs of other characters than a-z and 0-9 to one space).
A sentence that goes over several lines, or is cut at an abbreviation, is known as a whole; otherwise each line is looked
up, and what is not known as a line (SPDX identifiers are) sentence by sentence.
Known licence sentences become their identifiers, all others the gap 0; the sequence of identifiers is matched
against licence rules in their order, longer evidence first, and what a rule has matched no later rule sees.
Everything is a chain of SQL functions over one row: no shuffle, no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Known sentences in normal form, by identifier (fixed values).
SENTENCES = {
    1: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    2: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    3: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    4: "licensed under the apache license version 2 0 the license",
    5: "you may not use this file except in compliance with the license",
    6: "you may obtain a copy of the license at http www apache org licenses license 2 0",
    7: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    8: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    9: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    10: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    11: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    12: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    13: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    14: "see the gnu general public license for more details",
    15: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    16: "licensed under the apache license version 2 0",
    17: "released under the mit license",
    18: "licensed under the mit license",
    19: "licensed under cc by nc 4 0",
    20: "licensed under cc by 4 0",
    21: "licensed under cc by sa 4 0",
    22: "this work is licensed under the gnu general public license version 3",
    23: "licensed under the gnu general public license version 3",
    24: "licensed under the gnu general public license version 2",
    25: "this work is licensed under a creative commons attribution 4 0 international license",
    26: "this work is licensed under the creative commons attribution noncommercial 4 0 international license",
    27: "licensed under the mozilla public license version 2 0",
    28: "this source code form is subject to the terms of the mozilla public license v 2 0",
    29: "this is free and unencumbered software released into the public domain",
    30: "all rights reserved",
}
#: Licences that an SPDX line may name; their identifiers follow from SPDX_FIRST (fixed values).
SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "Zlib", "MPL-2.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
SPDX_FIRST = 101
SENTENCES |= {SPDX_FIRST + i: "spdx license identifier " + re.sub("[^a-z0-9]+", " ", name.lower()) for i, name in enumerate(SPDX)}
#: Headings that name a licence by themselves, by identifier (fixed values).
HEADINGS = {201: ("MIT", "the mit license"), 202: ("MIT", "the mit license mit"), 203: ("MIT", "mit license"), 204: ("BSD-2-Clause", "bsd 2 clause license"), 205: ("BSD-3-Clause", "bsd 3 clause license"), 206: ("ISC", "isc license"), 207: ("MPL-2.0", "mozilla public license version 2 0"), 208: ("Apache-2.0", "apache license version 2 0")}
SENTENCES |= {k: text for k, (_, text) in HEADINGS.items()}
#: Rules in the order of matching: licence, identifiers that follow each other (fixed values). SPDX lines and headings come last, each a rule of its own.
RULES = [
    ("Apache-2.0", (4, 5, 6, 7)), ("MIT", (1, 2, 3)), ("BSD-3-Clause", (8, 9, 10, 11)), ("GPL-3.0-or-later", (12, 13, 14)), ("BSD-2-Clause", (8, 9, 10)),
    ("Apache-2.0", (4, 5)), ("MIT", (1, 2)), ("GPL-3.0-or-later", (12, 13)), ("MPL-2.0", (28,)), ("GPL-3.0-or-later", (12,)), ("MIT", (1,)), ("ISC", (15,)), ("Apache-2.0", (4,)),
    ("Apache-2.0", (16,)), ("MIT", (17,)), ("MIT", (18,)), ("CC-BY-NC-4.0", (19,)), ("CC-BY-4.0", (20,)), ("CC-BY-SA-4.0", (21,)), ("GPL-3.0-only", (22,)), ("GPL-3.0-only", (23,)),
    ("GPL-2.0-only", (24,)), ("CC-BY-4.0", (25,)), ("CC-BY-NC-4.0", (26,)), ("MPL-2.0", (27,)), ("Unlicense", (29,)), ("Proprietary", (30,)),
    *((name, (SPDX_FIRST + i,)) for i, name in enumerate(SPDX)), *((name, (k,)) for k, (name, _) in HEADINGS.items()),
]
#: Ends of sentences.
BREAK = r"[.!?;:]+[\x20\x09-\x0D]+|[.!?;:]*[\x0A\x0D]+|[.!?;:]+$"
#: Of these, the ends of sentences in wrapped text: not single line breaks, blank lines before a URL, 'v. 2', 'free software: you' and what an SPDX line names.
WRAPPED = r"(?!(?<=\bv)\.\s+[0-9]|(?<=\bfree software)[:;]\s+you\b|(?<=\bspdx-license-identifier):)[.!?;:]+[\x20\x09-\x0D]+|\r?\n[\x20\t#*/;-]*\r?\n(?![\s#*/;-]*https?:)"


def scan_licences(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """docs with a struct column: n_sentences (not empty in normal form), n_known, n_rules (matches), identifiers (known ones in order, gaps left out), licences (distinct, sorted, comma-joined).

    Null and empty texts have no sentences and no licences. Repeated rows each get their result; other columns pass through.
    """
    known = F.create_map(*(F.lit(x) for k, v in SENTENCES.items() for x in (v, str(k))))
    normal = lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    looked_up = lambda parts: F.transform(F.transform(parts, lambda s: F.struct(s.alias("raw"), normal(s).alias("plain"))), lambda x: F.struct(x["raw"], x["plain"], F.try_element_at(known, x["plain"]).alias("id")))
    # list markers count as sentences, but leave no gap
    sentence = lambda x: F.coalesce(x["id"], F.when(x["plain"].rlike("^([0-9]{1,2}|[a-z])$"), F.lit("")).otherwise(F.lit("0")))
    sentences = lambda s: F.transform(F.filter(looked_up(F.split(s, BREAK)), lambda x: x["plain"] != ""), sentence)
    by_line = lambda s: F.flatten(F.transform(looked_up(F.split(s, "[\\x0A\\x0D]+")), lambda x: F.when(x["id"].isNotNull(), F.array(x["id"])).otherwise(sentences(x["raw"]))))
    lines = lambda s: F.when(s.contains("spdx-license-identifier:"), by_line(s)).otherwise(sentences(s))
    pieces = looked_up(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), WRAPPED))
    ids = F.flatten(F.transform(pieces, lambda x: F.when(x["id"].isNotNull(), F.array(x["id"])).otherwise(lines(x["raw"]))))
    names = [free_name(docs, f"_{name}_{k}") for k in ("ids", "seq", "hits")]
    # identifiers stand between commas of their own, so that neighbouring matches share none: ,1,,2,,0,
    sequence = F.concat_ws("", F.transform(F.filter(names[0], lambda i: i != ""), lambda i: F.concat(F.lit(","), i, F.lit(","))))
    out = docs.withColumn(names[0], ids).withColumn(names[1], sequence)
    left, hits = F.col(names[1]), []
    for licence, rule in RULES:
        pattern = "".join(f",{i}," for i in rule)
        cut = F.replace(left, F.lit(pattern), F.lit("|"))
        hits.append((licence, cut, left, len(pattern)))
        left = cut
    # a match shortens the sequence by its pattern less one character
    found = F.array(*(F.struct(F.lit(n).alias("licence"), ((F.length(b) - F.length(a)) / F.lit(k - 1)).cast("long").alias("n")) for n, a, b, k in hits))
    some = F.col(names[1]).rlike("[1-9]")
    none = F.array().cast("array<struct<licence:string,n:bigint>>")
    out = out.withColumn(names[2], F.filter(F.when(some, found).otherwise(none), lambda x: x["n"] > 0))
    ids_known = F.filter(F.col(names[0]), lambda i: ~i.isin("0", ""))
    result = F.struct(
        F.size(F.col(names[0])).cast("long").alias("n_sentences"), F.size(ids_known).cast("long").alias("n_known"),
        F.aggregate(F.col(names[2]), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_rules"),
        F.array_join(ids_known, ",").alias("identifiers"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(F.col(names[2]), lambda x: x["licence"]))), ",").alias("licences"),
    )
    return out.withColumn(name, result).drop(*names)


def oracle(source: str = "documents") -> str:
    """The same in DuckDB SQL."""
    known = ", ".join(f"('{v}', '{k}')" for k, v in SENTENCES.items())
    steps, last = [], "seq"
    for i, (_, rule) in enumerate(RULES):
        pattern = "".join(f",{k}," for k in rule)
        steps.append(f"t{i + 1} AS (SELECT *, replace({last}, '{pattern}', '|') AS s{i + 1} FROM t{i})")
        last = f"s{i + 1}"
    counts, before = [], "seq"
    for i, (licence, rule) in enumerate(RULES):
        width = len("".join(f",{k}," for k in rule)) - 1
        counts.append(f"{{'l': '{licence}', 'n': CAST((length({before}) - length(s{i + 1})) / {width} AS BIGINT)}}")
        before = f"s{i + 1}"
    return f"""WITH RECURSIVE known(s, k) AS (VALUES {known}),
cut AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '[.!?;:]+[ \\t-\\r]+|[.!?;:]*[\\n\\r]+|[.!?;:]+$'), lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS p FROM {source}),
m AS (SELECT map(list(s), list(k)) AS m FROM known),
t0 AS (SELECT doc_id, list_transform(p, lambda s: coalesce(m[s], '0')) AS ids, list_aggregate(list_transform(p, lambda s: ',' || coalesce(m[s], '0') || ','), 'string_agg', '') AS q, coalesce(q, '') AS seq FROM cut, m),
{", ".join(steps)},
f AS (SELECT doc_id, ids, list_filter([{", ".join(counts)}], lambda x: x.n > 0) AS h FROM t{len(RULES)})
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, CAST(len(list_filter(ids, lambda i: i <> '0')) AS BIGINT) AS n_known, CAST(coalesce(list_sum(list_transform(h, lambda x: x.n)), 0) AS BIGINT) AS n_rules, array_to_string(list_filter(ids, lambda i: i <> '0'), ',') AS identifiers, array_to_string(list_sort(list_distinct(list_transform(h, lambda x: x.l))), ',') AS licences FROM f"""
