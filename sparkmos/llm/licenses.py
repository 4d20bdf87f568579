"""License recognition by sentence rules, in columns only.

A text is normalised (A-Z to lower case, every run of other characters than letters and
digits to one space) and known license sentences are found in it, in order, the longest that
fits first. Each has an identifier; the text becomes the sequence of its identifiers. Ordered
rules then name the licenses: a rule is a sequence of identifiers that must stand side by
side; the first rules name whole license texts, the later ones single references. What a rule
has matched is taken out before the next one is tried, so the sentences of a full text are not
counted again as references. Identifiers that no rule has taken are left as unmatched.

Edge cases: null and empty texts have no sentences and no licenses. Sentences may be wrapped
over lines and spaced at will, and stand inside other text, but a changed word makes another
sentence. Repeated licenses are named once per rule.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmos.llm.frames import without

# Sentences of public license texts and notices, with identifiers of our own.
SENTENCES = {
    "apache2_ref": ["Licensed under the Apache License, Version 2.0"],
    "apache2_comply": ["you may not use this file except in compliance with the License."],
    "apache2_obtain": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "apache2_asis": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ],
    "apache2_see": ["See the License for the specific language governing permissions and limitations under the License."],
    "mit_ref": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License"],
    "mit_permission": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ],
    "mit_notice": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ],
    "mit_asis": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND'],
    "bsd_ref": ["Licensed under the BSD License", "Use of this source code is governed by a BSD-style license"],
    "bsd_conditions": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ],
    "bsd_source": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ],
    "bsd_binary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution."
    ],
    "bsd_endorse": ["may be used to endorse or promote products derived from this software without specific prior written permission."],
    "gpl3_ref": [
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License v3.0",
    ],
    "gpl2_ref": ["Licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License v2.0"],
    "gpl_free": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation,"
    ],
    "gpl3_later": ["either version 3 of the License, or (at your option) any later version."],
    "gpl2_later": ["either version 2 of the License, or (at your option) any later version."],
    "lgpl_ref": ["Licensed under the GNU Lesser General Public License"],
    "mpl2_ref": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "isc_permission": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    ],
    "cc_by_ref": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc_by_sa_ref": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc_by_nc_ref": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0_ref": ["Licensed under CC0 1.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "all_rights": ["All rights reserved"],
}

# Rules in the order they are tried.
RULES = [
    ("Apache-2.0", ["apache2_ref", "apache2_comply", "apache2_obtain", "apache2_asis", "apache2_see"]),
    ("MIT", ["mit_permission", "mit_notice", "mit_asis"]),
    ("BSD-3-Clause", ["bsd_conditions", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_conditions", "bsd_source", "bsd_binary"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl3_later"]),
    ("GPL-2.0-or-later", ["gpl_free", "gpl2_later"]),
    ("ISC", ["isc_permission"]),
    ("Apache-2.0", ["apache2_ref"]),
    ("MIT", ["mit_ref"]),
    ("BSD", ["bsd_ref"]),
    ("GPL-3.0", ["gpl3_ref"]),
    ("GPL-2.0", ["gpl2_ref"]),
    ("LGPL", ["lgpl_ref"]),
    ("MPL-2.0", ["mpl2_ref"]),
    ("CC-BY-4.0", ["cc_by_ref"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_ref"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_ref"]),
    ("CC0-1.0", ["cc0_ref"]),
    ("Unlicense", ["unlicense"]),
]

#: Every known sentence has one of these; other texts are not normalised at all.
KEYWORDS = ["licen", "permi", "redistribut", "warrant", "free software", "unencumbered", "reserved", "endorse", "option"]


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


KNOWN = {normal(s): name for name, found in SENTENCES.items() for s in found}
PATTERN = r"\b(" + "|".join(sorted(KNOWN, key=lambda s: (-len(s), s))) + r")\b"
# Words of a text may be wrapped anywhere: white space inside a keyword of two words.
HINT = "(?i)" + "|".join(k.replace(" ", r"\s+") for k in KEYWORDS)


def _token(names: list[str]) -> str:
    return "".join(f"<{n}>" for n in names)


def recognise(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with sentence_ids, licenses (arrays, in order) and unmatched (number of identifiers).

    No shuffle; only built-in functions.
    """
    body = df[f"`{text}`"]
    folded = F.regexp_replace(F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " ")
    found = F.when(body.rlike(HINT), F.regexp_extract_all(folded, F.lit(PATTERN), F.lit(1)))
    known = F.create_map(*[F.lit(x) for pair in sorted(KNOWN.items()) for x in pair])
    none = F.array().cast("array<string>")
    ids = F.coalesce(F.transform(found, lambda s: F.element_at(known, s)), none)
    out = without(df, ["sentence_ids", "licenses", "unmatched"]).withColumn("sentence_ids", ids)

    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_token(ids_)).alias("ids")) for name, ids_ in RULES])
    start = F.struct(F.concat_ws("", F.transform("sentence_ids", lambda x: F.concat(F.lit("<"), x, F.lit(">")))).alias("left"), none.alias("named"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["ids"])
        return F.struct(
            F.when(hit, F.replace(state["left"], rule["ids"], F.lit("#"))).otherwise(state["left"]).alias("left"),
            F.when(hit, F.array_append(state["named"], rule["name"])).otherwise(state["named"]).alias("named"),
        )

    done = F.when(F.size("sentence_ids") > 0, F.aggregate(rules, start, step))
    out = out.withColumn("__done", done)
    return out.select(
        *[F.col(f"`{c}`") for c in out.columns if c != "__done"],
        F.coalesce("__done.named", none).alias("licenses"),
        F.coalesce(F.length("__done.left") - F.length(F.replace(F.col("__done.left"), F.lit("<"), F.lit(""))), F.lit(0)).cast("long").alias("unmatched"),
    )


def oracle(table: str = "documents") -> str:
    """The same over ``table`` (doc_id, text) as SQL: sequences and names joined by commas."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    keys, names = zip(*sorted(KNOWN.items()))
    steps = []
    for i, (name, ids) in enumerate(RULES):
        token = quoted(_token(list(ids)))
        steps.append(
            f"s{i + 1} AS (SELECT doc_id, ids, replace(left_, {token}, '#') AS left_, "
            f"named || CASE WHEN contains(left_, {token}) THEN {quoted(',' + name)} ELSE '' END AS named FROM s{i})"
        )
    return f"""
WITH n AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^a-z0-9]+', ' ', 'g'), {quoted(PATTERN)}, 1) AS found FROM {table}),
k AS (SELECT map([{', '.join(map(quoted, keys))}], [{', '.join(map(quoted, names))}]) AS known),
s0 AS (
  SELECT doc_id, ids, coalesce(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), '') AS left_, '' AS named
  FROM (SELECT doc_id, list_transform(found, lambda x: known[x]) AS ids FROM n, k)),
{', '.join(steps)}
SELECT doc_id, coalesce(array_to_string(ids, ','), '') AS sentence_ids, ltrim(named, ',') AS licenses,
  CAST(length(left_) - length(replace(left_, '<', '')) AS BIGINT) AS unmatched
FROM s{len(RULES)}
"""
