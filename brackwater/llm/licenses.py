"""Licence scan by sentence rules.

A text is normalised: lower case, runs of anything but a-z and 0-9 (comment markers with them) become one separator. A run
with a blank line, or with white space after ``. ! ?``, ends a sentence; one with a line end, ``;`` or a bracket may end it or
lie within it, so sentences wrapped over lines are found, and those that a list or a bracket follows. Known licence
sentences between two ends are looked up, from left to right, longer ones first. The identifiers found form a sequence;
a rule names an ordered list of identifiers, which must occur in that order with at most ``MAX_GAP`` other known sentences
between two of them. Rules are tried in order, and a rule that a longer matching rule includes is not reported; ``RESERVED`` is
reported only where no licence is. Several wordings may share an identifier (``VARIANTS``, built from verbs and names).

All of it is one projection over the scan: no shuffle, no Python. The known sentences are a literal of fixed size.
Null and empty texts have no sentences. Repeated rows give repeated results; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Known sentences, normalised. The notices that the licences themselves ask for.
SENTENCES = {
    1: "licensed under the apache license version 2 0",
    2: "you may not use this file except in compliance with the license",
    3: "you may obtain a copy of the license at",
    4: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    5: "released under the mit license",
    6: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    7: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    8: "licensed under cc by nc 4 0",
    9: "licensed under cc by 4 0",
    10: "licensed under cc by sa 4 0",
    11: "this work is licensed under the gnu general public license version 3",
    12: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    13: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    14: "you should have received a copy of the gnu general public license along with this program",
    15: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    16: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    17: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    18: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    19: "all rights reserved",
    20: "licensed under the mit license",
    21: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    22: "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    23: "this source code form is subject to the terms of the mozilla public license v",
    24: "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    25: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    26: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    27: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    28: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    29: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    30: "this is free and unencumbered software released into the public domain",
    31: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    32: "use of this source code is governed by a bsd style license that can be found in the license file",
    33: "see the license for the specific language governing permissions and limitations under the license",
    34: "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    35: "the author disclaims copyright to this source code",
    36: "licensed under the eclipse public license 2 0",
    37: "licensed under cc0 1 0",
    38: "licensed under the boost software license version 1 0",
    39: "licensed under the mozilla public license 2 0",
    40: "licensed under the gnu lesser general public license version 3",
    41: "licensed under the gnu affero general public license version 3",
    42: "licensed under the gnu general public license version 2",
    43: "licensed under the bsd 3 clause license",
    44: "licensed under the bsd 2 clause license",
    45: "licensed under the isc license",
    46: "licensed under cc by nd 4 0",
    47: "licensed under cc by nc sa 4 0",
}

#: Names of what is licensed under, by the identifier of the sentence that says so; fixed values.
NAMES = {
    1: ("the apache license version 2 0", "the apache license 2 0", "apache 2 0", "apache license 2 0"),
    20: ("the mit license", "mit", "mit license"),
    8: ("cc by nc 4 0", "a creative commons attribution noncommercial 4 0 international license"),
    9: ("cc by 4 0", "a creative commons attribution 4 0 international license"),
    10: ("cc by sa 4 0", "a creative commons attribution sharealike 4 0 international license"),
    46: ("cc by nd 4 0", "a creative commons attribution noderivatives 4 0 international license"),
    47: ("cc by nc sa 4 0", "a creative commons attribution noncommercial sharealike 4 0 international license"),
    11: ("the gnu general public license version 3", "the gnu gpl v3", "gpl 3 0 only", "gpl 3 0 or later"),
    36: ("the eclipse public license 2 0", "epl 2 0"),
    37: ("cc0 1 0", "cc0 1 0 universal"),
    38: ("the boost software license version 1 0", "bsl 1 0"),
    39: ("the mozilla public license 2 0", "the mozilla public license version 2 0", "mpl 2 0"),
    40: ("the gnu lesser general public license version 3", "lgpl 3 0 only", "lgpl 3 0 or later"),
    41: ("the gnu affero general public license version 3", "agpl 3 0 only", "agpl 3 0 or later"),
    42: ("the gnu general public license version 2", "gpl 2 0 only", "gpl 2 0 or later"),
    43: ("the bsd 3 clause license", "bsd 3 clause"),
    44: ("the bsd 2 clause license", "bsd 2 clause"),
    45: ("the isc license", "isc"),
}
VERBS = ("licensed under", "released under", "distributed under", "this work is licensed under", "this project is licensed under", "this software is licensed under", "spdx license identifier")

#: Identifier of every known wording.
VARIANTS = {v: k for k, v in SENTENCES.items()}
for _id, _names in NAMES.items():
    for _name in _names:
        for _verb in VERBS:
            VARIANTS.setdefault(f"{_verb} {_name}", _id)
VARIANTS |= {SENTENCES[24].replace("https", "http"): 24, SENTENCES[18].replace("the copyright holder", "the author"): 18, SENTENCES[28].replace("program", "software"): 28, SENTENCES[14].replace("this program", "this library"): 14}

#: (licence, ordered sentence identifiers), longer rules of a licence before the shorter ones they include.
RULES = (
    ("Apache-2.0:notice", (1, 2, 3, 4)),
    ("Apache-2.0", (1,)),
    ("MIT:text", (6, 7)),
    ("MIT", (5,)),
    ("MIT", (20,)),
    ("CC-BY-NC-4.0", (8,)),
    ("CC-BY-4.0", (9,)),
    ("CC-BY-SA-4.0", (10,)),
    ("GPL-3.0:notice", (12, 13, 14)),
    ("GPL-3.0", (11,)),
    ("GPL-3.0-or-later", (12,)),
    ("BSD-3-Clause", (15, 16, 17, 18)),
    ("BSD-2-Clause", (15, 16, 17)),
    ("MIT", (6,)),
    ("BSD-3-Clause", (43,)),
    ("BSD-2-Clause", (44,)),
    ("BSD", (32,)),
    ("MPL-2.0:notice", (23, 24)),
    ("MPL-2.0", (39,)),
    ("GPL-2.0-or-later", (25,)),
    ("GPL-2.0", (42,)),
    ("LGPL-2.1-or-later", (26,)),
    ("LGPL-3.0-or-later", (27,)),
    ("LGPL-3.0", (40,)),
    ("AGPL-3.0-or-later", (28,)),
    ("AGPL-3.0", (41,)),
    ("ISC", (29,)),
    ("ISC", (45,)),
    ("Unlicense", (30,)),
    ("Zlib", (31,)),
    ("EPL-2.0", (36,)),
    ("CC0-1.0", (37,)),
    ("BSL-1.0", (38,)),
    ("CC-BY-ND-4.0", (46,)),
    ("CC-BY-NC-SA-4.0", (47,)),
    ("public-domain", (35,)),
)
#: What a text without any licence says of itself, and the sentence that says it.
RESERVED = ("proprietary", 19)
MAX_GAP = 2


def sentence_pattern(wordings: dict[str, int]) -> str:
    """Any of the wordings between two ends, over places that may be ends; longer ones first."""
    return f"(?<=[HS])(?:{'|'.join(x.replace(' ', '[ S]') for x in sorted(wordings, key=len, reverse=True))})(?=[HS])"


def separated(text: Column) -> Column:
    """``text`` normalised: H where a sentence ends, S where it may end, a space between other words."""
    # Each expression starts where a run of separators does, which keeps long runs linear.
    hard = F.regexp_replace(F.lower(text), r"(?<![^a-z0-9])[^a-z0-9]*?(?:[.!?]\s|\n[^a-z0-9\n]*+\n)[^a-z0-9]*+", "H")
    soft = F.regexp_replace(hard, r"(?<![^a-z0-9H])[^a-z0-9H]*?[\n;()][^a-z0-9H]*+", "S")
    return F.concat(F.lit("H"), F.trim(F.regexp_replace(soft, "[^a-z0-9HS]++", " ")), F.lit("H"))


def sentence_ids(text: Column, wordings: dict[str, int] = VARIANTS) -> Column:
    """Identifiers of the known sentences of ``text``, in order; repeats stay."""
    known = F.create_map(*[x for k, v in wordings.items() for x in (F.lit(k), F.lit(v))])
    # Every wording has its longest word; the cheap test spares the texts without one the rest.
    maybe = F.lower(text).rlike("|".join(sorted({max(v.split(), key=len) for v in wordings})))
    found = F.regexp_extract_all(separated(text), F.lit(sentence_pattern(wordings)), F.lit(0))
    return F.when(maybe, F.transform(found, lambda s: known[F.translate(s, "S", " ")])).otherwise(F.array().cast("array<int>"))


def rule_pattern(ids: tuple[int, ...], max_gap: int = MAX_GAP) -> str:
    return "," + f"([0-9]+,){{0,{max_gap}}}".join(f"{i}," for i in ids)


def included(rule: tuple[int, ...], longer: tuple[int, ...]) -> bool:
    """Whether ``rule`` is an ordered part of ``longer``."""
    rest = iter(longer)
    return len(rule) < len(longer) and all(i in rest for i in rule)


def scan(docs: DataFrame, rules: tuple = RULES, wordings: dict[str, int] = VARIANTS, max_gap: int = MAX_GAP, reserved: tuple[str, int] = RESERVED) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses): both lists comma-joined, licences in rule order without repeats."""
    found = docs.select("doc_id", sentence_ids(common.text_of(), wordings).alias("ids"))
    joined = found.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"))
    hit = {k: F.concat(F.lit(","), "sentence_ids", F.lit(",")).rlike(rule_pattern(ids, max_gap)) for k, (_, ids) in enumerate(rules)}
    names = []
    for k, (name, ids) in enumerate(rules):
        wider = [j for j, (_, other) in enumerate(rules) if included(ids, other)]
        says = hit[k]
        for j in wider:
            says = says & ~hit[j]
        names.append(F.when(says, F.lit(name)))
    named = F.array_join(F.array_distinct(F.array_compact(F.array(*names))), ",")
    kept = F.concat(F.lit(","), "sentence_ids", F.lit(",")).contains(f",{reserved[1]},")
    return joined.withColumn("licenses", named).withColumn("licenses", F.when((F.col("licenses") == "") & kept, F.lit(reserved[0])).otherwise(F.col("licenses")))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    known = ", ".join(f"({k}, '{v}')" for v, k in VARIANTS.items())
    cases = []
    for name, ids in RULES:
        wider = [other for _, other in RULES if included(ids, other)]
        test = lambda x: f"regexp_matches(',' || sentence_ids || ',', '{rule_pattern(x)}')"
        cases.append(f"CASE WHEN {' AND '.join([test(ids), *(f'NOT {test(x)}' for x in wider)])} THEN '{name}' END")
    rows = ", ".join(f"({k}, {c})" for k, c in enumerate(cases))
    return rf"""
WITH known(id, sentence) AS (VALUES {known}),
cut AS (
  SELECT rowid_, doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS pos FROM (
    SELECT row_number() OVER () AS rowid_, doc_id,
           string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+') AS parts FROM documents)),
hits AS (
  SELECT rowid_, any_value(doc_id) AS doc_id, count(id)::BIGINT AS n_sentences, coalesce(string_agg(id::VARCHAR, ',' ORDER BY pos), '') AS sentence_ids
  FROM cut LEFT JOIN known ON trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) = sentence GROUP BY rowid_)
SELECT doc_id, n_sentences, sentence_ids,
  coalesce((SELECT string_agg(l, ',' ORDER BY k) FROM (SELECT l, min(k) AS k FROM (VALUES {rows}) r(k, l) WHERE l IS NOT NULL GROUP BY l)),
           CASE WHEN contains(',' || sentence_ids || ',', ',{RESERVED[1]},') THEN '{RESERVED[0]}' ELSE '' END) AS licenses
FROM hits
"""


OP1_SQL = _sql()
