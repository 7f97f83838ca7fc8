"""Licence scans by sentence rules, with DataFrame functions alone.

A text is cut into sentences, at marks and at blank lines; single line breaks are spaces, so wrapped text, also behind
comment marks, stays whole. A normalised sentence may hold known licence sentences, at word borders, each with an
identifier. The identifiers of a document, in order, are then matched with rules: a licence is a sequence of identifiers
that follow each other with at most `gap` other sentences between two of them. At any place the longest rule counts, and
sentences that a rule has used start no other. All of it happens inside a row: nothing is joined or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.llm.common import LOWER, UPPER, ascii_lower, table, text_or_empty

# Sentences of public licences, as normalised (lower case, words apart by one space).
SENTENCES = {
    "apache-2.0-grant": "licensed under the apache license version 2 0",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license",
    "apache-2.0-comply": "you may not use this file except in compliance with the license",
    "apache-2.0-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-2.0-title": "apache license version 2 0 january 2004",
    "mit-name": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "mit license",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "cc-by-nc-4.0-name": "licensed under cc by nc 4 0",
    "cc-by-4.0-name": "licensed under cc by 4 0",
    "cc-by-sa-4.0-name": "licensed under cc by sa 4 0",
    "gpl-3.0-name": "this work is licensed under the gnu general public license version 3",
    "gpl-free-software": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-2.0-free-software": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl-2.1-free-software": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-3.0-free-software": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-3.0-free-software": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-3.0-title": "gnu general public license version 3 29 june 2007",
    "gpl-2.0-title": "gnu general public license version 2 june 1991",
    "lgpl-3.0-title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl-2.1-title": "gnu lesser general public license version 2 1 february 1999",
    "agpl-3.0-title": "gnu affero general public license version 3 19 november 2007",
    "gpl-no-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd-redistribute": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-permission": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-2.0-copy": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "mpl-2.0-title": "mozilla public license version 2 0",
    "epl-2.0-notice": "made available under the terms of the eclipse public license 2 0",
    "cc-by-4.0-long": "licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-4.0-long": "licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-4.0-long": "licensed under a creative commons attribution noncommercial 4 0 international license",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-permission": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
}
#: Rule, licence, identifiers in order.
RULES = (
    ("apache-2.0-notice", "Apache-2.0", ("apache-2.0-header", "apache-2.0-comply", "apache-2.0-as-is")),
    ("apache-2.0-short", "Apache-2.0", ("apache-2.0-grant", "apache-2.0-comply")),
    ("apache-2.0-name", "Apache-2.0", ("apache-2.0-grant",)),
    ("apache-2.0-header", "Apache-2.0", ("apache-2.0-header",)),
    ("apache-2.0-text", "Apache-2.0", ("apache-2.0-title",)),
    ("mit-text", "MIT", ("mit-title", "mit-permission", "mit-notice", "mit-as-is")),
    ("mit-untitled", "MIT", ("mit-permission", "mit-notice", "mit-as-is")),
    ("mit-name", "MIT", ("mit-name",)),
    ("mit-licensed", "MIT", ("mit-licensed",)),
    ("cc-by-nc-4.0-name", "CC-BY-NC-4.0", ("cc-by-nc-4.0-name",)),
    ("cc-by-4.0-name", "CC-BY-4.0", ("cc-by-4.0-name",)),
    ("cc-by-sa-4.0-name", "CC-BY-SA-4.0", ("cc-by-sa-4.0-name",)),
    ("gpl-3.0-name", "GPL-3.0-only", ("gpl-3.0-name",)),
    ("gpl-3.0-notice", "GPL-3.0-or-later", ("gpl-free-software", "gpl-no-warranty")),
    ("gpl-2.0-notice", "GPL-2.0-or-later", ("gpl-2.0-free-software", "gpl-no-warranty")),
    ("lgpl-2.1-notice", "LGPL-2.1-or-later", ("lgpl-2.1-free-software",)),
    ("lgpl-3.0-notice", "LGPL-3.0-or-later", ("lgpl-3.0-free-software",)),
    ("agpl-3.0-notice", "AGPL-3.0-or-later", ("agpl-3.0-free-software",)),
    ("gpl-3.0-text", "GPL-3.0", ("gpl-3.0-title",)),
    ("gpl-2.0-text", "GPL-2.0", ("gpl-2.0-title",)),
    ("lgpl-3.0-text", "LGPL-3.0", ("lgpl-3.0-title",)),
    ("lgpl-2.1-text", "LGPL-2.1", ("lgpl-2.1-title",)),
    ("agpl-3.0-text", "AGPL-3.0", ("agpl-3.0-title",)),
    ("bsd-3-clause-text", "BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("bsd-2-clause-text", "BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("bsd", "BSD", ("bsd-redistribute",)),
    ("isc-text", "ISC", ("isc-permission", "isc-as-is")),
    ("isc", "ISC", ("isc-permission",)),
    ("mpl-2.0-notice", "MPL-2.0", ("mpl-2.0-notice", "mpl-2.0-copy")),
    ("mpl-2.0-text", "MPL-2.0", ("mpl-2.0-title",)),
    ("epl-2.0-notice", "EPL-2.0", ("epl-2.0-notice",)),
    ("cc-by-4.0-long", "CC-BY-4.0", ("cc-by-4.0-long",)),
    ("cc-by-sa-4.0-long", "CC-BY-SA-4.0", ("cc-by-sa-4.0-long",)),
    ("cc-by-nc-4.0-long", "CC-BY-NC-4.0", ("cc-by-nc-4.0-long",)),
    ("unlicense", "Unlicense", ("unlicense-domain",)),
    ("zlib", "Zlib", ("zlib-as-is", "zlib-permission")),
)
#: A sentence ends at a mark with white space after it, or at a blank line, which may hold comment marks.
_ENDS = "[.!?]+[ \\t\\r\\n]+|\\r?\\n[ \\t*#/;%>-]*\\r?\\n"
_OTHER = "[^a-z0-9]+"
#: Every known sentence holds one of these.
_HINT = "licen|permi|software|redistribution|warrant|\\bmpl\\b"


def _hits(text: Column) -> Column:
    """Array of n (sentence, from 0), place (in the sentence), size, sentence_id, in their order."""
    known = F.array(*(F.struct(F.lit(k).alias("sentence_id"), F.lit(f" {v} ").alias("words")) for k, v in SENTENCES.items()))  # a fixed table
    sentences = F.transform(F.split(text, _ENDS), lambda s, n: F.struct(n.alias("n"), F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(s), _OTHER, " ")), F.lit(" ")).alias("words")))

    def of_one(s: Column) -> Column:
        places = F.transform(known, lambda k: F.struct(s["n"].alias("n"), F.instr(s["words"], k["words"]).alias("place"), F.length(k["words"]).alias("size"), k["sentence_id"].alias("sentence_id")))
        found = F.filter(places, lambda h: h["place"] > 0)
        within = lambda h, o: (o["size"] > h["size"]) & (o["place"] <= h["place"]) & (o["place"] + o["size"] >= h["place"] + h["size"])
        return F.filter(found, lambda h: ~F.exists(found, lambda o: within(h, o)))

    return F.array_sort(F.flatten(F.transform(F.filter(sentences, lambda s: s["words"].rlike(_HINT)), of_one)))


def licences(docs: DataFrame, gap: int = 2) -> DataFrame:
    """doc_id, start (sentence), n_sentences (known ones of the rule), rule_id, licence: a row for each match.

    Null and empty texts hold no licence; repeated rows give their matches each; ties between rules of equal length go to
    the rule_id that sorts first. A known sentence counts once in a sentence of the text, at its first place there, and not
    where it is part of a longer known one. Other columns are not read.
    """
    listed = docs.where(F.col("text").rlike(f"(?i){_HINT}")).select("doc_id", _hits(text_or_empty("text")).alias("hits"))
    rules = sorted(RULES, key=lambda r: (-len(r[2]), r[0]))
    literal = F.array(*(F.struct(F.lit(r).alias("rule_id"), F.lit(x).alias("licence"), F.array(*map(F.lit, ids)).alias("ids")) for r, x, ids in rules))
    close = lambda i, k: F.forall(F.sequence(F.lit(1), k), lambda j: (j == k) | (F.col("hits")[i + j]["n"] - F.col("hits")[i + j - 1]["n"] <= gap + 1))

    def best(i: Column) -> Column:
        fits = lambda r: (F.transform(F.slice(F.col("hits"), i + 1, F.size(r["ids"])), lambda h: h["sentence_id"]) == r["ids"]) & close(i, F.size(r["ids"]))
        return F.get(F.filter(literal, fits), 0)

    found = listed.withColumn("at", F.transform("hits", lambda _, i: best(i)))
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("starts"))
    size = lambda i: F.size(F.col("at")[i]["ids"])
    step = lambda a, i: F.when((i >= a["next"]) & F.col("at")[i].isNotNull(), F.struct((i + size(i)).alias("next"), F.concat(a["starts"], F.array(i)).alias("starts"))).otherwise(a)
    used = F.aggregate(F.transform("hits", lambda _, i: i), start, step)["starts"]
    rows = found.withColumn("i", F.explode_outer(used)).where("i IS NOT NULL")  # outer: else Spark filters on the hits first, and finds them twice
    return rows.select("doc_id", F.col("hits")[F.col("i")]["n"].alias("start"), size(F.col("i")).alias("n_sentences"), F.col("at")[F.col("i")]["rule_id"].alias("rule_id"), F.col("at")[F.col("i")]["licence"].alias("licence"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))


_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in SENTENCES.items())
_RULES = ", ".join(f"('{r}', '{x}', {len(ids)}, [{', '.join(repr(i) for i in ids)}])" for r, x, ids in RULES)
OP9_SQL = f"""
WITH RECURSIVE known(sentence_id, sentence) AS (VALUES {_VALUES}),
rules(rule_id, licence, size, ids) AS (VALUES {_RULES}),
lines AS (SELECT doc_id, n, ' ' || trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')) || ' ' AS s FROM (
  SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS n FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?]+[ \\t\\r\\n]+|\\r?\\n[ \\t*#/;%>-]*\\r?\\n') AS s FROM documents WHERE text IS NOT NULL))),
places AS (SELECT doc_id, n, sentence_id, instr(s, ' ' || sentence || ' ') AS place, length(sentence) AS size FROM lines JOIN known ON contains(s, ' ' || sentence || ' ')),
hits AS (SELECT doc_id, n, sentence_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, place) AS k FROM places p
  WHERE NOT EXISTS (SELECT 1 FROM places o WHERE o.doc_id = p.doc_id AND o.n = p.n AND o.size > p.size AND o.place <= p.place AND o.place + o.size >= p.place + p.size)),
chains AS (
  SELECT h.doc_id, h.k, h.n AS start, h.n, r.rule_id, r.licence, r.size, r.ids, 1 AS got FROM hits h JOIN rules r ON r.ids[1] = h.sentence_id
  UNION ALL
  SELECT c.doc_id, c.k, c.start, h.n, c.rule_id, c.licence, c.size, c.ids, c.got + 1 FROM chains c JOIN hits h ON h.doc_id = c.doc_id AND h.k = c.k + c.got AND h.sentence_id = c.ids[c.got + 1] AND h.n - c.n <= 3 WHERE c.got < c.size),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY size DESC, rule_id) AS nth FROM chains WHERE got = size) WHERE nth = 1),
walk AS (
  SELECT doc_id, min(k) AS k FROM best GROUP BY doc_id
  UNION ALL
  SELECT w.doc_id, (SELECT min(b2.k) FROM best b2 WHERE b2.doc_id = w.doc_id AND b2.k >= w.k + b.size) FROM walk w JOIN best b ON b.doc_id = w.doc_id AND b.k = w.k WHERE w.k IS NOT NULL)
SELECT b.doc_id, b.start::INTEGER AS start, b.size::INTEGER AS n_sentences, b.rule_id, b.licence FROM walk w JOIN best b ON b.doc_id = w.doc_id AND b.k = w.k
"""
