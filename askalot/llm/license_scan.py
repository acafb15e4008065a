"""Licence scan by sentence rules, row by row, in DataFrame functions only.

A text is normalised and cut into segments at sentence and line ends. Segments that follow each other within a paragraph, up to
``LONGEST``, are joined (wrapped text, "free software: you can") and the sentence that results is looked up among the known licence sentences: as it is, by the name of a licence in a
notice, or with a slot for what varies, such as the holder's name. From one segment on, the longest known sentence counts, or else the shortest with a slot; one that begins inside
an earlier one doesn't count. The identifiers found, in text order, are then matched
against an ordered list of rules. A rule names the identifiers that must follow
each other (other sentences may stand between them); what a rule has matched is
used up, so the full licence text wins over the one-line notice inside it.

There is no shuffle: the plan is scan -> project, whatever the table's size.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import let
from .common import table

# Known licence sentences, normalised (see ``normalise``).
SENTENCES: list[tuple[str, str]] = [
    ("mit_title", "the mit license"),
    ("mit_title", "mit license"),
    ("mit_grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit_keep", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as_is_caps", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache_title", "apache license version 2.0"),
    ("apache_comply", "you may not use this file except in compliance with the license"),
    ("apache_copy", "you may obtain a copy of the license at"),
    ("apache_as_is", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl_free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl2_free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl21_free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version"),
    ("lgpl3_free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl3_free", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("isc_grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("gpl_hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl_details", "see the gnu general public license for more details"),
    ("bsd_permit", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd_source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd_binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("mpl_notice", "this source code form is subject to the terms of the mozilla public license v. 2.0"),
    ("all_rights", "all rights reserved"),
]

# Licences by the names that notices use, and by their SPDX identifiers, normalised; with what a notice of each is called.
NAMES: list[tuple[str, str, list[str]]] = [
    ("mit_notice", "MIT", ["mit license", "mit"]),
    ("apache_notice", "Apache-2.0", ["apache license version 2.0", "apache license 2.0", "apache 2.0 license", "apache 2.0"]),
    ("gpl3_notice", "GPL-3.0-only", ["gnu general public license version 3", "gnu general public license v3.0", "gpl version 3", "gplv3", "gpl 3.0", "gpl 3.0 only"]),
    ("gpl3_later_notice", "GPL-3.0-or-later", ["gpl 3.0 or later"]),
    ("gpl2_notice", "GPL-2.0-only", ["gnu general public license version 2", "gnu general public license v2.0", "gpl version 2", "gplv2", "gpl 2.0", "gpl 2.0 only"]),
    ("gpl2_later_notice", "GPL-2.0-or-later", ["gpl 2.0 or later"]),
    ("lgpl3_notice", "LGPL-3.0-only", ["gnu lesser general public license version 3", "lgpl 3.0", "lgpl 3.0 only"]),
    ("lgpl21_notice", "LGPL-2.1-only", ["gnu lesser general public license version 2.1", "lgpl 2.1", "lgpl 2.1 only"]),
    ("lgpl21_later_notice", "LGPL-2.1-or-later", ["lgpl 2.1 or later"]),
    ("agpl3_notice", "AGPL-3.0-only", ["gnu affero general public license version 3", "agpl 3.0", "agpl 3.0 only"]),
    ("agpl3_later_notice", "AGPL-3.0-or-later", ["agpl 3.0 or later"]),
    ("bsd3_notice", "BSD-3-Clause", ["bsd 3 clause license", "3 clause bsd license", "bsd 3 clause"]),
    ("bsd2_notice", "BSD-2-Clause", ["bsd 2 clause license", "2 clause bsd license", "bsd 2 clause"]),
    ("bsd_notice", "BSD", ["bsd license"]),
    ("isc_notice", "ISC", ["isc license", "isc"]),
    ("mpl_notice", "MPL-2.0", ["mozilla public license version 2.0", "mozilla public license 2.0", "mpl 2.0"]),
    ("unlicense_notice", "Unlicense", ["unlicense"]),
    ("ccbync_notice", "CC-BY-NC-4.0", ["creative commons attribution noncommercial 4.0 international license", "cc by nc 4.0"]),
    ("ccbysa_notice", "CC-BY-SA-4.0", ["creative commons attribution sharealike 4.0 international license", "cc by sa 4.0"]),
    ("ccby_notice", "CC-BY-4.0", ["creative commons attribution 4.0 international license", "cc by 4.0"]),
    ("cc0_notice", "CC0-1.0", ["cc0 1.0"]),
]
NOTICE = (
    "^(?:this [a-z]+ is |the [a-z]+ is |it is )?(?:spdx license identifier|(?:licensed|released|distributed|available|published) under)(?: the| a)?(?: terms of the)? "
    f"({'|'.join(sorted((n for _, _, own in NAMES for n in own), key=lambda n: (-len(n), n)))})(?: the license)?(?: see .*)?$"
).replace(".0", "[.]0").replace(".1", "[.]1")

# Sentences with a slot, the surest first.
SLOTS: list[tuple[str, str]] = [
    ("bsd_name", "^neither the name .{1,200} (?:may|can) be used to endorse or promote products derived from this software without (?:specific )?prior written permission(?: .{0,60})?$"),
    ("bsd_name", "^the names? .{1,200} (?:may|must) not be used to endorse or promote products derived from this software without (?:specific )?prior written permission(?: .{0,60})?$"),
    ("bsd_other", "^(?:neither|the names?|all advertising materials|nor) .*(?:endorse|promote products|acknowledge?ment).*$"),
]

# Ordered licence rules, the longest evidence first.
RULES: list[tuple[str, str, list[str]]] = [
    ("mit_full", "MIT", ["mit_grant", "mit_keep", "as_is_caps"]),
    ("mit_grant_keep", "MIT", ["mit_grant", "mit_keep"]),
    ("apache_header", "Apache-2.0", ["apache_notice", "apache_comply", "apache_copy", "apache_as_is"]),
    ("apache_short_header", "Apache-2.0", ["apache_notice", "apache_comply"]),
    ("gpl3_header", "GPL-3.0-or-later", ["gpl_free", "gpl_hope", "gpl_details"]),
    ("gpl3_free", "GPL-3.0-or-later", ["gpl_free"]),
    ("gpl2_header", "GPL-2.0-or-later", ["gpl2_free", "gpl_hope", "gpl_details"]),
    ("gpl2_free", "GPL-2.0-or-later", ["gpl2_free"]),
    ("lgpl21_free", "LGPL-2.1-or-later", ["lgpl21_free"]),
    ("lgpl3_free", "LGPL-3.0-or-later", ["lgpl3_free"]),
    ("agpl3_free", "AGPL-3.0-or-later", ["agpl3_free"]),
    ("bsd3_full", "BSD-3-Clause", ["bsd_permit", "bsd_source", "bsd_binary", "bsd_name"]),
    ("bsd_unknown", "BSD", ["bsd_permit", "bsd_source", "bsd_binary", "bsd_other"]),
    ("bsd2_full", "BSD-2-Clause", ["bsd_permit", "bsd_source", "bsd_binary"]),
    ("isc_grant", "ISC", ["isc_grant"]),
    ("unlicense", "Unlicense", ["unlicense"]),
    ("mit_grant", "MIT", ["mit_grant"]),
    *((name, licence, [name]) for name, licence, _ in NAMES[:1]),
    ("mit_title", "MIT", ["mit_title"]),
    *((name, licence, [name]) for name, licence, _ in NAMES[1:2]),
    ("apache_title", "Apache-2.0", ["apache_title"]),
    *((name, licence, [name]) for name, licence, _ in NAMES[2:]),
    ("all_rights", "Proprietary", ["all_rights"]),
]

#: Every known sentence holds one of these words, wherever its lines break; texts without one aren't looked at.
WORDS = "(?i)licens|copyright|permission|redistribut|warrant|rights|gnu|public domain|endorse"
#: Marks of the ends of sentences, lines and paragraphs.
SENTENCE, LINE, PARAGRAPH = "\x01", "\x02", "\x03"
#: Segments that one sentence may be cut into: the longest known one at some 25 characters a line.
LONGEST = 18
STEPS: list[tuple[str, str]] = [
    (r"[.;:!?]+(\s|$)", SENTENCE + r"\1"),
    (f"[^a-z0-9.\n{SENTENCE}]+", " "),
    ("[ .]{3,}", " . "),  # so that the next steps take time in proportion to the text
    (f"[ .]*([\n{SENTENCE}])[ .]*", r"\1"),
    (f"{SENTENCE}*\n{SENTENCE}*\n[\n{SENTENCE}]*", PARAGRAPH),
    (f"{SENTENCE}*\n{SENTENCE}*", LINE),
    (f"{SENTENCE}+", SENTENCE),
    (PARAGRAPH, f"{LINE}{LINE}"),  # an empty segment, which no sentence has
    (f"([{SENTENCE}{LINE}])(?:[0-9]{{1,2}}|[b-hj-z]) ", r"\1"),  # numbers of clauses
]


def known_sentences() -> dict[str, str]:
    """Identifiers by sentence; a sentence end inside ("v. 2.0") is a space there."""
    return {s.replace(". ", " "): name for name, s in SENTENCES}


def first_words() -> list[str]:
    """Words that a sentence can begin with."""
    notices = "this the it spdx licensed released distributed available published neither nor all"
    return sorted({*(s.split()[0] for s in known_sentences()), *notices.split()})


def segments(text: Column) -> Column:
    """ASCII lower case; runs of other than a-z 0-9 . become one space; cut at ends of sentences and lines, between paragraphs an empty segment."""
    t = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\x01\x02\x03", "abcdefghijklmnopqrstuvwxyz   ")
    t = F.concat(F.lit("\n"), t)
    for pattern, by in STEPS:
        t = F.regexp_replace(t, pattern, by.replace(r"\1", "$1"))
    return F.transform(F.split(t, f"[{SENTENCE}{LINE}]"), lambda s: F.trim(s, F.lit(" .")))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known licence sentences of a text, in order (array of string; empty for null)."""
    known = F.from_json(F.lit(json.dumps(known_sentences())), "map<string,string>")
    names = F.from_json(F.lit(json.dumps({n: name for name, _, own in NAMES for n in own})), "map<string,string>")
    starts = F.array(*map(F.lit, first_words()))
    none = F.array().cast("array<string>")

    def hit(joined: Column) -> Column:
        """Of the sentences from one segment on, the shortest first: how many segments the best has, and its identifier; null without one."""
        at = lambda found, last: F.when(F.size(found) > 0, F.element_at(found, -1 if last else 1))
        one = lambda c, name: F.when(name.isNotNull(), F.struct(F.size(F.split(c, SENTENCE)).alias("n"), name.alias("id")))
        plain = lambda c: F.translate(c, SENTENCE, " ")
        every = lambda name: F.filter(F.transform(joined, lambda c: one(c, name(plain(c)))), lambda x: x.isNotNull())
        slots = [at(every(lambda c, name=name, p=p: F.when(c.rlike(p), F.lit(name))), False) for name, p in SLOTS]
        return F.coalesce(at(every(lambda c: F.try_element_at(known, c)), True), at(every(lambda c: F.try_element_at(names, F.regexp_extract(c, NOTICE, 1))), False), *slots)

    def found(segs: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(segs)), lambda i: F.array_contains(starts, F.substring_index(F.get(segs, i - 1), " ", 1)))

        def from_(i: Column) -> Column:
            own = F.slice(segs, i, F.lit(LONGEST))
            stop = F.array_position(own, "")
            own = F.when(stop > 0, F.slice(own, F.lit(1), stop.cast("int") - 1)).otherwise(own)
            joined = let(own, lambda o: F.transform(F.sequence(F.lit(1), F.size(o)), lambda n: F.array_join(F.slice(o, F.lit(1), n), SENTENCE)))
            return let(let(joined, hit), lambda h: F.when(h.isNotNull(), F.struct(i.alias("i"), (i + h["n"] - 1).alias("end"), h["id"].alias("id"))))

        hits = F.filter(F.transform(begins, from_), lambda x: x.isNotNull())
        return let(hits, lambda all_: F.transform(F.filter(all_, lambda x: ~F.exists(all_, lambda y: (y["i"] < x["i"]) & (y["end"] >= x["i"]))), lambda x: x["id"]))

    return F.when(text.rlike(WORDS), let(segments(text), found)).otherwise(none)


def match_rules(ids: Column) -> Column:
    """Rules met by a sequence of identifiers, in rule order: array of struct(rule, licence)."""
    rules = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), F.lit(licence).alias("licence"), F.lit(f" {' '.join(seq)} ").alias("seq"))
            for rule, licence, seq in RULES
        ]
    )
    start = F.struct(
        F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" ")).alias("left"),
        F.array().cast("array<struct<rule:string,licence:string>>").alias("found"),
    )

    def step(acc: Column, rule: Column) -> Column:
        hit = acc["left"].contains(rule["seq"])
        one = F.array(F.struct(rule["rule"].alias("rule"), rule["licence"].alias("licence")))
        return F.struct(
            F.when(hit, F.replace(acc["left"], rule["seq"], F.lit(" "))).otherwise(acc["left"]).alias("left"),
            F.when(hit, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"),
        )

    none = F.array().cast("array<struct<rule:string,licence:string>>")
    return F.when(F.size(ids) > 0, F.reduce(rules, start, step, lambda acc: acc["found"])).otherwise(none)


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``license_sentences`` (array of identifiers) and ``license_rules`` (array of struct(rule, licence)).

    Null and empty texts have empty arrays. Columns of those two names are replaced;
    rows are neither dropped nor merged, so repeated rows each get their result.
    """
    return docs.withColumn("license_sentences", sentence_ids(docs[text])).withColumn(
        "license_rules", match_rules(F.col("license_sentences"))
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document: doc_id, n_sentences, sentences, rules, licenses (joined by commas)."""
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.size("license_sentences").cast("long").alias("n_sentences"),
        F.array_join("license_sentences", ",").alias("sentences"),
        F.array_join(F.col("license_rules.rule"), ",").alias("rules"),
        F.array_join(F.array_distinct(F.col("license_rules.licence")), ",").alias("licenses"),
    )


def oracle() -> str:
    """The same definition, by joins with the known sentences."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(s)}, '{i}')" for s, i in known_sentences().items())
    names = ", ".join(f"('{n}', '{name}')" for name, _, own in NAMES for n in own)
    t = "chr(10) || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ\x01\x02\x03', 'abcdefghijklmnopqrstuvwxyz   ')"
    for pattern, by in STEPS:
        t = f"regexp_replace({t}, {quoted(pattern)}, {quoted(by)}, 'g')"
    slots = " ".join(f"WHEN regexp_matches(s, {quoted(p)}) THEN {k}" for k, (_, p) in enumerate(SLOTS, 2))
    slot_ids = " ".join(f"WHEN {k} THEN '{name}'" for k, (name, _) in enumerate(SLOTS, 2))
    steps, before = [], "r0"
    for k, (rule, licence, seq) in enumerate(RULES, 1):
        s = f" {' '.join(seq)} "
        steps.append(
            f"r{k} AS (SELECT doc_id, n_sentences, sentences, replace(rest, '{s}', ' ') AS rest,"
            f" CASE WHEN contains(rest, '{s}') THEN list_append(rules, '{rule}') ELSE rules END AS rules,"
            f" CASE WHEN contains(rest, '{s}') AND NOT list_contains(lic, '{licence}') THEN list_append(lic, '{licence}') ELSE lic END AS lic FROM {before})"
        )
        before = f"r{k}"
    return f"""
WITH known(sentence, id) AS (VALUES {known}), names(name, id) AS (VALUES {names}),
segs AS (SELECT doc_id, list_transform(regexp_split_to_array({t}, '[{SENTENCE}{LINE}]'), lambda s: trim(s, ' .')) AS segs FROM documents WHERE regexp_matches(text, '{WORDS}')),
starts AS (SELECT doc_id, segs, unnest(range(1, len(segs) + 1)) AS i FROM segs),
begins AS (SELECT doc_id, i, segs[i : i + {LONGEST - 1}] AS own FROM starts WHERE split_part(segs[i], ' ', 1) IN ({", ".join(map(quoted, first_words()))})),
joined AS (SELECT doc_id, i, n, array_to_string(own[1 : n], ' ') AS s FROM (SELECT *, unnest(range(1, len(own) + 1)) AS n FROM begins) WHERE NOT list_contains(own[1 : n], '')),
named AS (SELECT *, regexp_extract(s, '{NOTICE}', 1) AS name FROM joined),
graded AS (SELECT j.doc_id, j.i, j.n, CASE WHEN k.id IS NOT NULL THEN 0 WHEN m.id IS NOT NULL THEN 1 {slots} END AS grade, k.id AS k, m.id AS m
           FROM named j LEFT JOIN known k ON k.sentence = j.s LEFT JOIN names m ON m.name = j.name),
hits AS (SELECT doc_id, i, i + n - 1 AS e, CASE grade WHEN 0 THEN k WHEN 1 THEN m {slot_ids} END AS id FROM graded WHERE grade IS NOT NULL
         QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY grade, CASE WHEN grade = 0 THEN -n ELSE n END) = 1),
ids AS (SELECT h.doc_id, list(h.id ORDER BY h.i) AS ids FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits y WHERE y.doc_id = h.doc_id AND y.i < h.i AND y.e >= h.i) GROUP BY h.doc_id),
r0 AS (SELECT d.doc_id, coalesce(len(ids.ids), 0) AS n_sentences, coalesce(array_to_string(ids.ids, ','), '') AS sentences,
              ' ' || coalesce(array_to_string(ids.ids, ' '), '') || ' ' AS rest, []::VARCHAR[] AS rules, []::VARCHAR[] AS lic
       FROM documents d LEFT JOIN ids ON ids.doc_id = d.doc_id),
{", ".join(steps)}
SELECT doc_id, n_sentences, sentences, array_to_string(rules, ',') AS rules, array_to_string(lic, ',') AS licenses FROM {before}
"""
