"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into sentences, each is normalised, and normalised sentences that are known become identifiers. A rule is a
sequence of identifiers; it holds where a document's identifiers contain it in that order, others in between allowed. Two
readings of a text are matched: line by line, and with the lines of a paragraph joined, for notices that wrap.

Defined cases: a null or empty text has no sentences; a null doc_id stays null; repeated rows give repeated result rows; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence notices, by identifier, as they are written.
SENTENCES = {
    "mit-released": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "as-is-warranty": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "apache-2-licensed": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License");', "Licensed under the Apache License 2.0."],
    "apache-2-compliance": ["you may not use this file except in compliance with the License."],
    "apache-2-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "gpl-2-licensed": ["This work is licensed under the GNU General Public License, version 2."],
    "gpl-3-licensed": ["This work is licensed under the GNU General Public License, version 3."],
    "gpl-free": ["This program is free software;", "This program is free software:"],
    "gpl-2-later": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;", "either version 2 of the License, or (at your option) any later version."],
    "gpl-3-later": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "bsd-redistribution": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "mpl-2-subject": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."],
    "cc-by-4-licensed": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4-licensed": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-4-licensed": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0-dedicated": ["Released under CC0 1.0.", "This work is dedicated to the public domain."],
    "unlicense-released": ["This is free and unencumbered software released into the public domain."],
    "all-rights-reserved": ["All rights reserved."],
}

# Rules, (licence, identifiers in order).
RULES = [
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is-warranty"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache-2-licensed"]),
    ("GPL-2.0", ["gpl-2-licensed"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-2-later"]),
    ("GPL-3.0", ["gpl-3-licensed"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-3-later"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("MPL-2.0", ["mpl-2-subject"]),
    ("CC-BY-4.0", ["cc-by-4-licensed"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-licensed"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-licensed"]),
    ("CC0-1.0", ["cc0-dedicated"]),
    ("Unlicense", ["unlicense-released"]),
    ("Proprietary", ["all-rights-reserved"]),
]

#: Every known sentence has one of these stems, and a text without any is never cut.
STEMS = "licen|permi|redistribut|warrant|public domain|all rights|copyright|cc0|free software|unencumbered"
#: Marks a sentence that speaks of a licence but is not known.
SPEAKS = "licen[cs]e"
#: What ends a sentence, before white space.
STOPS = r"([.!?;:])[\x20\x09-\x0D]+"
#: An abbreviation whose full stop ends no sentence; it is read as the word.
VERSION = r"(?i)\bv\.[\x20\x09]+(?=[0-9])"


def normal(text: str) -> str:
    """What ``normalised`` does, for the fixed sentences."""
    text = re.sub("[^a-z0-9.]+", " ", text.lower())
    return re.sub(r"\.+( |$)", r"\1", text).strip(" ")


def normalised(text: Column) -> Column:
    """Lower case, letters, digits and inner full stops only, single spaces."""
    text = F.regexp_replace(F.lower(text), "[^a-z0-9.]+", " ")
    return F.trim(F.regexp_replace(text, r"\.+( |$)", "$1"))


def known() -> dict[str, str]:
    return {normal(s): name for name, sentences in SENTENCES.items() for s in sentences}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentence_ids and wrapped_ids (identifiers in order, comma-joined, of the two readings), licenses (in rule
    order, comma-joined), n_known and n_unknown (sentences, line by line, that are known, or speak of a licence but are not)."""
    table = F.create_map(*[F.lit(x) for pair in known().items() for x in pair])
    text = F.coalesce(F.col(text_col), F.lit(""))
    speaks = F.lower(text).rlike(STEMS)

    def sentences(flat: Column) -> Column:
        flat = F.regexp_replace(flat, VERSION, "version ")
        cut = F.split(F.regexp_replace(flat, STOPS, "$1\n"), "[\n\r]+")
        stems = F.filter(cut, lambda s: F.lower(s).rlike(STEMS + "|this program|you may|either version|neither the name"))
        return F.when(speaks, F.transform(stems, normalised)).otherwise(F.array().cast("array<string>"))

    joined = F.regexp_replace(F.regexp_replace(text, "\r", ""), "([^\n])\n([^\n])", "$1 $2")
    rows = docs.select(F.col(id_col).alias("doc_id"), sentences(text).alias("lines"), sentences(joined).alias("paragraphs"))

    def ids(column: str) -> Column:
        return F.filter(F.transform(column, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull())

    rows = rows.select(
        "doc_id",
        F.array_join(ids("lines"), ",").alias("sentence_ids"),
        F.array_join(ids("paragraphs"), ",").alias("wrapped_ids"),
        F.size(ids("lines")).cast("long").alias("n_known"),
        F.size(F.filter("lines", lambda s: F.try_element_at(table, s).isNull() & s.rlike(SPEAKS))).cast("long").alias("n_unknown"),
    )
    hits = []
    for name in dict.fromkeys(n for n, _ in RULES):
        patterns = [pattern(r) for n, r in RULES if n == name]
        one = F.lit(False)
        for p in patterns:
            for reading in ("sentence_ids", "wrapped_ids"):
                one = one | F.concat(F.lit(","), F.col(reading), F.lit(",")).rlike(p)
        hits.append(F.when(one, F.lit(name)))
    licenses = F.when((F.col("sentence_ids") != "") | (F.col("wrapped_ids") != ""), F.concat_ws(",", *hits)).otherwise(F.lit(""))
    return rows.select("doc_id", "sentence_ids", "wrapped_ids", licenses.alias("licenses"), "n_known", "n_unknown")


def pattern(rule: list[str]) -> str:
    """A regular expression over comma-enclosed identifiers for one ordered rule."""
    return "," + ",(.*,)?".join(rule) + ","


def oracle() -> str:
    """The same scan in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = "map {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in known().items()) + "}"
    stems = STEMS + "|this program|you may|either version|neither the name"

    def lines(flat: str) -> str:
        flat = f"regexp_replace({flat}, {quote(VERSION.replace('(?=[0-9])', '([0-9])'))}, 'version \\1', 'g')"
        cut = f"regexp_split_to_array(regexp_replace({flat}, {quote(STOPS)}, '\\1' || chr(10), 'g'), '[\\n\\r]+')"
        norm = "trim(regexp_replace(regexp_replace(lower(s), '[^a-z0-9.]+', ' ', 'g'), '\\.+( |$)', '\\1', 'g'), ' ')"
        return f"CASE WHEN regexp_matches(lower(t), {quote(STEMS)}) THEN list_transform(list_filter({cut}, lambda s: regexp_matches(lower(s), {quote(stems)})), lambda s: {norm}) ELSE [] END"

    joined = "regexp_replace(replace(t, chr(13), ''), '([^\\n])\\n([^\\n])', '\\1 \\2', 'g')"
    cases = []
    for name in dict.fromkeys(n for n, _ in RULES):
        any_of = " OR ".join(f"regexp_matches(',' || {r} || ',', {quote(pattern(p))})" for n, p in RULES if n == name for r in ("sentence_ids", "wrapped_ids"))
        cases.append(f"CASE WHEN {any_of} THEN {quote(name)} END")
    return f"""
        WITH k AS (SELECT {table} AS m), d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        s AS (SELECT doc_id, {lines('t')} AS lines, {lines(joined)} AS paragraphs FROM d),
        i AS (SELECT doc_id, lines, list_filter(list_transform(lines, lambda s: m[s]), lambda x: x IS NOT NULL) AS a,
                     list_filter(list_transform(paragraphs, lambda s: m[s]), lambda x: x IS NOT NULL) AS b, m FROM s, k),
        r AS (SELECT doc_id, coalesce(array_to_string(a, ','), '') AS sentence_ids, coalesce(array_to_string(b, ','), '') AS wrapped_ids,
                     CAST(len(a) AS BIGINT) AS n_known,
                     CAST(len(list_filter(lines, lambda s: m[s] IS NULL AND regexp_matches(s, {quote(SPEAKS)}))) AS BIGINT) AS n_unknown FROM i)
        SELECT doc_id, sentence_ids, wrapped_ids, concat_ws(',', {', '.join(cases)}) AS licenses, n_known, n_unknown FROM r
    """
