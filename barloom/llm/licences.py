"""Licence scans by sentence rules, in DataFrame expressions only.

A text is cut into pieces at stops and at line ends, and each is normalised
(lower case, runs of anything but letters and digits to one blank).  A run of
pieces that reads as a known licence sentence has that sentence's identifier:
inside it a single line end is white space, so wrapped texts are read like
unwrapped ones, and a stop may stand only where the sentence has one itself.
The sequence of identifiers of the text is then matched against licence rules,
which are ordered sequences of identifiers; other sentences may stand between.
No explode and no shuffle: one projection over the scan.

The SQL knows sentences of one piece only.  Both agree on texts without a known
sentence of several pieces; on the others the SQL misses the sentence.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifiers and sentences as published in the licences and their notices.
SENTENCES = {
    "mit-ref": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "apache-ref": "Licensed under the Apache License, Version 2.0",
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "ccbync4-ref": "Licensed under CC BY-NC 4.0",
    "ccby4-ref": "Licensed under CC BY 4.0",
    "reserved": "All rights reserved",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense-domain": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-ref": "Distributed under the Boost Software License, Version 1.0",
    "ccbysa4-ref": "Licensed under CC BY-SA 4.0",
    "ccby4-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "ccbysa4-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0-ref": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
}

#: Other published wordings of sentences.
VARIANTS = {
    "apache-ref": ["Licensed under the Apache License, Version 2.0 (the \"License\")"],
}

#: Licence rules in the order of the report; each is an ordered sequence of sentence identifiers.
RULES = {
    "MIT": [["mit-ref"], ["mit-grant", "mit-notice", "as-is"]],
    "Apache-2.0": [["apache-ref"], ["apache-comply", "apache-copy"]],
    "GPL-3.0": [["gpl3-ref"], ["gpl-free", "gpl-hope"]],
    "BSD-3-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]],
    "BSD-2-Clause": [["bsd-grant", "bsd-source", "bsd-binary"]],
    "CC-BY-NC-4.0": [["ccbync4-ref"]],
    "CC-BY-4.0": [["ccby4-ref"], ["ccby4-long"]],
    "proprietary": [["reserved"]],
    "GPL-2.0": [["gpl2-free", "gpl-hope"]],
    "LGPL-3.0": [["lgpl3-free"]],
    "AGPL-3.0": [["agpl3-free", "gpl-hope"]],
    "ISC": [["isc-grant", "isc-as-is"]],
    "MPL-2.0": [["mpl2-form"]],
    "Unlicense": [["unlicense-domain", "unlicense-anyone"]],
    "Zlib": [["zlib-as-is", "zlib-grant"]],
    "BSL-1.0": [["boost-ref"]],
    "CC-BY-SA-4.0": [["ccbysa4-ref"], ["ccbysa4-long"]],
    "CC0-1.0": [["cc0-ref"]],
}

SEPARATOR = "\u0001"
#: The same patterns serve both engines: no lookahead, explicit white space.
BREAK = r"[.!?:;]+(?:[ \t\n\f\r]+|\z)|\n+|\x01+"
FILLER = r"[^\p{L}\p{N}\x01]+"
#: BREAK in two: stops, and line ends; lines without a letter or digit part like a stop.
STOP = r"[.!?:;]+(?:[ \t\n\f\r]+|\z)|\x01+"
BLANK_LINE = r"\n[^\p{L}\p{N}\x01]*\n"
LINE_END = "\u0002"


def normal(sentence: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in sentence.lower()).split())


def rule_pattern(sequence: list[str]) -> str:
    """The sequence, in order, with any other identifiers between, in a text like ,a,b,c, of identifiers."""
    return "," + ",(?:.*,)?".join(sequence) + ","


def in_order(sequence: list[str]) -> str:
    """The same for a text like ,a,,b,,c, read once from its start: each part takes the first identifier it can and keeps it."""
    return "^" + "".join(f"(?>.*?,{i},)" for i in sequence)


def spellings() -> dict[str, tuple[str, str]]:
    """Identifier and pattern of each normalised known sentence, the longest first."""
    out = {}
    for i, sentence in [*SENTENCES.items(), *((i, s) for i, more in VARIANTS.items() for s in more)]:
        cut = [normal(x) for x in re.split(r"[.!?:;]+(?:\s+|$)", sentence)]
        out[normal(sentence)] = i, r"[ \x01\x02]".join(x.replace(" ", r"[ \x02]") for x in cut if x)
    return dict(sorted(out.items(), key=lambda x: -len(x[0])))


def marked_pieces(text: Column) -> Column:
    """The normalised pieces with a mark before and after each: LINE_END at a single line end, SEPARATOR elsewhere."""
    out = F.translate(F.lower(F.coalesce(text, F.lit(""))), LINE_END, " ")
    for pattern, mark in ((STOP, SEPARATOR), (BLANK_LINE, SEPARATOR), (r"\n", LINE_END), (r"[^\p{L}\p{N}\x01\x02]+", " "), (r"[ \x01\x02]*\x01[ \x01\x02]*", SEPARATOR), (r" ?\x02 ?", LINE_END)):
        out = F.regexp_replace(out, pattern, mark)
    return F.concat(F.lit(SEPARATOR), F.trim(out), F.lit(SEPARATOR))


def sentence_columns(marked: Column) -> dict[str, Column]:
    """The number of pieces of marked_pieces(), and the identifiers of those that are known sentences."""
    known = spellings()
    sentences = F.filter(F.split(marked, r"[\x01\x02]"), lambda s: s != "")
    names = F.create_map(*(F.lit(x) for spelled, (i, _) in known.items() for x in (spelled, i)))
    any_known = r"(?<=[\x01\x02])(?:" + "|".join(pattern for _, pattern in known.values()) + r")(?=[\x01\x02])"
    ids = F.transform(F.regexp_extract_all(marked, F.lit(any_known), F.lit(0)), lambda s: F.element_at(names, F.translate(s, SEPARATOR + LINE_END, "  ")))
    return {"n_sentences": F.size(sentences).cast("long"), "sentence_ids": ids}


def licences_of(listed: Column) -> Column:
    """Names of the rules of which a sequence is in the identifiers, listed like ,a,,b,,c, in the text's order."""
    found = []
    for name, sequences in RULES.items():
        held = F.lit(False)
        for sequence in sequences:
            held |= listed.rlike(in_order(sequence))
        found.append(F.when(held, F.lit(name)))
    return F.when(listed == ",,", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*found)))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_sentences, sentence_ids in order of the text, licences in order of RULES.

    n_sentences counts the pieces, as the SQL does: a wrapped line is one.  A null or empty text has no sentences and no licences.  Rows are scanned
    one by one: ids may be null or repeated, other columns are not read.
    """
    # each step reads the one before more than once, so they stay apart in the plan
    marked = docs.select(F.col(id_col).alias("doc_id"), marked_pieces(F.col(text_col)).alias("_marked"))
    named = marked.select("doc_id", *(c.alias(n) for n, c in sentence_columns(F.col("_marked")).items()))
    listed = named.withColumn("_listed", F.concat(F.lit(","), F.array_join("sentence_ids", ",,"), F.lit(",")))
    return listed.select("doc_id", "n_sentences", "sentence_ids", licences_of(F.col("_listed")).alias("licences"))


def oracle_sql() -> str:
    """The same in the SQL of DuckDB, for op2's columns."""
    known = ", ".join(f"('{normal(s)}', '{i}')" for i, s in SENTENCES.items())
    keys = ", ".join(f"'{normal(s)}'" for s in SENTENCES.values())
    rules = ", ".join("case when " + " or ".join(f"regexp_matches(',' || array_to_string(ids, ',') || ',', '{rule_pattern(s)}')" for s in sequences) + f" then '{name}' end" for name, sequences in RULES.items())
    return f"""
with cut as (
  select doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{BREAK}', chr(1), 'g'), '{FILLER}', ' ', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') s
  from documents),
named as (
  select doc_id, len(s) n_sentences,
         list_transform(list_filter(s, lambda x: x in ({keys})), lambda x: map_from_entries([{known}])[x]) ids
  from cut)
select doc_id, cast(n_sentences as bigint) n_sentences, array_to_string(ids, ',') sentence_ids,
       array_to_string(list_filter([{rules}], lambda x: x is not null), ',') licences
from named"""
