"""Licence recognition by sentences and rules.

Texts are cut into sentences, sentences normalised and looked up among known licence sentences;
the identifiers in order are then matched with ordered rules, the more specific first. A rule takes
the sentences it matched, so that later rules do not count them again. Listed sentences are cut as
texts are; where one falls into parts, it is known where all its parts follow each other, and a part
alone is not.

Only built-in column functions are used, on one row at a time: nothing is shuffled. The lists are
parameters and become part of the expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = 3  # unknown sentences that may stand between two of a rule

# Sentences of public licences and notices.
SENTENCES = {
    "Released under the MIT License.": "mit-tag",
    "Licensed under the MIT License.": "mit-tag",
    "This project is licensed under the MIT License.": "mit-tag",
    "SPDX-License-Identifier: MIT": "mit-tag",
    "The MIT License (MIT)": "mit-title",
    "MIT License": "mit-title",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:": "mit-grant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "mit-notice",
    "Licensed under the Apache License, Version 2.0.": "apache-tag",
    "Licensed under the Apache License, Version 2.0 (the \"License\");": "apache-tag",
    "SPDX-License-Identifier: Apache-2.0": "apache-tag",
    "you may not use this file except in compliance with the License.": "apache-use",
    "You may obtain a copy of the License at": "apache-copy",
    "This work is licensed under the GNU General Public License, version 3.": "gpl3-tag",
    "SPDX-License-Identifier: GPL-3.0-only": "gpl3-tag",
    "SPDX-License-Identifier: GPL-3.0-or-later": "gpl3-later-tag",
    "This work is licensed under the GNU General Public License, version 2.": "gpl2-tag",
    "SPDX-License-Identifier: GPL-2.0-only": "gpl2-tag",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl3-later-grant",
    "This program is free software;": "gpl-free",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;": "gpl-terms",
    "either version 2 of the License, or (at your option) any later version.": "gpl2-later",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;": "gpl-warranty",
    "Licensed under CC BY-NC 4.0.": "ccbync-tag",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "ccbync-tag",
    "Licensed under CC BY 4.0.": "ccby-tag",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "ccby-tag",
    "Licensed under CC BY-SA 4.0.": "ccbysa-tag",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "ccbysa-tag",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd-grant",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "bsd-source",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.": "bsd-binary",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd-name",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl2-tag",
    "SPDX-License-Identifier: MPL-2.0": "mpl2-tag",
    "SPDX-License-Identifier: GPL-2.0-or-later": "gpl2-later-tag",
    "SPDX-License-Identifier: BSD-2-Clause": "bsd2-tag",
    "SPDX-License-Identifier: BSD-3-Clause": "bsd3-tag",
    "SPDX-License-Identifier: CC-BY-4.0": "ccby-tag",
    "SPDX-License-Identifier: CC-BY-SA-4.0": "ccbysa-tag",
    "SPDX-License-Identifier: CC-BY-NC-4.0": "ccbync-tag",
    "SPDX-License-Identifier: CC0-1.0": "cc0-tag",
    "Licensed under CC0 1.0.": "cc0-tag",
    "SPDX-License-Identifier: LGPL-2.1-only": "lgpl21-tag",
    "SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl21-later",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": "lgpl21-later",
    "SPDX-License-Identifier: LGPL-3.0-only": "lgpl3-tag",
    "SPDX-License-Identifier: LGPL-3.0-or-later": "lgpl3-later",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "lgpl3-later",
    "SPDX-License-Identifier: AGPL-3.0-only": "agpl3-tag",
    "SPDX-License-Identifier: AGPL-3.0-or-later": "agpl3-later",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "agpl3-later",
    "SPDX-License-Identifier: ISC": "isc",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
    "SPDX-License-Identifier: Unlicense": "unlicense",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "SPDX-License-Identifier: BSL-1.0": "boost",
    "Distributed under the Boost Software License, Version 1.0.": "boost",
    "SPDX-License-Identifier: Zlib": "zlib",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:": "zlib",
    "SPDX-License-Identifier: EPL-2.0": "epl2",
    "All rights reserved.": "reserved",
    "copyright notice": "copyright",
}
RULES = (
    ("MIT", ("mit-title", "copyright", "mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-tag", "apache-use", "apache-copy")),
    ("GPL-3.0-or-later", ("gpl3-later-grant", "gpl-warranty")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-terms", "gpl2-later")),
    ("GPL-3.0-or-later", ("gpl3-later-grant",)),
    ("GPL-3.0-or-later", ("gpl3-later-tag",)),
    ("GPL-3.0-only", ("gpl3-tag",)),
    ("GPL-2.0-only", ("gpl2-tag",)),
    ("Apache-2.0", ("apache-tag",)),
    ("MIT", ("mit-tag",)),
    ("CC-BY-NC-4.0", ("ccbync-tag",)),
    ("CC-BY-SA-4.0", ("ccbysa-tag",)),
    ("CC-BY-4.0", ("ccby-tag",)),
    ("MPL-2.0", ("mpl2-tag",)),
    ("GPL-2.0-or-later", ("gpl2-later-tag",)),
    ("BSD-2-Clause", ("bsd2-tag",)),
    ("BSD-3-Clause", ("bsd3-tag",)),
    ("CC0-1.0", ("cc0-tag",)),
    ("LGPL-2.1-only", ("lgpl21-tag",)),
    ("LGPL-2.1-or-later", ("lgpl21-later",)),
    ("LGPL-3.0-only", ("lgpl3-tag",)),
    ("LGPL-3.0-or-later", ("lgpl3-later",)),
    ("AGPL-3.0-only", ("agpl3-tag",)),
    ("AGPL-3.0-or-later", ("agpl3-later",)),
    ("ISC", ("isc",)),
    ("Unlicense", ("unlicense",)),
    ("BSL-1.0", ("boost",)),
    ("Zlib", ("zlib",)),
    ("EPL-2.0", ("epl2",)),
    ("MIT", ("mit-title",)),
    ("Proprietary", ("copyright", "reserved")),
)

# A tag is a sentence of its own, up to the end of its line; a choice or a sum of licences counts as
# a tag for each, and an exception does not count.
TAG = r"(?i)[ \t\r\n]*spdx-license-identifier:[ \t]*"
TAG_LINE = r"(\x02[^\r\n]*)[\r\n]+"
TAG_WITH = r"(\x02[^\r\n\x01\x02]*?)[ \t]+WITH[ \t]+[A-Za-z0-9.-]+"
TAG_JOIN = r"(\x02[^\r\n\x01\x02]*?)[ \t)]+(?:OR|AND)[ \t(]+"
MOST_JOINS = 8  # licences after the first that a tag may name
# A sentence ends at a mark with white space after it, and at a line end before a capital, a digit
# or an empty line. Other line ends are white space.
MARK_END = r"([.!?;:])[ \t\r\n]+"
LINE_END = r"\n[ \t\r]*([A-Z0-9\n])"
NOT_PLAIN = r"[^a-z0-9]+"
NOTICE = r"^copyright( c)? [0-9]{4}( .*)?$"


def normal(sentence: str) -> str:
    """The same as :func:`normalised`, for the sentences of a list."""
    plain = re.sub(NOT_PLAIN, " ", sentence.lower()).strip(" ").replace("licence", "license")
    return re.sub(NOTICE, "copyright notice", plain)


def normalised(sentence: Column) -> Column:
    """Lower-cased letters and digits with single blanks between them, one spelling of licence,
    any dated copyright line as one notice."""
    plain = F.trim(F.regexp_replace(F.lower(sentence), NOT_PLAIN, " "))
    return F.regexp_replace(F.replace(plain, F.lit("licence"), F.lit("license")), NOTICE, "copyright notice")


def sentences_of(text: Column) -> Column:
    """The sentences of a text (the control characters 1 and 2 also end one)."""
    cut = F.regexp_replace(F.regexp_replace(text, TAG, "\x02"), TAG_LINE, "$1\x01")
    cut = F.regexp_replace(cut, TAG_WITH, "$1")
    for _ in range(MOST_JOINS):
        cut = F.regexp_replace(cut, TAG_JOIN, "$1\x01\x02")
    cut = F.replace(cut, F.lit("\x02"), F.lit("\x01SPDX-License-Identifier: "))
    tagged = F.regexp_replace(cut, "^\x01", "")
    # The same for a text without tags, at far less cost.
    cut = F.when(F.contains(F.lower(text), F.lit("spdx-license-identifier:")), tagged).otherwise(text)
    cut = F.regexp_replace(cut, MARK_END, "$1\x01")
    return F.split(F.regexp_replace(cut, LINE_END, "\x01$1"), "\x01")


def parts_of(sentence: str) -> list[str]:
    """The same as :func:`sentences_of`, normalised, for the sentences of a list."""
    cut = re.sub(LINE_END, "\x01\\1", re.sub(MARK_END, "\\1\x01", sentence))
    return [normal(part) for part in cut.split("\x01")]


def numbered(sentences: dict[str, str], rules) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Numbers for the identifiers: sentence to number, and rules as strings of them."""
    names = {name: i for i, name in enumerate(dict.fromkeys(sentences.values()), 1)}
    known = {normal(s): names[name] for s, name in sentences.items()}
    return known, [(licence, "".join(f"{names[n]}," for n in sequence)) for licence, sequence in rules]


def with_parts(sentences: dict[str, str], known: dict[str, int]) -> tuple[dict[str, int], list[tuple[list[int], int]]]:
    """``known`` with further numbers for parts of sentences that the cut takes apart, and the
    sequences of numbers that make a whole sentence, the longer first."""
    parts, wholes = dict(known), []
    for sentence in sentences:
        cut = re.sub(LINE_END, "\x01\\1", re.sub(MARK_END, "\\1\x01", sentence)).split("\x01")
        if len(cut) > 1:
            for part in map(normal, cut):
                parts.setdefault(part, max(known.values()) + len(parts))
            wholes.append(([parts[normal(part)] for part in cut], known[normal(sentence)]))
    return parts, sorted(wholes, key=lambda w: -len(w[0]))


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", sentences: dict[str, str] | None = None, rules=RULES,
    gap: int = GAP,
) -> DataFrame:
    """One row per row of ``docs`` that has a known licence sentence: doc_id, n_sentences (as cut),
    n_known, first_known (position of the first, from 0), licences (recognised, in the order of
    the rules, each once, comma-joined; empty where no rule fits).

    Null and empty texts give no row, rows with one key are scanned each, an empty table gives no
    rows, further columns are ignored.
    """
    known, wanted = numbered(SENTENCES if sentences is None else sentences, rules)
    parts, wholes = with_parts(SENTENCES if sentences is None else sentences, known)
    table = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
    number = lambda s: F.coalesce(F.element_at(table, normalised(s)), F.lit(0))
    rows = docs.select(F.col(key).alias("doc_id"), F.transform(sentences_of(F.col(text)), number).alias("ids"))
    rows = rows.where(F.exists("ids", lambda x: x > 0))
    # "<3><0><7>": parts in sequence become the number of the sentence, followed by -1; others go.
    marked = F.concat(F.lit("<"), F.array_join("ids", "><"), F.lit(">"))
    for sequence, whole in wholes:
        one = f"<{whole}>" + "<-1>" * (len(sequence) - 1)
        marked = F.replace(marked, F.lit("".join(f"<{n}>" for n in sequence)), F.lit(one))
    ids = F.split(F.expr("substring(marked, 2, length(marked) - 2)"), "><").cast("array<int>")
    top = max(known.values(), default=0)
    rows = rows.select("doc_id", marked.alias("marked")).select("doc_id", ids.alias("ids"))
    rows = rows.select("doc_id", F.transform("ids", lambda x: F.when(x <= top, x).otherwise(0)).alias("ids"))
    rows = rows.where(F.exists("ids", lambda x: x > 0))
    # "3,x,7,": the known ones in order, x where too many unknown ones lie between.
    line = F.concat(F.lit(","), F.array_join(F.filter("ids", lambda x: x >= 0), ","), F.lit(","))
    line = F.regexp_replace(line, rf"(,0){{{gap + 1},}},", ",x,")
    line = F.regexp_replace(line, r"(,0)+,", ",")
    rows = rows.select(
        "doc_id", F.size("ids").alias("n_sentences"), F.size(F.filter("ids", lambda x: x > 0)).alias("n_known"),
        (F.array_position(F.transform("ids", lambda x: x > 0), True) - 1).alias("first_known"), line.alias("left_0"),
        F.expr("CAST(array() AS array<string>)").alias("found_0"),
    )
    for i, (licence, sequence) in enumerate(wanted):
        here = F.contains(f"left_{i}", F.lit("," + sequence))
        rows = rows.select(
            "doc_id", "n_sentences", "n_known", "first_known",
            F.replace(f"left_{i}", F.lit("," + sequence), F.lit(",x,")).alias(f"left_{i + 1}"),
            F.when(here, F.array_append(f"found_{i}", F.lit(licence))).otherwise(F.col(f"found_{i}")).alias(f"found_{i + 1}"),
        )
    found = F.array_join(F.array_distinct(f"found_{len(wanted)}"), ",")
    return rows.select("doc_id", "n_sentences", "n_known", "first_known", found.alias("licences"))
