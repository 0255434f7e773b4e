"""License scans: segments of a text against licence templates by the Dice coefficient of word bigrams.

A template is the normalised text of a licence's notice, of one of its paragraphs, or of its usual one-line mention.
The segments of a text are its lines, its paragraphs (lines between blank ones), the sentences of both, and the whole.
A segment is normalised as the templates are (lower case, anything but letters and digits is one blank) and compared
to each template as a set of word bigrams: 2 * common / (size + size). Two sets can reach the threshold only if neither
is larger than (2 - t) / t times the other. This bound is applied to the segment's word count before any text is
compared, and again to the two sets; what passes is compared in full, so nothing is lost. Before all that, texts and
segments without any of a few telling words go: a match has at least t / (2 - t) of a template's bigrams, so words
that touch more than the rest of every template's bigrams are in every match.

A segment names one licence, that of its best template. Among equally good ones the template wins whose numbers
differ least from the segment's, so that versions are told apart, and then the licence that comes first by name.

Null and empty texts and segments of one word hold no bigram and match nothing. Very long texts are taken whole: the
words of one text must fit a task. Rows that share a key, null included, are one document, in which a normalised
segment counts once however often it occurs. An empty table gives an empty result. Other columns aren't read, whatever
their names. Templates are a parameter. Those here are notices and the paragraphs of short licences, as plain text; the
long bodies of the Apache, GNU, Mozilla and Creative Commons licences are not among them, their headers are.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices and usual mentions, by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation."),
    ("GPL-3.0", "GNU General Public License v3.0 or later"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Released under the GNU General Public License version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Licensed under the ISC License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("all-rights-reserved", "Copyright. All rights reserved."),
)
PERCENT = 80
#: Where sentences are parted, for Spark and Python; DuckDB's SQL has it without the look-behind.
SENTENCE_END = r"(?<=[.!?])[\x20\x09-\x0D]+"
#: Words of the templates that are so common that they tell little.
COMMON = frozenset("a all an and any are as at be by for free from in is it of on or that the this to under use used with you your".split())


def normal(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}0-9]+", " "))


def bigrams(text: str) -> Column:
    """The set of word bigrams of a normalised text."""
    w = F.split(F.col(text), " ")
    pairs = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(F.size(w) >= 2, pairs).otherwise(F.expr("cast(array() as array<string>)")))


def _numbers(text: str) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: w.rlike("^[0-9]+$")))


def templates(spark, found=TEMPLATES) -> DataFrame:
    df = spark.createDataFrame([(i, spdx, text) for i, (spdx, text) in enumerate(found)], "template int, license string, notice string")
    return df.withColumn("notice", normal(F.col("notice"))).select("template", "license", bigrams("notice").alias("grams"), _numbers("notice").alias("numbers"))


def _segments(text: Column) -> Column:
    """Lines, paragraphs of several lines, and the whole text if it has several paragraphs."""
    paragraphs = F.split(text, r"\n[\x20\x09-\x0D]*\n")
    longer = F.filter(paragraphs, lambda p: F.contains(p, F.lit("\n")))
    return F.concat(F.split(text, "\n"), longer, F.when(F.size(paragraphs) > 1, F.array(text)).otherwise(F.expr("cast(array() as array<string>)")))


def _with_sentences(segment: Column) -> Column:
    """A segment and its sentences."""
    return F.concat(F.array(segment), F.split(segment, SENTENCE_END))


def _grams_of(notice: str) -> set[tuple[str, str]]:
    w = [x for x in re.split(r"[\W_]+", notice.lower()) if x]
    return set(zip(w, w[1:], strict=False))


def telling_words(found=TEMPLATES, percent: int = PERCENT) -> list[str]:
    """Words of which every text that matches a template has one, found greedily; long words first, as they are rarer."""
    missing = {}
    for k, (_, notice) in enumerate(found):
        grams = _grams_of(notice)
        # A match lacks fewer than this many bigrams, so at least one of any larger number is in it.
        missing[k] = [grams, len(grams) - -(-percent * len(grams) // (200 - percent)) + 1]
    words: list[str] = []
    while any(need > 0 for _, need in missing.values()):
        worth = Counter()
        for grams, need in missing.values():
            for w in {w for g in grams for w in g} if need > 0 else ():
                worth[w] += min(need, sum(w in g for g in grams)) * (1 if w in COMMON or not w.isalpha() else 100 if len(w) > 5 else 10)
        best = min(worth, key=lambda w: (-worth[w], w))
        words.append(best)
        for entry in missing.values():
            gone = {g for g in entry[0] if best in g}
            entry[0], entry[1] = entry[0] - gone, entry[1] - len(gone)
    return words


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", found=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """``key``, ``license``, ``dice`` (the best segment's) and ``n_segments``: a row for each licence that a document names."""
    known = templates(docs.sparkSession, found)
    # At least the smallest template's number of different bigrams; marks count as blanks here, which only lowers it.
    sizes = [len(_grams_of(t)) for _, t in found]
    low, high = percent, 200 - percent
    words = telling_words(found, percent)
    # As a lambda's variable the lower-case text is made once, not once for each word.
    part = r"[\p{L}\p{M}0-9]"
    whole = lambda t, w: F.contains(t, F.lit(w)) & t.rlike(f"(?<!{part}){re.escape(w)}(?!{part})")
    told = lambda c: F.exists(F.array(F.lower(c)), lambda t: reduce(or_, (whole(t, w) for w in words)))
    likely = docs.select(F.col(key).alias(key), F.col(text).alias("body")).where(told("body"))
    segment = likely.select(key, F.explode(F.array_distinct(_segments(F.col("body")))).alias("segment")).where(told("segment"))
    segment = segment.select(key, F.explode(_with_sentences(F.col("segment"))).alias("segment")).where(told("segment"))
    # A set is no larger than the word count less one, so the lower bound prunes before normalisation ...
    blanks = F.char_length("segment") - F.char_length(F.regexp_replace("segment", r"[^\p{L}\p{M}0-9]", ""))
    segment = segment.where((blanks + 1) * high >= low * min(sizes, default=1))
    # ... and both bounds prune once the set is there. The templates are a fixed list, so they can be broadcast.
    segment = segment.select(key, normal(F.col("segment")).alias("segment")).distinct().withColumn("own", bigrams("segment"))
    a, b = F.size("own"), F.size("grams")
    near = segment.join(F.broadcast(known), (a > 0) & (a * low <= b * high) & (b * low <= a * high))
    common = F.size(F.array_intersect("own", "grams"))
    near = near.withColumn("common", common).where(200 * F.col("common") >= percent * (a + b))
    differ = F.size(F.array_except(_numbers("segment"), F.col("numbers"))) + F.size(F.array_except(F.col("numbers"), _numbers("segment")))
    best = near.groupBy(key, "segment").agg(F.min(F.struct((-2.0 * F.col("common") / (a + b)).alias("less"), differ.alias("differ"), "license")).alias("best"))
    return best.groupBy(key, F.col("best.license").alias("license")).agg(F.round(-F.min("best.less"), 6).alias("dice"), F.count("*").alias("n_segments"))


def sql(found=TEMPLATES, percent: int = PERCENT) -> str:
    """DuckDB SQL for ``scan`` of ``documents``, comparing every segment that the size bound leaves with every template."""
    values = ", ".join(f"({i}, '{spdx}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (spdx, text) in enumerate(found))
    norm = lambda c: f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{M}}0-9]+', ' ', 'g'))"
    grams = lambda w: f"list_distinct(list_transform(range(1, greatest(len({w}), 1)), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    numbers = lambda w: f"list_distinct(list_filter({w}, lambda x: regexp_full_match(x, '[0-9]+')))"
    return f"""WITH t AS (SELECT template, license, {grams('w')} AS grams, {numbers('w')} AS numbers FROM (SELECT template, license, string_split({norm('notice')}, ' ') AS w FROM (VALUES {values}) v(template, license, notice))),
paragraphs AS (SELECT doc_id, coalesce(text, '') AS body, regexp_split_to_array(coalesce(text, ''), '\\n[\\x20\\x09-\\x0D]*\\n') AS p FROM documents),
segments AS (SELECT DISTINCT doc_id, unnest(string_split(body, chr(10)) || list_filter(p, lambda x: contains(x, chr(10))) || CASE WHEN len(p) > 1 THEN [body] ELSE [] END) AS segment FROM paragraphs),
sentences AS (SELECT doc_id, unnest([segment] || string_split(regexp_replace(segment, '([.!?])[\\x20\\x09-\\x0D]+', '\\1' || chr(1), 'g'), chr(1))) AS segment FROM segments),
normal AS (SELECT DISTINCT doc_id, {norm('segment')} AS segment FROM sentences),
sets AS (SELECT doc_id, segment, {grams('w')} AS grams, {numbers('w')} AS numbers FROM (SELECT doc_id, segment, string_split(segment, ' ') AS w FROM normal)),
likely AS (SELECT * FROM sets WHERE len(grams) > 0 AND {percent} * len(grams) <= {200 - percent} * (SELECT max(len(grams)) FROM t)),
near AS (SELECT doc_id, segment, license, len(list_intersect(s.grams, t.grams)) AS common, len(s.grams) + len(t.grams) AS total,
  len(s.numbers) + len(t.numbers) - 2 * len(list_intersect(s.numbers, t.numbers)) AS differ FROM likely s, t),
best AS (SELECT doc_id, license, 2.0 * common / total AS dice FROM near WHERE 200 * common >= {percent} * total
  QUALIFY row_number() OVER (PARTITION BY doc_id, segment ORDER BY 2.0 * common / total DESC, differ, license) = 1)
SELECT doc_id, license, round(max(dice), 6) AS dice, count(*) AS n_segments FROM best GROUP BY doc_id, license"""
