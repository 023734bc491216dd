"""Licence scans: Dice coefficient over word bigrams, DataFrame functions only.

Each line of a text, and the whole text where it has several lines, is a unit. A unit is
lower-cased, everything but digits, letters a-z and characters beyond ASCII separates words,
and its set of distinct word bigrams is compared with that of each licence template:
2 * common / (size + size). A coefficient of at least t needs sizes within a factor of
t / (2 - t), and a unit of n words has n - 1 bigrams at most, so most units lose all their
candidate templates before a bigram is made. The templates are a fixed list of this module,
so nothing is broadcast or shuffled, and each row is worked on where it is read.

Templates of at least LONG words are also looked for within texts, whatever the line breaks:
each is compared with the windows of as many words that start at every eighth of its length,
and at the text's last.

What reaches the threshold has a known share of a template's bigrams at least, so one of a few
words, its anchors, that touch more than the rest of them. A text that contains no template's
anchor is done with; in others a unit needs an anchor, and a template is compared with those
windows alone that hold one of its own. That skips nothing that could reach the threshold,
which must be above 0.

The result has a row for each unit that reaches the threshold, with its best template (ties:
the name that sorts first), and one for each long template's best window (ties: the first).
``unit`` is the line's number from 1, 0 for the whole text, or minus the number of the word at
which a window starts.
Null and empty texts and units of fewer than two words match nothing; repeated rows give
repeated results; null ids are carried along; other columns stay behind.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import table, texts

THRESHOLD = 0.8

# Licence notices as their publishers word them.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
# Whole licences, looked for in windows only.
WHOLE = {
    "isc-text": TEMPLATES["isc"] + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "mit-text": TEMPLATES["mit-notice"] + ' The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
}
LONG = 18
STEPS = 8
SEPARATORS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def words_of(text: str) -> list[str]:
    return "".join(c if c.isdigit() or "a" <= c <= "z" or ord(c) > 127 else " " for c in text.lower()).split()


def bigrams(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def long_templates(templates: dict[str, str] | None) -> dict[str, str]:
    return {k: v for k, v in sorted((templates or TEMPLATES | WHOLE).items()) if len(words_of(v)) >= LONG}


def anchors(pairs: list[str], threshold: float, pool: set[str]) -> list[str]:
    """Words of which a unit that reaches the threshold has one at least: they touch more bigrams than it may lack.

    Those of the pool are taken first.
    """
    lacks, left, out = int(len(pairs) * (1 - threshold / (2 - threshold))), {p: p.split() for p in pairs}, []
    while left and len(pairs) - len(left) <= lacks:
        touched: dict[str, int] = {}
        for own in left.values():
            for word in set(own):
                touched[word] = touched.get(word, 0) + 1
        best = max(touched, key=lambda w: (w in pool, min(len(w), 8), touched[w], w))  # long words are rare ones
        out.append(best)
        left = {p: own for p, own in left.items() if best not in own}
    return out


def normal(lowered: Column) -> Column:
    return F.trim(F.regexp_replace(lowered, SEPARATORS, " "))


def literals(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def word_bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates: dict[str, str] | None = None) -> DataFrame:
    """id, unit, license, dice for each unit that is like a template."""
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    known = {k: bigrams(v) for k, v in sorted((templates or TEMPLATES).items())}
    known = {k: v for k, v in known.items() if v}
    long = {k: (len(words_of(v)), bigrams(v)) for k, v in long_templates(templates).items()}
    fewest = min(map(len, known.values())) * threshold / (2 - threshold)
    pool: set[str] = set()
    for pairs in sorted((*known.values(), *(p for _, p in long.values())), key=lambda p: (len(p), p)):
        pool.update(anchors(pairs, threshold, pool))
    of_units = sorted({word for pairs in known.values() for word in anchors(pairs, threshold, pool)})
    # Each explode is also a barrier: Catalyst evaluates what stands in it once, and pushes no
    # filter through that would evaluate it again.
    lowered = texts(docs, id_col, text_col).select("id", F.explode(F.array(F.lower("text"))).alias("low"))
    near = lowered.filter(reduce(or_, [F.contains("low", F.lit(word)) for word in sorted(pool)]))
    lined = near.select("id", F.explode(F.array(F.transform(F.split("low", "\n", -1), lambda x: F.split(normal(x), " ")))).alias("lines"))
    worded = lined.select("id", "lines", F.explode(F.array(F.filter(F.flatten("lines"), lambda w: w != ""))).alias("words"))
    template = "struct<license:string,n:int,pairs:array<string>,anchors:array<string>>"
    unit = lambda number, words: F.struct(number.cast("long").alias("unit"), words.alias("words"), F.lit(None).cast(template).alias("t"))
    units = F.concat(F.transform("lines", lambda x, i: unit(i + 1, x)), F.when(F.size("lines") > 1, F.array(unit(F.lit(0), F.col("words")))).otherwise(F.array()))
    units = F.filter(units, lambda u: (F.size(u["words"]) - 1 >= fewest) & F.arrays_overlap(u["words"], literals(of_units)))
    wide = []
    for name, (n, pairs) in long.items():
        own = literals(anchors(pairs, threshold, pool))
        t = F.struct(F.lit(name).alias("license"), F.lit(n).alias("n"), literals(pairs).alias("pairs"), own.alias("anchors")).cast(template)
        wide.append(F.when((F.size("words") > 1) & F.arrays_overlap("words", own), F.struct(F.lit(0).cast("long").alias("unit"), F.col("words").alias("words"), t.alias("t"))))
    both = F.concat(units, F.filter(F.array(*wide), lambda c: c.isNotNull())) if wide else units
    one = worded.select("id", F.explode(both).alias("c")).select("id", "c.unit", "c.words", "c.t")
    paired = one.select("*", F.explode(F.array(F.when(F.col("t").isNull(), word_bigrams(F.col("words"))))).alias("pairs"))
    found = F.when(F.col("t").isNull(), _best_of_unit(known, threshold)).otherwise(_best_window(threshold))
    return paired.select(F.col("id").alias(id_col), F.explode(found).alias("f")).select(id_col, "f.unit", "f.license", "f.dice")


def _found(unit: Column, license_: Column, dice: Column) -> Column:
    return F.struct(unit.alias("unit"), license_.alias("license"), dice.alias("dice"))


def _best_of_unit(known: dict[str, list[str]], threshold: float) -> Column:
    """The best template for the unit with bigrams ``pairs``, if one reaches the threshold."""
    scored, ratio, size = [], threshold / (2 - threshold), F.size("pairs")
    for name, pairs in known.items():
        fits = (size >= len(pairs) * ratio) & (size <= len(pairs) / ratio)
        dice = 2.0 * F.size(F.array_intersect("pairs", literals(pairs))) / (size + len(pairs))
        scored.append(F.when(fits, _found(F.col("unit"), F.lit(name), dice)))
    reach = F.filter(F.array(*scored), lambda s: s.isNotNull() & (s["dice"] >= threshold))
    best = F.array_sort(reach, lambda a, b: F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1).when(a["license"] < b["license"], -1).otherwise(1))
    return F.slice(best, 1, 1)


def _best_window(threshold: float) -> Column:
    """The best window of the long template ``t`` in ``words``, if one reaches the threshold."""
    n, step = F.col("t.n"), F.greatest(F.lit(1), F.floor(F.col("t.n") / STEPS).cast("int"))
    last = F.greatest(F.lit(1), F.size("words") - n + 1)
    # Steps that hold an anchor, and the starts whose windows reach one of them.
    held = F.array_distinct(F.transform("words", lambda w, i: F.when(F.array_contains(F.col("t.anchors"), w), F.floor(i / step).cast("int"))))
    reaching = F.transform(F.filter(held, lambda j: j.isNotNull()), lambda j: F.sequence(F.greatest(F.lit(0), j - F.ceil(n / step).cast("int")), j))
    starts = F.filter(F.transform(F.array_distinct(F.flatten(reaching)), lambda j: j * step + 1), lambda at: at < last)

    def score(at: Column) -> Column:
        own = word_bigrams(F.slice("words", at, n))
        return F.struct((2.0 * F.size(F.array_intersect(own, F.col("t.pairs"))) / (F.size(own) + F.size("t.pairs"))).alias("dice"), (-at).cast("long").alias("unit"))

    best = F.array(F.array_max(F.transform(F.concat(starts, F.array(last)), score)))
    return F.transform(F.filter(best, lambda b: b["dice"] >= threshold), lambda b: _found(b["unit"], F.col("t.license"), b["dice"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the licence notices of all documents."""
    return scan(table(spark, sf_dir, "documents"))


def oracle(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    listed = lambda pairs: f"[{', '.join(repr(b) for b in pairs)}]"
    known = ", ".join(f"('{k}', {listed(bigrams(v))})" for k, v in sorted((templates or TEMPLATES).items()))
    long = ", ".join(f"('{k}', {len(words_of(v))}, {listed(bigrams(v))})" for k, v in long_templates(templates).items()) or "('', 2, [''])"
    return rf"""
WITH templates(license, pairs) AS (VALUES {known}),
     long(license, n, pairs) AS (VALUES {long}),
     units AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS unit, unnest(l) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
               UNION ALL SELECT doc_id, 0, text FROM documents WHERE contains(text, chr(10))),
     worded AS (SELECT doc_id, unit, list_filter(string_split(regexp_replace(lower(text), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM units),
     sets AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pairs FROM worded WHERE len(w) > 1),
     scored AS (SELECT doc_id, unit, license, 2.0::DOUBLE * len(list_intersect(s.pairs, t.pairs)) / (len(s.pairs) + len(t.pairs)) AS dice FROM sets s, templates t WHERE len(s.pairs) <= 1.5 * len(t.pairs) + 1),
     flat AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split(regexp_replace(lower(text), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM documents),
     starts AS (SELECT r, doc_id, w, license, n, pairs, greatest(1, len(w) - n + 1) AS last FROM flat, long WHERE len(w) > 1 AND len(list_intersect(w, string_split(array_to_string(pairs, ' '), ' '))) > 1),
     windows AS (SELECT r, doc_id, license, pairs, w[p:p + n - 1] AS w, p FROM (SELECT *, unnest(list_distinct(list_append(range(1, last + 1, greatest(1, n // {STEPS})), last))) AS p FROM starts)),
     runs AS (SELECT r, doc_id, license, pairs, p, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS own FROM windows),
     best AS (SELECT r, doc_id, license, p, 2.0::DOUBLE * len(list_intersect(own, pairs)) / (len(own) + len(pairs)) AS dice FROM runs)
(SELECT doc_id, CAST(unit AS BIGINT) AS unit, license, dice FROM scored WHERE dice >= {threshold}
QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license) = 1)
UNION ALL
(SELECT doc_id, CAST(-p AS BIGINT), license, dice FROM best WHERE dice >= {threshold}
QUALIFY row_number() OVER (PARTITION BY r, license ORDER BY dice DESC, p) = 1)
"""
