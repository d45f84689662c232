"""Licence scans by a trained paragraph classifier (operator 1, DataFrame functions
only on the rows' path).

A multinomial logistic regression with an L1 penalty over word 1- and 2-grams
tells licence families apart, and from unknown text.  It is fitted by Spark on
windows of the families' templates with words dropped and foreign words put in
(made on the driver), and on the lines of all texts as unknown text, but those that
contain a template's words or a family's name.  The fit follows one half of the
different unknown lines; those of the other half that hold a rare word or pair (see below) set
the probability from which a family is named, so that at most one in a thousand of that half gets
one (but 0.99 at most, and 0.5 at least).

A prediction is confirmed by comparison with the family's templates: the share of
2-grams in common, of the shorter of paragraph and template.

Every line of every whole text is a paragraph, and so is every block of lines up to a
blank line, for notices wrapped over lines; a block is named only if none of its lines is.
A paragraph is unknown without looking further if each word and 2-gram that it shares
with a template or a notice frame is one that ordinary text has as well (more than one in a
thousand lines).  ``other`` is a notice of a family that is not listed.

Results are the paragraphs with a family.  Null and empty texts have none; repeated rows
give their rows again; null ids and clashing extra columns do not matter.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from .common import cut_lineage

WORD = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"

#: Usual notices of each family (fixed values).
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Distributed under the Apache 2.0 license.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "SPDX-License-Identifier: MIT",
        "MIT licensed.",
        "Under the MIT license, see LICENSE.",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Distributed under the BSD license.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Released under the GPL.",
        "License: GPLv2 or later",
        "License: GPLv3",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "Released under the AGPL.",
        "License: AGPLv3",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Released under the LGPL.",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "cc0": [
        "Dedicated to the public domain under the Creative Commons CC0 1.0 Universal dedication.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "proprietary": [
        "Copyright. All rights reserved. No part of this work may be reproduced without the prior written permission of the publisher.",
        "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
UNKNOWN, OTHER = "unknown", "other"
#: Different lines of a task of the fit.
_LINES = 20_000
#: Usual names of each family (fixed values); they stand alone or in frames.
NAMES = {
    "apache": ["Apache", "Apache 2.0", "Apache License", "Apache-2.0"],
    "mit": ["MIT", "MIT License", "MIT licensed"],
    "bsd": ["BSD", "BSD License", "BSD-style license", "BSD-2-Clause", "BSD 3-Clause"],
    "gpl": ["GPL", "GNU General Public License", "GPLv2", "GPLv3", "GNU GPL"],
    "agpl": ["AGPL", "GNU Affero General Public License", "AGPLv3", "GNU AGPL"],
    "lgpl": ["LGPL", "GNU Lesser General Public License", "LGPLv2.1", "LGPLv3", "GNU LGPL"],
    "mpl": ["MPL", "Mozilla Public License", "MPL 2.0"],
    "isc": ["ISC", "ISC License"],
    "epl": ["EPL", "Eclipse Public License", "EPL 2.0"],
    "boost": ["Boost Software License", "Boost License"],
    "cc0": ["CC0", "CC0 1.0 Universal", "CC0 1.0"],
    "unlicense": ["Unlicense"],
    "cc-by": ["CC BY", "CC BY 4.0", "Creative Commons Attribution"],
    "cc-by-sa": ["CC BY-SA", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike"],
    "cc-by-nc": ["CC BY-NC", "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial"],
    "proprietary": ["All rights reserved"],
}
#: Frames of notices (fixed values); a name of foreign words fills the gap of an unlisted family.
FRAMES = ["Licensed under the {} License.", "Released under the {} license, version 2.", "This work is licensed under the terms of the {} license.",
          "Distributed under the {} Public License.", "SPDX-License-Identifier: {}"]


def _words(text: str) -> list[str]:
    return re.findall(WORD, text.lower().replace("licence", "license"))


def _grams(words: list[str]) -> set[str]:
    return {*words, *map(" ".join, zip(words, words[1:], strict=False))}


def _line_words(text):
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("licence"), F.lit("license")), F.lit(WORD), F.lit(0))


def _pairs_of(w: str):
    return F.array_distinct(F.zip_with(F.expr(f"slice({w}, 1, greatest(size({w}) - 1, 0))"), F.expr(f"slice({w}, 2, greatest(size({w}) - 1, 0))"),
                                       lambda a, b: F.concat_ws(" ", a, b)))


def _literals(grams):
    return F.array(*map(F.lit, sorted(grams)))


def _any(conditions):
    return reduce(lambda a, b: a | b, conditions)


def line_vectors(docs: DataFrame, grams: list[str], templates: list[list[str]]) -> DataFrame:
    """(found, n): the ``grams`` of each line of every text that holds a word and shares less than
    0.3 of its pairs with each template; equal ones are one row."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select(F.inline(F.array(F.struct(_line_words("line").alias("words"))))).filter("size(words) > 0")
    lines = lines.select(F.inline(F.array(F.struct(F.col("words"), _pairs_of("words").alias("pairs")))))
    single, double = [g for g in grams if " " not in g], [g for g in grams if " " in g]
    found = F.struct(F.filter(F.array_distinct("words"), lambda w: w.isin(single)).alias("words"), F.filter("pairs", lambda p: p.isin(double)).alias("pairs"), F.size("pairs").alias("size"))
    lines = lines.select(F.inline(F.array(found)))

    def near(t: list[str]):
        return F.size(F.filter("pairs", lambda p: p.isin(t))) >= 0.3 * F.greatest(F.least(F.col("size"), F.lit(len(t))), F.lit(1))
    own = [t for t in ([*_grams(x) - set(x)] for x in templates) if t]
    lines = lines.filter(F.when(F.size("pairs") > 0, ~_any(map(near, own))).otherwise(True))
    return lines.groupBy(F.array_sort(F.concat("words", "pairs")).alias("found")).agg(F.count("*").alias("n"))


def train(docs: DataFrame, seed: int = 5, variants: int = 40, penalty: float = 1e-4, steps: int = 100):
    """(classes, grams, weights, bias, bar, anchors) from the templates and the lines of all texts."""
    import numpy as np
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel
    from pyspark.ml.functions import vector_to_array

    spark, rng = docs.sparkSession, np.random.default_rng(seed)
    classes = [UNKNOWN, *TEMPLATES, OTHER]
    known = [(_words(t), classes.index(c)) for c, ts in TEMPLATES.items() for t in ts]
    frames = [_words(f.replace("{}", " ")) for f in FRAMES]
    named = [(_words(f.replace("{}", n)), classes.index(c)) for c, names in NAMES.items() for n in names for f in ["{}", *FRAMES]]
    grams = sorted({g for w in [*(w for w, _ in known), *(w for w, _ in named), *frames] for g in _grams(w)})
    vectors = cut_lineage(line_vectors(docs, grams, [w for w, _ in known]))

    # Words and pairs that hardly any line has, by the counts of all lines.
    total, different = vectors.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    counts = {r.g: r.n for r in vectors.select(F.explode("found").alias("g"), "n").groupBy("g").agg(F.sum("n").alias("n")).collect()}
    usual = {g for g, n in counts.items() if n >= 1e-3 * total}     # "mit" alone is a German word
    rare = set(grams) - usual
    anchors = [g for g in rare if " " not in g or not rare & set(g.split())]
    # A line with a family's whole name is no unknown text, unless the name is usual in it.
    names = [x for x in ([*_grams(w) - set(w)] or w for w in (_words(n) for ns in NAMES.values() for n in ns)) if rare & set(x)]
    unknown = vectors.filter(~_any([F.size(F.array_except(_literals(x), "found")) == 0 for x in names])) if names else vectors

    # Foreign words: those of the table by the number of lines that hold them, and "?", which no gram has.
    words = ["?", *(g for g in grams if " " not in g)]
    often = np.array([0, *(counts.get(g, 0) for g in words[1:])], float)
    often[0] = max(often.sum(), 1)
    often /= often.sum()
    rows, marks = [], []
    for w, c in known:
        for v in range(variants):
            n = len(w) if v % 2 == 0 else max(4, int(rng.integers(len(w) // 2, len(w) + 1)))
            at = int(rng.integers(0, len(w) - min(n, len(w)) + 1))
            part = [x for x in w[at:at + n] if v < 2 or rng.random() > 0.05]
            extra = list(rng.choice(words, int(rng.integers(0, 12)), p=often)) if v % 3 == 2 else []
            rows.append(extra[:len(extra) // 2] + part + extra[len(extra) // 2:])
            marks.append(c)
    for v in range(variants * 2):       # names that no template has
        rows.append(_words(FRAMES[v % len(FRAMES)].replace("{}", " foreign " * int(rng.integers(1, 4)))))
        marks.append(len(classes) - 1)
    named = [(w, c) for w, c in named if not _grams(w) <= usual]
    rows += [w for w, _ in named]
    marks += [c for _, c in named]
    place = set(grams)
    size = np.bincount(marks, minlength=len(classes))
    made = spark.createDataFrame([(sorted(_grams(w) & place), float(c), 1000.0 / int(size[c])) for w, c in zip(rows, marks, strict=True)],
                                 "found array<string>, label double, weight double")
    # Half of the unknown lines fit the model, equal ones on one side; the other half sets the bar.
    unknown = unknown.withColumn("half", F.pmod(F.xxhash64("found"), F.lit(2)))
    mine = unknown.filter("half = 0")
    lines = mine.agg(F.sum("n")).first()[0] or 1
    made = made.union(mine.select("found", F.lit(0.0), F.col("n") * (1000.0 / lines)))
    vectorize = CountVectorizerModel.from_vocabulary(grams, inputCol="found", outputCol="features", binary=True)
    made = made.coalesce(1 + different // _LINES)       # each step goes over all of them
    fit = LogisticRegression(family="multinomial", regParam=penalty, elasticNetParam=1.0, standardization=False, weightCol="weight", maxIter=steps).fit(vectorize.transform(made))
    power = F.array_max(F.slice(vector_to_array("probability"), 2, len(classes) - 1))
    held = unknown.filter("half = 1").filter(F.arrays_overlap("found", _literals(anchors)) if anchors else F.lit(False))    # no other line can be named
    steps = fit.transform(vectorize.transform(held)).select(F.floor(power * 10000).alias("p"), "n").filter("p >= 5000").groupBy("p").agg(F.sum("n").alias("n")).collect()
    bar, left = 0.5, (unknown.filter("half = 1").agg(F.sum("n")).first()[0] or 0) / 1000
    for r in sorted(steps, key=lambda r: -r.p):
        left -= r.n
        if left < 0:
            bar = min(0.99, (r.p + 1) / 10000)
            break
    weights = fit.coefficientMatrix.toArray().T
    keep = np.abs(weights).sum(axis=1) > 0
    return classes, [g for g, k in zip(grams, keep, strict=True) if k], weights[keep], fit.interceptVector.toArray(), bar, sorted(set(anchors))


def scan(docs: DataFrame, match: float = 0.5) -> DataFrame:
    """(doc_id, paragraph, lines, family, probability, template_match, confirmed) of each
    paragraph that gets a family: its first line (from 0) and number of lines."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    classes, grams, weights, bias, bar, anchors = train(docs)

    table = F.from_json(F.lit(json.dumps({g: w for g, w in zip(grams, weights.round(6).tolist(), strict=True)})), "map<string,array<double>>")
    pairs = {c: [sorted(set(map(" ".join, zip(w, w[1:], strict=False)))) for w in map(_words, [*t, *NAMES.get(c, [])])]
             for c, t in {**TEMPLATES, OTHER: [f.replace("{}", " ") for f in FRAMES]}.items()}
    templates = F.from_json(F.lit(json.dumps(pairs)), "map<string,array<array<string>>>")

    # A block ends with a blank line; the lines before it are counted by their breaks.
    blocks = F.split("text", r"(?<=\n)[ \t\r\f]*\n")
    first = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(
        F.element_at(acc, -1) + F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))) + 1)))
    words, pairs_of = _line_words, _pairs_of

    def rare(w, p):
        return F.arrays_overlap(w, F.array(*map(F.lit, [a for a in anchors if " " not in a]))) \
            | F.arrays_overlap(p, F.array(*map(F.lit, [a for a in anchors if " " in a] or [""])))
    # Words are made inside the generators, so that no filter makes them anew.  A line holds
    # no rare word or pair that its block lacks: blocks are looked at first.
    made = F.zip_with(blocks, first, lambda x, i: F.struct(x.alias("block"), i.alias("first"), words(x).alias("bw")))
    rows = docs.select("doc_id", F.inline(made)).filter("block IS NOT NULL").filter(rare(F.col("bw"), pairs_of("bw")))
    lines = F.split("block", "\n")
    units = F.concat(F.transform(lines, lambda x, i: F.struct((F.col("first") + i).alias("paragraph"), F.lit(1).alias("lines"), words(x).alias("words"))),
                     F.array(F.struct(F.col("first").alias("paragraph"), F.size(F.filter(lines, lambda x: F.trim(x) != "")).alias("lines"), F.col("bw").alias("words"))))
    rows = rows.select("doc_id", F.struct("first", F.xxhash64("block").alias("text")).alias("block"), F.posexplode(units).alias("i", "unit"))
    rows = rows.filter("unit.lines > 1 OR i = unit.paragraph - block.first").select("doc_id", "block", "unit.*")
    rows = rows.withColumn("pairs", pairs_of("words")).filter(rare(F.col("words"), F.col("pairs")))
    zero = F.array(*[F.lit(0.0)] * len(classes))
    # One named column a step: each is used more than once by the next.
    start = F.array(*[F.lit(float(x)) for x in bias])
    found = F.array_intersect(F.array_union("words", "pairs"), F.array(*map(F.lit, grams)))
    score = F.aggregate(found, start,
                        lambda acc, g: F.zip_with(acc, F.coalesce(F.try_element_at(table, g), zero), lambda a, b: a + b))
    rows = rows.select("*", F.inline(F.array(F.struct(score.alias("score")))))      # a generator: computed once
    power = F.transform("score", lambda s: F.exp(s - F.array_max("score")))
    rows = rows.select("*", F.inline(F.array(F.struct(power.alias("power")))))
    rows = rows.withColumn("total", F.aggregate("power", F.lit(0.0), lambda a, x: a + x))
    rows = rows.withColumn("probability", F.array_max(F.slice("power", 2, len(classes) - 1)) / F.col("total"))
    rows = rows.filter(F.col("probability") >= bar)
    of_block = Window.partitionBy("doc_id", "block")            # named paragraphs only
    rows = rows.withColumn("least", F.min("lines").over(of_block)).filter("lines = least")
    best = F.array_position(F.slice("power", 2, len(classes) - 1), F.array_max(F.slice("power", 2, len(classes) - 1)))
    rows = rows.withColumn("family", F.element_at(F.array(*map(F.lit, classes[1:])), best.cast("int")))
    common = F.transform(F.try_element_at(templates, F.col("family")),
                         lambda t: F.size(F.array_intersect("pairs", t)) / F.greatest(F.least(F.size("pairs"), F.size(t)), F.lit(1)))
    rows = rows.withColumn("template_match", F.array_max(common))
    return rows.select("doc_id", "paragraph", "lines", "family", F.round("probability", 6).alias("probability"),
                       F.round("template_match", 6).alias("template_match"), (F.col("template_match") >= match).alias("confirmed"))
