"""op1: notices that are no template, and prose that is no notice."""
from postlens.llm import licenses, queries
from sample_paths import SF_SMALL

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""
NOTICES = [
    ("gpl", "Distributed under the GPL"), ("gpl", "GPLv2"), ("mit", "This file is MIT licensed"), ("mit", "Published under the MIT licence"),
    ("agpl", "licensed under the GNU Affero General Public License, version 3 or later"), ("isc", "Licensed under the ISC license."),
    ("epl", "made available under the terms of the Eclipse Public License v2.0"), ("cc0", "Released under CC0 1.0 Universal"),
    ("boost", "Boost Software License - Version 1.0"), ("lgpl", "under the terms of the GNU Lesser General Public License, version 3"),
    ("apache", "This file is under the Apache License, Version 2.0"), ("bsd", "governed by a BSD-style license"), ("mit", MIT),
    ("mit", "prose stands here\n\n" + MIT + "\n\nand here"), ("proprietary", "Copyright 2020 by them. All rights reserved."),
    ("other", "Licensed under the Frobnicator Public License."),
]
PROSE = ["the plate of a car", "mit der licht von haus", "you may copy the general idea of public service", "a version of the work by the author", "", None]


def test_notices_and_prose(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    texts = [t for _, t in NOTICES] + PROSE
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {}
    for r in licenses.scan(docs.union(more)).filter("doc_id >= 1000000").collect():
        got.setdefault(r.doc_id - 10**6, []).append((r.family, r.paragraph, r.lines))
    named = {i: {f for f, _, _ in got.get(i, [])} for i in range(len(texts))}
    missed = [(c, t, named[i]) for i, (c, t) in enumerate(NOTICES) if c not in named[i]]
    wrong = [(texts[i], f) for i, f in named.items() if i >= len(NOTICES) and f]
    print(missed, wrong)
    assert not wrong and len(missed) <= 2 and all(not f - {c} for (c, _), f in zip(NOTICES, named.values(), strict=False))


def test_only_license_lines_of_the_documents(spark):
    rows = queries.op1_licenses(spark, SF_SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    lines = [(r.family, r.confirmed, texts[r.doc_id].split("\n")[r.paragraph:][:1]) for r in rows]
    print(lines[:10])
    assert rows and all(any(k in x[0].lower() for k in ("licen", "rights reserved", "permission")) for _, _, x in lines)
