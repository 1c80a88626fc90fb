import re

from pyspark.sql import functions as F

from lexweft.llm.licenses import gate, rules, scan


def _slow(text, own):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    joined = "".join(f" {w} " for w in words) or "  "
    spans = []
    for i, r in enumerate(own):
        for m in re.finditer(r.pattern, joined):
            spans.append((joined[: m.start()].count(" ") // 2, (joined[: m.end()].count(" ")) // 2, i, r))
    kept = []
    for a, b, i, r in spans:
        inside = any(
            y.priority >= r.priority and c <= a and d >= b and (c < a or d > b or y.priority > r.priority or j < i) for c, d, j, y in spans
        )
        if r.base or not inside:
            kept.append((a, b, r.label, r.base))
    return len(words), sorted(kept)


TEXTS = [
    None, "", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.",
    "cc by nc cc-by-nc CC BY NC", "under the mit license under the MIT license", "This work is licensed under the GNU General Public License, version 3.",
    "SPDX-License-Identifier: GPL-3.0-only", "mitéunder the mit license", "éunder the mit license", "Under\x00the\x7fMIT--license",
    "cc by nc sa 4.0 and CC BY 4.0", "nothing at all", "the unlicense https://www.gnu.org/licenses/gpl", "word " * 20000 + "mit license",
    "subject to the Mozilla Public License Version 2.0 or Apache-2.0 License: BSD-3-Clause", "mit lizenz " * 10, "0BSD İ K under THE mit license",
]


def test_detections_are_brute_force(spark):
    own = rules()
    assert len(own) > 200
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    for r in scan(df).collect():
        n, kept = _slow(TEXTS[r.doc_id] or "", own)
        assert r.n_words == n and sorted((s.start, s.stop, s.label, s.base) for s in r.detections) == kept, TEXTS[r.doc_id]
    assert scan(df.limit(0)).count() == 0
    same = spark.createDataFrame([(None, TEXTS[2])] * 2, "doc_id long, text string")
    assert [r.n for r in scan(same).select(F.size("detections").alias("n")).collect()] == [2, 2]


def test_gate_lets_every_rule_through():
    shut = re.compile(gate(rules()))
    for r in rules():
        sample = " ".join(w.strip() for w in r.words) + (" license" if r.anchor == "licen" else "")
        assert shut.search(sample), r


BODIES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that",
    "bsd-3": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived",
    "gpl-3": "the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3": "GNU Affero General Public License as published by",
    "eupl": "European Union Public Licence",
    "cc0": "To the extent possible under law, Jo Doe has waived all copyright and related or neighboring rights",
    "postgresql": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted",
}


def test_bodies_and_names_without_version(spark):
    more = {"agpl-3": ["the GNU AGPL applies", "GNU AGPL v3"], "mit": ["see opensource.org/license/mit", "opensource.org/licenses/mit"], "gpl-2": ["GPL v2"], "lgpl-3": ["gnu lesser general public license v3"]}
    rows = [*BODIES.items(), *((k, t) for k, ts in more.items() for t in ts)]
    df = spark.createDataFrame(rows, "label string, text string")
    for r in scan(df).collect():
        assert r.label in {s.label for s in r.detections}, r.text


def _gnu(name, version, what="program"):
    return (
        f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; "
        f"either version {version} of the License, or (at your option) any later version.\n\nThis {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY. "
        f"See the GNU {name} for more details.\n\nYou should have received a copy of the GNU {name} along with this {what}."
    )


#: Usual notices, and all that they are to be labelled.
NOTICES = (
    (_gnu("General Public License", "2"), ["gpl", "gpl-2"]),
    (_gnu("General Public License", "3"), ["gpl", "gpl-3"]),
    (_gnu("Library General Public License", "2", "library"), ["lgpl", "lgpl-2"]),
    (_gnu("Lesser General Public License", "2.1", "library"), ["lgpl", "lgpl-2"]),
    (_gnu("Lesser General Public License", "3", "library"), ["lgpl", "lgpl-3"]),
    (_gnu("Affero General Public License", "3"), ["agpl-3"]),
    ("either version 3 of the License, or (at your option) any later version", []),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution", ["epl-1"]),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v 1.0", ["epl-1"]),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", ["epl-2"]),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", ["epl-2"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["mpl-2"]),
)


def test_notices_have_their_own_labels_only(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NOTICES)], "i int, text string")
    got = {r.i: sorted({s.label for s in r.detections}) for r in scan(df).collect()}
    assert [got[i] for i in range(len(NOTICES))] == [want for _, want in NOTICES]


def test_each_name_is_found_with_and_without_optional_words(spark):
    from lexweft.llm.licenses import LICENSES

    simple = lambda w: w.replace("[cs]", "s").replace("(?:data|database)", "data").replace("(?:lesser|library)", "lesser")
    rows = []
    for label, names, _, _ in LICENSES:
        for name in names:
            parts = [simple(w) for w in name.split(" ")]
            plain = lambda w: re.sub(r"\[(.)[^]]*\]", r"\1", re.sub(r"(.)\?", r"\1", w.removeprefix("~")))
            rows += [(label, " ".join(map(plain, parts))), (label, " ".join(plain(w) for w in parts if w[0] != "~"))]
    df = spark.createDataFrame(rows, "label string, text string")
    for r in scan(df, [x for x in rules() if x.confidence == 0.6]).collect():
        assert r.label in {s.label for s in r.detections}, (r.label, r.text)


def test_many_matches_take_no_square_time(spark):
    import time

    df = spark.createDataFrame([("the mit license and so on, " * 30_000,)], "text string")
    began = time.time()
    assert scan(df).select(F.size("detections").alias("n")).first().n == 30_000 and time.time() - began < 60
