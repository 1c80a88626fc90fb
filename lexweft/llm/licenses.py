"""License scans by ordered signature rules.

Rules are regexes over words: signatures of license texts and notices, and a
table of licenses whose names, identifiers and addresses stand in the forms in
which texts cite licenses. A rule runs only on texts that hold all of its plain words, and texts that hold
no anchor word of any rule aren't even split into words.

Detections overlap: a notice contains a title, a title may contain another
license's title. They are resolved by interval containment: one that lies
within another of the same or a higher priority is suppressed. Base phrases are
rules of the highest priority that are never suppressed.

DataFrame functions only, all within a document's row, so nothing is shuffled.

Defined results for odd input: a null text is empty, and an empty text has no
words, labels "" and score 0. Null doc_ids are kept, repeated rows stay
repeated, other columns are kept, whatever their names, but for ``n_words`` and
``detections``, which are replaced. A very long text is scanned whole in its row,
in time nearly in proportion to its detections. An empty table gives an empty
result.
"""

import json
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweft.llm.common import ascii_lower, bind, scanned, table

#: Words are runs of ASCII letters and digits and of anything that isn't ASCII; A-Z count as a-z.
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

BASE_PRIORITY = 3
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: label, names, identifiers, addresses; a regex for each word, "~" before it makes the word optional.
LICENSES = (
    ("mit", ("mit licen[cs]es?", "expat licen[cs]e", "mit x11 licen[cs]e"), ("mit",), ("opensource org licenses? mit",)),
    ("mit-0", ("mit no attribution ~licen[cs]e",), ("mit 0",), ("opensource org licenses? mit 0",)),
    ("apache-2", ("apache licen[cs]e ~version v?2 ~0", "apache ~software licen[cs]e v?2 ~0"), ("apache v?2 ~0",), ("apache org licenses license 2 0",)),
    ("apache-1", ("apache ~software licen[cs]e ~version 1 [01]",), ("apache 1 [01]",), ("apache org licenses license 1 [01]",)),
    ("bsd-2", ("bsd 2 clause ~simplified ~licen[cs]e", "simplified bsd licen[cs]e", "freebsd licen[cs]e"), ("bsd 2 clause",), ("opensource org licenses? bsd 2 clause",)),
    ("bsd-3", ("bsd 3 clause ~new ~or ~revised ~licen[cs]e", "new bsd licen[cs]e", "revised bsd licen[cs]e"), ("bsd 3 clause",), ("opensource org licenses? bsd 3 clause",)),
    ("bsd-4", ("bsd 4 clause ~original ~licen[cs]e", "original bsd licen[cs]e"), ("bsd 4 clause",), ("spdx org licenses bsd 4 clause",)),
    ("bsd", ("bsd ~style licen[cs]e",), ("bsd",), ("opensource org licenses? bsd license",)),
    ("gpl-2", ("gnu general public licen[cs]e ~version v?2", "gpl ~version v?2"), ("gpl 2 0", "gplv?2"), ("gnu org licenses old licenses gpl 2 0",)),
    ("gpl-3", ("gnu general public licen[cs]e ~version v?3", "gpl ~version v?3"), ("gpl 3 0", "gplv?3"), ("gnu org licenses gpl 3 0",)),
    ("gpl", ("gnu general public licen[cs]e", "gnu gpl"), ("gpl",), ("gnu org licenses gpl",)),
    ("lgpl-2", ("gnu (?:lesser|library) general public licen[cs]e ~version v?2 ~1",), ("lgpl 2 [01]", "lgplv?2"), ("gnu org licenses old licenses lgpl 2 [01]",)),
    ("lgpl-3", ("gnu lesser general public licen[cs]e ~version v?3",), ("lgpl 3 0", "lgplv?3"), ("gnu org licenses lgpl 3 0",)),
    ("lgpl", ("gnu lesser general public licen[cs]e", "gnu lgpl"), ("lgpl",), ("gnu org licenses lgpl",)),
    ("agpl-3", ("gnu affero general public licen[cs]e ~version ~v?3", "gnu agpl ~v?3"), ("agpl 3 0", "agplv?3"), ("gnu org licenses agpl 3 0",)),
    ("fdl", ("gnu free documentation licen[cs]e ~version ~1 ~[123]",), ("gfdl 1 [123]",), ("gnu org licenses fdl",)),
    ("mpl-1", ("mozilla public licen[cs]e ~version v?1 [01]",), ("mpl 1 [01]",), ("mozilla org mpl 1 [01]",)),
    ("mpl-2", ("mozilla public licen[cs]e ~version v?2 ~0",), ("mpl 2 0",), ("mozilla org mpl 2 0",)),
    ("epl-1", ("eclipse public licen[cs]e ~version v?1 ~0",), ("epl 1 0",), ("eclipse org legal epl v10",)),
    ("epl-2", ("eclipse public licen[cs]e ~version v?2 ~0",), ("epl 2 0",), ("eclipse org legal epl 2 0",)),
    ("eupl", ("european union public licen[cs]e ~version ~v?1 ~[012]",), ("eupl 1 [012]",), ("joinup ec europa eu eupl",)),
    ("cddl", ("common development and distribution licen[cs]e ~version ~1 ~[01]",), ("cddl 1 [01]",), ("opensource org licenses? cddl",)),
    ("isc", ("isc licen[cs]e",), ("isc",), ("opensource org licenses? isc",)),
    ("zlib", ("zlib ~libpng licen[cs]e",), ("zlib",), ("opensource org licenses? zlib",)),
    ("boost", ("boost software licen[cs]e ~version ~1 ~0",), ("bsl 1 0",), ("boost org license 1 0",)),
    ("unlicense", ("the unlicense",), ("unlicense",), ("unlicense org",)),
    ("wtfpl", ("do what the fuck you want to public licen[cs]e",), ("wtfpl",), ("wtfpl net",)),
    ("artistic-2", ("artistic licen[cs]e ~version 2 ~0",), ("artistic 2 0",), ("opensource org licenses? artistic 2 0",)),
    ("python", ("python software foundation licen[cs]e",), ("psf 2 0",), ("python org psf license",)),
    ("ofl", ("sil open font licen[cs]e ~version ~1 ~1",), ("ofl 1 1",), ("scripts sil org ofl",)),
    ("cc0", ("cc0 ~1 ~0 ~universal", "creative commons zero ~1 ~0"), ("cc0 1 0",), ("creativecommons org publicdomain zero",)),
    ("cc-by", ("cc by ~[1234] ~[05]", "creative commons attribution ~[1234] ~[05]"), ("cc by [1234] [05]",), ("creativecommons org licenses by [1234]",)),
    ("cc-by-sa", ("cc by sa ~[1234] ~[05]", "creative commons attribution share alike ~[1234] ~[05]"), ("cc by sa [1234] [05]",), ("creativecommons org licenses by sa",)),
    ("cc-by-nd", ("cc by nd ~[1234] ~[05]", "creative commons attribution no derivatives"), ("cc by nd [1234] [05]",), ("creativecommons org licenses by nd",)),
    ("cc-by-nc", ("cc by nc ~[1234] ~[05]", "creative commons attribution non commercial"), ("cc by nc [1234] [05]",), ("creativecommons org licenses by nc",)),
    ("cc-by-nc-sa", ("cc by nc sa ~[1234] ~[05]",), ("cc by nc sa [1234] [05]",), ("creativecommons org licenses by nc sa",)),
    ("cc-by-nc-nd", ("cc by nc nd ~[1234] ~[05]",), ("cc by nc nd [1234] [05]",), ("creativecommons org licenses by nc nd",)),
    ("odbl", ("open (?:data|database) ~commons ~open ~database licen[cs]e", "open database licen[cs]e"), ("odbl 1 0",), ("opendatacommons org licenses odbl",)),
    ("openrail", ("open rail ~m licen[cs]e", "responsible ai licen[cs]e"), ("openrail",), ("licenses ai",)),
    ("proprietary", ("all rights reserved",), ("licenseref proprietary",), ("all rights reserved copyright",)),
)

#: form, what it takes (0 names, 1 identifiers, 2 addresses), priority, confidence.
FORMS = (
    ("spdx license identifier {}", 1, 2, 1.0),
    ("licensed under ~the ~terms ~of ~the {}", 0, 2, 0.95),
    ("(?:released|distributed|published|available|provided|redistributed) under ~the {}", 0, 2, 0.9),
    ("under ~the terms ~and ~conditions of ~the {}", 0, 2, 0.9),
    ("(?:subject|according|pursuant) to ~the {}", 0, 2, 0.85),
    ("license osi approved {}", 0, 2, 0.95),
    ("licen[cs]e ~(?:type|id|name|info) {}", 1, 1, 0.8),
    ("~https? ~www {}", 2, 1, 0.9),
    ("{}", 0, 0, 0.6),
)

#: Phrases of license texts and notices: label, words (as above), confidence. Fixed values of those texts.
SIGNATURES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 1.0),
    ("mit", "the above copyright notice and this permission notice ~(?:including) ~the ~next ~paragraph shall be included in all copies or substantial portions of the software", 0.95),
    ("mit-0", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided", 1.0),
    ("x11", "except as contained in this notice the name of the x consortium shall not be used in advertising", 1.0),
    ("json", "the software shall be used for good not evil", 1.0),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 0.95),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.9),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", 0.9),
    ("bsd-3", "neither the names? of .{1,120}? nor the names of its contributors may be used to endorse or promote products", 1.0),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1.0),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", 1.0),
    ("isc", "permission to use copy modify and ~or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", 1.0),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 1.0),
    ("apache-2", "you may not use this file except in compliance with the license", 0.9),
    ("apache-2", "terms and conditions for use reproduction and distribution", 0.85),
    ("apache-1", "this product includes software developed by the apache (?:software foundation|group)", 0.9),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", 0.95),
    ("gpl-2", "gnu general public licen[cs]e as published by the free software foundation ~inc ~either version 2 of the licen[cs]e", 1.0),
    ("gpl-3", "gnu general public licen[cs]e as published by the free software foundation ~inc ~either version 3 of the licen[cs]e", 1.0),
    ("gpl-2", "gnu general public licen[cs]e version 2 june 1991", 1.0),
    ("gpl-3", "gnu general public licen[cs]e version 3 29 june 2007", 1.0),
    ("gpl", "you should have received a copy of the gnu general public licen[cs]e along with this program", 0.9),
    ("gpl", "linking this library statically or dynamically with other modules is making a combined work", 0.9),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e", 0.95),
    ("lgpl-2", "gnu (?:lesser|library) general public licen[cs]e as published by the free software foundation ~inc ~either version 2 ~1 of the licen[cs]e", 1.0),
    ("lgpl-3", "gnu lesser general public licen[cs]e as published by the free software foundation ~inc ~either version 3 of the licen[cs]e", 1.0),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with this (?:library|program)", 0.9),
    ("agpl-3", "under the terms of the gnu affero general public licen[cs]e as published by the free software foundation", 1.0),
    ("agpl-3", "you should have received a copy of the gnu affero general public licen[cs]e", 0.95),
    ("fdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", 1.0),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", 1.0),
    ("mpl-1", "the contents of this file are subject to the mozilla public licen[cs]e version 1 [01]", 1.0),
    ("npl", "the contents of this file are subject to the netscape public licen[cs]e", 1.0),
    ("epl-1", "made available under the terms of the eclipse public licen[cs]e (?:v1|v 1|version 1) 0", 1.0),
    ("epl-2", "made available under the terms of the eclipse public licen[cs]e (?:v2|v 2|version 2|2) 0", 1.0),
    ("cpl-1", "common public licen[cs]e version? 1 0", 0.95),
    ("cddl", "subject to the terms of the common development and distribution licen[cs]e", 1.0),
    ("eupl", "licen[cs]ed under the eupl", 0.95),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 1.0),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 0.95),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 1.0),
    ("unlicense", "this is free and unencumbered software released into the public domain", 1.0),
    ("wtfpl", "you just do what the fuck you want to", 1.0),
    ("beerware", "the beer ware licen[cs]e", 0.95),
    ("beerware", "you can buy me a beer in return", 0.9),
    ("public-domain", "(?:released|placed|dedicated|put) (?:in|into|in to|to) the public domain", 0.85),
    ("public-domain", "this (?:work|file|code|software) is in the public domain", 0.85),
    ("cc0", "to the extent possible under law .{1,120}? has waived all copyright and related or neighboring rights", 1.0),
    ("cc-by", "you are free to share copy and redistribute the material in any medium or format", 0.85),
    ("cc-by", "you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made", 0.9),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e as the original", 0.95),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material", 0.95),
    ("cc-by-nc", "you may not use the material for commercial purposes", 0.95),
    ("artistic-2", "this package is free software you can redistribute it and or modify it under the terms of the artistic licen[cs]e", 0.95),
    ("perl", "under the same terms as perl itself", 0.95),
    ("python", "psf is making python available to licensee on an as is basis", 1.0),
    ("php", "this source file is subject to version 3 ~0?1 of the php licen[cs]e", 1.0),
    ("ruby", "you may make and give away verbatim copies of the source form of the software without restriction", 0.9),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 1.0),
    ("openssl", "this product includes software developed by the openssl project", 1.0),
    ("ncsa", "university of illinois ncsa open source licen[cs]e", 1.0),
    ("ofl", "this font software is licen[cs]ed under the sil open font licen[cs]e", 1.0),
    ("ms-pl", "microsoft public licen[cs]e", 0.95),
    ("ms-rl", "microsoft reciprocal licen[cs]e", 0.95),
    ("odbl", "you are free to (?:copy distribute and use|share) the database", 0.9),
    ("elastic-2", "you may not provide the software to third parties as a hosted or managed service", 1.0),
    ("sspl", "server side public licen[cs]e", 0.95),
    ("busl", "business source licen[cs]e 1 1", 1.0),
    ("commons-clause", "commons clause licen[cs]e condition", 1.0),
    ("llama", "llama ~[0-9]+ ~[0-9]+ community licen[cs]e agreement", 1.0),
    ("openrail", "attachment a use restrictions you agree not to use the model", 0.95),
    ("proprietary", "proprietary and confidential", 0.85),
    ("proprietary", "confidential and proprietary", 0.85),
    ("proprietary", "unauthori[sz]ed (?:copying|reproduction|distribution) of this (?:file|document|software) .{0,60}? is strictly prohibited", 0.95),
    ("proprietary", "no part of this (?:publication|book|document) may be reproduced", 0.95),
)

#: Words that never serve as anchors while a rule has another one.
COMMON = {"to", "under", "of", "terms", "the", "all", "new", "open", "public"}


class Rule(NamedTuple):
    """``words``: those that a text must hold for ``pattern`` to match; ``anchor``: what it is asked for first."""

    label: str
    pattern: str
    priority: int
    confidence: float
    base: bool
    words: tuple[str, ...]
    anchor: str


def _rule(phrase: str, label: str, priority: int, confidence: float, base: bool = False) -> Rule:
    # In the text a word is written with a blank on either side, so neighbours are two blanks apart.
    parts, words, known = [], [], False
    # Blanks within a group are between words as well.
    for t in re.findall(r"(?:\([^)]*\)|\S)+", phrase):
        optional, core = t[0] == "~", t.removeprefix("~").replace(" ", "  ")
        parts.append(f"(?: {core} )?" if optional else f" {core} ")
        if not optional and core.isalnum():
            words.append(f" {core} ")
        known |= not optional and core.startswith("licen")
    anchor = "licen" if known else max((w.strip() for w in words), key=lambda w: (w not in COMMON, len(w)))
    return Rule(label, "".join(parts), priority, confidence, base, tuple(words), anchor)


def rules() -> list[Rule]:
    """All rules in order: base phrases, signatures of texts and notices, then each license in each form."""
    out = [_rule(phrase, label, BASE_PRIORITY, 1.0, True) for phrase, label in BASE_PHRASES]
    out += [_rule(phrase, label, BASE_PRIORITY - 1, confidence) for label, phrase, confidence in SIGNATURES]
    for label, *kinds in LICENSES:
        for form, kind, priority, confidence in FORMS:
            out += [_rule(form.format(x), label, priority, confidence) for x in kinds[kind]]
    return out


def gate(own: list[Rule]) -> str:
    """A regex over lower-cased text that any text must match which some rule matches."""
    words = sorted({r.anchor for r in own} - {"licen"})
    return "licen|(?<![a-z0-9])(?:" + "|".join(words) + ")(?![a-z0-9])"


def normalised(text: Column) -> Column:
    """The words of ``text``, each with a blank on either side."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(ascii_lower(text), NO_WORD, "  "), F.lit(" ")), F.lit(" "))


def _n_words(s: Column) -> Column:
    return F.floor((F.char_length(s) - F.char_length(F.replace(s, F.lit(" "), F.lit("")))) / 2).cast("int")


SPAN = "struct<start: int, stop: int, rule: int, label: string, priority: int, confidence: double, base: boolean>"


def _spans(text: Column, rule: Column) -> Column:
    """Matches of ``rule`` as spans of words."""
    parts = F.arrays_zip(
        F.split(text, rule["pattern"]).alias("gap"), F.regexp_extract_all(text, rule["pattern"], F.lit(0)).alias("match")
    )
    sized = F.transform(F.filter(parts, lambda p: p["match"].isNotNull()), lambda p: F.struct(_n_words(p["gap"]).alias("gap"), _n_words(p["match"]).alias("match")))

    def span(part, before):
        start = before + part["gap"]
        return F.struct(
            start.alias("start"), (start + part["match"]).alias("stop"), rule["no"].alias("rule"), rule["label"].alias("label"),
            rule["priority"].alias("priority"), rule["confidence"].alias("confidence"), rule["base"].alias("base"),
        )

    return bind(sized, lambda all_: F.zip_with(all_, scanned(F.transform(all_, lambda p: p["gap"] + p["match"]), F.lit(0), lambda a, b: a + b), span))


def _unsuppressed(spans: Column) -> Column:
    """Drops spans within another one of the same or a higher priority, in one sweep from the left, wider ones first."""
    ordered = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("wide"), (-s["priority"]).alias("low"), s["rule"].alias("rule"), s.alias("span")),
        )
    )
    reach = [f"r{p}" for p in range(BASE_PRIORITY + 1)]  # how far spans of priority p or higher have come
    zero = F.struct(*[F.lit(-1).alias(r) for r in reach])
    own = lambda x: F.struct(*[F.when(x["span"]["priority"] >= p, x["span"]["stop"]).otherwise(-1).alias(r) for p, r in enumerate(reach)])
    further = lambda a, b: F.struct(*[F.greatest(a[r], b[r]).alias(r) for r in reach])

    def kept(item, before):
        s, by = item["span"], F.lit(-1)
        for p, r in enumerate(reach):
            by = F.when(s["priority"] == p, before[r]).otherwise(by)
        return F.when(s["base"] | (by < s["stop"]), s)

    return bind(ordered, lambda all_: F.array_compact(F.zip_with(all_, scanned(F.transform(all_, own), zero, further), kept)))


def scan(docs: DataFrame, table_of_rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with ``n_words`` and ``detections``, the spans (in words) that remain."""
    own = rules() if table_of_rules is None else table_of_rules
    listed = [
        {"no": i, "label": r.label, "pattern": r.pattern, "priority": r.priority, "confidence": r.confidence, "base": r.base, "words": r.words}
        for i, r in enumerate(own)
    ]
    shape = "array<struct<no: int, label: string, pattern: string, priority: int, confidence: double, base: boolean, words: array<string>>>"
    known = F.from_json(F.lit(json.dumps(listed)), shape)
    text = F.coalesce("text", F.lit(""))
    held = F.regexp_like(F.lower(text), F.lit(gate(own)))
    found = bind(
        normalised(text),
        lambda words: _unsuppressed(
            F.flatten(
                F.transform(
                    F.filter(known, lambda r: F.forall(r["words"], lambda w: F.contains(words, w)) & F.regexp_like(words, r["pattern"])),
                    lambda r: _spans(words, r),
                )
            )
        ),
    )
    none = F.expr(f"cast(array() AS array<{SPAN}>)")
    return docs.select(
        *[c for c in docs.columns if c not in ("n_words", "detections")],
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
        F.when(held, found).otherwise(none).alias("detections"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("base", F.filter("detections", lambda s: s["base"]))
    starts = F.transform("base", lambda s: s["start"].cast("long"))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels("base").alias("base_labels"),
        labels("detections").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda s: s["confidence"])), F.lit(0.0)).alias("score"),
    )


def _oracle() -> str:
    """The same rules in DuckDB, suppression by NOT EXISTS."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    own = rules()
    values = ",\n".join(
        f"({i}, {quoted(r.label)}, {quoted(r.pattern)}, {r.priority}, {r.confidence}, {str(r.base).lower()}, [{', '.join(map(quoted, r.words))}]::VARCHAR[])"
        for i, r in enumerate(own)
    )
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, ' ' || trim(regexp_replace(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '{NO_WORD}', '  ', 'g'), ' ') || ' ' AS words FROM documents
), r(no, label, pattern, priority, confidence, base, need) AS (VALUES {values}),
p AS (
  SELECT id, r.* EXCLUDE (need), words FROM d JOIN r
  ON len(list_filter(need, lambda w: NOT contains(words, w))) = 0 AND regexp_matches(words, pattern)
), m AS (
  SELECT * EXCLUDE (words), regexp_extract_all(words, pattern) AS ms, string_split_regex(words, pattern) AS gaps FROM p
), u AS (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM m),
t AS (
  SELECT *, (length(a) - length(replace(a, ' ', ''))) // 2 AS start,
         (length(ms[k]) - length(replace(ms[k], ' ', ''))) // 2 AS n
  FROM (SELECT *, array_to_string(gaps[:k], '') || array_to_string(ms[:k-1], '') AS a FROM u)
), s AS (
  SELECT id, no, label, priority, confidence, base, start, start + n AS stop FROM t
), kept AS (
  SELECT * FROM s x WHERE base OR NOT EXISTS (
    SELECT 1 FROM s y WHERE y.id = x.id AND y.priority >= x.priority AND y.start <= x.start AND y.stop >= x.stop
    AND (y.start < x.start OR y.stop > x.stop OR y.priority > x.priority OR y.no < x.no))
)
SELECT any_value(doc_id) AS doc_id,
       any_value(len(regexp_extract_all(words, '[^ ]+')))::BIGINT AS n_words,
       count(*) FILTER (base) AS n_base,
       min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS labels,
       coalesce(max(confidence), 0)::DOUBLE AS score
FROM d LEFT JOIN kept USING (id) GROUP BY id
"""


QUERIES = {"op8_licenses": op8_licenses}
ORACLES = {"op8_licenses": _oracle()}
