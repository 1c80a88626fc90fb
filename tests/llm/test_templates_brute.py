"""Decontamination against a plain-Python search of every window of every item in every document."""

import os
import random
from collections import defaultdict

import pytest
import regex

from lexweft.llm import templates
from lexweft.llm.common import table
from lexweft.llm.templates import SHORT, UNITS, decontaminate, find_leaks

SF = "/root/testdata/sf0.001"
WORD = regex.compile(rf"[\p{{L}}\p{{M}}]+|[0-9]+(?:[.,][0-9]+)*(?: ?(?:(?i:{UNITS})(?![\p{{L}}\p{{M}}])|[%°€£$]))?")
BEFORE = regex.compile(r"[\p{L}\p{M}\p{N},;] \Z")


def _words(text):
    """(word, kind) with kind n (name by place), s (other title-case word), 0, 0u or w."""
    out = []
    for m in WORD.finditer(text or ""):
        w = m[0]
        if w[0] in "0123456789":
            kind = "0" if regex.fullmatch("[0-9.,]+", w) else "0u"
        elif regex.match(r"\p{Lu}\p{Ll}", w):
            kind = "n" if BEFORE.search(text, 0, m.start()) else "s"
        else:
            kind = "w"
        out.append((w.lower(), kind))
    return out


def _template(words, starts):
    return tuple("<n>" if k == "n" or (k == "s" and starts) else k if k[0] == "0" else w for w, k in words)


def _item(text, window, stride):
    """Windows (at, started, template, words), the number that coverage counts, and the share that must be there."""
    own = _words(text)
    if len(own) < SHORT:
        return None
    width = window if len(own) >= window else SHORT
    last = len(own) - width
    kept, ample = [], set()
    for at in range(last + 1):
        if width == window and at % stride and at != last:
            continue
        part = own[at : at + width]
        slots = sum(k not in "ws" for _, k in part)
        for started in (False, True):
            starts = sum(k == "s" for _, k in part) if started else 0
            if started and not starts or width - slots - starts < (1 if width < window else 2):
                continue
            kept.append((at, started, _template(part, started), part))
            if (slots + sum(k == "s" for _, k in part)) * 2 <= width:
                ample.add(at)
    every = {k[0] for k in kept}
    weak = len(ample) * 2 < len(every)
    return kept, every if weak else ample, 1 if width < window else templates.WEAK_COVERAGE if weak else None, width


def brute(docs, items, window=8, stride=4, coverage=0.5):
    found = {}
    for item_id, text in set(items):
        item = _item(text, window, stride)
        if not item or not item[0]:
            continue
        kept, counted, need, width = item
        for doc_id, body in docs:
            own = _words(body)
            at_of = defaultdict(list)
            for at in range(len(own) - width + 1):
                at_of[_template(own[at : at + width], True)].append(at)
            rows = []
            for item_at, started, template, part in kept:
                for at in at_of[template]:
                    pairs = list(zip(part, own[at : at + width]))
                    named = {(a, b, k) for (a, k), (b, _) in pairs if k == "n" or (started and k == "s")}
                    differs = started and any(k == "s" and a != b for (a, k), (b, _) in pairs)
                    rows.append((at - item_at, item_at, differs, item_at in counted, named, any(a != b for (a, _), (b, _) in pairs)))
            shifts = sorted({r[0] for r in rows})
            chain, start = {}, None
            for i, s in enumerate(shifts):
                start = s if not i or s - shifts[i - 1] > templates.GAP else start
                chain[s] = start
            ways = defaultdict(list)
            for r in rows:
                for starts in {True, r[2]}:
                    ways["d", r[0], starts].append(r)
                    ways["c", chain[r[0]], starts].append(r)
            for (_, _, starts), some in ways.items():
                names = {(a, b) for r in some for a, b, k in r[4] if starts or k == "n"}
                share = len({r[1] for r in some if r[3]}) / len(counted)
                if len({a for a, _ in names}) == len(names) == len({b for _, b in names}) and share >= (need or coverage):
                    old = found.get((doc_id, item_id), (0, True))
                    found[doc_id, item_id] = (max(old[0], share), min(old[1], any(r[5] for r in some)))
    return {k: (round(v[0], 6), v[1]) for k, v in found.items()}


def _got(found):
    return {(r.doc_id, r.item_id): (round(r.coverage, 6), r.reparameterised) for r in found.collect()}


def _frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def _random_texts(rnd, n):
    names, plain = ["Tom", "Ann", "Maria", "Łuc"], "has buys red apples how many are left in the old shop now km each of ñu".split()

    def sentence():
        k = rnd.randrange(3, 9)
        part = [rnd.choice([rnd.choice(names), str(rnd.randrange(20)), f"{rnd.randrange(9)} km", *[rnd.choice(plain)] * 5]) for _ in range(k)]
        return " ".join([part[0].title(), *part[1:]]) + rnd.choice([". ", "? ", ",\n", "; "])

    return ["".join(sentence() for _ in range(rnd.randrange(1, 4))) for _ in range(n)]


def _renamed(rnd, text):
    swap = dict(zip(["Tom", "Ann", "Maria", "Łuc"], rnd.sample(["Eva", "Bob", "Ida", "Uwe"], 4)))
    text = regex.sub(r"\p{Lu}\p{Ll}+", lambda m: swap.get(m[0], m[0]), text)
    return regex.sub("[0-9]+", lambda m: str(rnd.randrange(50)), text)


@pytest.mark.parametrize("small", [templates.SMALL_WINDOWS, 0])
def test_random_questions(spark, monkeypatch, small):
    monkeypatch.setattr(templates, "SMALL_WINDOWS", small)
    rnd = random.Random(4)
    items = [(i, t) for i, t in enumerate(_random_texts(rnd, 25))] + [(100, "What is 12 plus 30 minus 4?"), (101, "a b"), (102, "Tom and 3, Ann and 4, Eva and 5, Bob and 6"), (103, None)]
    docs = []
    for i in range(120):
        item = rnd.choice(items)[1] or ""
        body = rnd.choice([item, _renamed(rnd, item), item.lower(), item.upper(), _renamed(rnd, item).replace(" has", " always has"), rnd.choice(_random_texts(rnd, 1))])
        docs.append((i, " ".join([*_random_texts(rnd, 1), body, *_random_texts(rnd, 1)])))
    docs += [(200, "x What is 7 plus 8 minus 9? y"), (201, "what is 7 plus 8"), (202, None), (203, ""), (204, "Uwe and 1, Ida and 2, Tom and 3, Eva and 9")]
    want = brute(docs, items)
    assert len(want) > 50 and (200, 100) in want and (201, 100) not in want and (204, 102) in want
    assert _got(find_leaks(*_frames(spark, docs, items))) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_test_table(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want and _got(find_leaks(docs, items)) == want


def test_clean_rows_stay_whatever_their_id(spark):
    item = "The farmer keeps two goats in the cellar for many days and then sells them at the market of the town."
    docs = [(None, item), (None, "a clean text"), (None, "another one"), (1, item), (1, "clean"), (1, "clean")]
    d = spark.createDataFrame([(a, b, 0, 1) for a, b in docs], "doc_id long, text string, th int, _leak_id int")
    _, b = _frames(spark, docs, [(7, item), (7, item)])
    assert sorted(r.text for r in decontaminate(d, b).collect()) == ["a clean text", "another one", "clean", "clean"]
    assert decontaminate(d, b).columns == d.columns and _got(find_leaks(d, b)) == {(None, 7): (1.0, False), (1, 7): (1.0, False)}
