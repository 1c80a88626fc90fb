from lexweft.llm.templates import decontaminate, find_leaks

ITEM = "Then Maria, Peter and Maria walked 12 km to the old market and bought 3,5 kg of red apples for 7 dollars each."
OTHER = "The train from the north leaves the station at noon and reaches the harbour after two hours of slow travel along the coast."


def _found(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    return {(r.doc_id, r.item_id): r.reparameterised for r in find_leaks(d, b, **how).collect()}, d, b


def test_reparameterised_questions(spark):
    swap = ITEM.replace("Maria", "Clara").replace("Peter", "Paul").replace("12 km", "45 miles").replace("7 dollars", "9 euros")
    mixed = ITEM.replace("Maria, Peter and Maria", "Clara, Paul and Rosa")
    same = ITEM.replace("Maria, Peter and Maria", "Clara, Clara and Clara")
    docs = [
        (1, f"Intro words here. {ITEM} And more."), (2, f"Intro.\n{swap}\nMore"), (3, mixed), (4, same), (5, OTHER), (6, None), (7, ""),
        (8, "A clean text about the old market and the red apples that Maria bought."), (9, ITEM.upper()), (None, ITEM), (1, ITEM),
        (10, "filler " * 20000 + OTHER), (11, " ".join(OTHER.split()[:6])),
    ]
    rows = [(a, b, 0) for a, b in docs]
    got, d, b = _found(spark, rows, [(100, ITEM, "x"), (200, OTHER, "y"), (300, "too short", "z"), (400, None, "w")])
    assert got == {(1, 100): False, (2, 100): True, (None, 100): False, (5, 200): False, (9, 100): False, (10, 200): False}
    kept = sorted(r.doc_id for r in decontaminate(d, b).collect())
    assert kept == [3, 4, 6, 7, 8, 11]
    assert decontaminate(d, b).columns == d.columns
    assert decontaminate(d, b.limit(0)).count() == len(rows) and find_leaks(d.limit(0), b).count() == 0


def test_parts_of_items(spark):
    words = OTHER.split()
    docs = [(1, " ".join(words[:8]), 0), (2, " ".join(words[:16]), 0), (3, "x " + " ".join(words[6:]), 0)]
    got, *_ = _found(spark, docs, [(1, OTHER, "")])
    assert set(got) == {(2, 1), (3, 1)}
