from lexweft.llm.templates import find_leaks


def _found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.coverage for r in find_leaks(d, b).collect()}


def test_words_put_in_or_left_out(spark):
    words = [f"{a}{b}" for a in "bcdf" for b in ("ala", "ele", "ili", "olo", "ulu", "yly")]  # 24 words
    one = [*words[:12], "new", *words[12:]]
    out = [*words[:12], *words[14:]]
    apart = [*words[:12], *(f"far{chr(97 + i)}" for i in range(20)), *words[12:]]
    got = _found(spark, [(1, " ".join(one)), (2, " ".join(out)), (3, " ".join(apart)), (4, " ".join(words))], [(7, " ".join(words))])
    assert got[4, 7] == 1 and got[1, 7] == 0.8 and (2, 7) in got and (3, 7) not in got


def test_equal_figures_may_become_different(spark):
    item = "The farmer keeps 2 apples in the cellar for 2 days and then sells the rest at the market, as Maria and Peter do."
    docs = [(1, item.replace("2 apples", "3 apples").replace("2 days", "5 days")), (2, item.replace("Peter", "Maria"))]
    assert set(_found(spark, docs, [(7, item)])) == {(1, 7)}


def test_names_at_the_start_of_sentences(spark):
    item = "Tom has 5 red apples. Tom buys 3 more. How many apples does Tom have now?"
    swap = item.replace("Tom", "Ann").replace("5", "9").replace("3", "4")
    docs = [(1, item), (2, f"Some text before. {swap} And more."), (3, swap.replace("Ann buys", "Eva buys")), (4, item.lower())]
    assert set(_found(spark, docs, [(7, item)])) == {(1, 7), (2, 7), (4, 7)}
