from lexweft.llm.line_dedup import dedup_lines

LONG = "This is a line that is long enough to count"


def test_rules(spark):
    rows = [(i, f"own {i}\n  {LONG.upper() if i % 2 else LONG}\t\nend") for i in range(5)]
    rows += [(10, None), (11, ""), (12, "\n"), (13, "É" * 45), (14, "é" * 45), (15, "\n".join([LONG] * 3)), (15, "\n".join([LONG] * 3))]
    rows += [(None, LONG + "\nx")]
    df = spark.createDataFrame([(a, b, "k", 7) for a, b in rows], "doc_id long, text string, source string, n_lines int")
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert dedup_lines(df).count() == len(rows)
    assert [got[i].text for i in range(5)] == [f"own {i}\nend" for i in range(5)]
    assert got[15].text == "\n".join([LONG] * 3) and got[15].n_dropped == 0  # the largest id keeps all of them
    assert got[None].text == "x"
    assert (got[10].text, got[10].n_lines, got[11].n_lines, got[12].text, got[12].n_lines) == ("", 1, 1, "\n", 2)
    assert got[0].source == "k" and got[0].n_lines == 3 and got[0].n_dropped == 1
    assert dedup_lines(df.limit(0)).count() == 0


def test_below_threshold(spark):
    df = spark.createDataFrame([(i, LONG) for i in range(4)] + [(9, LONG[:39])] * 5, "doc_id long, text string")
    assert {r.n_dropped for r in dedup_lines(df).collect()} == {0}


def test_clashing_names_and_long_texts(spark):
    rows = [(i, "\n".join([LONG, *(f"line {k} of document {i}, long enough" for k in range(3000))]), 1, 2, 3, 4) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, drop_pos int, drop_id int, own_text int, row int")
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "drop_pos", "drop_id", "own_text", "row", "text", "n_lines", "n_dropped"]
    for r in out.collect():
        assert (r.n_lines, r.n_dropped, r.drop_pos, r.own_text, r["row"]) == (3001, int(r.doc_id < 5), 1, 3, 4)
        assert r.text == rows[r.doc_id][1].removeprefix(LONG + "\n" if r.doc_id < 5 else "")
