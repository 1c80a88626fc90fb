import pytest
from pyspark.sql import functions as F

from lexweft.operators import documents, jobs, pairing, retrieval
from lexweft.sources import files, sinks
from lexweft.streaming.jobs import ingest, track_jobs


def test_conversion_chain(spark):
    def primary(name, content):
        if b"bad" in content:
            raise ValueError("broken")
        return content.decode(), 2

    def fallback(name, content):
        if b"worse" in content:
            raise KeyError("no")
        return "fallback " + content.decode() + " x" * 500, 9

    def ocr(name, content):
        if b"noocr" in content:
            raise RuntimeError("no esta configurado")
        return "seen", None

    rows = [("long.pdf", b"word " * 300), ("bad.pdf", b"bad"), ("worse.pdf", b"bad worse"), ("short.pdf", b"tiny"), ("none.pdf", b"noocr"), ("empty.pdf", b" noocr"[:1] + b"\n")]
    df = spark.createDataFrame([(a, bytearray(b)) for a, b in rows], "filename string, content binary")
    got = {r.filename: r for r in documents.convert(df, primary, fallback, ocr).collect()}
    assert (got["long.pdf"].ocr_used, got["long.pdf"].pages, got["long.pdf"].warnings) == (False, 2, [])
    assert got["bad.pdf"].pages is None and got["bad.pdf"].warnings == ["docling_failed: ValueError: broken"]
    assert got["worse.pdf"].ocr_used and len(got["worse.pdf"].warnings) == 2 and got["worse.pdf"].markdown == "seen\n"
    assert got["short.pdf"].ocr_used and got["none.pdf"].warnings == ["ocr_skipped_or_failed: RuntimeError: no esta configurado"]
    assert got["none.pdf"].markdown == "noocr\n" and not got["none.pdf"].ocr_used and got["empty.pdf"].markdown == "seen\n"
    calls = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(k, converter):
        def call(name, content):
            calls[k].add(1)
            return converter(name, content)

        return call

    once = documents.convert(df, counted(0, primary), counted(1, fallback), counted(2, ocr))
    assert once.count() == once.where("markdown IS NOT NULL").count() == len(rows)
    assert [c.value for c in calls] == [6, 2, 4]
    assert documents.convert(df.where("filename = 'short.pdf'"), primary, fallback, lambda n, c: ("", None)).first().error.startswith("ValueError")
    assert documents.convert(df.where("filename = 'short.pdf'"), primary, fallback, lambda n, c: ("", None), keep_native=True).first().markdown == "tiny\n"


def test_gates(spark):
    mb = 1024 * 1024
    df = spark.createDataFrame([("a.PDF", 75 * mb), ("a.pdf", 75 * mb + 1), ("a.txt", 99 * mb), (None, 1), ("", 1)], "n string, s long")
    got = [r.e for r in df.select(documents.upload_error(F.col("n"), F.col("s")).alias("e")).collect()]
    assert got == [None, "FILE_TOO_LARGE", "INVALID_FILE_TYPE", "INVALID_FILE_TYPE", "INVALID_FILE_TYPE"]


def test_errors(spark):
    cases = [
        ("timeout x", None, 504), ("", "TimeoutError", 504), ("Invalid api_key", None, 422), ("GEMINI_API_KEY no esta configurado", None, 503),
        ("display_name no puede estar vacio", None, 422), ("No existe File Search Store", None, 503), ("stored", None, 503), ("gemini down", None, 503), ("x", "JSONDecodeError", 422),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "m string, k string")
    got = [r.e for r in df.select(jobs.classify_error(F.col("m"), F.col("k")).alias("e")).collect()]
    assert [e.status for e in got] == [c[2] for c in cases]
    assert got[2].code == "AGENT_VALIDATION_FAILED" and got[3].code == "UPSTREAM_NOT_CONFIGURED" and got[4].code == "PROCESSING_FAILED"


def test_jobs(spark):
    df = spark.createDataFrame([("a", 1, "queued", None), ("a", 2, "succeeded", ("x",)), ("b", 1, "running", None)], "job_id string, seq long, status string, result struct<v: string>")
    last = jobs.latest_states(df)
    assert {r.job_id: r.status for r in last.collect()} == {"a": "succeeded", "b": "running"}
    parts = jobs.split_by_status(last)
    assert parts["pending"].count() == 1 and jobs.unwrap_results(parts["succeeded"]).first().v == "x"
    with pytest.raises(Exception, match="no result"):
        jobs.unwrap_results(last).collect()
    assert jobs.public_jobs(last).columns == ["job_id", "status", "result"]
    found = jobs.find_jobs(spark.createDataFrame([("a",), ("z",)], "job_id string"), last)
    assert {r.job_id: r.code for r in found.collect()} == {"a": None, "z": "JOB_NOT_FOUND"}


def test_pairing_and_stores(spark):
    names = spark.createDataFrame([("x.md",), ("x.metadata.json",), ("y.md",), ("z.metadata.json",), (".md",), ("q.txt",)], "name string")
    assert [r.stem for r in pairing.complete_pairs(names).collect()] == ["x"]
    assert sorted(r.stem for r in pairing.unpaired(names).collect()) == ["y", "z"]
    registry = spark.createDataFrame([("k", "s1")], "display_name string, store string")
    listed = spark.createDataFrame([(0, "d", "n0"), (1, "n0", "n1"), (2, None, "n2")], "pos int, display_name string, name string")
    asked = spark.createDataFrame([(x,) for x in ("k", "d", "n0", "n2", "new", "fileSearchStores/9")], "requested string")
    got = {r.requested: (r.store, r.how, r.save) for r in pairing.resolve_stores(asked, registry, listed).collect()}
    assert got == {
        "k": ("s1", "registry", False), "d": ("n0", "listed", True), "n0": ("n0", "listed", False), "n2": ("n2", "listed", False),
        "new": (None, "create", True), "fileSearchStores/9": ("fileSearchStores/9", "given", False),
    }


def test_citations_and_answers(spark):
    schema = "resp_id int, cand_pos int, chunk_pos int, title string, text string, custom_metadata array<struct<key: string, string_value: string>>"
    long = "s" * 120
    rows = [
        (1, 0, 0, " T ", long + "a", [("fuente", "u"), ("fuente", "v"), ("", "x"), ("identificador", None)]), (1, 0, 1, "T", long + "b", [("fuente", "v")]),
        (1, 1, 0, None, "x", None), (1, 1, 1, None, None, None), (2, 0, 0, "T", long, []),
    ]
    got = retrieval.citations(spark.createDataFrame(rows, schema)).orderBy("resp_id", "cand_pos", "chunk_pos").collect()
    assert [(r.resp_id, r.cand_pos, r.file_id, r.file_name, r.file_url) for r in got] == [(1, 0, "None", "T", "v"), (1, 1, "", "Fuente legal", ""), (2, 0, "T", "T", "")]
    answers = spark.createDataFrame([(1, "yes"), (2, ""), (3, "no sources")], "resp_id int, answer string")
    out = {r.resp_id: r for r in retrieval.responses(answers, retrieval.citations(spark.createDataFrame(rows, schema))).collect()}
    assert (out[1].valid, out[2].answer, out[3].valid) == (True, retrieval.NO_ANSWER, False) and out[3].retry_suggestion == retrieval.RETRY
    with pytest.raises(ValueError):
        retrieval.check_bounded(spark.range(20), 10)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.pdf", "b.PDF", "c.txt"):
        (tmp_path / "in" / name).write_bytes(b"body")
    path = str(tmp_path / "in")
    assert sorted(r.filename for r in files.read_files(spark, path).collect()) == ["a.pdf", "b.PDF", "c.txt"]
    assert files.read_files(spark, path, only_pdf=True).count() == 2
    reg = str(tmp_path / "reg")
    assert files.read_registry(spark, reg).count() == 0
    sinks.write_registry(spark.createDataFrame([("ñ", "s"), ("b", "t")], "display_name string, store string"), reg)
    assert {r.display_name: r.store for r in files.read_registry(spark, reg).collect()} == {"ñ": "s", "b": "t"}
    (tmp_path / "broken.json").write_text("{nope")
    assert files.read_registry(spark, str(tmp_path / "broken.json")).count() == 0
    (tmp_path / "env").write_text("# no\nexport GEMINI_API_KEY='k'\nMAX_UPLOAD_MB=9\nENABLE_GEMINI_FILE_SEARCH_UPLOAD=true # yes\nEXTRA=1\n")
    got = files.Settings.from_env({"max_upload_mb": "5", "OTHER": "x"}, str(tmp_path / "env"))
    assert got == files.Settings(max_upload_mb=5, gemini_api_key="k", enable_gemini_file_search_upload=True) and not got.ocr_ready()
    many = spark.range(120_000).selectExpr("concat('s\"', id) AS display_name", "string(id) AS store")
    sinks.write_registry(many, reg)
    assert files.read_registry(spark, reg).count() == 120_000
    sinks.write_registry(many.limit(0), reg)
    assert files.read_registry(spark, reg).count() == 0
    docs = spark.createDataFrame(
        [("a", "md", [("k", "v")], "st"), ("b", "md", [("k", "x" * 300)], "st")], "filename string, markdown string, custom_metadata array<struct<key: string, string_value: string>>, store string"
    )
    logs = sinks.upload(docs, str(tmp_path), 1)
    assert {r.filename: r.status for r in logs.collect()} == {"a": "uploaded", "b": "error"}
    sinks.upload(docs, str(tmp_path), 1)  # again, which replaces
    sinks.write_logs(logs, str(tmp_path), 1)
    sinks.write_logs(logs, str(tmp_path), 1)
    sinks.write_errors(logs, str(tmp_path), 1)
    assert {r.status for r in sinks.upload(docs, str(tmp_path), 2, enabled=False).collect()} == {"skipped", "error"}
    assert spark.read.parquet(str(tmp_path / "store")).count() == 1 and spark.read.parquet(str(tmp_path / "logs")).count() == 2
    conv = spark.createDataFrame([("a.pdf", "a-1", "m", None, False, [])], "filename string, document_id string, markdown string, pages int, ocr_used boolean, warnings array<string>")
    meta = spark.createDataFrame([("a-1", "t", 0.5)], "document_id string, titulo string, confidence double")
    package = documents.review_package(conv, meta)
    row = package.first()
    assert row.review_name == "a-1.review.json" and '"titulo" : "t"' in row.review_json and '"pages" : null' in row.review_json
    for _ in range(2):
        sinks.write_outputs(package, str(tmp_path / "out"), "b")
    assert spark.read.parquet(str(tmp_path / "out" / "review")).count() == 1


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", 2, "succeeded"), ("a", 1, "queued"), ("b", 1, "running")], "job_id string, seq long, status string").coalesce(1).write.json(str(tmp_path / "ev"))
    events = spark.readStream.schema("job_id string, seq long, status string").json(str(tmp_path / "ev"))
    q = track_jobs(events).writeStream.format("memory").queryName("tracked").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.job_id: (r.status, r.done) for r in spark.table("tracked").collect()} == {"a": ("succeeded", True), "b": ("running", False)}
    (tmp_path / "pdf").mkdir()
    for i in range(3):
        (tmp_path / "pdf" / f"{i}.pdf").write_bytes(b"x")
    seen = []
    ingest(files.stream_files(spark, str(tmp_path / "pdf"), 2), lambda df, i: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination(120)
    assert sum(seen) == 3 and max(seen) <= 2
