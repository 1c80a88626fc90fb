import json

import pytest
from pyspark.sql import functions as F

from lexweft.operators import jobs, metadata, pairing, retrieval, services
from lexweft.sources.files import METADATA_REQUEST, Settings, stream_requests
from lexweft.sources.shared import shared_path

KEY = Settings(gemini_api_key="k", gemini_file_search_store="main")
GOOD = json.dumps({"titulo": "T", "categorias": [{"categoria": "Generales", "subcategorias": ["Otros"]}], "confidence": 1})


def test_retries():
    seen, slept = [], []

    def call(x):
        seen.append(x)
        if len(seen) < 3:
            raise ValueError("again")
        return x + 1

    assert services.retried(call, 1, tries=5, pause=5, sleep=slept.append) == (2, None, None, 3) and slept == [5, 5]
    assert services.retried(lambda: 1 / 0, tries=2, sleep=slept.append) == (None, "ZeroDivisionError", "division by zero", 2)


def test_waiting():
    now = [0.0]
    poll = iter([False, False, True])
    clock, sleep = lambda: now[0], lambda s: now.__setitem__(0, now[0] + s)
    assert services.wait_operation(lambda op: next(poll), "op", False, 10, clock=clock, sleep=sleep) and now[0] == 3
    with pytest.raises(TimeoutError, match="no termino en 5 segundos"):
        services.wait_operation(lambda op: False, "op", False, 5, clock=clock, sleep=sleep)
    with pytest.raises(ValueError):
        services.wait_operation(lambda op: True, "op", True, 0)


def test_extraction(spark):
    df = spark.createDataFrame([("a", "ok", None), ("b", "bad", "s"), ("c", "none", ""), ("d", "broken", None)], METADATA_REQUEST)

    def extractor(prompt):
        if "\nbroken\n" in prompt:
            raise RuntimeError("gemini down")
        return GOOD if "\nok\n" in prompt else "{}" if "\nbad\n" in prompt else "no json"

    got = {r.filename: r for r in services.extract_route(df, extractor, KEY, pause=0).collect()}
    assert (got["a"].status, got["a"].titulo, got["a"].tries) == (200, "T", 1)
    assert [(got[x].status, got[x].code, got[x].tries) for x in "bcd"] == [(422, "AGENT_VALIDATION_FAILED", 5)] * 2 + [(503, "UPSTREAM_UNAVAILABLE", 5)]
    bare = services.extract_route(df, extractor, Settings(), pause=0).first()
    assert (bare.status, bare.code, bare.tries) == (503, "UPSTREAM_NOT_CONFIGURED", 1)


def test_an_answer_that_is_valid_on_the_third_try(spark, tmp_path):
    df = spark.createDataFrame([("a", "slow", None), ("b", "ok", None)], METADATA_REQUEST)
    seen, slept = str(tmp_path / "seen"), []

    def extractor(prompt):
        if "\nok\n" in prompt:
            return GOOD
        with open(seen, "a+") as f:
            f.write("x")
            f.seek(0)
            n = len(f.read())
        if n == 1:
            raise ConnectionError("gemini")
        return "{}" if n == 2 else GOOD

    out = services.extract_route(df, extractor, KEY, pause=5, sleep=slept.append)
    assert out.count() == 2 and {r.filename: (r.status, r.tries) for r in out.collect()} == {"a": (200, 3), "b": (200, 1)}
    assert slept == [5, 5] and (tmp_path / "seen").read_text() == "xxx"  # read twice, asked three times
    assert services.extract_route(df.limit(0), extractor, KEY).count() == 0


def test_numeric_strings(spark):
    texts = ["0.5", " 1e0 ", "0.5d", "1f", "0x1", "1_0", "1__0", "_1", ".5", "5.", ".", "", "+inf", "NaN", "Infinity", "1e", "0.25\n", "٣"]
    df = spark.createDataFrame([(json.dumps({"confidence": t, "categorias": []}),) for t in texts], "raw string")
    got = [r.confidence for r in metadata.extract(df).select("confidence").collect()]
    for t, x in zip(texts, got):
        try:
            want = float(t) if t.isascii() else None
        except ValueError:
            want = None
        assert x == want or (x != x and want != want), t


def test_clashing_names(spark):
    raw = spark.createDataFrame([(GOOD, 1, 2, 3, 4)], "raw string, _v int, _entries int, _ok int, _titulo int")
    made = metadata.extract(raw)
    assert (made.first()._v, made.first()._ok, made.first().titulo) == (1, 3, "T")
    pairs = metadata.custom_metadata(made.withColumn("row", F.lit(9)), "_v").first()
    assert pairs["row"] == 9 and pairs["_titulo"] == 4 and pairs["_v"][0].key == "titulo"
    asked = spark.createDataFrame([("generales", 7, 8)], "q string, _key int, c2 int")
    hints = retrieval.retrieval_hints(asked, "q").first()
    assert (hints._key, hints.c2, hints.canonical_category) == (7, 8, "Generales")
    stores = pairing.resolve_stores(spark.createDataFrame([("a", 1, 2)], "requested string, _reg int, _hit int"), spark.createDataFrame([("a", "s")], "display_name string, store string"), spark.createDataFrame([], "pos int, display_name string, name string")).first()
    assert (stores._reg, stores._hit, stores.store, stores.how) == (1, 2, "s", "registry")


def test_places(spark):
    rows = [(i % 7 if i % 11 else None, str(i)) for i in range(500)]
    got = jobs.with_places(spark.createDataFrame(rows, "created_at int, job_id string").repartition(7), "created_at", "job_id")
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.created_at, r.job_id) for r in sorted(got.collect(), key=lambda r: r.place)] == want
    assert sorted(r.place for r in got.collect()) == list(range(1, 501))
    assert "SinglePartition" not in jobs.fifo(spark.createDataFrame(rows, "created_at int, job_id string"))._jdf.queryExecution().executedPlan().toString()


def test_whole_uploads(spark):
    fields = [*metadata.STRING_FIELDS, metadata.NOTES]
    shape = ", ".join(f"{f} string" for f in fields) + f", confidence double, categorias array<{metadata.GROUP}>, filename string, markdown string, file_search_store_name string, create_store_if_missing boolean, wait_until_done boolean, max_wait_seconds int"
    row = lambda name, store, make=None, wait=None: (*["T" if f == "titulo" else None for f in fields], 0.5, [("Generales", ["Otros"])], name, "m " + name, store, make, wait, 1)
    asked = [row("a", "fileSearchStores/x"), row("b", "k"), row("c", "new"), row("d", "new", False), row("e", "gone", False), row("f", None), row("g", "bad"), row("slow", "k"), row("h", "slow store", True, False)]
    calls = spark.sparkContext.accumulator(0)

    def create(name):
        calls.add(1)
        if name == "bad":
            raise RuntimeError("store quota")
        return f"fileSearchStores/{name}"

    def upload(store, name, markdown, pairs):
        return json.dumps([store, markdown, pairs]), name == "a"

    registry, listed = spark.createDataFrame([("k", "s1")], "display_name string, store string"), spark.createDataFrame([], "pos int, display_name string, name string")
    answers, news = services.upload_requests(spark.createDataFrame(asked, shape), registry, listed, create, upload, lambda op: "slow" not in op, KEY, every=0.1)
    got = {r.filename: r for r in answers.collect()}
    assert json.loads(got["a"].operation) == ["fileSearchStores/x", "m a", [["titulo", "T"], ["categorias_count", "1"], ["categorias_compact", "gen:otros"], ["confidence", "0.5"]]]
    assert {n: got[n].file_search_store for n in "bcd"} == {"b": "s1", "c": "fileSearchStores/new", "d": "fileSearchStores/new"} and got["b"].message == services.UPLOADED
    assert (got["e"].status, got["e"].code, got["e"].error_message) == (503, "UPSTREAM_UNAVAILABLE", "No existe File Search Store con display_name 'gone'")
    assert got["f"].error_message == services.NO_STORE and got["g"].error_message == "store quota" and got["slow"].status == 504
    assert (got["h"].uploaded, got["h"].done) == (True, False) and calls.value == 3
    assert sorted(map(tuple, news.collect())) == [("new", "fileSearchStores/new"), ("slow store", "fileSearchStores/slow store")]
    bare, none = services.upload_requests(spark.createDataFrame(asked, shape), registry, listed, create, upload, bool)
    assert {r.code for r in bare.collect()} == {"UPSTREAM_NOT_CONFIGURED"} and none.count() == 0


def test_stores(spark):
    calls = spark.sparkContext.accumulator(0)

    def create(name):
        calls.add(1)
        if name == "broken":
            raise RuntimeError("gemini")
        return f"fileSearchStores/{name}"

    registry = spark.createDataFrame([("k", "s1")], "display_name string, store string")
    listed = spark.createDataFrame([(0, "d", "n0")], "pos int, display_name string, name string")
    asked = spark.createDataFrame([("k", True), ("d", False), ("n0", False), ("new", True), ("new", True), ("no", False), (" ", True), ("broken", True)], "display_name string, create_if_missing boolean")
    got = sorted(map(tuple, services.resolve_route(asked, registry, listed, create, KEY).select("display_name", "name", "created", "saved", "status", "code").collect()), key=str)
    assert got == sorted([
        ("k", "s1", False, True, 200, None), ("d", "n0", False, True, 200, None), ("n0", "n0", False, True, 200, None), *[("new", "fileSearchStores/new", True, True, 200, None)] * 2,
        ("no", None, False, False, 503, "UPSTREAM_UNAVAILABLE"), (" ", None, False, False, 422, "PROCESSING_FAILED"), ("broken", None, False, False, 503, "UPSTREAM_UNAVAILABLE"),
    ], key=str)
    assert calls.value == 2
    assert {r.code for r in services.resolve_route(asked, registry, listed, create).collect()} == {"UPSTREAM_NOT_CONFIGURED"}


def test_uploads(spark):
    shape = "filename string, markdown string, store string, custom_metadata array<struct<key: string, string_value: string>>"
    rows = [("a", "m", "s", [("k", "v")]), ("b", "m", None, [("k", "x" * 300)]), ("c", "boom", "", [("k", "v")]), ("d", "slow", "s", [])]

    def upload(store, name, markdown, pairs):
        if markdown == "boom":
            raise RuntimeError("quota")
        return f"{store}/{name}/{len(pairs)}", markdown != "slow"

    df = spark.createDataFrame(rows, shape)
    got = {r.filename: r for r in services.upload_route(df, upload, lambda op: False, KEY, most=1, every=0.2).collect()}
    assert (got["a"].uploaded, got["a"].operation, got["a"].status) == (True, "s/a/1", 200)
    assert got["b"].error_message.startswith("custom_metadata contiene") and got["b"].store == "main" and got["b"].status == 422
    assert got["c"].error_message == 'quota; custom_metadata_sent=[{"index":0,"key":"k","length":1,"value":"v"}]'
    assert (got["d"].status, got["d"].code) == (504, "UPSTREAM_TIMEOUT")
    assert not services.upload_route(df, upload, lambda op: False, KEY, wait=False).where("filename = 'd'").first().done


def test_search(spark):
    shape = "resp_id int, query string, original_message string, legal_category string, canonical_category string, canonical_subcategories array<string>, metadata_hints array<string>, search_terms array<string>, store string"
    df = spark.createDataFrame([(i, q, None, None, None, None, None, None, s) for i, q, s in ((1, "full", None), (2, "empty", "x"), (3, "down", None))], shape)

    def retriever(prompt, store):
        if "down" in prompt:
            raise TimeoutError("late")
        if "empty" in prompt:
            return " ", [], []
        return None, ["one ", "two"], [("T", "cafe\u0301", [("fuente", store)]), ("T", "caf\u00e9", [("fuente", store)])]

    got = {r.resp_id: r for r in services.rag_search(df, retriever, KEY).collect()}
    assert (got[1].answer, got[1].valid, got[1].status) == ("one\n\ntwo", True, 200)
    assert [(c.file_name, c.snippet, c.file_url) for c in got[1].citations] == [("T", "caf\u00e9", "main")]
    assert not got[2].valid and got[2].retry_suggestion and got[2].citations is None and (got[3].status, got[3].code, got[3].answer) == (504, "UPSTREAM_TIMEOUT", None)


def test_conversion_jobs(spark):
    df = spark.createDataFrame([("a.pdf", bytearray(b"word " * 300)), ("b.pdf", bytearray(b"")), ("c.txt", bytearray(b"x"))], "filename string, content binary")

    def primary(name, content):
        return content.decode(), 1

    def ocr(name, content):
        raise RuntimeError("no esta configurado")

    queued = services.start_jobs(df)
    assert {r.filename: (r.status, r.http, r.code) for r in queued.collect()} == {"a.pdf": ("queued", 200, None), "b.pdf": ("queued", 200, None), "c.txt": (None, 400, "INVALID_FILE_TYPE")}
    assert len({r.job_id for r in queued.collect()}) == 3
    done = {r.filename: r for r in services.run_jobs(queued, primary, primary, ocr).collect()}
    assert (done["a.pdf"].status, done["a.pdf"].result.pages, done["b.pdf"].status, done["b.pdf"].result) == ("succeeded", 1, "failed", None)
    asked = services.jobs.find_jobs(queued.select("job_id").union(spark.createDataFrame([("x",)], "job_id string")).where("job_id IS NOT NULL"), services.run_jobs(queued, primary, primary, ocr))
    assert {(r.filename, r.http, r.code, r.message) for r in asked.collect()} == {("a.pdf", 200, None, None), ("b.pdf", 200, None, None), (None, 404, "JOB_NOT_FOUND", "Conversion job no existe.")}
    assert done["a.pdf"].result.warnings == [] and "Document AI OCR no esta configurado" in services.convert_route(df.where("filename = 'b.pdf'"), primary, primary, ocr).first().warnings[0]
    assert done["b.pdf"].error.startswith("ValueError: ") and done["a.pdf"].job_id in {r.job_id for r in queued.collect()}
    shown = {r.filename: (r.status, r.code) for r in services.convert_route(df, primary, primary, ocr).collect()}
    assert shown == {"a.pdf": (200, None), "b.pdf": (422, "PROCESSING_FAILED"), "c.txt": (400, "INVALID_FILE_TYPE")}
    assert services.health(spark).first().status == "ok"


def test_failures_and_reviews(spark):
    started = spark.createDataFrame([("a", 200, None), ("b", 413, "FILE_TOO_LARGE")], "filename string, status int, code string")
    polled = spark.createDataFrame([("1", "c", 404, "JOB_NOT_FOUND", None, None), ("2", "d", 200, None, "failed", "E: x"), ("3", "e", 200, None, "running", None)], "job_id string, filename string, http int, code string, status string, error string")
    extracted = spark.createDataFrame([("f", 422, "AGENT_VALIDATION_FAILED"), ("g", 200, None)], "filename string, status int, code string")
    got = {r.filename: (r.stage, r.record_name) for r in services.failures(started, polled, extracted).collect()}
    assert got == {"b": ("start", "b.error.json"), "c": ("poll", "c.error.json"), "d": ("conversion", "d.error.json"), "f": ("extraction", "f.error.json")}
    packages = spark.createDataFrame([("x",), ("y",), ("z",)], "document_id string")
    reviews = spark.createDataFrame([("x", "changes", 1), ("x", "approved", 2), ("y", "rejected", 1)], "document_id string, decision string, seq int")
    assert {r.document_id: r.review for r in services.review_state(packages, reviews).collect()} == {"x": "approved", "y": "rejected", "z": "waiting"}


def test_request_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"filename": "a", "markdown": "m"}\n{"filename": "b", "markdown": "n", "fuente": "u", "more": 1}\n')
    got = []
    q = stream_requests(spark, str(tmp_path / "in"), METADATA_REQUEST).writeStream.foreachBatch(lambda df, i: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, got), key=str) == [("a", "m", None), ("b", "n", "u")]


def test_repeated_keys_and_assignments(spark):
    raw = '{"titulo": "old", "titulo": "new", "categorias": [{"categoria": "Generales", "subcategorias": ["Otros"]}], "confidence": 1}'
    assert metadata.extract(spark.createDataFrame([(raw,)], "raw string")).first().titulo == "new"
    groups = spark.createDataFrame([(("Generales", ["Otros", "x"]),), (("generales", ["Otros"]),), (("Sucesiones y Herencia", []),), (("Generales", []),)], f"g {metadata.GROUP}")
    got = [tuple(r.a) for r in groups.select(metadata.assignment(F.col("g")).alias("a")).collect()]
    assert got == [("Generales", "Otros", True), ("generales", "Otros", False), ("Sucesiones y Herencia", None, True), ("Generales", None, False)]


def test_shared_folder(spark):
    assert "lexweft-" in shared_path(spark, "x")

    class Cluster:
        conf = {"spark.master": "spark://far:7077"}

    with pytest.raises(ValueError, match="checkpoint"):
        shared_path(Cluster, "x")
