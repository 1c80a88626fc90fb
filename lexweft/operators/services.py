"""The service's routes as functions of tables: requests in, a row with status, code and result out for each.

What a route calls outside (an extractor, a retriever, an uploader, a store
creator) is a function that the caller passes in. It runs in Arrow batches where
its rows lie: the stage that calls is written to the shared folder before anything
reads its outcome twice, so a row's call is made again only with a task that Spark runs
again. Uploads that mustn't be are for ``sources.store``. A call that fails is the
row's outcome, never the job's.
"""

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweft.functions import text
from lexweft.operators import documents, jobs, metadata, pairing, retrieval
from lexweft.sources.files import Settings
from lexweft.sources.shared import materialize

#: Takes a prompt, gives the model's raw answer; may raise.
Extractor = Callable[[str], str]
#: Takes a prompt and a store, gives (text, parts, chunks); a chunk is (title, text, [(key, value)]); may raise.
Retriever = Callable[[str, str], tuple[str | None, list[str], list[tuple]]]
#: Takes (store, display name, Markdown, [(key, value)]), gives (operation, done); may raise.
Uploader = Callable[[str, str, str, list[tuple[str, str]]], tuple[str, bool]]

#: Tries of an extraction and the seconds between, the seconds between looks at an upload, its bounds, and what callers are told.
TRIES, PAUSE = 5, 5.0
POLL, MAX_WAIT, WAIT_BOUNDS = 1.0, 600, (1, 3600)
NOT_CONFIGURED = "GEMINI_API_KEY no esta configurado"
NO_STORE = "file_search_store_name o GEMINI_FILE_SEARCH_STORE no esta configurado"
UPLOADED = "Archivo enviado a Gemini File Search Store."
REFUSALS = {"INVALID_FILE_TYPE": (400, "Solo se aceptan archivos PDF."), "FILE_TOO_LARGE": (413, "Archivo supera {} MB.")}


def health(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("ok").alias("status"))


def retried(call: Callable, *args, tries: int = 1, pause: float = 0.0, sleep=time.sleep):
    """``(result, kind, message, tries)``: the first try that doesn't raise, else the last error."""
    for n in range(1, tries + 1):
        try:
            return call(*args), None, None, n
        except Exception as e:  # noqa: BLE001  a row's failure is its outcome
            kind, message = type(e).__name__, str(e)
        if n < tries:
            sleep(pause)
    return None, kind, message, tries


def call_each(df: DataFrame, call: Callable, names: list[str], out: str, label: str, tries: int = 1, pause: float = 0.0) -> DataFrame:
    """``df`` with ``result`` (of type ``out``), ``error_kind``, ``error_message`` and ``tries`` of one call for each row; written, so it is called once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [retried(call, *args, tries=tries, pause=pause) for args in zip(*(pdf[n] for n in names))]
            own = pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=object) for k, c in enumerate(("result", "error_kind", "error_message", "tries"))})
            yield pd.concat([pdf.reset_index(drop=True), own], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return materialize(df.mapInPandas(run, f"{fields}, result {out}, error_kind string, error_message string, tries int"), label)


def outcome(kind: Column, message: Column) -> list[Column]:
    """``status``, ``code`` and ``message`` of an answer: 200, or what the error rules say."""
    e = jobs.classify_error(message, kind)
    failed = kind.isNotNull()
    return [F.when(failed, e["status"]).otherwise(200).alias("status"), F.when(failed, e["code"]).alias("code"), F.when(failed, e["message"]).alias("message")]


# --- conversion ---


def gate(files: DataFrame, max_mb: int = documents.MAX_UPLOAD_MB) -> DataFrame:
    """``files`` (filename, content) with ``status`` (200, 400, 413), ``code`` and ``message``."""
    code = documents.upload_error(F.col("filename"), F.octet_length("content"), max_mb)
    status, message = F.lit(200), F.lit(None).cast("string")
    for name, (number, said) in REFUSALS.items():
        status, message = F.when(code == name, number).otherwise(status), F.when(code == name, F.lit(said.format(max_mb))).otherwise(message)
    return files.withColumns({"code": code, "status": status, "message": message})


def convert_route(files: DataFrame, primary, fallback, ocr, settings: Settings = Settings()) -> DataFrame:
    """One row for each upload: refused by the gate, converted, or failed."""
    gated = gate(files, settings.max_upload_mb)
    refused = gated.where("status <> 200").select("filename", "status", "code", "message")
    ocr = documents.configured_ocr(ocr, settings.ocr_ready())
    done = documents.convert(gated.where("status = 200").select("filename", "content"), primary, fallback, ocr, settings.min_text_chars_for_native_pdf)
    kind, said = F.regexp_extract("error", r"\A(\w+): ", 1), F.regexp_replace("error", F.lit(r"\A\w+: "), F.lit(""))
    shown = done.select("*", *outcome(F.when(F.col("error").isNotNull(), kind), said)).drop("error")
    return shown.unionByName(refused, allowMissingColumns=True)


def _now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def start_jobs(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """An answer for each upload: a queued job with its ``job_id``, times and file, or why it is refused (``http`` 400 or 413, no job)."""
    gated = gate(files, settings.max_upload_mb).withColumnRenamed("status", "http")
    good = F.col("http") == 200
    only = lambda c: F.when(good, c)
    return materialize(gated.select(
        only(F.expr("uuid()")).alias("job_id"), only(F.lit("queued")).alias("status"), "filename", F.lit(None).cast("string").alias("error"),
        only(_now()).alias("created_at"), only(_now()).alias("updated_at"), only(F.col("content")).alias("content"), "http", "code", "message",
    ), "jobs")


def run_jobs(started: DataFrame, primary, fallback, ocr, settings: Settings = Settings()) -> DataFrame:
    """The queued ones of ``started`` done: ``status`` succeeded with ``result``, or failed with ``error`` (kind: message)."""
    named = started.where("status = 'queued'").select("job_id", "created_at", "filename", "content")
    ocr = documents.configured_ocr(ocr, settings.ocr_ready())
    done = documents.convert(named, primary, fallback, ocr, settings.min_text_chars_for_native_pdf, carry=["job_id", "created_at"])
    fields = [c for c in done.columns if c not in ("job_id", "created_at", "error")]
    failed = F.col("error").isNotNull()
    status = F.when(failed, F.lit("failed")).otherwise(F.lit("succeeded"))
    return done.select("job_id", status.alias("status"), "filename", F.when(~failed, F.struct(*fields)).alias("result"), "error", "created_at", _now().alias("updated_at"))


# --- extraction ---


def _judged(found: DataFrame) -> DataFrame:
    """``found`` (with ``result``, ``error_kind``, ``error_message`` of a call) with the metadata, its ``errors``, and ``status``, ``code`` and ``message``."""
    parsed = metadata.extract(found, "result")
    invalid = F.col("error_kind").isNull() & (F.size("errors") > 0)
    kind = F.when(invalid, F.when(F.array_contains("errors", "json"), F.lit("JSONDecodeError")).otherwise(F.lit("ValidationError"))).otherwise(F.col("error_kind"))
    said = F.when(invalid, F.array_join("errors", ", ")).otherwise(F.col("error_message"))
    return parsed.select("*", *outcome(kind, F.coalesce(said, F.lit("")))).drop("result", "error_kind", "error_message")


def extract_route(requests: DataFrame, extractor: Extractor, settings: Settings = Settings(), tries: int = TRIES, pause: float = PAUSE, sleep=time.sleep) -> DataFrame:
    """Metadata for ``requests`` (filename, markdown, fuente), with ``status``, ``code``, ``message`` and ``tries``.

    Whatever isn't answered by valid metadata, be it a call that raises or an
    answer that is none, is asked again with the next round, ``tries`` rounds in
    all and ``pause`` seconds apart. A round is a table, written before it is
    judged, so pauses hold no executor. Without a key nothing is called, nor
    tried again.
    """
    prompt = retrieval.extraction_prompt(F.col("filename"), F.col("markdown"), F.coalesce("fuente", F.lit("")))
    left, parts = requests.select("filename", prompt.alias("prompt")), []
    if not settings.gemini_api_key:
        none = F.lit(None).cast("string")
        return _judged(left.select("filename", none.alias("result"), F.lit("RuntimeError").alias("error_kind"), F.lit(NOT_CONFIGURED).alias("error_message"), F.lit(1).alias("tries")))
    for n in range(1, tries + 1):
        found = call_each(left, extractor, ["prompt"], "string", f"answers-{n}").withColumn("tries", F.lit(n))
        again = F.col("status") != 200
        judged = materialize(_judged(found).withColumn("prompt", F.when(again, F.col("prompt"))), f"judged-{n}")
        left = judged.where(again).select("filename", "prompt")
        last = n == tries or left.isEmpty()
        parts.append((judged if last else judged.where(~again)).drop("prompt"))
        if last:
            break
        sleep(pause)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


# --- stores and uploads ---


def resolve_route(requests: DataFrame, registry: DataFrame, listed: DataFrame, create: Callable[[str], str], settings: Settings = Settings()) -> DataFrame:
    """Stores for ``requests`` (display_name, create_if_missing): ``name``, ``created``, ``saved``, or status and code.

    New stores are made once for each name, however many requests ask for it.
    """
    asked = requests.withColumn("requested", F.col("display_name"))
    known = registry.select("display_name", "store")
    found = pairing.resolve_stores(asked.where(~text.is_blank(F.col("display_name"))), known, listed, save_name_hits=True, bypass=False)
    names = found.where("how = 'create'").groupBy(F.col("requested").alias("new_name")).agg(F.bool_or("create_if_missing").alias("wanted")).where("wanted").select("new_name")
    made = call_each(names, create, ["new_name"], "string", "stores")
    joined = found.join(made, found["requested"] == made["new_name"], "left")
    missing = (F.col("how") == "create") & ~F.col("create_if_missing")
    said = F.when(missing, F.concat(F.lit("No existe File Search Store con display_name '"), "display_name", F.lit("'"))).otherwise(F.col("error_message"))
    kind = F.when(missing, F.lit("RuntimeError")).when(F.col("how") == "create", F.col("error_kind"))
    good = joined.select("display_name", F.coalesce("store", F.when(~missing, F.col("result"))).alias("name"), ((F.col("how") == "create") & F.col("result").isNotNull()).alias("created"), kind.isNull().alias("saved"), *outcome(kind, F.coalesce(said, F.lit(""))))
    blank = requests.where(text.is_blank(F.col("display_name"))).select(
        "display_name", F.lit(None).cast("string").alias("name"), F.lit(False).alias("created"), F.lit(False).alias("saved"), *outcome(F.lit("RuntimeError"), F.lit("display_name no puede estar vacio"))
    )
    shown = good.unionByName(blank)
    if settings.gemini_api_key:
        return shown
    return requests.select("display_name", F.lit(None).cast("string").alias("name"), F.lit(False).alias("created"), F.lit(False).alias("saved"), *outcome(F.lit("RuntimeError"), F.lit(NOT_CONFIGURED)))


def wait_operation(poll: Callable[[str], bool], operation: str, done: bool, most: float = MAX_WAIT, every: float = POLL, clock=time.monotonic, sleep=time.sleep) -> bool:
    """Asks whether an operation is done until it is; a TimeoutError once ``most`` seconds have gone."""
    least, longest = WAIT_BOUNDS
    if not least <= most <= longest:
        raise ValueError(f"max_wait_seconds must be between {least} and {longest}")
    deadline = clock() + most
    while not done:
        if clock() >= deadline:
            raise TimeoutError(f"Gemini File Search upload no termino en {most:g} segundos")
        sleep(every)
        done = poll(operation)
    return done


def upload_route(requests: DataFrame, upload: Uploader, poll: Callable[[str], bool], settings: Settings = Settings(), wait: bool = True, most: float = MAX_WAIT, every: float = POLL) -> DataFrame:
    """Uploads of ``requests`` (filename, markdown, store, custom_metadata), waited for: ``uploaded``, ``operation``, or status and code.

    Values above the limit are refused before any call; an upload that fails says
    what metadata was sent.
    """
    over = metadata.oversized(F.col("custom_metadata"))
    store = F.coalesce(F.nullif("store", F.lit("")), F.nullif(F.lit(settings.gemini_file_search_store or ""), F.lit("")))
    refused = F.when(F.lit(not settings.gemini_api_key), F.lit(NOT_CONFIGURED)).when(store.isNull(), F.lit(NO_STORE)).when(
        F.size(over) > 0, F.concat(F.lit("custom_metadata contiene string_value mayor a 256 caracteres: "), F.to_json(over))
    )
    sent = F.to_json(F.transform("custom_metadata", lambda p, i: F.struct(i.alias("index"), p["key"].alias("key"), F.char_length(p["string_value"]).alias("length"), p["string_value"].alias("value"))))
    asked = requests.select("filename", "markdown", store.alias("store"), F.transform("custom_metadata", lambda p: F.array(p["key"], p["string_value"])).alias("pairs"), sent.alias("sent"), refused.alias("refused"))

    def call(filename, markdown, store_, pairs, sent_, refused_):
        if refused_ is not None:
            raise RuntimeError(refused_)
        try:
            operation, done = upload(store_, filename, markdown, [tuple(p) for p in pairs])
        except Exception as e:
            raise RuntimeError(f"{e}; custom_metadata_sent={sent_}") from e
        return operation, wait_operation(poll, operation, done, most, every) if wait else done

    found = call_each(asked, call, ["filename", "markdown", "store", "pairs", "sent", "refused"], "struct<operation: string, done: boolean>", "uploads")
    status = outcome(F.col("error_kind"), F.coalesce("error_message", F.lit("")))
    return found.select("filename", "store", F.col("error_kind").isNull().alias("uploaded"), "result.operation", "result.done", "error_message", *status)


def upload_requests(
    requests: DataFrame, registry: DataFrame, listed: DataFrame, create: Callable[[str], str], upload: Uploader, poll: Callable[[str], bool],
    settings: Settings = Settings(), every: float = POLL,
) -> tuple[DataFrame, DataFrame]:
    """Answers to whole upload requests, and what the registry is to learn (display_name, store).

    ``requests``: filename, markdown, the metadata fields, file_search_store_name,
    create_store_if_missing, wait_until_done, max_wait_seconds. A store's name is
    resolved (given in full, by ``registry``, by what is ``listed``, or created,
    once for each name), the metadata becomes key/value pairs, and the Markdown is
    uploaded and waited for. A store that one request has made is there for others
    that wouldn't make it.
    """
    paired = metadata.custom_metadata(requests, "custom_metadata")
    name, key = F.col("file_search_store_name"), settings.gemini_api_key
    refused = F.when(F.lit(not key), F.lit(NOT_CONFIGURED)).when(F.coalesce(name, F.lit("")) == "", F.lit(NO_STORE))
    make = F.coalesce("create_store_if_missing", F.lit(True))
    asked = materialize(paired.select("filename", "markdown", "custom_metadata", name.alias("requested"), make.alias("make"), "wait_until_done", "max_wait_seconds", refused.alias("refused")), "asked")

    names = asked.where("refused IS NULL").groupBy("requested").agg(F.bool_or("make").alias("wanted"))
    found = pairing.resolve_stores(names, registry, listed)
    made = call_each(found.where("how = 'create' AND wanted").select("requested"), create, ["requested"], "string", "stores")
    created = made.select(F.col("requested").alias("new_name"), "result", "error_message")
    both = found.join(created, F.col("requested") == F.col("new_name"), "left")
    stores = materialize(both.select(F.col("requested").alias("display_name"), F.coalesce("store", "result").alias("store"), "save", F.col("error_message").alias("failed")), "resolved")
    news = stores.where("save AND store IS NOT NULL").select("display_name", "store")

    met = asked.join(stores, F.col("requested") == F.col("display_name"), "left")
    missing = F.concat(F.lit("No existe File Search Store con display_name '"), "requested", F.lit("'"))
    over = metadata.oversized(F.col("custom_metadata"))
    why = F.coalesce(
        F.col("refused"),
        F.when(F.col("store").isNull(), F.coalesce(F.when(F.col("make"), F.col("failed")), missing)),
        F.when(F.size(over) > 0, F.concat(F.lit("custom_metadata contiene string_value mayor a 256 caracteres: "), F.to_json(over))),
    )
    sent = F.to_json(F.transform("custom_metadata", lambda p, i: F.struct(i.alias("index"), p["key"].alias("key"), F.char_length(p["string_value"]).alias("length"), p["string_value"].alias("value"))))
    pairs = F.transform("custom_metadata", lambda p: F.array(p["key"], p["string_value"]))
    wait, most = F.coalesce("wait_until_done", F.lit(True)), F.coalesce("max_wait_seconds", F.lit(MAX_WAIT))
    ready = met.select("filename", "markdown", "store", pairs.alias("pairs"), sent.alias("sent"), why.alias("why"), wait.alias("wait"), most.alias("most"))

    def call(filename, markdown, store, pairs_, sent_, why_, wait_, most_):
        if why_ is not None:
            raise RuntimeError(why_)
        try:
            operation, done = upload(store, filename, markdown, [tuple(p) for p in pairs_])
        except Exception as e:
            raise RuntimeError(f"{e}; custom_metadata_sent={sent_}") from e
        return operation, wait_operation(poll, operation, done, most_, every) if wait_ else done

    uploads = call_each(ready, call, ["filename", "markdown", "store", "pairs", "sent", "why", "wait", "most"], "struct<operation: string, done: boolean>", "uploads")
    good = F.col("error_kind").isNull()
    told = outcome(F.col("error_kind"), F.coalesce("error_message", F.lit("")))
    answer = uploads.select("filename", F.lit(True).alias("enabled"), good.alias("uploaded"), F.when(good, F.col("store")).alias("file_search_store"), "result.operation", "result.done", "error_message", *told)
    return answer.withColumn("message", F.when(F.col("status") == 200, F.lit(UPLOADED)).otherwise(F.col("message"))), news


# --- search ---


def rag_search(requests: DataFrame, retriever: Retriever, settings: Settings = Settings()) -> DataFrame:
    """Answers to ``requests`` (resp_id, query, original_message, legal_category, canonical_category, canonical_subcategories, metadata_hints, search_terms, store).

    ``resp_id, answer, citations, valid, retry_suggestion``, or status and code.
    """
    listed = lambda c: F.coalesce(c, F.expr("cast(array() AS array<string>)"))
    prompt = retrieval.search_prompt(
        F.col("query"), F.coalesce("original_message", F.lit("")), F.col("legal_category"), F.col("canonical_category"),
        *(listed(F.col(c)) for c in ("canonical_subcategories", "metadata_hints", "search_terms")),
    )
    store = F.coalesce(F.nullif("store", F.lit("")), F.lit(settings.gemini_file_search_store or ""))
    key = settings.gemini_api_key

    def call(prompt_, store_):
        if not key or not store_:
            raise RuntimeError(NOT_CONFIGURED if not key else NO_STORE)
        said, parts, chunks = retriever(prompt_, store_)
        return said, list(parts or []), [(t, x, [(k, v) for k, v in m or []]) for t, x, m in chunks]

    shape = "struct<text: string, parts: array<string>, chunks: array<struct<title: string, text: string, custom_metadata: array<struct<key: string, string_value: string>>>>>"
    found = call_each(requests.select("resp_id", prompt.alias("prompt"), store.alias("store")), call, ["prompt", "store"], shape, "answers")
    answers = found.select("resp_id", text.response_text(F.col("result.text"), F.col("result.parts")).alias("answer"), *outcome(F.col("error_kind"), F.coalesce("error_message", F.lit(""))))
    chunks = found.select("resp_id", F.lit(0).alias("cand_pos"), F.posexplode("result.chunks").alias("chunk_pos", "c")).select("resp_id", "cand_pos", "chunk_pos", "c.*")
    cited = materialize(retrieval.citations(chunks), "citations")
    one = F.struct("chunk_pos", "file_id", "file_name", "snippet", "file_url")
    listed_ = cited.groupBy("resp_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda c: c.dropFields("chunk_pos")).alias("citations"))
    shown = retrieval.responses(answers.where("status = 200").select("resp_id", "answer"), cited).drop("n_citations")
    good = shown.join(listed_, "resp_id", "left").join(answers.select("resp_id", "status", "code", "message"), "resp_id")
    return good.unionByName(answers.where("status <> 200").select("resp_id", "status", "code", "message"), allowMissingColumns=True)


# --- errors and review ---


def failures(started: DataFrame, polled: DataFrame, extracted: DataFrame) -> DataFrame:
    """The error records of all routes: starts that were refused, polls without a job, jobs that failed, extractions that failed.

    ``started`` (filename, status, code), ``polled`` (job_id, filename, http, code, status, error) and ``extracted`` (filename, status, code).
    """
    none = F.lit(None).cast("string")
    shape = lambda df, stage, code, message: df.select("filename", F.lit(stage).alias("stage"), code.alias("code"), message.alias("message"))
    parts = [
        shape(started.where("status <> 200"), "start", F.col("code"), none),
        shape(polled.where("http <> 200"), "poll", F.col("code"), none),
        shape(polled.where("http = 200 AND status = 'failed'"), "conversion", none, F.col("error")),
        shape(extracted.where("status <> 200"), "extraction", F.col("code"), none),
    ]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return jobs.error_records(whole).withColumn("stage", F.get_json_object("error", "$.stage"))


def review_state(packages: DataFrame, reviews: DataFrame) -> DataFrame:
    """``packages`` (document_id and more) with ``review``: waiting, or the last decision of ``reviews`` (document_id, decision, seq).

    The pause of a workflow for its reviewer is a table: what is approved goes on
    when a later run finds the decision.
    """
    last = jobs.latest_states(reviews.select("document_id", "decision", "seq"), "document_id", "seq").select("document_id", "decision")
    return packages.join(last, "document_id", "left").withColumn("review", F.coalesce("decision", F.lit("waiting"))).drop("decision")
