"""The registered queries of the library's own operators, each with SQL for DuckDB where SQL can express it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweft.functions import exact, taxonomy, text
from lexweft.operators import documents as docs_ops
from lexweft.operators import jobs, metadata, pairing, retrieval, search, services
from lexweft.plans.fixtures import DIRTY, JOB_EVENTS, LABELS, OUTPUTS, PAIRS, RESPONSES, view
from lexweft.sources import sinks
from lexweft.sources.files import Settings, read_table
from lexweft.sources.shared import materialize, shared_path

QUERIES: dict = {}
ORACLES: dict = {}

#: DuckDB's white space, spelled out to mean what text.WS does.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}]"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _collapse(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{WS}+|{WS}+\z', '', 'g')"


def _key(x: str) -> str:
    return _strip(_collapse(f"lower(strip_accents({x}))"))


_MD_BODY = _strip(
    r"regexp_replace(regexp_replace(regexp_replace(md, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{4,}', chr(10)||chr(10)||chr(10), 'g')"
)
_NORMALIZED = f"CASE WHEN {_MD_BODY} = '' THEN '' ELSE {_MD_BODY} || chr(10) END"


def _plain(x: str) -> str:
    out = f"regexp_replace({x}, '`{{3}}.*?`{{3}}', ' ', 'gs')"
    out = rf"regexp_replace({out}, '!\[[^\]]*\]\([^)]+\)', ' ', 'g')"
    out = rf"regexp_replace({out}, '\[([^\]]+)\]\([^)]+\)', '\1', 'g')"
    return _strip(_collapse(f"regexp_replace({out}, '[#>*_`|~-]', ' ', 'g')"))


def _fit(x: str) -> str:
    return f"""CASE WHEN length({x}) <= 256 THEN {x}
      WHEN strpos({x}, '. ') BETWEEN 1 AND 256 THEN substring({x}, 1, strpos({x}, '. '))
      ELSE regexp_replace(substring({x}, 1, 253), '{WS}+\\z', '') || '...' END"""


def _dirty(spark, sf_dir):
    return view(spark, sf_dir, DIRTY, "documents")


# --- text ---


@query(f"SELECT doc_id, {_NORMALIZED} AS markdown FROM ({DIRTY})")
def normalize_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dirty(spark, sf_dir).select("doc_id", text.normalize_markdown(F.col("md")).alias("markdown"))


@query(f"SELECT doc_id, {_plain('md')} AS plain FROM ({DIRTY})")
def plain_text(spark, sf_dir):
    return _dirty(spark, sf_dir).select("doc_id", text.plain_text(F.col("md")).alias("plain"))


_CLEAN = _strip(_collapse(r"regexp_replace(replace(md, chr(160), ' '), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"))


@query(f"SELECT doc_id, {_CLEAN} AS cleaned FROM ({DIRTY})")
def clean_text(spark, sf_dir):
    return _dirty(spark, sf_dir).select("doc_id", text.clean_text(F.col("md")).alias("cleaned"))


@query(f"SELECT doc_id, {_fit('t')} AS value FROM (SELECT doc_id, {_strip(_collapse('text'))} AS t FROM documents)")
def fit_value(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", text.fit_value(F.col("text")).alias("value"))


@query(
    "SELECT doc_id, coalesce(nullif(trim(regexp_replace(replace(lower(strip_accents(t)), 'ß', 'ss'), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS code"
    " FROM (SELECT doc_id, text AS t FROM documents)"
)
def metadata_code(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", text.metadata_code(F.col("text")).alias("code"))


@query("SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_.-]+', '-', 'g') || '.error.json' AS record_name FROM pages")
def safe_filename(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", text.safe_filename(F.col("url")).alias("record_name"))


@query(
    "SELECT doc_id, trim(regexp_replace(lower(concat(source, ' ', lang, '.v', doc_id % 5)), '[^a-z0-9]+', '-', 'g'), '-') || '-' || substring(sha256(text), 1, 12)"
    " AS document_id FROM documents"
)
def document_id(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    name = F.concat("source", F.lit(" "), F.upper("lang"), F.lit(".v"), F.col("doc_id") % 5, F.lit(".pdf"))
    return d.select("doc_id", text.document_id(name, F.col("text").cast("binary")).alias("document_id"))


_RESPONSE = "string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) FILTER (trim(text) <> '')"


@query(f"SELECT conv_id, coalesce({_RESPONSE}, '') AS answer FROM conversations GROUP BY conv_id")
def response_text(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", text.response_text(F.lit(""), F.transform("t", lambda x: x["text"])).alias("answer"))


_LINES = "list_filter(list_transform(string_split(p, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""
SELECT doc_id, trim('## Pagina 1' || chr(10) || chr(10) || array_to_string({_LINES.replace('(p,', '(text,')}, chr(10))
       || chr(10) || chr(10) || chr(10) || '## Pagina 2' || chr(10) || chr(10) || text, ' ' || chr(10)) AS markdown FROM documents""")
def ocr_markdown(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    pages = F.array(F.split("text", "\n"), F.expr("cast(array() as array<string>)"))
    return d.select("doc_id", text.ocr_markdown(F.col("text"), pages).alias("markdown"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{"a": "' || source || '"}' ELSE source END AS body FROM documents""")
def strip_code_fence(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    fenced = F.concat(F.lit(' ```json\n{"a": "'), "source", F.lit('"}\n```\n'))
    return d.select("doc_id", text.strip_code_fence(F.when(F.col("doc_id") % 2 == 0, fenced).otherwise(F.col("source"))).alias("body"))


# --- documents ---


@query("""
SELECT page_id, CASE WHEN page_id % 3 = 2 THEN 'INVALID_FILE_TYPE' WHEN strlen(html)::BIGINT * 20000 > 75 * 1024 * 1024 THEN 'FILE_TOO_LARGE' END AS refused
FROM pages""")
def upload_gate(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    end = F.when(F.col("page_id") % 3 == 0, F.lit(".pdf")).when(F.col("page_id") % 3 == 1, F.lit(".PDF")).otherwise(F.lit(".pdf.html"))
    size = F.octet_length("html").cast("long") * 20000
    return p.select("page_id", docs_ops.upload_error(F.concat("url", end), size).alias("refused"))


@query(f"SELECT doc_id, length({_plain('text')}) < 800 AS needs_ocr FROM documents")
def ocr_gate(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", text.plain_text(F.col("text")).alias("plain"))
    return d.select("doc_id", docs_ops.needs_ocr(F.col("plain")).alias("needs_ocr"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || '.pdf' ELSE 'http://x/' || source END AS hint FROM documents")
def source_hint(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    link = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("http://x/"), "source")).when(F.col("doc_id") % 3 == 2, F.concat(F.lit("http://x/"), "source")).otherwise("")
    return d.select("doc_id", docs_ops.source_hint(link, F.concat("source", F.lit(".pdf"))).alias("hint"))


# --- taxonomy and metadata ---


@query(f"""
SELECT string_agg(line, chr(10) ORDER BY cat_ord) AS catalog FROM (
  SELECT cat_ord, '- ' || category || ': ' || coalesce(string_agg(subcategory, ', ' ORDER BY sub_ord), 'sin subcategoria') AS line
  FROM ({PAIRS}) GROUP BY category, cat_ord)""")
def catalog_text(spark, sf_dir):
    return spark.range(1).select(F.lit(taxonomy.catalog_text()).alias("catalog"))


_CANON = f"""
SELECT l.doc_id, l.pos, l.categoria, l.subcategoria, coalesce(c.category, l.categoria) AS canonical_category,
  CASE WHEN c.childless THEN NULL ELSE coalesce(s.subcategory, l.subcategoria) END AS canonical_subcategory,
  c.cat_code, CASE WHEN c.childless THEN NULL ELSE s.sub_code END AS sub_code,
  CASE WHEN c.childless THEN true ELSE coalesce(s.subcategory IS NOT NULL, false) END AS valid
FROM ({LABELS}) l
LEFT JOIN (SELECT DISTINCT category, cat_code, childless FROM ({PAIRS})) c ON {_key('l.categoria')} = lower(c.category)
LEFT JOIN ({PAIRS}) s ON s.category = c.category AND {_key('l.subcategoria')} = lower(s.subcategory)"""


@query(f"SELECT doc_id, pos, canonical_category, canonical_subcategory, valid FROM ({_CANON})")
def alias_lookup(spark, sf_dir):
    found = taxonomy.canonicalize_by_join(view(spark, sf_dir, LABELS, "documents"))
    return found.select("doc_id", "pos", "canonical_category", "canonical_subcategory", "valid")


@query(f"SELECT doc_id, pos, valid FROM ({_CANON})")
def pair_validation(spark, sf_dir):
    labels = view(spark, sf_dir, LABELS, "documents")
    cat = taxonomy.canonical_category(F.col("categoria"))
    sub = taxonomy.canonical_subcategory(F.col("categoria"), F.col("subcategoria"))
    return labels.select("doc_id", "pos", taxonomy.valid_pair(cat, sub).alias("valid"))


_GROUPED = f"""
WITH x AS ({_CANON}), g AS (SELECT doc_id, canonical_category, min(pos) AS first_pos FROM x GROUP BY ALL),
s AS (SELECT doc_id, canonical_category, canonical_subcategory AS sub, min(pos) AS sub_pos FROM x
      WHERE canonical_subcategory IS NOT NULL AND {_strip('subcategoria')} <> '' GROUP BY ALL),
a AS (SELECT doc_id, canonical_category, string_agg(sub, ',' ORDER BY sub_pos) AS subs,
        string_agg(coalesce(p.sub_code, trim(regexp_replace(lower(sub), '[^a-z0-9]+', '_', 'g'), '_')), ',' ORDER BY sub_pos) AS codes
      FROM s LEFT JOIN (SELECT subcategory, sub_code FROM ({PAIRS})) p ON p.subcategory = sub GROUP BY ALL),
c AS (SELECT DISTINCT category, cat_code FROM ({PAIRS}))
SELECT g.doc_id, g.canonical_category, g.first_pos, subs, cat_code || coalesce(':' || codes, '') AS entry
FROM g LEFT JOIN a USING (doc_id, canonical_category) LEFT JOIN c ON c.category = g.canonical_category"""


def _grouped(spark, sf_dir):
    labels = view(spark, sf_dir, LABELS, "documents")
    entry = F.struct("pos", "categoria", F.array("subcategoria").alias("subcategorias"))
    listed = labels.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return listed.select("doc_id", metadata.group_categories(F.col("entries")).alias("categorias"))


@query(f"""SELECT doc_id, string_agg(canonical_category || coalesce('=' || subs, '='), ';' ORDER BY first_pos) AS groups
FROM ({_GROUPED}) GROUP BY doc_id""")
def group_categories(spark, sf_dir):
    shown = F.transform("categorias", lambda g: F.concat(g["categoria"], F.lit("="), F.array_join(g["subcategorias"], ",")))
    return _grouped(spark, sf_dir).select("doc_id", F.array_join(shown, ";").alias("groups"))


@query(f"""SELECT doc_id, count(*)::VARCHAR AS categorias_count, string_agg(entry, '|' ORDER BY first_pos) AS categorias_compact
FROM ({_GROUPED}) GROUP BY doc_id""")
def compact_metadata(spark, sf_dir):
    pairs = _grouped(spark, sf_dir).withColumn("p", metadata.category_pairs(F.col("categorias")))
    chunks = F.filter("p", lambda x: F.startswith(x["key"], F.lit("categorias_compact")))
    return pairs.select("doc_id", F.col("p")[0]["string_value"].alias("categorias_count"), F.array_join(F.transform(chunks, lambda x: x["string_value"]), "|").alias("categorias_compact"))


#: A document's whole catalog, an entry a category, packed greedily into chunks of at most 256 characters.
_PACKED = f"""
WITH RECURSIVE e AS (SELECT cat_ord, cat_code || coalesce(':' || string_agg(sub_code, ',' ORDER BY sub_ord), '') AS entry FROM ({PAIRS}) GROUP BY cat_ord, cat_code),
o AS (SELECT row_number() OVER (ORDER BY cat_ord) AS i, entry FROM e),
p(i, chunk, now) AS (
  SELECT 0::BIGINT, 0, '' UNION ALL
  SELECT o.i, CASE WHEN p.now = '' OR length(p.now || '|' || o.entry) <= 256 THEN p.chunk ELSE p.chunk + 1 END,
    CASE WHEN p.now = '' THEN o.entry WHEN length(p.now || '|' || o.entry) <= 256 THEN p.now || '|' || o.entry ELSE o.entry END
  FROM p JOIN o ON o.i = p.i + 1),
c AS (SELECT chunk AS pos, arg_max(now, i) AS chunk FROM p WHERE i > 0 GROUP BY chunk)
SELECT doc_id, pos, chunk FROM documents CROSS JOIN c"""


@query(_PACKED)
def pack_entries(spark, sf_dir):
    """Every category with every subcategory needs more than one chunk."""
    everything = [(c, [s for s, _ in subs]) for c, _, subs in taxonomy.CATEGORIES]
    groups = spark.createDataFrame([(everything,)], f"categorias array<{metadata.GROUP}>")
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    chunks = groups.select(metadata.pack_entries(metadata.category_entries(F.col("categorias"))).alias("chunks"))
    return d.join(F.broadcast(chunks)).select("doc_id", F.posexplode("chunks").alias("pos", "chunk"))


@query(f"""
WITH j AS (SELECT doc_id, CASE WHEN json_valid(b) THEN b::JSON END AS j
  FROM (SELECT doc_id, trim(replace(replace(raw, '```json', ''), '```', ''), ' ' || chr(10)) AS b FROM ({OUTPUTS}))),
f AS (SELECT doc_id, j IS NOT NULL AS ok, CASE json_type(j, '$.confidence') WHEN 'BOOLEAN' THEN (j->>'$.confidence')::BOOLEAN::INT::DOUBLE
        ELSE try_cast(trim(j->>'$.confidence') AS DOUBLE) END AS confidence,
    json_type(j, '$.articulo') AS art, nullif(trim(j->>'$.titulo'), '') AS titulo, j->>'$.materia' AS materia,
    j->>'$.categorias[0].categoria' AS cat, coalesce(j->>'$.categorias[0].subcategorias[0]', j->>'$.categorias[0].subcategoria') AS sub FROM j)
SELECT doc_id, CASE WHEN art = 'UBIGINT' THEN NULL ELSE titulo END AS titulo, materia, confidence,
  CASE WHEN NOT ok THEN 'json' ELSE concat_ws(',', CASE WHEN art = 'UBIGINT' THEN 'articulo' END,
    CASE WHEN lower(cat) = 'sucesiones y herencia' OR (lower(cat) = 'generales' AND lower(sub) = 'otros') THEN NULL ELSE 'categorias' END,
    CASE WHEN confidence BETWEEN 0 AND 1 THEN NULL ELSE 'confidence' END) END AS errors
FROM f""")
def validate_metadata(spark, sf_dir):
    found = metadata.extract(view(spark, sf_dir, OUTPUTS, "documents"))
    return found.select("doc_id", "titulo", "materia", "confidence", F.array_join("errors", ",").alias("errors"))


@query(f"""
SELECT doc_id, CASE doc_id % 7
  WHEN 0 THEN 'titulo=T ' || source || ';categorias_count=1;categorias_compact=gen:otros;confidence=0.9'
  WHEN 1 THEN 'materia=' || lang || ';categorias_count=1;categorias_compact=gen:otros;confidence=0.5'
  ELSE 'categorias_count=1;categorias_compact=sh;confidence=1.0' END AS pairs, 0 AS oversized
FROM documents WHERE doc_id % 7 IN (0, 1, 6)""")
def custom_metadata(spark, sf_dir):
    found = metadata.extract(view(spark, sf_dir, OUTPUTS, "documents")).where("size(errors) = 0")
    pairs = metadata.custom_metadata(found, "p")
    return pairs.select("doc_id", F.array_join(F.transform("p", lambda x: F.concat_ws("=", x["key"], x["string_value"])), ";").alias("pairs"), F.size(metadata.oversized(F.col("p"))).alias("oversized"))


# --- jobs and errors ---


@query(f"SELECT job_id, max(seq) AS seq, arg_max(status, seq) AS status FROM ({JOB_EVENTS}) GROUP BY job_id")
def job_latest_status(spark, sf_dir):
    return jobs.latest_states(view(spark, sf_dir, JOB_EVENTS, "events")).select("job_id", "seq", "status")


@query(f"SELECT status, count(*) AS n_jobs FROM (SELECT job_id, arg_max(status, seq) AS status FROM ({JOB_EVENTS}) GROUP BY job_id) GROUP BY status")
def job_rollup(spark, sf_dir):
    return jobs.latest_states(view(spark, sf_dir, JOB_EVENTS, "events")).groupBy("status").agg(F.count("*").alias("n_jobs"))


@query(f"""SELECT job_id, CASE WHEN status IN ('succeeded', 'failed') THEN status ELSE 'pending' END AS branch
FROM (SELECT job_id, arg_max(status, seq) AS status FROM ({JOB_EVENTS}) GROUP BY job_id)""")
def status_branch(spark, sf_dir):
    last = jobs.latest_states(view(spark, sf_dir, JOB_EVENTS, "events"))
    parts = [df.select("job_id", F.lit(name).alias("branch")) for name, df in jobs.split_by_status(last).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_MESSAGES = """SELECT event_id, concat(CASE event_id % 8 WHEN 0 THEN 'Timeout waiting ' WHEN 1 THEN 'Invalid api_key ' WHEN 2 THEN 'API_KEY missing '
  WHEN 3 THEN 'No existe File Search Store ' WHEN 4 THEN 'Gemini unreachable ' WHEN 5 THEN 'bad JSON ' WHEN 6 THEN 'la operacion no termino ' ELSE 'display_name vacio ' END, event_type) AS message FROM events"""


@query(f"""
SELECT event_id, CASE WHEN m LIKE '%timeout%' OR m LIKE '%no termino%' THEN 504 WHEN m LIKE '%json%' OR m LIKE '%valid%' THEN 422
  WHEN m LIKE '%api!_key%' ESCAPE '!' OR m LIKE '%no esta configurado%' THEN 503 WHEN m LIKE '%file search%' OR m LIKE '%store%' THEN 503
  WHEN m LIKE '%gemini%' THEN 503 ELSE 422 END AS status,
  CASE WHEN m LIKE '%timeout%' OR m LIKE '%no termino%' THEN 'UPSTREAM_TIMEOUT' WHEN m LIKE '%json%' OR m LIKE '%valid%' THEN 'AGENT_VALIDATION_FAILED'
  WHEN m LIKE '%api!_key%' ESCAPE '!' OR m LIKE '%no esta configurado%' THEN 'UPSTREAM_NOT_CONFIGURED' WHEN m LIKE '%file search%' OR m LIKE '%store%' OR m LIKE '%gemini%'
  THEN 'UPSTREAM_UNAVAILABLE' ELSE 'PROCESSING_FAILED' END AS code
FROM (SELECT event_id, lower(message) AS m FROM ({_MESSAGES}))""")
def classify_error(spark, sf_dir):
    found = view(spark, sf_dir, _MESSAGES, "events").withColumn("e", jobs.classify_error(F.col("message")))
    return found.select("event_id", "e.status", "e.code")


@query(f"""SELECT seq, filename, regexp_replace(filename, '[^a-zA-Z0-9_.-]+', '-', 'g') || '.error.json' AS record_name
FROM ({JOB_EVENTS}) WHERE status = 'failed'""")
def error_records(spark, sf_dir):
    failed = view(spark, sf_dir, JOB_EVENTS, "events").where("status = 'failed'")
    found = jobs.error_records(failed)
    return found.select(F.get_json_object("error", "$.seq").cast("long").alias("seq"), "filename", "record_name")


@query(f"""SELECT w.job_id, j.status, j.filename, CASE WHEN j.job_id IS NULL THEN 404 ELSE 200 END AS http, CASE WHEN j.job_id IS NULL THEN 'JOB_NOT_FOUND' END AS code,
  CASE WHEN j.job_id IS NULL THEN 'Conversion job no existe.' END AS message
FROM (SELECT 'job-' || c_custkey AS job_id FROM customer) w
LEFT JOIN (SELECT job_id, arg_max(status, seq) AS status, arg_max(filename, seq) AS filename FROM ({JOB_EVENTS}) GROUP BY job_id) j USING (job_id)""")
def find_jobs(spark, sf_dir):
    wanted = read_table(spark, sf_dir, "customer").select(F.concat(F.lit("job-"), F.col("c_custkey")).alias("job_id"))
    return jobs.find_jobs(wanted, jobs.latest_states(view(spark, sf_dir, JOB_EVENTS, "events")))


# --- pairing ---


def _outputs(spark, sf_dir):
    stem = F.concat(F.lit("doc-"), F.col("doc_id"))
    d = read_table(spark, sf_dir, "documents").select(F.concat(stem, F.lit(".md")).alias("name"))
    m = read_table(spark, sf_dir, "labels").select(F.concat(stem, F.lit(".metadata.json")).alias("name"))
    return d.union(m)


@query("SELECT 'doc-' || d.doc_id AS stem, 'doc-' || d.doc_id || '.md' AS md, 'doc-' || d.doc_id || '.metadata.json' AS metadata FROM documents d JOIN labels USING (doc_id)")
def pair_md_metadata(spark, sf_dir):
    return pairing.complete_pairs(_outputs(spark, sf_dir))


@query("SELECT 'doc-' || doc_id AS stem, 'doc-' || doc_id || '.md' AS md, NULL::VARCHAR AS metadata FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unpaired(spark, sf_dir):
    return pairing.unpaired(_outputs(spark, sf_dir))


def _sources(spark, sf_dir):
    name = F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".pdf")).alias("filename")
    return read_table(spark, sf_dir, "documents").select(name, "source"), read_table(spark, sf_dir, "labels").select(name)


@query("SELECT 'doc-' || doc_id || '.pdf' AS filename, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def reviewed_sources(spark, sf_dir):
    return pairing.reviewed(*_sources(spark, sf_dir))


@query("SELECT 'doc-' || doc_id || '.pdf' AS filename, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_sources(spark, sf_dir):
    return pairing.pending(*_sources(spark, sf_dir))


@query("""
SELECT c_custkey AS req, requested, CASE WHEN c_custkey % 4 = 0 THEN requested WHEN c_custkey % 4 = 1 THEN 'reg-' || (c_custkey % 20)
  WHEN c_custkey % 4 = 2 THEN 'fileSearchStores/n' || (c_custkey % 20) END AS store,
  CASE c_custkey % 4 WHEN 0 THEN 'given' WHEN 1 THEN 'registry' WHEN 2 THEN 'listed' ELSE 'create' END AS how,
  c_custkey % 4 >= 2 AS save
FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'fileSearchStores/' || c_custkey WHEN 1 THEN 'known ' || (c_custkey % 20)
  WHEN 2 THEN 'shown ' || (c_custkey % 20) ELSE 'new ' || c_custkey END AS requested FROM customer)""")
def resolve_stores(spark, sf_dir):
    c, k = read_table(spark, sf_dir, "customer"), F.col("c_custkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("fileSearchStores/"), k)).when(k % 4 == 1, F.concat(F.lit("known "), k % 20))
    name = name.when(k % 4 == 2, F.concat(F.lit("shown "), k % 20)).otherwise(F.concat(F.lit("new "), k))
    i = spark.range(20).select("id")
    registry = i.select(F.concat(F.lit("known "), "id").alias("display_name"), F.concat(F.lit("reg-"), "id").alias("store"))
    listed = i.select(F.col("id").alias("pos"), F.concat(F.lit("shown "), "id").alias("display_name"), F.concat(F.lit("fileSearchStores/n"), "id").alias("name"))
    later = listed.select((F.col("pos") + 100).alias("pos"), "display_name", F.concat(F.lit("fileSearchStores/late"), "pos").alias("name"))
    requests = c.select(k.alias("req"), name.alias("requested"))
    return pairing.resolve_stores(requests, registry, listed.unionByName(later))


@query("SELECT 'store ' || (o_custkey % 50) AS display_name, arg_max('s' || o_orderkey, o_orderkey) AS store FROM orders GROUP BY 1 UNION ALL SELECT 'kept', 'old'")
def registry_upsert(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    news = o.select(F.concat(F.lit("store "), F.col("o_custkey") % 50).alias("display_name"), F.concat(F.lit("s"), "o_orderkey").alias("store"), F.col("o_orderkey").alias("seq"))
    old = spark.createDataFrame([("kept", "old"), ("store 1", "old")], "display_name string, store string")
    return pairing.upsert_registry(old, news)


# --- retrieval ---


def _chunks(spark, sf_dir):
    r = view(spark, sf_dir, RESPONSES, "documents")
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("string_value"))
    meta = F.array(entry("fuente", F.lit("x")), entry("fuente", F.col("source")), entry("identificador", F.concat(F.lit("id "), "source")))
    return r.select("resp_id", "cand_pos", "chunk_pos", "title", F.col("body").alias("text"), meta.alias("custom_metadata"))


_SNIPPET = _strip(_collapse("body"))


@query(f"""
SELECT resp_id, cand_pos, chunk_pos, 'id ' || source AS file_id, title AS file_name, snippet, source AS file_url FROM (
  SELECT *, row_number() OVER (PARTITION BY resp_id, title, source, substring(snippet, 1, 120) ORDER BY cand_pos, chunk_pos) AS n
  FROM (SELECT *, {_SNIPPET} AS snippet FROM ({RESPONSES}))) WHERE n = 1""")
def citation_dedupe(spark, sf_dir):
    return retrieval.citations(_chunks(spark, sf_dir))


@query(f"""
WITH c AS (SELECT resp_id, count(DISTINCT title || '|' || source || '|' || substring({_SNIPPET}, 1, 120)) AS n FROM ({RESPONSES}) GROUP BY resp_id),
a AS (SELECT conv_id AS resp_id, CASE WHEN conv_id % 3 = 0 THEN '' ELSE max(text) END AS answer FROM conversations GROUP BY conv_id)
SELECT resp_id, CASE WHEN answer = '' THEN '{retrieval.NO_ANSWER}' ELSE answer END AS answer, coalesce(n, 0) AS n_citations,
  answer <> '' AND coalesce(n, 0) > 0 AS valid, CASE WHEN answer <> '' AND coalesce(n, 0) > 0 THEN NULL ELSE '{retrieval.RETRY}' END AS retry_suggestion
FROM a LEFT JOIN c USING (resp_id)""")
def rag_responses(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("resp_id")).agg(F.max("text").alias("t"))
    answers = c.select("resp_id", F.when(F.col("resp_id") % 3 == 0, F.lit("")).otherwise(F.col("t")).alias("answer"))
    return retrieval.responses(answers, retrieval.citations(_chunks(spark, sf_dir)))


def _questions(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").where("role = 'user'")
    name = F.when(F.col("turn") % 4 == 0, F.lit("PENSIÓN de alimentos")).when(F.col("turn") % 4 == 2, F.lit("generales")).otherwise(F.lit("otra"))
    asked = c.select("conv_id", "turn", "text", name.alias("legal"))
    return retrieval.retrieval_hints(asked, "legal").withColumn("terms", F.array(F.lit("alimentos"), F.lit("custodia")))


_HINTS = """SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN 'PENSIÓN de alimentos' WHEN 2 THEN 'generales' ELSE 'otra' END AS legal,
  CASE turn % 4 WHEN 0 THEN 'Relaciones Paterno-Filiales y Menores' WHEN 2 THEN 'Generales' ELSE '' END AS cat,
  CASE turn % 4 WHEN 0 THEN 'Pension de Alimentos' ELSE '' END AS sub,
  CASE turn % 4 WHEN 0 THEN 'rpfm:pension_alimentos' WHEN 2 THEN 'gen' ELSE '' END AS hint FROM conversations WHERE role = 'user'"""


@query(f"""SELECT conv_id, turn, 'Consulta del usuario: ' || text || chr(10) || 'Categoria legal: ' || legal || chr(10) || 'Categoria canonica: ' || cat || chr(10)
  || 'Subcategorias canonicas: ' || sub || chr(10) || 'Metadata preferida: ' || hint || chr(10) || 'Terminos de busqueda: alimentos, custodia' AS prompt FROM ({_HINTS})""")
def enriched_query(spark, sf_dir):
    q = _questions(spark, sf_dir)
    args = ("text", "legal", "canonical_category", "canonical_subcategories", "metadata_hints", "terms")
    return q.select("conv_id", "turn", retrieval.enriched_query(*map(F.col, args)).alias("prompt"))


@query(f"""SELECT conv_id, turn, 'Consulta del usuario: ' || text || chr(10) || 'Consulta de busqueda: ' || text || chr(10) || 'Categoria legal: ' || legal || chr(10)
  || 'Categoria canonica: ' || cat || chr(10) || 'Subcategorias canonicas: ' || sub || chr(10) || 'Metadata preferida: ' || hint || chr(10)
  || 'Terminos de busqueda: alimentos, custodia' || '{retrieval.SEARCH_RULES}' AS prompt FROM ({_HINTS})""")
def rag_prompt(spark, sf_dir):
    q = _questions(spark, sf_dir)
    args = (F.lit(""), "legal", "canonical_category", "canonical_subcategories", "metadata_hints", "terms")
    return q.select("conv_id", "turn", retrieval.search_prompt(F.col("text"), *[F.col(a) if isinstance(a, str) else a for a in args]).alias("prompt"))


@query(f"""SELECT doc_id, sha256('{retrieval.EXTRACT_RULES}{taxonomy.catalog_text()}{retrieval.EXTRACT_SCHEMA}' || source || '.pdf' || chr(10) || 'Fuente sugerida: '
  || source || '.pdf' || chr(10) || chr(10) || 'Documento Markdown:' || chr(10) || '---' || chr(10) || substring(text, 1, 180000) || chr(10) || '---') AS prompt_sha256
FROM documents""")
def metadata_prompt(spark, sf_dir):
    name = F.concat("source", F.lit(".pdf"))
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(retrieval.extraction_prompt(name, F.col("text"), F.lit("")), 256).alias("prompt_sha256"))


@query("""
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS rank
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 5""")
def retrieve_topk(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return retrieval.top_k_blocks(e.where("vec_id % 100 = 0"), e, 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


# --- the whole path for documents ---


@query(f"""
WITH n AS (SELECT doc_id, source, {_NORMALIZED} AS markdown FROM ({DIRTY})), p AS (SELECT *, {_plain('markdown')} AS plain FROM n)
SELECT doc_id, trim(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '-') || '-' || substring(sha256(markdown), 1, 12) AS document_id,
  length(plain) AS plain_chars, length(plain) < 800 AS needs_ocr, categorias_count, categorias_compact
FROM p LEFT JOIN (SELECT doc_id, count(*)::VARCHAR AS categorias_count, string_agg(entry, '|' ORDER BY first_pos) AS categorias_compact
  FROM ({_GROUPED}) GROUP BY doc_id) USING (doc_id)""")
def document_overview(spark, sf_dir):
    """Markdown to one row for each document: identity, OCR gate, categories and their compact form."""
    d = view(spark, sf_dir, DIRTY, "documents")
    shaped = d.select("doc_id", "source", text.normalize_markdown(F.col("md")).alias("markdown"))
    plain = shaped.select("doc_id", "source", "markdown", text.plain_text(F.col("markdown")).alias("plain"))
    made = plain.select(
        "doc_id", text.document_id(F.concat("source", F.lit(".pdf")), F.col("markdown").cast("binary")).alias("document_id"),
        F.char_length("plain").cast("long").alias("plain_chars"), docs_ops.needs_ocr(F.col("plain")).alias("needs_ocr"),
    )
    return made.join(compact_metadata(spark, sf_dir), "doc_id", "left")


_CONVERTED = f"""
WITH n AS (SELECT doc_id, text, {_NORMALIZED.replace('md', 'text')} AS native FROM documents),
p AS (SELECT *, length({_plain('native')}) < 800 AS short, doc_id % 10 = 7 AS odd, doc_id % 10 = 3 AS blind FROM n),
d AS (SELECT *, CASE WHEN short AND NOT blind THEN {_NORMALIZED.replace('md', "('OCR ' || text)")} ELSE native END AS markdown FROM p)
SELECT 'd' || doc_id || '.pdf' AS filename, 'd' || doc_id || '-' || substring(sha256(text), 1, 12) AS document_id,
  CASE WHEN odd THEN NULL ELSE 1 END AS pages, short AND NOT blind AS ocr_used,
  concat_ws(';', CASE WHEN odd THEN 'docling_failed: ValueError: no layout' END, CASE WHEN short AND blind THEN 'ocr_skipped_or_failed: RuntimeError: OCR no esta configurado' END) AS warnings,
  CASE WHEN markdown = '' THEN 'ValueError: No se pudo extraer contenido Markdown del PDF' END AS error, sha256(markdown) AS markdown_sha256
FROM d"""


@query(_CONVERTED)
def convert_documents(spark, sf_dir):
    """The conversion chain with stand-ins: UTF-8 text, a fallback for some names, OCR that says so."""

    def primary(name, content):
        if name.endswith("7.pdf"):
            raise ValueError("no layout")
        return content.decode(), 1

    def fallback(name, content):
        return content.decode(), 9

    def ocr(name, content):
        if name.endswith("3.pdf"):
            raise RuntimeError("OCR no esta configurado")
        return "OCR " + content.decode(), None

    d = read_table(spark, sf_dir, "documents")
    files = d.select(F.concat(F.lit("d"), "doc_id", F.lit(".pdf")).alias("filename"), F.col("text").cast("binary").alias("content"))
    out = docs_ops.convert(files, primary, fallback, ocr)
    return out.select("filename", "document_id", "pages", "ocr_used", F.array_join("warnings", ";").alias("warnings"), "error", F.sha2("markdown", 256).alias("markdown_sha256"))


# --- the service's routes, with stand-ins for what they call ---

CONFIGURED = Settings(gemini_api_key="key", gemini_file_search_store="main")


@query("SELECT 'ok' AS status")
def health(spark, sf_dir):
    return services.health(spark)


_MARKED = """SELECT doc_id, source, CASE doc_id % 4 WHEN 0 THEN concat('e\u0301', ' ', source) WHEN 1 THEN concat('Ã', chr(177), ' ', source)
  WHEN 2 THEN concat('a', chr(160), chr(7), 'n\u0303', source) ELSE concat(' ', text, ' ') END AS raw FROM documents"""


@query(f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'é ' || source WHEN 1 THEN 'ñ ' || source WHEN 2 THEN 'a ñ' || source
  ELSE {_strip(_collapse('raw'))} END AS cleaned FROM ({_MARKED})""")
def clean_exact(spark, sf_dir):
    """Cleaning of combining marks, mojibake, control characters and odd blanks."""
    return exact.clean_exact(view(spark, sf_dir, _MARKED, "documents"), "raw", "cleaned").select("doc_id", "cleaned")


@query(f"""
SELECT doc_id, ok AND json_type(j) = 'OBJECT' AS is_object, json_type(j, '$.articulo') = 'UBIGINT' AS number_for_text, nullif(trim(j->>'$.titulo'), '') AS titulo
FROM (SELECT doc_id, json_valid(b) AS ok, CASE WHEN json_valid(b) THEN b::JSON END AS j
  FROM (SELECT doc_id, trim(replace(replace(raw, '```json', ''), '```', ''), ' ' || chr(10)) AS b FROM ({OUTPUTS})))""")
def parse_metadata_json(spark, sf_dir):
    v = view(spark, sf_dir, OUTPUTS, "documents").select("doc_id", metadata.parse_json(F.col("raw")).alias("v"))
    kind = lambda path: F.regexp_extract(F.schema_of_variant(F.try_variant_get("v", path, "variant")), "^[A-Z]+", 0)
    title = F.nullif(text.ws_strip(F.try_variant_get("v", "$.titulo", "string")), F.lit(""))
    return v.select("doc_id", F.coalesce(kind("$") == "OBJECT", F.lit(False)).alias("is_object"), (kind("$.articulo") == "BIGINT").alias("number_for_text"), title.alias("titulo"))


@query(f"""SELECT doc_id, pos, categoria, coalesce(p.k IS NOT NULL OR (c.childless IS NOT NULL AND subcategoria IS NULL AND c.childless), false) AS valid
FROM (SELECT * REPLACE (CASE WHEN (doc_id * 3 + pos) % 8 = 2 AND subcategoria = ' ' THEN NULL ELSE subcategoria END AS subcategoria) FROM ({LABELS})) l
LEFT JOIN (SELECT DISTINCT category, childless FROM ({PAIRS})) c ON c.category = l.categoria
LEFT JOIN ({PAIRS}) p ON p.category = l.categoria AND p.subcategory = l.subcategoria""")
def exact_assignment(spark, sf_dir):
    """Groups of one subcategory as pairs, valid only where spelt as in the catalog."""
    labels = view(spark, sf_dir, LABELS, "documents")
    group = F.struct("categoria", F.when(F.col("subcategoria").isNull(), F.expr("cast(array() AS array<string>)")).otherwise(F.array("subcategoria")).alias("subcategorias"))
    return labels.select("doc_id", "pos", metadata.assignment(group).alias("a")).select("doc_id", "pos", "a.categoria", "a.valid")


def _requests(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select(F.concat("doc_id", F.lit(".pdf")).alias("filename"), F.col("text").alias("markdown"), F.lit(None).cast("string").alias("fuente"))


def _extracted(spark, sf_dir):
    good = '{"titulo": "T", "categorias": [{"categoria": "Generales", "subcategorias": ["Otros"]}], "confidence": 1}'

    def extractor(prompt):
        doc_id = int(prompt.rpartition("\nArchivo: ")[2].partition(".pdf")[0])
        if doc_id % 5 == 4:
            raise TimeoutError("late")
        return (good, "{}", "no json", f"```json\n{good}\n```")[doc_id % 5]

    return services.extract_route(_requests(spark, sf_dir), extractor, CONFIGURED, pause=0.0)


@query("""
SELECT doc_id || '.pdf' AS filename, CASE doc_id % 5 WHEN 4 THEN 504 WHEN 0 THEN 200 WHEN 3 THEN 200 ELSE 422 END AS status,
  CASE doc_id % 5 WHEN 4 THEN 'UPSTREAM_TIMEOUT' WHEN 0 THEN NULL WHEN 3 THEN NULL ELSE 'AGENT_VALIDATION_FAILED' END AS code,
  CASE WHEN doc_id % 5 IN (0, 3) THEN 'T' END AS titulo, CASE WHEN doc_id % 5 IN (0, 3) THEN 1 ELSE 5 END AS tries FROM documents""")
def extract_route(spark, sf_dir):
    """Extraction with retries: valid answers at once; answers that are none, and calls that fail, each time."""
    return _extracted(spark, sf_dir).select("filename", "status", "code", "titulo", "tries")


@query("""
SELECT c_custkey AS req, CASE c_custkey % 4 WHEN 0 THEN 'reg-' || (c_custkey % 20) WHEN 1 THEN 'fileSearchStores/n' || (c_custkey % 20) WHEN 2 THEN 'made/new ' || (c_custkey % 30) END AS name,
  c_custkey % 4 = 2 AS created, c_custkey % 4 <> 3 AS saved, CASE WHEN c_custkey % 4 = 3 THEN 503 ELSE 200 END AS status FROM customer""")
def resolve_route(spark, sf_dir):
    """Store names by registry, listing, creation (once a name), or refusal."""
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("known "), k % 20)).when(k % 4 == 1, F.concat(F.lit("shown "), k % 20)).when(k % 4 == 2, F.concat(F.lit("new "), k % 30)).otherwise(F.concat(F.lit("none "), k))
    asked = read_table(spark, sf_dir, "customer").select(k.alias("req"), name.alias("display_name"), (k % 4 == 2).alias("create_if_missing"))
    i = spark.range(20).select("id")
    registry = i.select(F.concat(F.lit("known "), "id").alias("display_name"), F.concat(F.lit("reg-"), "id").alias("store"))
    listed = i.select(F.col("id").alias("pos"), F.concat(F.lit("shown "), "id").alias("display_name"), F.concat(F.lit("fileSearchStores/n"), "id").alias("name"))
    names = asked.select("display_name", "create_if_missing").distinct()
    found = services.resolve_route(names, registry, listed, lambda n: f"made/{n}", CONFIGURED)
    return asked.join(found, "display_name").select("req", "name", "created", "saved", "status")


@query("""
SELECT doc_id || '.md' AS filename, CASE WHEN doc_id % 3 = 0 THEN 's' || doc_id % 7 ELSE 'main' END AS store, doc_id % 4 < 2 AS uploaded,
  CASE doc_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 200 WHEN 2 THEN 503 ELSE 422 END AS status,
  CASE doc_id % 4 WHEN 2 THEN 'gemini; custom_metadata_sent=[{"index":0,"key":"fuente","length":' || length(source) || ',"value":"' || source || '"}]'
    WHEN 3 THEN 'custom_metadata contiene string_value mayor a 256 caracteres: [{"index":0,"key":"fuente","length":257,"value":"' || repeat('x', 257) || '"}]' END AS error_message
FROM documents""")
def upload_route(spark, sf_dir):
    """Uploads that are done at once, need a second look, fail with what was sent, or are refused for a long value."""
    k = F.col("doc_id")

    def upload(store, name, markdown, pairs):
        if int(name.partition(".")[0]) % 4 == 2:
            raise RuntimeError("gemini")
        return f"op/{name}", int(name.partition(".")[0]) % 4 == 0

    meta = F.array(F.struct(F.lit("fuente").alias("key"), F.when(k % 4 == 3, F.repeat(F.lit("x"), 257)).otherwise(F.col("source")).alias("string_value")))
    d = read_table(spark, sf_dir, "documents")
    asked = d.select(F.concat(k, F.lit(".md")).alias("filename"), F.col("text").alias("markdown"), F.when(k % 3 == 0, F.concat(F.lit("s"), k % 7)).alias("store"), meta.alias("custom_metadata"))
    return services.upload_route(asked, upload, lambda operation: True, CONFIGURED, every=0.0).select("filename", "store", "uploaded", "status", "error_message")


@query(f"""
SELECT conv_id AS resp_id, CASE WHEN n % 3 = 2 THEN NULL WHEN n % 3 = 1 THEN '{retrieval.NO_ANSWER}' ELSE 'about ' || first END AS answer,
  CASE WHEN n % 3 = 0 THEN 'cite ' || first END AS snippet, CASE WHEN n % 3 < 2 THEN n % 3 = 0 END AS valid, CASE WHEN n % 3 = 2 THEN 504 ELSE 200 END AS status
FROM (SELECT conv_id, conv_id AS n, 'q' || conv_id AS first FROM conversations GROUP BY conv_id)""")
def rag_search(spark, sf_dir):
    """Searches that answer with a citation, answer nothing, or time out."""

    def retriever(prompt, store):
        asked = prompt.partition("Consulta del usuario: ")[2].partition("\n")[0]
        kind = int(asked[1:]) % 3
        if kind == 2:
            raise TimeoutError("late")
        return ("about " + asked, [], [("T", "cite  " + asked, [("fuente", store)])] * 2) if kind == 0 else (" ", [], [])

    c = read_table(spark, sf_dir, "conversations").select("conv_id").distinct()
    none = F.lit(None).cast("string")
    lists = [F.expr("cast(array() AS array<string>)").alias(n) for n in ("canonical_subcategories", "metadata_hints", "search_terms")]
    asked = c.select(F.col("conv_id").alias("resp_id"), F.concat(F.lit("q"), "conv_id").alias("query"), *(none.alias(n) for n in ("original_message", "legal_category", "canonical_category")), *lists, none.alias("store"))
    found = services.rag_search(asked, retriever, CONFIGURED)
    return found.select("resp_id", "answer", F.get("citations", F.lit(0))["snippet"].alias("snippet"), "valid", "status")


@query(f"""
SELECT page_id || '' AS item, 'start' AS stage FROM pages WHERE page_id % 3 = 2
UNION ALL SELECT 'job-' || c_custkey, 'poll' FROM customer WHERE 'job-' || c_custkey NOT IN (SELECT job_id FROM ({JOB_EVENTS}))
UNION ALL SELECT job_id, 'conversion' FROM (SELECT job_id, arg_max(status, seq) AS status FROM ({JOB_EVENTS}) GROUP BY job_id)
  WHERE status = 'failed' AND job_id IN (SELECT 'job-' || c_custkey FROM customer)
UNION ALL SELECT doc_id || '.pdf', 'extraction' FROM documents WHERE doc_id % 5 IN (1, 2, 4)""")
def failure_records(spark, sf_dir):
    """Failed starts, polls, conversions and extractions as one table of error records."""
    p = read_table(spark, sf_dir, "pages")
    end = F.when(F.col("page_id") % 3 == 2, F.lit("")).otherwise(F.lit(".pdf"))
    started = services.gate(p.select(F.concat(F.col("page_id").cast("string"), end).alias("filename"), F.lit(b"x").alias("content")))
    failed = F.when(F.col("status") == "failed", F.concat(F.lit("E: "), "filename"))
    polled = find_jobs(spark, sf_dir).select(F.col("job_id").alias("filename"), "http", "code", "status", failed.alias("error"))
    extracted = _extracted(spark, sf_dir).select("filename", "status", "code")
    return services.failures(started.select("filename", "status", "code"), polled, extracted).select(F.col("filename").alias("item"), "stage")


@query("""
SELECT 'doc-' || d.doc_id AS document_id, CASE WHEN l.doc_id IS NULL THEN 'waiting' WHEN l.quality = 1 THEN 'approved' ELSE 'rejected' END AS review
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def review_state(spark, sf_dir):
    """Which documents wait for their reviewer, and the last decision on others."""
    name = F.concat(F.lit("doc-"), F.col("doc_id")).alias("document_id")
    reviews = read_table(spark, sf_dir, "labels").select(name, F.when(F.col("quality") == 1, F.lit("approved")).otherwise(F.lit("rejected")).alias("decision"), F.lit(2).alias("seq"))
    earlier = reviews.withColumns({"decision": F.lit("changes"), "seq": F.lit(1)})
    return services.review_state(read_table(spark, sf_dir, "documents").select(name), reviews.unionByName(earlier))


@query("SELECT job_id, row_number() OVER (ORDER BY seq, job_id) AS place FROM (SELECT job_id, min(seq) AS seq FROM (" + JOB_EVENTS + ") GROUP BY job_id)")
def job_queue(spark, sf_dir):
    """Jobs in the order in which they came."""
    first = view(spark, sf_dir, JOB_EVENTS, "events").groupBy("job_id").agg(F.min("seq").alias("created_at"))
    return jobs.with_places(first, "created_at", "job_id").select("job_id", "place")


#: Uploads of documents: two in seven by names that are no PDF, those above 20,000 bytes made too large, the rest converted without OCR.
_UPLOADED = "SELECT doc_id, text, doc_id % 7 < 2 AS no_pdf, strlen(text) > 20000 AS large FROM documents"


def _uploads(spark, sf_dir):
    k = F.col("doc_id")
    name = F.concat(F.lit("d"), k, F.when(k % 7 == 0, F.lit(".txt")).when(k % 7 == 1, F.lit("")).when(k % 7 == 2, F.lit(".PDF")).otherwise(F.lit(".pdf")))
    content = F.when(F.octet_length("text") > 20000, F.concat("text", F.repeat(F.lit(" "), 1 << 20))).otherwise(F.col("text"))
    return read_table(spark, sf_dir, "documents").select(name.alias("filename"), content.cast("binary").alias("content"))


def _decoded(name, content):
    return content.decode(), 1


_ENDING = "CASE doc_id % 7 WHEN 0 THEN '.txt' WHEN 1 THEN '' WHEN 2 THEN '.PDF' ELSE '.pdf' END"
_REFUSED = "CASE WHEN no_pdf THEN 'INVALID_FILE_TYPE' WHEN large THEN 'FILE_TOO_LARGE' END"
_TOLD = "CASE WHEN no_pdf THEN 'Solo se aceptan archivos PDF.' WHEN large THEN 'Archivo supera 1 MB.' END"


@query(f"""
WITH u AS (SELECT *, {_NORMALIZED.replace('md', 'text')} AS markdown FROM ({_UPLOADED})),
c AS (SELECT *, length({_plain('markdown')}) < 800 AS short, markdown = '' AS bare, NOT no_pdf AND NOT large AS taken FROM u)
SELECT 'd' || doc_id || {_ENDING} AS filename, CASE WHEN no_pdf THEN 400 WHEN large THEN 413 WHEN bare THEN 422 ELSE 200 END AS status,
  coalesce({_REFUSED}, CASE WHEN bare THEN 'PROCESSING_FAILED' END) AS code,
  coalesce({_TOLD}, CASE WHEN bare THEN 'No se pudo completar el procesamiento.' END) AS message,
  CASE WHEN taken THEN sha256(markdown) END AS markdown_sha256, CASE WHEN taken THEN false END AS ocr_used,
  CASE WHEN taken THEN CASE WHEN short THEN 'ocr_skipped_or_failed: RuntimeError: Document AI OCR no esta configurado' ELSE '' END END AS warnings
FROM c""")
def convert_route(spark, sf_dir):
    """Uploads that are refused by name or size, converted, or empty, by a service without OCR."""
    done = services.convert_route(_uploads(spark, sf_dir), _decoded, _decoded, _decoded, Settings(max_upload_mb=1))
    return done.select("filename", "status", "code", "message", F.sha2("markdown", 256).alias("markdown_sha256"), "ocr_used", F.array_join("warnings", ";").alias("warnings"))


@query(f"""
WITH u AS (SELECT *, {_NORMALIZED.replace('md', 'text')} AS markdown, NOT no_pdf AND NOT large AS taken FROM ({_UPLOADED}))
SELECT 'd' || doc_id || {_ENDING} AS filename, CASE WHEN no_pdf THEN 400 WHEN large THEN 413 ELSE 200 END AS http, {_REFUSED} AS code, {_TOLD} AS message,
  CASE WHEN taken THEN CASE WHEN markdown = '' THEN 'failed' ELSE 'succeeded' END END AS status,
  CASE WHEN taken AND markdown = '' THEN 'ValueError: No se pudo extraer contenido Markdown del PDF' END AS error,
  CASE WHEN taken AND markdown <> '' THEN sha256(markdown) END AS markdown_sha256
FROM u""")
def convert_jobs_route(spark, sf_dir):
    """Jobs started for uploads or refused, run, and asked for with their result or error."""
    settings = Settings(max_upload_mb=1)
    started = services.start_jobs(_uploads(spark, sf_dir), settings)
    done = services.run_jobs(started, _decoded, _decoded, _decoded, settings)
    asked = jobs.find_jobs(started.where("http = 200").select("job_id"), done)
    found = asked.select("filename", "http", "code", "message", "status", "error", F.sha2("result.markdown", 256).alias("markdown_sha256"))
    refused = started.where("http <> 200").select("filename", "http", "code", "message", "status", "error", F.lit(None).cast("string").alias("markdown_sha256"))
    return found.unionByName(refused)


@query("""
SELECT doc_id || '.md' AS filename, CASE WHEN k < 5 OR k = 8 THEN store END AS file_search_store, k < 5 OR k = 8 AS uploaded,
  CASE WHEN k < 5 OR k = 8 THEN 200 ELSE 503 END AS status, CASE WHEN k < 5 THEN true WHEN k = 8 THEN false END AS done,
  CASE k WHEN 5 THEN 'No existe File Search Store con display_name ' || chr(39) || 'none ' || doc_id || chr(39) WHEN 6 THEN 'file_search_store_name o GEMINI_FILE_SEARCH_STORE no esta configurado'
    WHEN 7 THEN 'gemini; custom_metadata_sent=[{"index":0,"key":"titulo","length":' || length(source) || ',"value":"' || source || '"},{"index":1,"key":"fuente","length":' || length(lang) || ',"value":"' || lang || '"}]' END AS error_message,
  CASE WHEN k < 5 OR k = 8 THEN sha256(text) || ' titulo=' || source || ';fuente=' || lang END AS operation
FROM (SELECT *, doc_id % 9 AS k, CASE doc_id % 9 WHEN 0 THEN 'fileSearchStores/' || source WHEN 1 THEN 'reg-' || source WHEN 2 THEN 'fileSearchStores/n' || source ELSE 'made/new ' || source END AS store FROM documents)""")
def upload_requests(spark, sf_dir):
    """Whole uploads: stores given, registered, listed, created or missing, no store named, uploads that fail, that are looked at again, or not waited for."""
    k = F.col("doc_id") % 9
    d = read_table(spark, sf_dir, "documents")
    name = F.when(k == 0, F.concat(F.lit("fileSearchStores/"), "source")).when(k == 1, F.concat(F.lit("known "), "source")).when(k == 2, F.concat(F.lit("shown "), "source"))
    name = name.when(k == 5, F.concat(F.lit("none "), "doc_id")).when(k != 6, F.concat(F.lit("new "), "source"))
    fields = dict.fromkeys((*metadata.STRING_FIELDS, metadata.NOTES), F.lit(None).cast("string")) | {"titulo": F.col("source"), "fuente": F.col("lang")}
    asked = d.select(
        F.concat("doc_id", F.lit(".md")).alias("filename"), F.col("text").alias("markdown"), *[c.alias(n) for n, c in fields.items()], F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast(f"array<{metadata.GROUP}>").alias("categorias"), name.alias("file_search_store_name"), (k != 5).alias("create_store_if_missing"), (k != 8).alias("wait_until_done"), F.lit(60).alias("max_wait_seconds"),
    )
    sources = d.select("source").distinct()
    registry = sources.select(F.concat(F.lit("known "), "source").alias("display_name"), F.concat(F.lit("reg-"), "source").alias("store"))
    listed = sources.select(F.lit(0).alias("pos"), F.concat(F.lit("shown "), "source").alias("display_name"), F.concat(F.lit("fileSearchStores/n"), "source").alias("name"))

    def upload(store, filename, markdown, pairs):
        import hashlib

        kind = int(filename.partition(".")[0]) % 9
        if kind == 7:
            raise RuntimeError("gemini")
        return f"{hashlib.sha256(markdown.encode()).hexdigest()} {';'.join(f'{x}={v}' for x, v in pairs)}", kind < 4

    answers, _ = services.upload_requests(asked, registry, listed, lambda n: f"made/{n}", upload, lambda operation: True, CONFIGURED, every=0.0)
    return answers.select("filename", "file_search_store", "uploaded", "status", "done", "error_message", "operation")


_TERMS = "list_filter(regexp_split_to_array(replace(lower(strip_accents({})), 'ß', 'ss'), '[^\\pL\\pN]+'), lambda w: w <> '')"


@query(rf"""
WITH d AS (SELECT doc_id, lang, {_TERMS.format("text")} AS words FROM documents),
c AS (SELECT doc_id, lang, n AS chunk, words[n * 200 + 1 : n * 200 + 200] AS words FROM (SELECT *, unnest(range((len(words) + 199) // 200)) AS n FROM d)),
s AS (SELECT count(*)::DOUBLE AS n, avg(len(words)) AS mean FROM c),
f AS (SELECT doc_id, chunk, lang, length, term, count(*) AS tf FROM (SELECT doc_id, chunk, lang, len(words) AS length, unnest(words) AS term FROM c) GROUP BY ALL),
p AS (SELECT term, doc_id, chunk, lang, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * (1.2::DOUBLE + 1) / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * length / mean))) * 1000000)::BIGINT AS impact
  FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM f), s),
q AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 2 THEN 'es' END AS wanted, unnest(list_distinct({_TERMS.format("text")})) AS term FROM conversations WHERE role = 'user' AND conv_id % 100 = 0),
r AS (SELECT conv_id, turn, doc_id, chunk, sum(impact)::BIGINT AS score FROM q JOIN p USING (term) WHERE wanted IS NULL OR wanted = lang GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, doc_id, chunk) AS rank FROM r) WHERE rank <= 5""")
def search_text(spark, sf_dir):
    """The five best chunks of all documents for every question of each hundredth conversation, some in one language only."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("markdown"), F.col("lang").alias("facet"))
    index = search.postings(search.chunks(d))
    asked = read_table(spark, sf_dir, "conversations").where("role = 'user' AND conv_id % 100 = 0")
    queries = asked.select(F.struct("conv_id", "turn").alias("query_id"), F.col("text").alias("query"), F.when(F.col("turn") % 4 == 2, F.lit("es")).alias("facet"))
    found = search.top_chunks(queries, index, search.bounds(index))
    return found.select("query_id.conv_id", "query_id.turn", "doc_id", "chunk", "score", "rank")


# --- shapes, projections and sinks ---

#: Category entries in the shapes that models answer: a string for a list, repeated categories, odd members, pairs, and none.
_SHAPES = """
SELECT doc_id, concat('{"titulo": "', source, '", "confidence": 1, "categorias": ', CASE doc_id % 9
  WHEN 0 THEN '[{"categoria": "Generales", "subcategorias": "Otros"}]'
  WHEN 1 THEN '[{"categoria": "generales", "subcategorias": "Otros"}]'
  WHEN 2 THEN '[{"categoria": "generales", "subcategoria": "otros"}, {"categoria": "GENERALES", "subcategorias": ["Derecho de Familia", "OTROS"]}]'
  WHEN 3 THEN '[{"categoria": "Generales", "subcategorias": ["Otros", 3, " "]}]'
  WHEN 4 THEN '[{"categoria": "sucesiones y herencia", "subcategoria": "lo que sea"}]'
  WHEN 5 THEN '[]' WHEN 6 THEN '[1]'
  WHEN 7 THEN '[{"categoria": "Generales", "subcategorias": null, "subcategoria": "Otros"}]'
  ELSE '[{"categoria": "Generales", "subcategorias": " "}]' END, '}') AS raw
FROM documents"""


@query("""
SELECT doc_id, source AS titulo, CASE WHEN doc_id % 9 IN (0, 2, 3, 4) THEN '' ELSE 'categorias' END AS errors,
  CASE doc_id % 9 WHEN 0 THEN 'Generales=Otros' WHEN 2 THEN 'Generales=Otros,Derecho de Familia' WHEN 3 THEN 'Generales=Otros' WHEN 4 THEN 'Sucesiones y Herencia=' END AS groups
FROM documents""")
def category_shapes(spark, sf_dir):
    """Groups of whatever shape, as grouping rescues, canonicalisation and validation in their order leave them."""
    found = metadata.extract(view(spark, sf_dir, _SHAPES, "documents"))
    shown = F.transform("categorias", lambda g: F.concat(g["categoria"], F.lit("="), F.array_join(g["subcategorias"], ",")))
    return found.select("doc_id", "titulo", F.array_join("errors", ",").alias("errors"), F.when(F.size("errors") == 0, F.array_join(shown, ";")).alias("groups"))


@query("SELECT l_orderkey, l_linenumber, (l_discount / 2000)::DOUBLE::VARCHAR AS small, l_tax::DOUBLE::VARCHAR AS plain FROM lineitem")
def float_text(spark, sf_dir):
    number = lambda c: text.float_text(c.cast("double"))
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", number(F.col("l_discount") / 2000).alias("small"), number(F.col("l_tax")).alias("plain"))


@query(f"SELECT doc_id, {_strip('substring(text, 1, 10) || substring(text, 13, 8) || substring(text, 31)')} AS layout FROM documents")
def layout_text(spark, sf_dir):
    """Slices of a page's text, the last one to its end."""
    end = F.char_length("text")
    cut = lambda a, z: F.struct(F.lit(a).cast("int").alias("start"), z.cast("int").alias("end"))
    segments = F.array(cut(None, F.lit(10)), cut(12, F.lit(20)), cut(30, F.greatest(end, F.lit(30))))
    return read_table(spark, sf_dir, "documents").select("doc_id", text.layout_text(F.col("text"), segments).alias("layout"))


@query(f"""SELECT job_id, status, filename, CASE WHEN status = 'succeeded' THEN filename END AS shown
FROM (SELECT job_id, arg_max(status, seq) AS status, arg_max(filename, seq) AS filename FROM ({JOB_EVENTS}) GROUP BY job_id)""")
def job_projection(spark, sf_dir):
    """What callers see of jobs, and the unwrapped results of those that have one."""
    last = jobs.latest_states(view(spark, sf_dir, JOB_EVENTS, "events")).withColumns({"result": F.struct("job_id", F.col("filename").alias("shown")), "error": F.lit(None).cast("string"), "created_at": F.lit("x")})
    public = jobs.public_jobs(last)
    done = jobs.unwrap_results(public.where("status = 'succeeded'")).withColumnRenamed("job_id", "done_id")
    return public.join(done, F.col("job_id") == F.col("done_id"), "left").select("job_id", "status", "filename", "shown")


def _packages(spark, sf_dir):
    found = metadata.extract(view(spark, sf_dir, OUTPUTS, "documents")).where("size(errors) = 0")
    name = F.concat(F.lit("d"), "doc_id", F.lit(".pdf"))
    d = read_table(spark, sf_dir, "documents").select("doc_id", name.alias("filename"), F.col("text").alias("markdown"), text.document_id(name, F.col("text").cast("binary")).alias("document_id"))
    meta = found.join(d.select("doc_id", "document_id"), "doc_id").drop("raw", "doc_id")
    converted = d.select("filename", "document_id", "markdown", F.lit(3).alias("pages"), F.lit(False).alias("ocr_used"), F.array(F.lit("w")).alias("warnings"))
    return docs_ops.review_package(converted, meta)


#: Documents whose metadata is valid, with what it says.
_VALID = """SELECT *, 'd' || doc_id || '-' || substring(sha256(text), 1, 12) AS document_id, CASE WHEN doc_id % 7 = 6 THEN 'Sucesiones y Herencia' ELSE 'Generales' END AS category,
  CASE doc_id % 7 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM documents WHERE doc_id % 7 IN (0, 1, 6)"""


@query(f"""
SELECT document_id, document_id || '.md' AS markdown_name, document_id || '.metadata.json' AS metadata_name, document_id || '.review.json' AS review_name, sha256(text) AS markdown_sha256,
  CASE WHEN doc_id % 7 = 0 THEN 'T ' || source END AS titulo, category, confidence, 'd' || doc_id || '.pdf' AS filename, category AS reviewed_category, '["w"]' AS warnings
FROM ({_VALID})""")
def review_packages(spark, sf_dir):
    """Conversion and metadata joined by document, with the names and texts of the output files."""
    said = lambda c, path: F.get_json_object(c, path)
    return _packages(spark, sf_dir).select(
        "document_id", "markdown_name", "metadata_name", "review_name", F.sha2("markdown", 256).alias("markdown_sha256"),
        said("metadata_json", "$.titulo").alias("titulo"), said("metadata_json", "$.categorias[0].categoria").alias("category"), said("metadata_json", "$.confidence").cast("double").alias("confidence"),
        said("review_json", "$.filename").alias("filename"), said("review_json", "$.metadata.categorias[0].categoria").alias("reviewed_category"), said("review_json", "$.warnings").alias("warnings"),
    )


@query(f"""
SELECT 'markdown' AS folder, document_id || '.md' AS name, sha256(text) AS value FROM ({_VALID})
UNION ALL SELECT 'metadata', document_id || '.metadata.json', category FROM ({_VALID})
UNION ALL SELECT 'review', document_id || '.review.json', document_id FROM ({_VALID})""")
def written_outputs(spark, sf_dir):
    """What the ordered sinks leave in their folders, written twice as a batch that runs again does."""
    root, packages = shared_path(spark, "outputs"), materialize(_packages(spark, sf_dir), "packages")
    for _ in range(2):
        sinks.write_outputs(packages, root, 7)
    values = {"markdown": F.sha2("value", 256), "metadata": F.get_json_object("value", "$.categorias[0].categoria"), "review": F.get_json_object("value", "$.document_id")}
    parts = [spark.read.parquet(f"{root}/{folder}").select(F.lit(folder).alias("folder"), "name", value.alias("value")) for folder, value in values.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
SELECT doc_id || '.md' AS filename, CASE WHEN doc_id % 5 = 0 THEN 'error' ELSE 'uploaded' END AS status,
  CASE WHEN doc_id % 5 = 0 THEN 'custom_metadata contiene string_value mayor a 256 caracteres: [{"index":0,"key":"fuente","length":257,"value":"' || repeat('y', 257) || '"}]' END AS message,
  CASE WHEN doc_id % 5 <> 0 THEN sha256(text) END AS stored FROM documents""")
def upload_log(spark, sf_dir):
    """The log of uploads by status, read back, with what the store table got."""
    k, root = F.col("doc_id"), shared_path(spark, "store")
    meta = F.array(F.struct(F.lit("fuente").alias("key"), F.when(k % 5 == 0, F.repeat(F.lit("y"), 257)).otherwise(F.col("source")).alias("string_value")))
    d = read_table(spark, sf_dir, "documents").select(F.concat(k, F.lit(".md")).alias("filename"), F.col("text").alias("markdown"), meta.alias("custom_metadata"), F.concat(F.lit("s"), k % 3).alias("store"))
    sinks.write_logs(sinks.upload(d, root, 0), root, 0)
    stored = spark.read.parquet(f"{root}/store").select(F.col("display_name").alias("filename"), F.sha2("markdown", 256).alias("stored"))
    return spark.read.parquet(f"{root}/logs").select("filename", "status", "message").join(stored, "filename", "left")
