"""Secret scans through a trigram inverted index.

Each rule's regex yields a Boolean query over trigrams (see ``trigrams``). The
index has postings for the trigrams that any query names: one row for each of
them that a document contains. A document that holds no clause's anchor, its
rarest trigram, satisfies no query and has no postings, so most texts are only
asked for some twenty anchors. Queries are answered by intersecting postings,
the documents that have all trigrams of some clause are the rule's candidates,
and only those are matched against the regex. Rules without mandatory trigrams
scan all documents. Candidates meet their documents by broadcast up to
SMALL_FOUND of them; beyond that the texts with anchors are shuffled.

DataFrame functions only. Spans come from splitting a text at a rule's matches:
the lengths of the parts between give the offsets, in code points.

Postings are keyed by a hash of doc_id and text. Should two documents share it,
both become candidates of both's rules, which the regex settles. No posting list
is ever gathered; intersecting counts trigrams per (clause, document). The
clauses are broadcast, a table as small as the rules.

Defined results for odd input: a null text is empty, and an empty text has no
spans. Null doc_ids are kept, repeated rows stay repeated, other columns are
kept, whatever their names, but for ``spans``, which is replaced. A very long text
is matched whole in its row, and its spans are made in time nearly in proportion
to their number. An empty table gives an empty result.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweft.llm.common import bind, materialize, packed, scanned, table
from lexweft.llm.trigrams import trigram_query


class Rule(NamedTuple):
    """A regex (valid for Java and Python alike); ``least`` is the least length of group ``measured``."""

    kind: str
    pattern: str
    measured: int = 0
    least: int = 1


#: Base kinds first, in the order in which spans at one start are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_password", r"://[A-Za-z0-9._~-]+:[^\s@/]{3,}@"),
)
BASE_KINDS = ("assign", "access", "hex")


#: The most candidates that are broadcast to their documents, a hash and some numbers each.
SMALL_FOUND = 1_000_000

#: Letters from the most frequent in English text on.
_FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"


def anchor(clause: frozenset[str]) -> str:
    """The trigram of a clause that natural text is least likely to hold; any would be right."""
    rank = lambda c: _FREQUENT.index(c) if c in _FREQUENT else 15 if c in " -/:." else 30
    return max(sorted(clause), key=lambda t: sum(map(rank, t)))


def _key(text: Column) -> Column:
    return F.xxhash64("doc_id", text)


def _anchored(folded: Column, anchors: list[str]) -> Column:
    """Whether a folded text holds an anchor, without which it satisfies no clause."""
    return F.exists(F.array(*map(F.lit, anchors)), lambda t: F.contains(folded, t))


def build_index(docs: DataFrame, queries: list[tuple[int, frozenset[str]]]) -> DataFrame:
    """Postings ``(trigram, key)`` of the queries' trigrams, in any case, for the documents that hold an anchor of any clause."""
    text = F.coalesce("text", F.lit(""))
    wanted = F.array(*[F.lit(t) for t in sorted({t for _, clause in queries for t in clause})])
    anchors = sorted({anchor(clause) for _, clause in queries})
    # Bound once: within the filter, an inlined lower() would run again for each trigram.
    held = bind(F.lower(text), lambda folded: F.when(_anchored(folded, anchors), F.filter(wanted, lambda t: F.contains(folded, t))))
    some = docs.select(_key(text).alias("key"), held.alias("held")).where("held IS NOT NULL")
    return some.select("key", F.explode("held").alias("trigram")).select("trigram", "key")


def candidates(index: DataFrame, queries: list[tuple[int, frozenset[str]]]) -> DataFrame:
    """``(key, rules)``: numbers of the rules a clause of which a document satisfies."""
    rows = [(i, rule, t, len(clause)) for i, (rule, clause) in enumerate(queries) for t in sorted(clause)]
    clauses = index.sparkSession.createDataFrame(rows, "clause int, rule int, trigram string, need int")
    # A key is in the postings of a trigram once a row; repeated rows must not count twice.
    met = index.distinct().join(F.broadcast(clauses), "trigram").groupBy("key", "clause", "rule", "need").agg(F.count("*").alias("n"))
    return met.where("n = need").groupBy("key").agg(F.collect_set("rule").alias("rules"))


def rule_spans(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<kind, start, end>>``, in code points."""
    pattern = F.lit(rule.pattern)
    empty = F.expr("cast(array() AS array<struct<kind: string, start: int, end: int>>)")
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    # The part behind the last match has no match beside it; zipping to it gives a null, which filtering drops.
    parts = F.filter(
        F.arrays_zip(
            F.split(text, rule.pattern).alias("gap"),
            matches.alias("match"),
            F.regexp_extract_all(text, pattern, F.lit(rule.measured)).alias("measured"),
        ),
        lambda p: p["match"].isNotNull(),
    )

    def spans(parts):
        before = scanned(F.transform(parts, lambda p: F.char_length(p["gap"]) + F.char_length(p["match"])), F.lit(0), lambda a, b: a + b)

        def span(p, at):
            begin = at + F.char_length(p["gap"])
            end = begin + F.char_length(p["match"])
            return F.when(F.char_length(p["measured"]) >= rule.least, F.struct(F.lit(rule.kind).alias("kind"), begin.alias("start"), end.alias("end")))

        return F.array_compact(F.zip_with(parts, before, span))

    return F.when(F.regexp_like(text, pattern), bind(parts, spans)).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``spans``: ``array<struct<start, rule, kind, end>>`` of all rules, by start and order of rules."""
    known = {i: trigram_query(rule.pattern) for i, rule in enumerate(rules)}
    queries = [(i, clause) for i, clauses in known.items() for clause in clauses or ()]
    text = F.coalesce("text", F.lit(""))
    own = docs.select(packed(docs, "spans", "text"), text.alias("own_text"), F.col("text").alias("raw_text"), _key(text).alias("own_key"))
    none = F.lit(None).cast("array<int>")
    if queries:
        found = materialize(candidates(build_index(docs, queries), queries), "candidates")
        if found.count() <= SMALL_FOUND:
            parts = [own.join(F.broadcast(found), F.col("own_key") == F.col("key"), "left")]
        else:
            # Only texts that hold an anchor can be candidates, and move to meet their rules.
            held = bind(F.lower("own_text"), lambda folded: _anchored(folded, sorted({anchor(clause) for _, clause in queries})))
            parts = [own.where(held).join(found, F.col("own_key") == F.col("key"), "left"), own.where(~held).withColumn("key", F.lit(None).cast("long")).withColumn("rules", none)]
    else:
        parts = [own.withColumn("rules", none)]
    empty = F.expr("cast(array() AS array<struct<start: int, rule: int, kind: string, end: int>>)")

    def numbered(i, rule):
        order = lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rule"), s["kind"].alias("kind"), s["end"].alias("end"))
        spans = F.transform(rule_spans(F.col("own_text"), rule), order)
        return spans if known[i] is None else F.when(F.array_contains("rules", i), spans).otherwise(empty)

    each = [numbered(i, rule) for i, rule in enumerate(rules)]
    columns = [F.col("raw_text").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c != "spans"]
    done = [p.select(*columns, F.array_sort(F.concat(*each)).alias("spans")) for p in parts]
    return done[0] if len(done) == 1 else done[0].unionByName(done[1])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )


def _oracle() -> str:
    """The same spans in DuckDB, every rule matched against every text."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    # RE2 folds case beyond ASCII, so letters in either case are written out.
    written = {"assign": "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"}
    parts = []
    for i, rule in enumerate(RULES):
        pattern = rule.pattern.replace("((?i:password|passwd|secret|token|api_?key))", written["assign"])
        # RE2 splits the classes of blanks as Java does not: \s is written out for Java's meaning.
        pattern = pattern.replace(r"[^\s@/]", r"[^ \t\n\x0b\f\r@/]")
        p = quoted(pattern)
        parts.append(f"""
  SELECT id, {i} AS rule, {quoted(rule.kind)} AS kind,
         list_sum(list_transform(gaps[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:k-1], lambda x: length(x))), 0) AS s,
         length(ms[k]) AS n, length(gs[k]) AS measured, {rule.least} AS least
  FROM (SELECT id, ms, gs, gaps, unnest(range(1, len(ms) + 1)) AS k FROM (
    SELECT id, regexp_extract_all(text, {p}) AS ms, regexp_extract_all(text, {p}, {rule.measured}) AS gs,
           string_split_regex(text, {p}) AS gaps FROM d))""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(parts)}),
s AS (SELECT id, rule, kind, s, kind || ':' || s || ':' || (s + n) AS span FROM m WHERE measured >= least)
SELECT any_value(doc_id) AS doc_id,
       count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
       count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY s, rule) FILTER (rule < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY s, rule), '') AS spans
FROM d LEFT JOIN s USING (id) GROUP BY id
"""


QUERIES = {"op6_secrets": op6_secrets}
ORACLES = {"op6_secrets": _oracle()}
