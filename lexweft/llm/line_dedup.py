"""Drop lines that many documents share.

Lines are exploded with their position and a 128-bit hash of the normalised
line; distinct documents are counted per hash; lines over the threshold go
everywhere but in one keeper document; each text is reassembled by position.

Only ids, positions and hashes are exploded and counted, never line texts. The
text itself moves once, when the dropped positions are joined back to it.

Defined results for odd input: a null or empty text is one empty line. Null
doc_ids count as one document that is below all others. Rows that repeat a
doc_id count as one document. Other columns are kept, whatever their names, but
for ``n_lines`` and ``n_dropped``, which are replaced. Very long texts are split
within their row. A line that a third of all documents hold is a hot key, which
``join_by_key`` spreads. An empty table gives an empty result.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweft.llm.common import BLANKS, ascii_lower, bind, join_by_key, materialize, packed, table, unpacked


def line_hashes(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """``(doc_id, th, pos, h1, h2)`` for each line whose key has ``min_chars`` code points.

    ``th`` tells apart rows that share a doc_id but not a text.
    """
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "th", "pos", F.btrim("line", F.lit(BLANKS)).alias("line")).where(
        F.char_length("line") >= min_chars
    )
    key = ascii_lower(F.col("line"))
    return keyed.select("doc_id", "th", "pos", key.alias("key")).select(
        "doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )


def repeated_lines(hashes: DataFrame, min_docs: int = 5) -> DataFrame:
    """``(h1, h2, n_docs, keeper, n)`` for hashes that at least ``min_docs`` documents hold, in n lines."""
    per_doc = hashes.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("lines"))
    counted = per_doc.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"), F.sum("lines").alias("n"))
    return counted.where(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """``docs`` with ``text`` rid of repeated lines, and ``n_lines`` and ``n_dropped``."""
    hashes = materialize(line_hashes(docs, min_chars), "lines")
    # Joined by one of the two hashes; lines that agree in it alone would be told apart by the other.
    repeated = repeated_lines(hashes, min_docs).groupBy("h1").agg(F.collect_list(F.struct("h2", "keeper")).alias("kept"), F.sum("n").alias("n"))
    met = join_by_key(hashes, repeated, "h1", hashes.count())
    drops = (
        met.where(F.exists("kept", lambda k: (k["h2"] == F.col("h2")) & ~k["keeper"].eqNullSafe(F.col("doc_id"))))
        .groupBy(F.col("doc_id").alias("drop_id"), F.col("th").alias("drop_th"))
        .agg(F.collect_set("pos").alias("drop_pos"))
    )
    whole = F.coalesce("text", F.lit(""))
    own = docs.select(packed(docs, "text", "n_lines", "n_dropped"), F.col("doc_id").alias("own_id"), whole.alias("own_text"), F.xxhash64(whole).alias("own_th"))
    joined = own.join(drops, F.col("own_id").eqNullSafe(F.col("drop_id")) & (F.col("own_th") == F.col("drop_th")), "left")
    kept = F.when(F.col("drop_pos").isNull(), F.col("own_text")).otherwise(
        bind(
            F.split("own_text", "\n"),
            lambda lines: F.array_join(
                F.transform(
                    F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop_pos")), lambda i: lines[i]
                ),
                "\n",
            ),
        )
    )
    n_lines = F.char_length("own_text") - F.char_length(F.replace("own_text", F.lit("\n"), F.lit(""))) + 1
    # In two steps: a name of theirs beside an expression of ours would be taken for it.
    done = joined.select(
        "row", kept.alias("kept_text"), n_lines.cast("long").alias("lines"), F.coalesce(F.size("drop_pos"), F.lit(0)).cast("long").alias("dropped")
    )
    return done.select(*unpacked(done), done["kept_text"].alias("text"), done["lines"].alias("n_lines"), done["dropped"].alias("n_dropped"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, t.pos AS pos, t.line AS line,
         translate(trim(t.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM documents,
       LATERAL (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos) t
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT l.doc_id, count(*) AS n_lines,
       count(*) FILTER (r.key IS NOT NULL AND l.doc_id <> r.keeper) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos)
              FILTER (r.key IS NULL OR l.doc_id = r.keeper), '')) AS kept_sha256
FROM lines l LEFT JOIN repeated r ON l.key = r.key
GROUP BY l.doc_id
"""

QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLES = {"op9_line_dedup": SQL}
