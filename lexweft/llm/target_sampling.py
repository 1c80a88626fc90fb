"""Importance resampling to a target distribution by bucketed n-grams, hashed by DuckDB in each partition.

Each Arrow batch of a partition is a DuckDB table for as long as it takes: SQL
splits the texts into words, unnests them, makes n-grams by window functions,
hashes the distinct ones with zlib's CRC-32 (a registered function) and counts
buckets per document. These counts are spilled to Parquet in the folder that the
cluster shares, by Spark's commit protocol. Spark merges them into counts per
bucket of raw text and of target text, which give each bucket's gain, and scores
every document from its own counts; no text is read twice.

A document's weight is the floored mean of the gains of its n-grams. Gumbel noise
from its id is added, and the highest scores are drawn. A score is a whole number
within some 200,000 whatever the data, so counts per score are a small table: it says
from which score on documents are drawn and how many stand before each score, and
only documents of one score are ever sorted together.

Defined results for odd input: a null, empty or wordless text has no n-grams,
weight 0, and is never drawn. A null doc_id draws noise as an empty id and comes
after others of its score. Repeated rows have equal scores and each a rank of its
own. Of a text longer than ``long_chars`` DuckDB gets a part at a time, cut where no
n-gram is cut. An empty target, or an empty
corpus, counts 0 in every bucket. ``sampled`` keeps other columns, whatever their
names, but for ``n_features``, ``weight``, ``score`` and ``rank``, which it
replaces. An empty table gives an empty result.
"""

import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from lexweft.llm.common import bound_batches, give_back, materialize, packed, table, unpacked

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before capitals are lower-cased, and a character that is in no word.
_WORD, _NO_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: What DuckDB may use in a task. Its own temporary files are off: a batch fits.
DUCKDB = {"threads": 1, "memory_limit": "1GB", "temp_directory": ""}


def bucket_sql(max_n: int, buckets: int) -> str:
    """SQL for ``(r, bucket, n)`` of table ``batch`` (r, text), ordered, and ``(r, words)`` beside it as bucket -1."""
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    split = f"SELECT r, regexp_extract_all({lower}, '{WORD}') AS own FROM batch"
    if max_n == 1:
        grams = "SELECT r, word AS gram FROM words"
        unnested = "SELECT r, unnest(own) AS word FROM split"
    else:
        unnested = "SELECT r, unnest(own) AS word, generate_subscripts(own, 1) AS pos FROM split"
        parts = [
            f"SELECT r, word || {''.join(f' || chr(32) || lead(word, {k}) OVER w' for k in range(1, n)).removeprefix(' || ')} AS gram FROM words WINDOW w AS (PARTITION BY r ORDER BY pos)"
            for n in range(2, max_n + 1)
        ]
        grams = " UNION ALL ".join(["SELECT r, word AS gram FROM words", *parts])
    return f"""
WITH split AS ({split}), words AS ({unnested}), grams AS ({grams}),
counted AS (SELECT r, gram, count(*) AS n FROM grams WHERE gram IS NOT NULL GROUP BY r, gram),
hashed AS (SELECT gram, zlib_crc32(gram) % {buckets} AS bucket FROM (SELECT DISTINCT gram FROM counted))
SELECT r, bucket::INTEGER AS bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (gram) GROUP BY r, bucket
UNION ALL SELECT r, -1, len(own)::BIGINT FROM split WHERE len(own) > 0
ORDER BY r, bucket
"""


def _connect():
    import duckdb

    def crc(grams: pa.Array) -> pa.Array:
        return pa.array([zlib.crc32(g) for g in grams.cast(pa.binary()).to_pylist()], pa.int64())

    con = duckdb.connect(config=DUCKDB)
    con.create_function("zlib_crc32", crc, ["VARCHAR"], "BIGINT", type="arrow")
    return con


def _parts(text: str, long_chars: int, overlap: int) -> Iterator[tuple[str, str]]:
    """``(part, lead)``: parts of a text, cut between words; ``lead`` holds the last ``overlap`` words before a part."""
    at, lead = 0, []
    while at < len(text):
        cut = _NO_WORD.search(text, at + long_chars)
        end = cut.end() if cut else len(text)
        yield text[at:end], " ".join(lead)
        if overlap:
            lead = [*lead, *_WORD.findall(text, at, end)][-overlap:]
        at = end


def bucket_counts(docs: DataFrame, max_n: int = 1, buckets: int = 10_000, long_chars: int = 4 << 20) -> DataFrame:
    """``(row, n_words, buckets, counts)`` for each of ``docs`` (text, row): what its n-grams hash to, ``buckets`` ascending."""
    sql = bucket_sql(max_n, buckets)
    schema = docs.select("row").schema.add("n_words", "long").add("buckets", ArrayType(IntegerType())).add("counts", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connect()

        def counted(r, texts):
            """``(r, bucket, n)`` columns; bucket -1 counts words."""
            con.register("batch", pa.table({"r": r, "text": texts}))
            found = con.sql(sql).to_arrow_table()
            con.unregister("batch")
            return [found.column(i).to_numpy().astype(np.int64) for i in range(3)]

        for batch in batches:
            n, texts = batch.num_rows, batch.column(0)
            long = pc.fill_null(pc.greater(pc.utf8_length(texts), long_chars), False).to_numpy(zero_copy_only=False)
            usual = np.flatnonzero(~long)
            parts = [counted(pa.array(usual), texts.take(pa.array(usual)))]
            for i in np.flatnonzero(long).tolist():
                for part, lead in _parts(texts[i].as_py(), long_chars, max_n - 1):
                    parts.append(counted(pa.array([i]), pa.array([f"{lead} {part}"])))
                    if lead:  # what lies within it was counted with the part before
                        no, bucket, count = counted(pa.array([i]), pa.array([lead]))
                        parts.append([no, bucket, -count])
            r, bucket, count = map(np.concatenate, zip(*parts))
            if len(parts) > 1:
                key, place = np.unique(r * (buckets + 1) + bucket + 1, return_inverse=True)
                total = np.zeros(len(key), np.int64)
                np.add.at(total, place, count)
                r, bucket, count = key[total > 0] // (buckets + 1), key[total > 0] % (buckets + 1) - 1, total[total > 0]
            whole = bucket < 0
            words = np.zeros(n, np.int64)
            words[r[whole]] = count[whole]
            r, bucket, count = r[~whole], bucket[~whole], count[~whole]
            ends = pa.array(np.searchsorted(r, np.arange(n + 1)).astype(np.int32))
            columns = [batch.column(1), pa.array(words), pa.ListArray.from_arrays(ends, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(count))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n_words", "buckets", "counts"])
        con.close()
        give_back()

    bound_batches(docs.sparkSession)
    return docs.select("text", "row").mapInArrow(run, schema)


def merged(counts: DataFrame, buckets: int) -> np.ndarray:
    """Counts per bucket of all rows of ``bucket_counts``; the driver gets as many rows as there are buckets."""
    pairs = counts.select(F.explode(F.arrays_zip("buckets", "counts")).alias("p")).select(F.col("p.buckets").alias("bucket"), F.col("p.counts").alias("n"))
    rows = pairs.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of target to raw frequency per bucket, one n-gram added to each, floored."""
    s, t, n = raw.astype(float), target.astype(float), len(raw)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def noise(seed: int) -> Column:
    """Gumbel noise in thousandths from the doc_id, floored."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(key, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def scored(counts: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """``(row, n_words, n_features, weight, score)`` of the rows of ``bucket_counts``."""

    @F.arrow_udf("long")
    def total(buckets: pa.Array, count: pa.Array) -> pa.Array:
        sums = np.concatenate([[0], np.cumsum(gain[buckets.flatten().to_numpy()] * count.flatten().to_numpy())])
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(buckets).to_numpy(zero_copy_only=False))])
        return pa.array(sums[ends[1:]] - sums[ends[:-1]])

    features = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    own = counts.select("row", "n_words", features.alias("n_features"), total("buckets", "counts").alias("total"))
    # Whole numbers: pmod first, as ``div`` cuts towards zero.
    weight = F.expr("CASE WHEN n_features > 0 THEN (total - pmod(total, n_features)) div n_features ELSE 0L END")
    return own.withColumn("weight", weight).withColumn("score", F.col("weight") + noise(seed)).drop("total")


def drawn(rows: DataFrame, percent: int, min_words: int) -> DataFrame:
    """``rows`` of ``scored`` (a written table) with ``rank``: 1, 2, 3... for the ``percent`` of highest scores, else null."""
    fit = F.col("n_words") >= min_words
    by_score = rows.where(fit).groupBy("score").agg(F.count("*").alias("n"))
    higher = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    table_ = materialize(by_score.select("score", "n", F.coalesce(higher, F.lit(0)).alias("ahead")), "scores")  # one row a score
    k = percent * (table_.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // 100
    some = table_.where(F.col("ahead") < k).select(F.col("score").alias("at"), "ahead")
    met = rows.join(F.broadcast(some), fit & (F.col("score") == F.col("at")), "left")
    nth = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("row.doc_id")))
    ahead = met.where("at IS NOT NULL").withColumn("rank", (F.col("ahead") + nth).cast("long"))
    ahead = ahead.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    rest = met.where("at IS NULL").withColumn("rank", F.lit(None).cast("long"))
    return ahead.unionByName(rest).drop("at", "ahead")


def sampled(docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024, long_chars: int = 4 << 20) -> DataFrame:
    """``docs`` without their text, with ``n_features``, ``weight``, ``score`` and ``rank``; ``target`` (text) is what to be like."""
    mine = ("text", "n_features", "weight", "score", "rank")
    own = materialize(bucket_counts(docs.select("text", packed(docs, *mine)), max_n, buckets, long_chars), "counts")
    aim = bucket_counts(target.select("text", F.struct(F.lit(0).alias("none")).alias("row")), max_n, buckets, long_chars)
    gain = gains(merged(own, buckets), merged(aim, buckets))
    rows = drawn(materialize(scored(own, gain, seed), "scored"), percent, min_words)
    return rows.select(*unpacked(rows), "n_features", "weight", "score", "rank")


def op13_target_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sampled(docs, table(spark, sf_dir, "benchmark"))


#: CRC-32 in SQL, byte by byte, of the distinct words.
SQL = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS c
    FROM range(256) r(i))
), doc_words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM documents
), aim_words AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark
), doc_counts AS (SELECT doc_id, word, count(*) AS n FROM doc_words GROUP BY ALL
), bytes AS (
  SELECT word, list_transform(range(1, strlen(word) + 1), lambda i: ('0x' || substr(hex(word), 2 * i - 1, 2))::BIGINT) AS b
  FROM (SELECT word FROM doc_counts UNION SELECT word FROM aim_words)
), hashed AS (
  SELECT word, xor(list_reduce(b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM bytes, crc_table
), raw AS (SELECT bucket, sum(n) AS s FROM doc_counts JOIN hashed USING (word) GROUP BY bucket
), aim AS (SELECT bucket, count(*) AS t FROM aim_words JOIN hashed USING (word) GROUP BY bucket
), totals AS (SELECT (SELECT coalesce(sum(s), 0)::DOUBLE FROM raw) AS s_all, (SELECT coalesce(sum(t), 0)::DOUBLE FROM aim) AS t_all
), gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS g
  FROM raw FULL JOIN aim USING (bucket), totals
), weighed AS (
  SELECT doc_id, sum(n)::BIGINT AS n, sum(n * g)::BIGINT AS total FROM doc_counts JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id
), scores AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM documents d LEFT JOIN weighed w USING (doc_id)
), ranked AS (
  SELECT *, weight + noise AS score, n_features >= 20 AS fit,
         row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS nth
  FROM scores
)
SELECT doc_id, n_features, weight::BIGINT AS weight, score::BIGINT AS score,
       CASE WHEN fit AND nth <= 10 * (SELECT count(*) FROM ranked WHERE fit) // 100 THEN nth END AS rank
FROM ranked
"""

QUERIES = {"op13_target_sampling": op13_target_sampling}
ORACLES = {"op13_target_sampling": SQL}
