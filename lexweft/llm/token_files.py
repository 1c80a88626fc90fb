"""Token-ID files: texts to ids, ids to rANS segments, and back.

Documents are dealt out by ranges of doc_id and sorted within a range, so the
files are in ascending doc_id order as a whole. Each task tokenises its range
once and closes a segment after about ``segment_ids`` ids; a segment has one
frequency table that its independent blocks share (see ``rans``). Segments are
rows of Parquet files, written by Spark's commit protocol: a lost executor or a
task that runs twice leaves no torn or doubled file.

Reading decodes segments on their own, in any number of tasks; the ids before
each range come from the ranges' totals, a table with one row for each range.

Defined results for odd input: a null or empty text is its end id alone. Null
doc_ids come first. Rows that share a doc_id are all kept, ordered by a hash of
their text. Other columns are ignored. An empty table gives no segment and an
empty result.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweft.llm.common import bound_batches, give_back, shared_path, table
from lexweft.llm.pieces import byte_slices, shared_encoder
from lexweft.llm.rans import Segment, encode_segment

SCHEMA = "part int, seq int, n_docs long, n_ids long, segment binary"


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int, segment_ids: int = 1 << 20) -> DataFrame:
    """One row for each segment of ``docs`` (doc_id, text); ids must be below 65,536."""

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        coder = shared_encoder(tokenizer_path, True)
        held, doc_ids, lengths, n = [], [], [], 0

        def close():
            nonlocal seq, held, doc_ids, lengths, n
            each = np.concatenate(lengths)
            row = [part, seq, len(each), n, encode_segment(np.concatenate(held), pa.chunked_array(doc_ids).to_pylist(), each)]
            seq, held, doc_ids, lengths, n = seq + 1, [], [], [], 0
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, types)], names=["part", "seq", "n_docs", "n_ids", "segment"]
            )

        for batch in batches:
            for some in byte_slices(batch, 1):
                ids, sizes = coder.encode(some.column(1))
                ends = np.cumsum(sizes)
                held.append(np.insert(ids, ends, np.uint16(end_id)))
                doc_ids.append(some.column(0))
                lengths.append(sizes + 1)
                n += len(held[-1])
                if n >= segment_ids:
                    yield close()
        if n:
            yield close()
        give_back()

    bound_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = own.withColumn("th", F.xxhash64("text")).repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th")
    return dealt.select("doc_id", "text").mapInArrow(run, SCHEMA)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, segment_ids: int = 1 << 20) -> None:
    encode_documents(docs, tokenizer_path, end_id, segment_ids).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` per document, with ``ids`` (little-endian u32 bytes) on demand."""
    files = spark.read.schema(SCHEMA).parquet(path)
    totals = files.groupBy("part", "seq").agg(F.sum("n_ids").alias("n"))
    per_part = totals.groupBy("part").agg(F.sum("n").alias("part_n"))
    before = F.sum("part_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    part_start = per_part.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
    ahead = F.sum("n").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.join(part_start, "part").select(
        "part", "seq", (F.col("part_start") + F.coalesce(ahead, F.lit(0))).alias("segment_start")
    )

    def run(batches):
        for batch in batches:
            for data, part, seq in zip(*(batch.column(i) for i in range(3))):
                seg = Segment(data.as_py())
                ids = seg.ids().astype("<u4")
                ends = np.cumsum(seg.lengths)
                each = [ids[e - k : e].tobytes() for e, k in zip(ends.tolist(), seg.lengths.tolist())]
                k = len(each)
                columns = [
                    pa.array(seg.doc_ids, pa.int64()),
                    pa.array(np.full(k, part.as_py(), np.int32)),
                    pa.array(np.full(k, seq.as_py(), np.int32)),
                    pa.array(ends - seg.lengths),
                    pa.array(seg.lengths.copy()),
                    pa.array([zlib.crc32(x) for x in each], pa.int64()),
                    pa.array(each if with_ids else [None] * k, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "seq", "inner", "n_tokens", "ids_crc32", "ids"])
        give_back()

    schema = "doc_id long, part int, seq int, inner long, n_tokens long, ids_crc32 long, ids binary"
    read = files.select("segment", "part", "seq").mapInArrow(run, schema)
    out = read.join(starts, ["part", "seq"])
    start = (F.col("segment_start") + F.col("inner")).alias("start")
    return out.select("doc_id", start, "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_rows(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Writes the token files of ``docs`` to the shared folder and gives what reading them back yields."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_token_files(docs, path, tokenizer_path, end_id)
    return read_token_files(spark, path)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_rows(docs, public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op5_token_files": op5_token_files}
ORACLES: dict = {}
