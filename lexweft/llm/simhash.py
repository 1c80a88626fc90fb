"""Near-duplicate groups by SimHash, found through a popcount embedding.

A 64-bit fingerprint maps to the bit counts of its segments of four bits. The
Manhattan distance of two such vectors is never above the Hamming distance of
the fingerprints, so a range join of radius 2 on the integer grid of vectors
loses no pair at Hamming distance 2; what it finds is then verified on the
fingerprints.

The range join is an equi-join: two grid points at most 2 apart have a point in
common that is at most 1 from both. So each distinct fingerprint goes to its
own cell and the cells beside it, 33 at most, and pairs meet in a cell.

Cells with more than ``cell_limit`` fingerprints (a group of thousands of near
copies fills some) never have their pairs listed. Their members take an exact
way that needs none: each goes to the 65 fingerprints at most one bit away;
those that meet there are all within 2 bits of each other, at most 65 of them,
and a star links them.

Copies share a fingerprint and are one node from the start, so a group of any
size costs one node. Fingerprints of very many documents, and cells of very many
fingerprints, meet their rows by broadcast (``join_by_key``).

Defined results for odd input: a null, empty or blank text has fingerprint
zero, and zero links like any other. Null doc_ids are kept; they never become
a component_id unless a whole component has none. Repeated rows stay repeated.
Other columns are ignored, whatever their names. Very long texts are hashed whole,
some shingles at a time. An empty table gives an empty result.
"""

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweft.llm.common import bound_batches, give_back, join_by_key, materialize, table
from lexweft.llm.components import connected_components

#: Shingles whose bits are counted at a time, which bounds memory for any text.
BITS_AT_ONCE = 1 << 17


def shingle_hashes(data: bytes, words_each: int):
    """Arrays of XXH64 (seed 42) of the word shingles of ``data``, some at a time; nothing for a blank text."""
    import xxhash

    words = data.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    if len(words) <= words_each:
        yield np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    pairs = list(zip(starts[: len(words) - words_each + 1].tolist(), ends[words_each - 1 :].tolist()))
    for at in range(0, len(pairs), BITS_AT_ONCE):
        part = pairs[at : at + BITS_AT_ONCE]
        yield np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in part], repeat(42)), np.uint64, len(part))


def fingerprint(data: bytes, words_each: int = 3) -> int:
    """SimHash over XXH64 (seed 42) of word shingles, as an unsigned integer."""
    return majority(shingle_hashes(data, words_each))


def majority(parts) -> int:
    """The bits that are set in over half the hashes of all ``parts``, as an unsigned integer; zero for none."""
    total, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words_each: int = 3) -> DataFrame:
    """``(doc_id, th, fp)`` with th a hash of the text and fp a signed long, for each row of ``docs``."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(x or b"", words_each) for x in batch.column(2).to_pylist()), np.uint64, batch.num_rows)
            columns = [batch.column(0), batch.column(1), pa.array(fps.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "fp"])
        give_back()

    bound_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.col("text").cast("binary"))
    return own.mapInArrow(run, "doc_id long, th long, fp long")


def _cells(nodes: DataFrame) -> DataFrame:
    """``(cell, fp)`` for a fingerprint's grid cell and the cells at distance 1."""
    low = f"{0x1111111111111111}L"
    count = " + ".join(f"(shiftrightunsigned(fp, {k}) & {low})" for k in range(4))
    counts = nodes.select("fp", F.expr(count).alias("v"))
    beside = F.expr(
        "concat(array(v),"
        " transform(filter(sequence(0, 60, 4), s -> (shiftrightunsigned(v, s) & 15L) < 4L), s -> v + shiftleft(1L, s)),"
        " transform(filter(sequence(0, 60, 4), s -> (shiftrightunsigned(v, s) & 15L) > 0L), s -> v - shiftleft(1L, s)))"
    )
    return counts.select("fp", beside.alias("cells")).select(F.explode("cells").alias("cell"), "fp")


def _one_bit_stars(members: DataFrame) -> DataFrame:
    """Links among ``members`` (fp) within 2 bits, as stars around their common one-bit neighbours."""
    near = members.select(
        "fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), s -> fp ^ shiftleft(1L, s)))")).alias("at")
    )
    met = near.groupBy("at").agg(F.min("fp").alias("v"), F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return met.select(F.explode("fps").alias("u"), "v").where("u <> v").distinct()


def links(nodes: DataFrame, cell_limit: int = 64) -> DataFrame:
    """``(u, v)``: links among distinct fingerprints that connect all those within 2 bits of each other."""
    cells = _cells(nodes)
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").withColumn("size", F.col("n"))
    met = materialize(join_by_key(cells, sizes, "cell", 33 * nodes.count()), "cells").withColumnRenamed("size", "n")
    few = met.where(F.col("n") <= cell_limit).groupBy("cell").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    pairs = few.select(
        F.explode(
            F.expr(
                "flatten(transform(fps, (a, i) -> transform(filter(slice(fps, i + 2, size(fps)),"
                " b -> bit_count(a ^ b) <= 2), b -> struct(b AS u, a AS v))))"
            )
        ).alias("p")
    ).select("p.u", "p.v")
    many = met.where(F.col("n") > cell_limit).select("fp").distinct()
    return pairs.union(_one_bit_stars(many)).distinct()


def components(fps: DataFrame, cell_limit: int = 64) -> DataFrame:
    """``(fp, root, component_id, n)`` for each distinct fingerprint of ``fps`` (doc_id, fp); n: rows that have it."""
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "nodes")
    star = connected_components(links(nodes, cell_limit), "simhash")
    own = star.select(F.col("u").alias("fp"), F.col("v").alias("root")).union(star.select("v", "v").distinct())
    member = materialize(own.join(nodes, "fp"), "members").drop("n")
    least = member.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    linked = join_by_key(member, least, "root", member.count()).select("fp", "root", "component_id")
    return nodes.join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least_id").alias("component_id"), "n"
    )


def near_duplicates(docs: DataFrame, words_each: int = 3, cell_limit: int = 64) -> DataFrame:
    """``(doc_id, th, fp, root, component_id)`` for each row of ``docs``; root is the component's least fingerprint."""
    fps = materialize(fingerprints(docs, words_each), "fingerprints")
    found = join_by_key(fps, components(fps, cell_limit), "fp", fps.count())
    return found.select("doc_id", "th", "fp", "root", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
ORACLES: dict = {}
