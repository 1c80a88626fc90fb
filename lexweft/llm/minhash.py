"""Near-duplicate groups by SimHash and MinHash: sets of five-word shingles of Jaccard similarity 0.8 or more.

A text is the set of the XXH64 hashes of its word shingles. SimHash fingerprints
of the sets, joined within 2 bits on the grid of their segments' popcounts as in
``simhash``, name the first candidates; those that are alike are groups from then on.
Of a pair of similarity 0.8 the fingerprints differ in 15 % of their bits on average,
which that join doesn't reach, so MinHash bands name the candidates for the rest.

The bands only name candidates: of MINIMA minima, each of BANDS bands takes ROWS at random. Two
sets of similarity 0.8 agree in 0.8 of the minima, give or take 0.03, and pass
each other in all bands with probability 0.0004 (0.00001 if they agree in just
0.8); sets that share a common passage, of similarity 0.3, meet in one band of
15,000. Pairs of a band whose sketches (four bits each of SKETCH minima) differ too
much for a similarity of 0.8, by 4.5 deviations, go no further. Candidates are
then compared on their whole sets, so no pair below the threshold is ever linked.

Texts of equal sets are one node from the start. Pairs already in one group
need no comparison, which keeps large groups of near copies from being listed
pair by pair: in STARS rounds each cell's nodes are compared with one node of
the cell, and what was linked is grouped. At first that is the one that shares
most cells with others, the least changed of a text's near copies, which is like
most of them; then any that has no group yet.
After that the pairs of a cell that are still in different groups are compared,
so nothing that the bands found is left out. Of a large group of near copies that
are not alike to each other these are very many, so they meet by odd sketches: of
ODD bits, each is the parity of the hashes that fall on it. In as many bits as the
sketches differ, the sets differ at least, and a pair that differs in more than a
ninth of both sizes can't have a similarity of 0.8. That is within the join by cell; only
pairs that pass are ever rows.

Defined results for odd input: a text with fewer words than a shingle is one
shingle; null, empty and blank texts are equal. Null doc_ids are kept; they never
become a component_id unless a whole component has none. Repeated rows stay
repeated in ``near_duplicates``, and one of them is kept by the filter. Other
columns are ignored by the search and kept by the filter, whatever their names.
Very long texts are hashed whole. An empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweft.llm import simhash
from lexweft.llm.common import HOT_KEYS, bound_batches, discard, give_back, in_few_parts, join_by_key, join_by_key_or_all, materialize, packed, recorded, write_shared
from lexweft.llm.components import connected_components
from lexweft.llm.pieces import forget
from lexweft.llm.simhash import majority, shingle_hashes

MINIMA, BANDS, ROWS = 160, 64, 8
STARS = 3
#: Minima of a sketch, 16 to a long, and the most of them in which two sets of similarity 0.8 differ (12 on average).
SKETCH, MOST_APART = 64, 26
#: Bits of an odd sketch, which tells sets of some 1,600 shingles apart.
ODD = 1024
#: Pairs of one node that are compared in one task.
PAIRS_AT_ONCE = 500
#: Elements of a block of hashes by permutations, which bounds memory for any text.
AT_ONCE = 1 << 20

_RANDOM = np.random.default_rng(42)
_XOR, _TIMES = (_RANDOM.integers(0, 1 << 64, (MINIMA, 1), np.uint64) | np.uint64(k) for k in (0, 1))
_TAKEN = np.array([_RANDOM.choice(MINIMA, ROWS, replace=False) for _ in range(BANDS)])
_COMBINE = _RANDOM.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingle_set(data: bytes, words_each: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of ``data``."""
    found = list(shingle_hashes(data, words_each))
    return np.unique(np.concatenate(found)) if found else np.zeros(1, np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    step = max(1, AT_ONCE // MINIMA)
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), step):
        np.minimum(least, ((hashes[None, at : at + step] ^ _XOR) * _TIMES).min(1), out=least)
    return least ^ (least >> np.uint64(29))


def bands(mixed: np.ndarray) -> np.ndarray:
    """A hash for each band of minima, as signed longs."""
    # Each band has multipliers of its own, so equal minima of different bands don't meet.
    return (mixed[_TAKEN] * _COMBINE).sum(1, dtype=np.uint64).view(np.int64)


def sketch(mixed: np.ndarray) -> np.ndarray:
    """Four bits of each of the first minima, as signed longs."""
    some = (mixed[:SKETCH] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60)
    places = np.tile(np.arange(16, dtype=np.uint64) * np.uint64(4), SKETCH // 16)
    return np.bitwise_or.reduceat(some << places, np.arange(0, SKETCH, 16)).view(np.int64)


def _apart(a: str, b: str):
    """In how many of their minima two sketches differ, as an SQL expression."""
    parts = []
    for k in range(SKETCH // 16):
        x = f"({a}[{k}] ^ {b}[{k}])"
        x = f"({x} | shiftrightunsigned({x}, 1))"
        parts.append(f"bit_count(({x} | shiftrightunsigned({x}, 2)) & {0x1111111111111111}L)")
    return F.expr(" + ".join(parts))


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """For each of ODD bits whether an odd number of ``hashes`` falls on it, as signed longs."""
    place = (hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - (ODD.bit_length() - 1))
    return np.packbits(np.bincount(place.astype(np.int64), minlength=ODD) & 1).view(np.int64)


def _set_key(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 42)).astype(np.int64))


def signatures(docs: DataFrame, words_each: int = 5) -> DataFrame:
    """``(doc_id, th, node, n, fp, bands, sketch, odd)`` for each row: hash of the text, hash, size and fingerprint of its set, band hashes, sketches."""

    def lists(found, width):
        flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * width), flat)

    def run(batches):
        forget()
        for batch in batches:
            nodes, sizes, fps, found, drawn, odd = [], [], [], [], [], []
            for text in batch.column(2).to_pylist():
                hashes = shingle_set(text or b"", words_each)
                nodes.append(_set_key(hashes))
                sizes.append(len(hashes))
                at = range(0, len(hashes), simhash.BITS_AT_ONCE)
                fps.append(majority(hashes[a : a + simhash.BITS_AT_ONCE] for a in at))
                least = minima(hashes)
                found.append(bands(least))
                drawn.append(sketch(least))
                odd.append(odd_sketch(hashes))
            columns = [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), lists(found, BANDS), lists(drawn, SKETCH // 16), lists(odd, ODD // 64)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "node", "n", "fp", "bands", "sketch", "odd"])
        give_back()

    bound_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.col("text").cast("binary"))
    return own.mapInArrow(run, "doc_id long, th long, node long, n long, fp long, bands array<long>, sketch array<long>, odd array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, words_each: int) -> DataFrame:
    """``(node, hashes)`` with the set as signed longs, for ``wanted`` (node, th)."""

    def run(batches):
        for batch in batches:
            found = [shingle_set(x or b"", words_each).view(np.int64) for x in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, found)])
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["node", "hashes"])
        give_back()

    own = docs.select(F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text")).join(wanted, "th")
    one = own.groupBy("node").agg(F.first("text").alias("text"))
    return one.mapInArrow(run, "node long, hashes array<long>")


def close_fingerprints(nodes: DataFrame) -> DataFrame:
    """``(u, v, u_n, v_n)``, u above v, for pairs of ``nodes`` (node, n, fp) that connect all those within 2 bits of each other."""
    held = nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("least"), F.count("*").alias("c"))
    held = materialize(held.select("fp", F.col("least.node").alias("v"), F.col("least.n").alias("v_n"), "c"), "fingerprints")
    # Nodes of one fingerprint are a star around their least one, and those stars are linked.
    same = join_by_key(nodes.select("node", "n", "fp"), held.where("c > 1"), "fp", nodes.count(), "c")
    same = same.select(F.col("node").alias("u"), "v", F.col("n").alias("u_n"), "v_n").where("u <> v")
    side = F.struct(F.col("v").alias("node"), F.col("v_n").alias("n"))
    near = simhash.links(held.select("fp")).join(held.select(F.col("fp").alias("u"), side.alias("a")), "u")
    near = near.join(held.select(F.col("fp").alias("v"), side.alias("b")), "v").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
    return same.union(near.select("x.node", "y.node", "x.n", "y.n"))


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float, label: str) -> DataFrame:
    """Those of ``pairs`` (u, v) whose sets are ``similarity`` or more alike, compared in the JVM, a pair at a time; written.

    v may be the centre of very many pairs: its set is sent once for each
    PAIRS_AT_ONCE of them, to as many tasks.
    """
    pairs, path = write_shared(pairs, "pairs")
    asked = pairs.groupBy("v").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PAIRS_AT_ONCE).cast("int"))
    total = pairs.count()
    dealt = join_by_key_or_all(pairs, asked, "v", total).withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int"))
    left = sets.select(F.col("node").alias("u"), F.col("hashes").alias("u_set"))
    copies = asked.select("v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # Each node asked for has one part at least, and one more for each PAIRS_AT_ONCE pairs.
    copies = F.broadcast(in_few_parts(copies, total)) if 2 * total <= HOT_KEYS else copies
    right = sets.select(F.col("node").alias("v"), F.col("hashes").alias("v_set")).join(copies, "v")
    both = dealt.join(left, "u").join(right, ["v", "part"]).withColumn("both", F.size(F.array_intersect("u_set", "v_set")))
    found = materialize(both.where(F.col("both") / (F.size("u_set") + F.size("v_set") - F.col("both")) >= similarity).select("u", "v"), label)
    discard(pairs.sparkSession, path)
    return found


def _grouped(met: DataFrame, star: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``met`` (cell, node, n, sketch, others) with each node's root, without cells whose nodes are all of one group; written, and where."""
    root = star.select(F.col("u").alias("node"), F.col("v").alias("root"))
    own = met.join(F.broadcast(root) if star.count() <= HOT_KEYS else root, "node", "left")
    own = own.withColumn("root", F.coalesce("root", "node"))
    own, path = write_shared(own.select("cell", "node", "n", "sketch", "others", "root"), "rooted")
    mixed = own.groupBy("cell").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("rows")).where("a <> b").select("cell", "rows")
    found = write_shared(join_by_key(own, mixed, "cell", own.count(), "rows").select("cell", "node", "n", "sketch", "others", "root"), label)
    discard(met.sparkSession, path)
    return found


def links(docs: DataFrame, nodes: DataFrame, words_each: int, similarity: float) -> DataFrame:
    """``(u, v)`` where v is the least node of u's group, for nodes that have a group and aren't its least."""
    cells = nodes.select(F.explode("bands").alias("cell"), "node")
    shared = cells.groupBy("cell").agg(F.count("*").alias("c")).where("c > 1")
    some, path = write_shared(join_by_key(cells, shared.withColumn("others", F.col("c")), "cell", BANDS * nodes.count(), "c").select("cell", "node", "others"), "shared")
    known = some.groupBy("node").agg(F.sum("others").alias("others")).join(nodes.select("node", "n", "sketch"), "node")
    met = materialize(some.drop("others").join(known, "node").select("cell", "node", "n", "sketch", "others"), "cells")
    discard(docs.sparkSession, path)
    sized = lambda a, b: F.least(a, b) / F.greatest(a, b) >= similarity  # noqa: E731  no other pair can be alike
    close = materialize(close_fingerprints(nodes).where(sized(F.col("u_n"), F.col("v_n"))).select("u", "v"), "close")
    compared = met.select("node").union(close.select("u")).union(close.select("v")).distinct()
    wanted = nodes.join(compared, "node").select("node", "th")
    sets = materialize(_sets(docs, wanted, words_each), "sets")
    star = connected_components(_alike(close, sets, similarity, "alike-simhash"), "simhash")
    for step in range(STARS + 1):
        now, path = _grouped(met, star, f"open-{step}")
        if now.isEmpty():
            break
        if step < STARS:
            first = -F.col("others") if step == 0 else F.lit(0)
            grouped = F.lit(False) if step == 0 else F.col("root") != F.col("node")
            order = F.struct(grouped.alias("grouped"), first, F.xxhash64(F.lit(step), "node"), "node", "n", "sketch", "root")
            centre = now.groupBy("cell").agg(F.min(order).alias("c"), F.count("*").alias("rows"))
            centre = centre.select("cell", "rows", *(F.col(f"c.{k}").alias(f"o_{k}") for k in ("node", "n", "sketch", "root")))
            pairs = join_by_key(now, centre, "cell", now.count(), "rows").where("root <> o_root")
        else:
            now = now.join(nodes.select("node", "odd"), "node")
            other = now.select("cell", *(F.col(k).alias(f"o_{k}") for k in ("node", "n", "sketch", "root", "odd")))
            differ = F.expr(" + ".join(f"bit_count(odd[{k}] ^ o_odd[{k}])" for k in range(ODD // 64)))
            # What two sets may differ in, of both sizes together; with room for rounding.
            most = (F.col("n") + F.col("o_n")) * ((1 - similarity) / (1 + similarity)) + 1e-6
            pairs = now.join(other, "cell").where(F.col("root") < F.col("o_root")).where(differ <= most)
        pairs = pairs.where(_apart("sketch", "o_sketch") <= MOST_APART)
        pairs = pairs.where(sized(F.col("n"), F.col("o_n"))).select(F.least("node", "o_node").alias("v"), F.greatest("node", "o_node").alias("u")).distinct()
        alike = _alike(pairs, sets, similarity, f"alike-{step}")
        discard(docs.sparkSession, path)
        if not alike.isEmpty():
            # What is grouped already is a star, which goes on as it is.
            star = connected_components(star.unionByName(alike), "minhash")
    return star


def near_duplicates(docs: DataFrame, words_each: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, th, node, root, component_id)`` for each row of ``docs``."""
    rows, path = write_shared(signatures(docs, words_each), "signatures")
    of_node = rows.groupBy("node").agg(
        F.min("doc_id").alias("least_id"), F.min("th").alias("th"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("odd").alias("odd"), F.count("*").alias("rows")
    )
    nodes = materialize(of_node, "nodes")
    rows = materialize(rows.select("doc_id", "th", "node"), "rows")
    discard(docs.sparkSession, path)
    star = links(docs, nodes, words_each, similarity)
    own = nodes.join(star.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
    member = materialize(own.select("node", "least_id", "rows", F.coalesce("root", "node").alias("root")), "members")
    least = member.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    named = join_by_key(member, least, "root", member.count()).select("node", "root", "component_id", "rows")
    return join_by_key(rows, named, "node", rows.count(), "rows").select("doc_id", "th", "node", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, words_each: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each component, that of the least doc_id (null last), with all its columns."""
    with recorded() as paths:
        found = near_duplicates(docs, words_each, similarity)
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
        first = found.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.doc_id").alias("k_id"), F.col("first.th").alias("k_th"))
        first = materialize(first, "keepers")
    # The result reads the last of them alone.
    for path in paths[:-1]:
        discard(docs.sparkSession, path)
    own = docs.select(packed(docs), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_th"))
    kept = own.join(first, F.col("own_id").eqNullSafe(F.col("k_id")) & (F.col("own_th") == F.col("k_th")))
    # Repeated rows: any of them stands for all.
    return kept.groupBy("own_id", "own_th").agg(F.first("row").alias("row")).select("row.*")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)
