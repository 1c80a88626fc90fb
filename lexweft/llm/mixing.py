"""Mixing sources to target weights, in blocks.

The words of a source, document after document, are packed into blocks of
``block_words``. The mix has as many slots per source as its target asks for.
They are dealt to output shards by multinomial draws: each source draws how many
of its slots each shard gets, all shards being as likely, so a shard's counts of
sources are multinomial given its size, and the totals are exact. Which block
fills a slot follows from the shard: a source's slots are numbered shard by
shard, and the i-th takes block perm(i mod blocks), a pseudorandom permutation of
the source's block indices that changes with each round through them, so a block
comes again only when all have come. Within a shard slots stand in pseudorandom
order. Blocks are joined by their index.

Targets share the size of the whole corpus by weight; none goes above
``max_repeats`` times its source's size, and the excess is shared anew.

Word positions come from prefix sums in two steps, over buckets of a source and
within a bucket, so that a source with a third of all rows is never in one task.
Texts are not moved for that: only ids, sizes and positions. Sources are a table,
as there may be one for each host; each draws on its own, in an executor.

Defined results for odd input: a null, empty or blank text has size 0 and none
taken. The null source is one like any other, the last. Rows that repeat are
separate documents. Null doc_ids are kept. A very long text is cut within its
row, into as many blocks as it reaches. Other columns are kept where texts are
returned, whatever their names. An empty table gives an empty result.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweft.llm.common import BLANKS, bind, join_by_key, materialize, packed, table

WORD = r"[^\x20\x09-\x0D]+"
#: The most sources whose plan is broadcast.
SMALL_PLAN = 100_000
SLOTS_PER_SHARD = 1 << 14
#: Counts and slots made at a time.
AT_ONCE = 1 << 16


def shares(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """``(source, no, n, docs, target)`` for ``sizes`` (source, n, docs): sources by code point, null last; ``weights`` repeat.

    Sources that would get more than ``max_repeats`` times their size get that,
    and the rest is shared anew until none is above.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")  # of sources only, a few bytes each
    numbered = sizes.select("source", "n", "docs", (F.row_number().over(order) - 1).alias("no"))
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), F.col("no") % len(weights))
    plan = materialize(numbered.withColumn("weight", weight), "sources")
    rest, free = plan.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    total, most = rest, F.col("n") * max_repeats
    while free:
        share = F.lit(float(rest)) * F.col("weight") / F.lit(free)
        # Whole numbers and small weights: the sums are exact, whatever their order.
        capped, left = plan.agg(F.coalesce(F.sum(F.when(share > most, most)), F.lit(0)), F.coalesce(F.sum(F.when(share <= most, F.col("weight"))), F.lit(0.0))).first()
        if left == free:
            return plan.select("source", "no", "n", "docs", F.when(share > most, most.cast("double")).otherwise(share).alias("target"))
        rest, free = total - capped, left
    return plan.select("source", "no", "n", "docs", most.cast("double").alias("target"))


def mix_plan(sizes: DataFrame, block_words: int, weights=(1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """``shares`` with ``blocks`` and ``slots`` of each source."""
    blocks = F.expr(f"(n + {block_words - 1}) div {block_words}")
    wanted = F.rint(F.col("target") * F.col("blocks") / F.col("n")).cast("long")
    slots = F.when(F.col("n") > 0, F.least(F.col("blocks") * max_repeats, wanted)).otherwise(0)
    return shares(sizes, weights, max_repeats).withColumn("blocks", blocks).withColumn("slots", slots)


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of range(size), elementwise: a Feistel network that walks its cycle back into the range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)

    def scramble(x):
        left, right = x >> half, x & mask
        for r in range(4):
            h = (right + key * np.uint64(4) + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h >> np.uint64(32)) & mask)
        return (left << half) | right

    x, n = scramble(index.astype(np.uint64)), size.astype(np.uint64)
    while (out := x >= n).any():
        x = np.where(out, scramble(x), x)
    return x.astype(np.int64)


def shard_counts(slots: int, shards: int, seed: int, no: int):
    """``(shards, first, count)`` arrays of one source, some at a time: a multinomial draw of its slots, and how many went before."""
    rng, left, done = np.random.default_rng((seed, no)), slots, 0
    for at in range(0, shards, AT_ONCE):
        some = min(AT_ONCE, shards - at)
        here = int(rng.binomial(left, min(1.0, some / (shards - at)))) if at + some < shards else left
        count = np.bincount(rng.integers(0, some, here), minlength=some) if here < some else rng.multinomial(here, np.full(some, 1 / some))
        first = done + np.cumsum(count) - count
        held = np.flatnonzero(count)
        yield at + held, first[held], count[held]
        left, done = left - here, done + here


def draw_shards(plan: DataFrame, shards: int, seed: int) -> DataFrame:
    """``(shard, source_no, first, count, blocks)``: how many slots of each source each shard gets."""

    def draw(batches):
        for batch in batches:
            for no, slots, blocks in zip(*(c.to_pylist() for c in batch.columns)):
                for shard, first, count in shard_counts(slots, shards, seed, no):
                    columns = [shard, np.full(len(shard), no, np.int32), first, count.astype(np.int64), np.full(len(shard), blocks)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "source_no", "first", "count", "blocks"])

    own = plan.where("slots > 0").select("no", "slots", "blocks")
    return own.mapInArrow(draw, "shard long, source_no int, first long, count long, blocks long")


def slots(drawn: DataFrame, seed: int) -> DataFrame:
    """``(shard, place, source_no, round, block)`` for each slot; ``place`` orders the slots of a shard."""

    def fill(batches):
        for batch in batches:
            shard, no, first, count, blocks = (c.to_numpy() for c in batch.columns)
            ends = np.cumsum(count)
            for at in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
                slot = np.arange(at, min(at + AT_ONCE, int(ends[-1])))
                row = np.searchsorted(ends, slot, "right")
                i, n, source = first[row] + slot - (ends - count)[row], blocks[row], no[row]
                turn = i // n
                key = (np.uint64(seed) << np.uint64(40)) + (source.astype(np.uint64) << np.uint64(8)) + turn.astype(np.uint64)
                block = permuted(i % n, n, key)
                place = (i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (source.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed))
                place = ((place ^ (place >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
                columns = [shard[row], place, source, turn.astype(np.int32), block]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "place", "source_no", "round", "block"])

    dealt = drawn.repartition("shard", "source_no")
    return dealt.mapInArrow(fill, "shard long, place long, source_no int, round int, block long")


def positions(docs: DataFrame, seed_columns: list[str], bucket_docs: int = 1000) -> DataFrame:
    """``(doc_id, row_hash, copy, source, size, start)``: where each document's words begin in its source.

    ``row_hash`` and ``copy`` tell apart rows that share a doc_id, or all they have.
    """
    size = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD))).cast("long")
    own = materialize(docs.select("doc_id", F.xxhash64(*seed_columns).alias("row_hash"), "source", size.alias("size")), "sizes")
    buckets = max(1, math.ceil(own.count() / bucket_docs))
    dealt = own.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row_hash"), F.lit(buckets)))
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inner = Window.partitionBy("source", "bucket").orderBy("doc_id", "row_hash")
    within = dealt.select(
        "*",
        (F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("inner"),
        F.row_number().over(inner).alias("nth"),
        F.rank().over(inner).alias("rank"),
    )
    placed = within.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return placed.select(
        "doc_id", "row_hash", (F.col("nth") - F.col("rank")).alias("copy"), "source", "size", (F.col("ahead") + F.col("inner")).alias("start")
    )


class Mix:
    """A mix of ``docs`` (doc_id, text, source and any other columns)."""

    def __init__(self, docs: DataFrame, block_words: int = 64, weights=(1, 2, 3), max_repeats: int = 3, seed: int = 11, slots_per_shard: int = SLOTS_PER_SHARD):
        self.docs, self.block_words, self.seed = docs, block_words, seed
        placed = materialize(positions(docs, docs.columns), "positions")
        sizes = placed.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs"))
        self.plan = materialize(mix_plan(sizes, block_words, weights, max_repeats), "plan")
        n_sources, n_docs, n_slots = self.plan.agg(F.count("*"), F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("slots"), F.lit(0))).first()
        self.shards = max(1, -(-n_slots // slots_per_shard))
        rows = self.plan.select(F.col("source").alias("source_name"), F.col("no").alias("source_no"), F.col("n").alias("source_size"), "target", "docs")
        if n_sources <= SMALL_PLAN:
            self.placed = placed.join(F.broadcast(rows.drop("docs")), F.col("source").eqNullSafe(F.col("source_name"))).drop("source_name")
        else:
            # By a hash, within which sources are told apart; those of very many documents meet them by broadcast.
            named = rows.groupBy(F.xxhash64("source_name").alias("source_key")).agg(F.collect_list(F.struct(*rows.columns)).alias("sources"), F.sum("docs").alias("n"))
            met = join_by_key(placed.withColumn("source_key", F.xxhash64("source")), named, "source_key", n_docs)
            own = F.filter("sources", lambda s: s["source_name"].eqNullSafe(F.col("source")))[0]
            self.placed = met.withColumn("own", own).select(*placed.columns, "own.source_no", "own.source_size", "own.target")

    def pieces(self) -> DataFrame:
        """``(source_no, block, start, first_word, n_words)``: the part of each document in each block it reaches."""
        b = F.lit(self.block_words)
        some = self.placed.where("size > 0").select("source_no", "start", "size")
        # Whole numbers throughout: a double would lose word positions beyond 2^53.
        cut = some.withColumn("block", F.explode(F.expr(f"sequence(start div {self.block_words}, (start + size - 1) div {self.block_words})")))
        low, high = F.greatest(F.col("start"), F.col("block") * b), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
        return cut.select("source_no", "block", "start", (low - F.col("start")).alias("first_word"), (high - low).alias("n_words"))

    def blocks(self) -> DataFrame:
        """Each slot of the mix with the pieces of documents that fill it."""
        # The planner takes slots to be as few as the draws that they are made of, and would broadcast them.
        made = slots(draw_shards(self.plan, self.shards, self.seed), self.seed).hint("merge")
        return made.join(self.pieces(), ["source_no", "block"])

    def taken(self) -> DataFrame:
        """Each document with ``size``, ``source_size``, ``target`` and ``taken`` (words, repeats counted)."""
        got = self.blocks().groupBy("source_no", "start").agg(F.sum("n_words").alias("got"))
        key = F.when(F.col("size") > 0, F.col("start")).otherwise(-1 - F.pmod(F.xxhash64("doc_id", "row_hash", "copy"), F.lit(1 << 40)))
        named = got.select(F.col("source_no").alias("g_no"), F.col("start").alias("g_start"), "got")
        joined = self.placed.join(named, (F.col("source_no") == F.col("g_no")) & (key == F.col("g_start")), "left")
        return joined.select("doc_id", "size", "source_size", "target", F.coalesce("got", F.lit(0)).alias("taken"))

    def _with_parts(self, part: list[str]) -> DataFrame:
        """``(row, text_words, parts)`` for each document of which any words are taken; parts in order of shards and places."""
        got = self.blocks().groupBy("source_no", "start").agg(F.array_sort(F.collect_list(F.struct(*part))).alias("parts"))
        found = self.placed.where("size > 0").join(got, ["source_no", "start"])
        keyed = found.select(F.col("doc_id").alias("k_id"), F.col("row_hash").alias("k_hash"), F.col("copy").alias("k_copy"), "source_no", "parts")
        columns = self.docs.columns
        own = self.docs.select(packed(self.docs, "text"), F.col("text").alias("own_text"), F.col("doc_id").alias("own_id"), F.xxhash64(*columns).alias("own_hash"))
        nth = F.row_number().over(Window.partitionBy("own_id", "own_hash").orderBy("own_hash")) - 1
        own = own.withColumn("own_copy", nth)
        same = F.col("own_id").eqNullSafe(F.col("k_id")) & (F.col("own_hash") == F.col("k_hash")) & (F.col("own_copy") == F.col("k_copy"))
        return own.join(keyed, same)

    def texts(self) -> DataFrame:
        """The mix as documents: rows with any words taken, ``text`` the taken words in the order of shards and slots."""
        joined = self._with_parts(["shard", "place", "first_word", "n_words"])
        # Bound once: within the transform, an inlined split would run again for each part.
        text = bind(_words(), lambda w: F.array_join(F.transform("parts", lambda p: _slice(w, p)), ""))
        return joined.select(*[F.rtrim(text, F.lit(BLANKS)).alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in self.docs.columns])

    def output(self) -> DataFrame:
        """The mix as shards: ``(shard, slot, source_no, round, block, text)``, a row for each slot, text the block's words."""
        joined = self._with_parts(["shard", "place", "first_word", "n_words", "round", "block"]).select(
            "source_no", F.explode(bind(_words(), lambda w: F.transform("parts", lambda p: F.struct(p["shard"], p["place"], p["round"], p["block"], _slice(w, p).alias("words"))))).alias("p"), "k_id", "k_hash", "k_copy"
        )
        # A block's pieces in the order of positions: that of bucket and document, which the words' own start tells.
        placed = self.placed.select(F.col("doc_id").alias("o_id"), F.col("row_hash").alias("o_hash"), F.col("copy").alias("o_copy"), "start")
        same = F.col("k_id").eqNullSafe(F.col("o_id")) & (F.col("k_hash") == F.col("o_hash")) & (F.col("k_copy") == F.col("o_copy"))
        ordered = joined.join(placed, same).groupBy("p.shard", "p.place", "source_no", "p.round", "p.block").agg(
            F.array_sort(F.collect_list(F.struct("start", F.rtrim("p.words", F.lit(BLANKS)).alias("words")))).alias("all")
        )
        slot = F.row_number().over(Window.partitionBy("shard").orderBy("place", "source_no", "round", "block")) - 1
        return ordered.select("shard", slot.alias("slot"), "source_no", "round", "block", F.array_join(F.transform("all", lambda x: x["words"]), " ").alias("text"))


def _words():
    return F.regexp_extract_all(F.concat("own_text", F.lit("\n")), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))


def _slice(words, part):
    return F.array_join(F.slice(words, part["first_word"].cast("int") + 1, part["n_words"].cast("int")), "")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).taken()


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = Mix(docs).texts()
    return mixed.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else mixed


QUERIES = {"op3_mixing": op3_mixing}
ORACLES: dict = {}
