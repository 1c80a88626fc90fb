"""Helpers that the operators of this subpackage share."""

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweft.sources.shared import discard, materialize, recorded, shared_path, write_shared  # noqa: F401  for the operators

#: ASCII blanks: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch, of which the JVM and a Python worker hold a few at a time.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Makes the session's Arrow batches no larger than BATCH_BYTES (a larger row is alone)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Returns free memory of a Python worker, which lives on after its task, to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def packed(docs: DataFrame, *but: str) -> Column:
    """The columns of ``docs``, without those named, as one struct, ``row``, beside which no column of ours can clash with them."""
    return F.struct(*(docs[c] for c in docs.columns if c not in but)).alias("row")


def unpacked(df: DataFrame, *but: str) -> list[Column]:
    """The columns of ``row``, without those named."""
    return [F.col("row").getField(c).alias(c) for c in df.schema["row"].dataType.names if c not in but]


#: The most keys that are broadcast as hot ones, and the least number of rows of a hot key.
HOT_KEYS, HOT_ROWS = 100_000, 100


def join_by_key(rows: DataFrame, values: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """``rows`` with what ``values`` (one row for each key; ``n``: rows that have it) has for their long ``key``; others go.

    Keys that more than a HOT_KEYS-th of all ``total`` rows have, HOT_KEYS of them
    at most, meet their rows by broadcast. Their rows are then dealt out by a hash
    of their own place instead of the key, so that no task gets a hot key's rows.
    ``rows`` should be a written table: a place is its row's.
    """
    names = [c for c in values.columns if c not in (key, n)]
    some = F.struct(*names)
    hot = F.col(n) > max(HOT_ROWS, total // HOT_KEYS)
    few = values.where(hot).select(F.col(key).alias("_hot_key"), some.alias("_hot"))
    rest = values.where(~hot).select(F.col(key).alias("_rest_key"), some.alias("_rest"))
    flagged = rows.join(F.broadcast(few), F.col(key) == F.col("_hot_key"), "left")
    spread = F.xxhash64(F.lit("spread"), F.monotonically_increasing_id())
    dealt = flagged.withColumn("_dealt", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(spread))
    found = dealt.join(rest, F.col("_dealt") == F.col("_rest_key"), "left").withColumn("_met", F.coalesce("_hot", "_rest"))
    return found.where("_met IS NOT NULL").select(*rows.columns, *(F.col(f"_met.{c}").alias(c) for c in names))


#: Rows that a part of a small table has at least, and the number of parts that it may have in any case.
ROWS_EACH, FEW_PARTS = 50_000, 8


def in_few_parts(df: DataFrame, n: int) -> DataFrame:
    """``df``, of ``n`` rows at most, in no more parts than they need: each costs a task, and a file if written."""
    return df.coalesce(max(FEW_PARTS, -(-n // ROWS_EACH)))


def join_by_key_or_all(rows: DataFrame, values: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """``join_by_key`` in which all keys count as hot ones if there are HOT_KEYS rows at most."""
    if total > HOT_KEYS:
        return join_by_key(rows, values, key, total, n)
    few = in_few_parts(values.select(*(c for c in values.columns if c != n)), total)
    return rows.join(F.broadcast(few), key).select(*rows.columns, *(few[c] for c in few.columns if c != key))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` has a byte-wise path for ASCII strings, ``translate`` hasn't.
    """
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    )


def bind(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value`` once.

    A lambda variable keeps an expensive expression from being evaluated for
    each element of another lambda that uses it.
    """
    return F.transform(F.array(value), body)[0]


def scanned(values: Column, zero: Column, combine, block: int = 256) -> Column:
    """For each element of ``values`` what ``combine`` makes of ``zero`` and all before it; ``combine`` is associative, ``zero`` neutral.

    A fold that appends to an array copies it each time, which is quadratic; here
    it does so within blocks, and once more over the blocks.
    """

    def scan(xs):
        start = F.struct(zero.alias("now"), F.slice(F.array(zero), 1, 0).alias("out"))
        step = lambda acc, x: F.struct(combine(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out"))
        return F.aggregate(xs, start, step, lambda acc: acc["out"])

    def of(xs):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda b: F.slice(xs, b * block + 1, F.lit(block)))

        def joined(parts):
            heads = scan(F.transform(parts, lambda x: F.aggregate(x, zero, combine)))
            return F.flatten(F.zip_with(F.transform(parts, scan), heads, lambda x, h: F.transform(x, lambda v: combine(h, v))))

        return F.when(F.size(xs) > block, bind(blocks, joined)).otherwise(scan(xs))

    return bind(values, of)
