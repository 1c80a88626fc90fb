"""Connected components by alternating large-star and small-star steps.

Links never reach the driver; each round is written to the shared folder, so
lineage stays short and a lost executor costs one round at most; the one before goes.
A node that many others point to is a hot key of the joins, which ``join_by_key``
spreads. There may be dozens of rounds, most of few links, which are written in
parts by their number, not by that of the session's shuffle partitions.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweft.llm.common import discard, in_few_parts, join_by_key_or_all, write_shared


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    return join_by_key_or_all(both.where("v > u"), least, "u", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    others = join_by_key_or_all(down, least, "u", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(u, v)`` longs to ``(u, v)`` where v is the least node that u reaches, u <> v.

    Nodes that are their component's least, or have no edge, get no row.
    """
    now, path = write_shared(edges.select("u", "v").where("u <> v").distinct(), f"{label}-0")
    state, step = _state(now), 0
    while state[0]:
        step += 1
        large, beside = write_shared(in_few_parts(_large_star(now, state[0]).distinct(), state[0]), f"{label}-{step}-large")
        discard(now.sparkSession, path)
        now, path = write_shared(in_few_parts(_small_star(large, state[0]).distinct(), state[0]), f"{label}-{step}")
        discard(now.sparkSession, beside)
        before, state = state, _state(now)
        if state == before:
            break
    return now
