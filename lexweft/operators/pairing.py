"""Pairing of outputs, review tracking, and names of stores."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweft.operators.jobs import latest_states


def pair_outputs(files: DataFrame) -> DataFrame:
    """``(stem, md, metadata)`` for X.md with X.metadata.json among ``files`` (name); null where one is missing.

    One aggregate by stem does for both sides, so the table is shuffled once.
    """
    ends = F.regexp_extract("name", r"\A(.+?)(\.metadata\.json|\.md)\z", 2)
    split = files.select("name", ends.alias("_end")).where("_end <> ''")  # no other columns, so none clashes
    stem = F.substring(F.col("name"), F.lit(1), F.char_length("name") - F.char_length("_end"))
    pick = lambda end: F.max(F.when(F.col("_end") == end, F.col("name")))
    return split.groupBy(stem.alias("stem")).agg(pick(".md").alias("md"), pick(".metadata.json").alias("metadata"))


def complete_pairs(files: DataFrame) -> DataFrame:
    return pair_outputs(files).where("md IS NOT NULL AND metadata IS NOT NULL")


def unpaired(files: DataFrame) -> DataFrame:
    return pair_outputs(files).where("md IS NULL OR metadata IS NULL")


def reviewed(sources: DataFrame, reviews: DataFrame) -> DataFrame:
    """Sources whose name some review has, exactly."""
    return sources.join(reviews.select("filename"), "filename", "left_semi")


def pending(sources: DataFrame, reviews: DataFrame) -> DataFrame:
    return sources.join(reviews.select("filename"), "filename", "left_anti")


def resolve_stores(requests: DataFrame, registry: DataFrame, listed: DataFrame, save_name_hits: bool = False, bypass: bool = True) -> DataFrame:
    """``requests`` (requested) with ``store``, ``how`` and ``save``.

    A full store name stands for itself if ``bypass``; then the registry (display_name,
    store) counts, then the listing (pos, display_name, name) by either of its
    names, first match; else it has to be created. A theta join by either name
    would be a nested loop, so it is two equi-joins. ``save`` tells whether the
    registry is to learn the hit: those by display name, by either name with
    ``save_name_hits``.
    """
    asked = requests.select(F.struct(*requests.columns).alias("row"), "requested")
    known = registry.select(F.col("display_name").alias("requested"), F.col("store").alias("_reg"))
    both = listed.select(F.col("display_name").alias("requested"), "name", "pos", F.lit(True).alias("shown")).unionByName(
        listed.select(F.col("name").alias("requested"), "name", "pos", F.lit(False).alias("shown"))
    )
    best = both.where("requested IS NOT NULL").groupBy("requested").agg(F.min_by(F.struct("name", "shown"), F.struct("pos", ~F.col("shown"))).alias("_hit"))
    joined = asked.join(known, "requested", "left").join(best, "requested", "left")
    full = F.startswith("requested", F.lit("fileSearchStores/")) & F.lit(bypass)
    how = (
        F.when(full, F.lit("given")).when(F.col("_reg").isNotNull(), F.lit("registry")).when(F.col("_hit").isNotNull(), F.lit("listed")).otherwise(F.lit("create"))
    )
    store = F.when(full, F.col("requested")).otherwise(F.coalesce("_reg", "_hit.name"))
    save = (how == "create") | ((how == "listed") & (F.col("_hit.shown") | F.lit(save_name_hits)))
    return joined.select(*[F.col("row").getField(c).alias(c) for c in requests.columns if c not in ("store", "how", "save")], store.alias("store"), how.alias("how"), save.alias("save"))


def upsert_registry(registry: DataFrame, news: DataFrame) -> DataFrame:
    """The registry with ``news`` (display_name, store, seq) over it, the last of a name winning."""
    old = registry.select("display_name", "store", F.lit(-1).cast("long").alias("seq"))
    return latest_states(old.unionByName(news.select("display_name", "store", F.col("seq").cast("long"))), "display_name", "seq").drop("seq")
