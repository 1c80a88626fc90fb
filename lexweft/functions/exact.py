"""Cleaning of whole columns, and lookup keys of distinct labels."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweft.functions import text, unicode


def clean_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with each of ``names`` cleaned as by ``text.clean_text``.

    Each step is a projection of its own, within whole-stage code where Spark has
    it, as each stands several times in the next.
    """
    whole = df.withColumns({n: F.coalesce(n, F.lit("")) for n in names})
    repaired = whole.withColumns({n: text.repair_mojibake(F.col(n)) for n in names})
    composed = repaired.withColumns({n: unicode.compose(F.col(n)) for n in names})
    return composed.withColumns({n: text.tidy_text(F.col(n)) for n in names})


def clean_exact(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with ``out``, the clean text of ``column``."""
    return clean_columns(df.withColumn(out, F.col(column)), [out])


def label_keys_exact(labels: DataFrame, column: str, out: str) -> DataFrame:
    """``labels`` with lookup keys, worked out once for each distinct label."""
    keys = labels.select(F.struct(F.col(column).alias("label")).alias("k")).distinct().select("k", text.label_key(F.col("k.label")).alias("key"))
    own = labels.select(F.struct(*labels.columns).alias("row"))
    met = own.join(keys, F.col("row").getField(column).eqNullSafe(F.col("k.label")), "left")
    return met.select(*[F.col("row").getField(c).alias(c) for c in labels.columns if c != out], F.col("key").alias(out))
