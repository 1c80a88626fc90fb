"""Helpers for column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value`` once.

    An expression that stands several times in another is worked out as often,
    and nested ones multiply; a lambda variable is worked out once.
    """
    return F.transform(F.array(value), body)[0]
