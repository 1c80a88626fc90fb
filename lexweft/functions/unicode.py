"""Unicode normalisation and case folding in the JVM.

Spark has no function for them, but the ICU library is part of it, and its static
methods take strings, so ``reflect`` calls them for a row: no Python worker, and no
table of our own. Strings of ASCII alone take Spark's functions. Calls by
``reflect`` count as nondeterministic, so they stand in projections and not in
join conditions.
"""

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweft.functions.columns import bind


def _icu(method: str, c: Column, flag: bool) -> Column:
    return F.reflect(F.lit(f"com.ibm.icu.{method.rpartition('.')[0]}"), F.lit(method.rpartition(".")[2]), c, F.lit(flag))


def _unless_ascii(c: Column, otherwise, ascii_=lambda x: x) -> Column:
    """Null for null; ``reflect`` never sees it."""
    return F.when(F.octet_length(c) == F.char_length(c), ascii_(c)).when(c.isNotNull(), otherwise(c))


def compose(c: Column) -> Column:
    """Canonical composition (NFC). ``c`` stands in it several times and is meant to be a column."""
    return _unless_ascii(c, lambda x: _icu("text.Normalizer.compose", x, False))


def decompose_compatible(c: Column) -> Column:
    """Compatibility decomposition (NFKD)."""
    return _unless_ascii(c, lambda x: _icu("text.Normalizer.decompose", x, True))


@cache
def _marks() -> str:
    """A class of the characters with a combining class of their own, as merged ranges, asked only for what is no Latin letter."""
    points = [p for p in range(0x300, 0x1F000) if unicodedata.combining(chr(p))]
    known = set(points)
    starts, ends = ([p for p in points if p + step not in known] for step in (-1, 1))
    ranges = "".join(rf"\x{{{a:x}}}-\x{{{z:x}}}" for a, z in zip(starts, ends))
    return rf"[\x{{300}}-\x{{1efff}}&&[{ranges}]]+"


def without_marks(c: Column) -> Column:
    """A decomposed string without its combining marks. Spacing vowels and the like, of class 0, stay."""
    return F.regexp_replace(c, F.lit(_marks()), F.lit(""))


def casefold(c: Column) -> Column:
    """Full case folding."""
    return _unless_ascii(c, lambda x: _icu("lang.UCharacter.foldCase", x, True), F.lower)


def fold(c: Column) -> Column:
    """What of a string tells labels apart: decomposed, without marks, case-folded."""
    return bind(c, lambda x: _unless_ascii(x, lambda y: bind(without_marks(_icu("text.Normalizer.decompose", y, True)), casefold), F.lower))
