"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of words in which names, numbers, and numbers with
units are typed placeholders, so a question asked again with other figures keeps
its template. Windows of template words are hashed on both sides and joined.
Matches of a document and an item are gathered on one diagonal, and on chains of
diagonals a few words apart, as words put in or left out move the rest; what
stands in the placeholders is compared: each name of the item must go with one
name of the document and the reverse, wherever it occurs. Figures may differ each
for itself, as two that agree by chance do when they change. A document with
windows that cover enough of an item in a consistent way holds it, verbatim or
re-parameterised.

DataFrame functions only. Documents never move: a bitmap of the items' hashes, of
a bounded size whatever their number, sorts out nearly all of a document's
windows within its row, and only the others leave it, each with its own words.
They meet the items' windows in a hash join, by broadcast up to ``SMALL_WINDOWS``
of them and by a shuffle beyond that. Within an item, windows start every
``stride`` words, which spares matches but no finding: any run of window + stride
- 1 words holds one of them.

Names are title-case words. In an item, one that stands behind a word, comma or
semicolon and a blank is a name by its place; at the start of a sentence or line
it may be a name or not, so the item's windows with such starts are hashed both
ways, as names and as words (a document in lower case has them so). Words all in
capitals are words. Windows count as evidence if half of their words are neither
placeholders nor such starts. Others, with at least LITERAL literal words, are
matched too, for what stands in their placeholders; the rest would match whatever
is asked. An item most of whose windows are no evidence counts all of them, and a
share WEAK_COVERAGE must be found.

Short items, of SHORT words up to a window, have windows of SHORT words at each
place, which must all be found.

Defined results for odd input: null and empty texts have no windows and hold
nothing; an item with fewer than SHORT words is never found. Very long texts are
searched whole, in their row. Rows that share a doc_id (null too) are one
document in ``find_leaks``, while ``decontaminate`` judges rows by doc_id and
text, so a clean row stays whatever its id. Repeated items, and repeated rows,
change nothing. Other columns are ignored by the search, kept by the filter,
whatever their names. Empty tables give an empty result, and an empty benchmark
leaves all documents in.
"""

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweft.llm.common import bind, materialize, table

#: The most rows of item windows, and of found documents, that are broadcast (about 300 and 16 bytes each).
SMALL_WINDOWS = 100_000
SMALL_FOUND = 1_000_000

#: The most bits of the bitmap of item hashes; beyond 2^15 windows it lets more of a document's windows through.
MOST_BITS = 1 << 21

#: The least literal words of a window.
LITERAL = 2

#: The share that must be found of items that are mostly placeholders.
WEAK_COVERAGE = 0.75

#: Words of the windows of short items.
SHORT = 4

#: The most words put in or left out at one place between windows of a chain.
GAP = 4

NAME, START = "\u0001", "\u0002"
NUMBER, MEASURE = "0", "0u"
#: Signs of units, singular and plural, that count as such behind a number.
UNITS = (
    "mm|cm|dm|m|km|inch|inches|ft|feet|foot|yards?|miles?|mg|g|kg|t|tons?|lbs?|pounds?|oz|ounces?|ml|cl|dl|l|liters?|litres?|gallons?"
    "|ms|s|secs?|seconds?|min|mins|minutes?|h|hrs?|hours?|days?|weeks?|months?|years?|mph|kmh|hz|khz|mhz|ghz|w|kw|mw|kwh|v|a|ohms?"
    "|cents?|dollars?|euros?|usd|eur|gbp|percent|degrees?|celsius|fahrenheit|bytes?|kb|mb|gb|tb"
)
_TITLE = r"\p{Lu}(?<![\p{L}\p{M}\x01]\p{Lu})\p{Ll}"
_NAME_AT = r"(?<=[\p{L}\p{M}\p{N},;] )(\p{Lu}\p{Ll})"
_WORD = rf"[{NAME}{START}]?[\p{{L}}\p{{M}}]+|[0-9]+(?:[.,][0-9]+)*(?: ?(?:(?i:{UNITS})(?![\p{{L}}\p{{M}}])|[%°€£$]))?"


def _split(signed: Column) -> Column:
    return F.regexp_extract_all(signed, F.lit(_WORD), F.lit(0))


def words(text: Column) -> Column:
    """Words of ``text`` in order, a number and its unit as one; names (title-case words) have a sign in front that says so."""
    return _split(F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(_TITLE), F.lit(NAME + "$0")))


def item_words(text: Column) -> Column:
    """The same with a sign of their own for title-case words that are no names by their place."""
    named = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(_NAME_AT), F.lit(NAME + "$1"))
    return _split(F.regexp_replace(named, F.lit(_TITLE), F.lit(START + "$0")))


def _is_name(word: Column) -> Column:
    return word < F.lit(START)


def _is_start(word: Column) -> Column:
    return F.startswith(word, F.lit(START))


def _is_slot(word: Column) -> Column:
    """Whether a word is a placeholder by its place: a name or a figure."""
    return _is_name(word) | ((word > F.lit("0")) & (word < F.lit(":"))) | (word == F.lit("0"))


def _bare(word: Column) -> Column:
    """A word in lower case without its sign."""
    return F.lower(F.ltrim(word, F.lit(NAME + START)))


def _hashed(word: Column, starts: bool = True) -> Column:
    """The hash of a template word; ``starts``: with title-case words as names wherever they stand."""
    figure = F.when(F.regexp_like(word, F.lit("^[0-9.,]+$")), F.xxhash64(F.lit(NUMBER))).otherwise(F.xxhash64(F.lit(MEASURE)))
    named = word < F.lit("\u0003") if starts else _is_name(word)
    plain = F.xxhash64(F.lower(word)) if starts else F.xxhash64(_bare(word))
    return F.when(named, F.xxhash64(F.lit(NAME))).when((word < F.lit(":")) & (word >= F.lit("0")), figure).otherwise(plain)


def _widened(hashed: Column, width: int, window: int) -> Column:
    """From a hash for each run of ``width`` words, by its first word, to one for each run of ``window``."""

    def joined(hashes, apart):
        """Hashes of each element with the one ``apart`` places on; the last ones, without a partner, are cut off in the end."""
        return bind(hashes, lambda h: F.zip_with(h, F.slice(h, F.lit(apart + 1), F.greatest(F.size(h) - apart, F.lit(0))), lambda a, b: F.xxhash64(a, b)))

    # Twice as long each time; the last step overlaps if window is no such multiple.
    cut = window - width
    while width < window:
        step = min(width, window - width)
        hashed, width = joined(hashed, step), width + step
    return bind(hashed, lambda h: F.slice(h, F.lit(1), F.greatest(F.size(h) - cut, F.lit(0))))


def _bitmap(items: DataFrame, n: int) -> tuple[Column, int]:
    """A bit for each hash of ``items``, as a literal array of longs, and the number of bits; bounded by MOST_BITS."""
    bits = min(MOST_BITS, max(1 << 12, 1 << (64 * n - 1).bit_length()))
    at = F.shiftrightunsigned("hash", 40).bitwiseAND(F.lit(bits - 1))
    some = items.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("place")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("bits"))
    longs = [0] * (bits // 64)
    for place, found in some.collect():  # as many rows as longs at most
        longs[place] = found
    return F.from_json(F.lit(json.dumps(longs)), "array<bigint>"), bits


def _met(hash_: Column, bitmap: Column, bits: int) -> Column:
    at = F.shiftrightunsigned(hash_, 40).bitwiseAND(F.lit(bits - 1))
    return F.getbit(F.get(bitmap, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1


def _windows(docs: DataFrame, bitmap: Column, bits: int, window: int, short: bool) -> DataFrame:
    """``(doc_id, th, at, hash, own)`` for each window of ``docs`` whose bit is set, with its words."""

    def some(raw, hashes, width):
        struct = lambda h, i: F.struct(i.alias("at"), h.alias("hash"), F.slice(raw, i + 1, F.lit(width)).alias("own"))
        return F.array_compact(F.transform(hashes, lambda h, i: F.when(_met(h, bitmap, bits), struct(h, i))))

    def found(raw):
        runs = _widened(F.transform(raw, lambda w: _hashed(w)), 1, SHORT)
        whole = lambda h: some(raw, _widened(h, SHORT, window), window)
        return bind(runs, lambda h: F.concat(whole(h), some(raw, h, SHORT)) if short else whole(h))

    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.xxhash64(text).alias("th"), bind(words(text), found).alias("met"))
    return own.where(F.size("met") > 0).select("doc_id", "th", F.explode("met").alias("w")).select("doc_id", "th", "w.*")


def item_windows(benchmark: DataFrame, window: int, stride: int) -> DataFrame:
    """``(item_id, hash, item_at, started, item_own, short, need, evidence, item_windows)``; the last window of an item is always among them."""
    raw = benchmark.select("item_id", item_words(F.col("text")).alias("raw")).where(F.size("raw") >= SHORT).distinct()
    long_enough = F.size("raw") >= window
    runs = {"literal": F.transform("raw", lambda w: _hashed(w, False)), "named": F.transform("raw", lambda w: _hashed(w))}
    sized = lambda h: F.when(long_enough, _widened(h, 1, window)).otherwise(_widened(h, 1, SHORT))
    hashed = raw.select("item_id", "raw", F.when(long_enough, window).otherwise(SHORT).alias("width"), *(sized(h).alias(k) for k, h in runs.items()))
    each = hashed.select("*", F.size("literal").alias("n"), F.posexplode(F.arrays_zip("literal", "named")).alias("item_at", "h"))
    kept = each.where((F.col("width") < window) | (F.col("item_at") % stride == 0) | (F.col("item_at") == F.col("n") - 1))
    ways = F.array(F.struct(F.col("h.literal").alias("hash"), F.lit(False).alias("started")), F.struct(F.col("h.named").alias("hash"), F.lit(True).alias("started")))
    ways = F.when(F.col("h.literal") == F.col("h.named"), F.slice(ways, 1, 1)).otherwise(ways)
    both = kept.select("item_id", "item_at", "width", F.slice("raw", F.col("item_at") + 1, F.col("width")).alias("item_own"), F.explode(ways).alias("way"))
    slots = F.size(F.filter("item_own", _is_slot))
    starts = F.when(F.col("way.started"), F.size(F.filter("item_own", _is_start))).otherwise(0)
    least = F.when(F.col("width") < window, 1).otherwise(LITERAL)
    ample = (slots + F.size(F.filter("item_own", _is_start))) * 2 <= F.col("width")
    some = both.withColumn("ample", ample).where(F.col("width") - slots - starts >= least)
    held = some.groupBy("item_id").agg(F.count_distinct(F.when(F.col("ample"), F.col("item_at"))).alias("a"), F.count_distinct("item_at").alias("b"))
    weak = F.col("a") * 2 < F.col("b")
    counted = held.select("item_id", weak.alias("weak"), F.when(weak, F.col("b")).otherwise(F.col("a")).alias("item_windows"))
    need = F.when(F.col("width") < window, 1.0).when(F.col("weak"), WEAK_COVERAGE)
    return some.join(counted, "item_id").select(
        "item_id", F.col("way.hash").alias("hash"), "item_at", F.col("way.started").alias("started"), "item_own",
        (F.col("width") < window).alias("short"), need.alias("need"), (F.col("weak") | F.col("ample")).alias("evidence"), "item_windows",
    )


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 8, stride: int = 4) -> DataFrame:
    """Each document window that is an item window, with what stands in its names.

    ``(doc_id, th, item_id, item_windows, need, shift, item_at, started, evidence, names, changed)``.
    """
    items = materialize(item_windows(benchmark, window, stride), "items")
    n, short = items.agg(F.count("*"), F.coalesce(F.bool_or("short"), F.lit(False))).first()
    bitmap, bits = _bitmap(items, n)
    met = _windows(docs, bitmap, bits, window, short).join(F.broadcast(items) if n <= SMALL_WINDOWS else items, "hash")
    one = lambda a, b: F.struct(a.alias("item"), b.alias("doc"))
    both = F.zip_with("item_own", "own", one)
    start = lambda p: F.col("started") & _is_start(p["item"])
    differs = lambda p: _bare(p["item"]) != _bare(p["doc"])
    named = F.filter(both, lambda p: _is_name(p["item"]) | start(p))
    names = F.transform(named, lambda p: F.struct(_bare(p["item"]).alias("item"), _bare(p["doc"]).alias("doc"), _is_start(p["item"]).alias("start")))
    return met.select(
        "doc_id", "th", "item_id", "item_windows", "need", (F.col("at") - F.col("item_at")).alias("shift"),
        "item_at", F.exists(both, lambda p: start(p) & differs(p)).alias("started"), "evidence", names.alias("names"), F.exists(both, differs).alias("changed"),
    )


def _chained(met: DataFrame) -> DataFrame:
    """``met`` with ``chain``: the least of a run of shifts, each at most GAP words from the next."""
    order = Window.partitionBy("doc_id", "th", "item_id").orderBy("shift")
    starts = F.when(F.col("shift") - F.lag("shift").over(order) <= GAP, None).otherwise(F.col("shift"))
    return met.withColumn("_start", starts).withColumn("chain", F.last("_start", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def row_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 8, stride: int = 4, coverage: float = 0.5) -> DataFrame:
    """``(doc_id, th, item_id, coverage, reparameterised)``: items that rows hold in a consistent way; ``th`` is a hash of the text."""
    met = matches(docs, benchmark, window, stride)
    # A window found again at the same shift (repeated rows) counts once; a diagonal has at most the item's windows.
    own = ("doc_id", "th", "item_id", "item_windows", "need")
    one = met.groupBy(*own, "shift", "item_at", "started").agg(F.bool_or("evidence").alias("evidence"), F.min("names").alias("names"), F.bool_or("changed").alias("changed"))
    # With all title-case starts as names, and without, as other words open sentences too; then windows in which a start differs say nothing.
    kinds = [(k, c, s) for k, c in (("diagonal", "shift"), ("chain", "chain")) for s in (F.lit(True), F.col("started"))]
    ways = F.array_distinct(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("at"), s.alias("starts")) for k, c, s in kinds)))
    along = _chained(one).withColumn("way", F.explode(ways)).groupBy(*own, "way").agg(
        F.size(F.collect_set(F.when(F.col("evidence"), F.col("item_at")))).alias("n"),
        F.array_distinct(F.flatten(F.collect_set("names"))).alias("names"),
        F.bool_or("changed").alias("changed"),
    )
    asked = F.filter("names", lambda p: F.col("way.starts") | ~p["start"])
    pairs = F.array_distinct(F.transform(asked, lambda p: F.struct(p["item"], p["doc"])))
    distinct = lambda side: F.size(F.array_distinct(F.transform(asked, lambda p: p[side])))
    consistent = (distinct("item") == F.size(pairs)) & (distinct("doc") == F.size(pairs))
    share = F.col("n") / F.col("item_windows")
    good = along.where(consistent & (share >= F.coalesce("need", F.lit(coverage))))
    return good.groupBy("doc_id", "th", "item_id").agg(F.max(share).alias("coverage"), F.min("changed").alias("reparameterised"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``(doc_id, item_id, coverage, reparameterised)``: items that documents hold in a consistent way."""
    found = row_leaks(docs, benchmark, **how)
    return found.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.min("reparameterised").alias("reparameterised"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    leaks = row_leaks(docs.select("doc_id", "text"), benchmark, **how)
    found = materialize(leaks.select(F.col("doc_id").alias("_leak_id"), F.col("th").alias("_leak_th")).distinct(), "leaks")
    if found.count() <= SMALL_FOUND:
        found = F.broadcast(found)
    same = docs["doc_id"].eqNullSafe(found["_leak_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["_leak_th"])
    return docs.join(found, same, "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item."""
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return find_leaks(docs, benchmark).select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), "reparameterised")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLES: dict = {}
