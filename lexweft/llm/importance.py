"""Quality classifier by importance resampling.

Two hashed n-gram models are fitted, one of target text (labelled good) and one
of raw text (the whole corpus). A document's weight is the ratio of the two for
its n-grams, and a sample in proportion to the weights is drawn without
replacement by Gumbel top-k: the k largest of log weight plus Gumbel noise.

The n-grams are of the text itself: lower-cased words, pairs of words and runs of
four bytes. Others show form in whatever the language and have a table of their
own: unigrams and bigrams of word shapes (runs of lower-case letters, capitals
and digits are one sign each, other signs stand as they are), and whether a word
repeats one of the eight words before it. Bytes are hashed for whole batches at
once. Target text is labelled good and, where labels tell, not toxic. N-grams
overlap, so log weights are tempered by OVERLAP, and a long text counts for
MOST_GRAMS of its n-grams, by their mean over all of them.

Toxic text is good text but for some words, so a third model, of text labelled
good and toxic, is set against that of target text. N-grams that are far likelier in toxic
text are evidence; what a document has above TOXIC_FREE, and above some times
what target text of its length has, counts against it.

k is given, or the expected number of documents that are like target text: the
sum of the chances that their weights and ``prior_log_odds`` make. Noise decides
among documents about as likely to be target as raw text, while those far below
are rejected. Each text is hashed twice, for the raw model and for its weight;
what is carried along is written with the weight.

The raw model counts all documents. The target and toxic models are fitted on at most
``fit_rows`` labelled rows each, a documented bound, chosen by a hash of the doc_id;
the bound is what makes their ids safe to broadcast.

The k-th largest key is found exactly by refining histograms; no sort of all
documents, nothing of them on the driver.

Defined results for odd input: a null, empty or blank text has no n-grams and a
log weight of minus infinity, so it is rejected. Null labels are ignored.
Without any good label all weights are 1 and no text is rejected. Rows that tie at the last key are all
kept. Repeated rows get equal weights and equal noise. Very long texts are hashed
in parts, to the same n-grams. Other columns are kept, whatever their names, but
for ``log_weight`` and ``sample_key``, which are replaced (the pipeline's stage
keeps those too). An empty table gives an empty result.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweft.llm.common import bound_batches, give_back, materialize, packed, table, unpacked
from lexweft.llm.pieces import forget

BUCKET_BITS = 14
#: For the n-grams of the text itself.
CONTENT_BITS = 18
#: Bytes of a character n-gram.
CHARS = 4
#: Bytes hashed at a time.
AT_ONCE = 1 << 18
LAGS = 8

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[128:] = ord("a")
_RUN = np.zeros(256, bool)
_RUN[[ord("a"), ord("A"), ord("0")]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict = {}


def _powers(n: int):
    """Powers of the base and of its inverse modulo 2^64, at least n + 1 of each."""
    if _POWERS.get("n", -1) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for name, b in (("up", _BASE), ("down", inverse)):
            _POWERS[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]), dtype=np.uint64)
        _POWERS["n"] = n
    return _POWERS["up"], _POWERS["down"]


def _mix(h: np.ndarray, bits: int = BUCKET_BITS) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h >> np.uint64(64 - bits)


def _word_hashes(a: np.ndarray):
    """Polynomial hashes of the blank-separated words of a byte array, and where they start."""
    blank = _BLANK[a]
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(a))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], dtype=np.uint64)])
    return (sums[ends] - sums[starts]) * down[starts], starts


def _hash_part(data: bytes):
    """Word hashes and shape hashes of a piece of text, with the words' starts."""
    words, starts = _word_hashes(np.frombuffer(data.lower(), np.uint8))
    shape = _SHAPE[np.frombuffer(data, np.uint8)]
    same = np.concatenate([[False], (shape[1:] == shape[:-1]) & _RUN[shape[1:]]])[: len(shape)]
    shapes, _ = _word_hashes(shape[~same])
    return words, shapes, starts


def _parts(data: bytes):
    """Pieces of at most AT_ONCE bytes, cut at blanks (a longer word stays whole)."""
    at = 0
    while at < len(data):
        end = at + AT_ONCE
        if end < len(data):
            cut = max(data.rfind(b, at, end) for b in (b" ", b"\n", b"\t"))
            while cut < at and end < len(data) and not _BLANK[data[end]]:
                end += 1
            end = cut if cut >= at else end
        yield data[at : end + 1]
        at = end + 1


def _groups(texts: list[bytes]):
    """Word hashes, shape hashes and documents of the words, for some documents at a time."""
    group, first, size = [], 0, 0

    def hashed():
        words, shapes, starts = _hash_part(b"\n".join(group))
        begins = np.cumsum([0, *(len(t) + 1 for t in group[:-1])])
        return words, shapes, first + np.searchsorted(begins, starts, "right") - 1

    for i, t in enumerate(texts):
        if group and size + len(t) > AT_ONCE:
            yield hashed()
            group, size = [], 0
        if len(t) > AT_ONCE:
            parts = [_hash_part(p)[:2] for p in _parts(t)]
            words = np.concatenate([w for w, _ in parts])
            yield words, np.concatenate([s for _, s in parts]), np.full(len(words), i)
            continue
        if not group:
            first = i
        group.append(t)
        size += len(t) + 1
    if group:
        yield hashed()


def features(texts: list[bytes]):
    """``(documents, buckets)`` arrays for all n-grams of ``texts``, one kind of n-gram and some documents at a time."""
    for w, s, o in _groups(texts):
        yield o, _mix(s + np.uint64(11)).astype(np.int64)
        for lag in range(1, LAGS + 1):
            own = o[lag:] == o[:-lag]
            if lag == 1:
                yield o[1:][own], _mix(s[:-1] * np.uint64(3) + s[1:] + np.uint64(12))[own].astype(np.int64)
            repeats = np.where(w[lag:] == w[:-lag], lag, lag + 100).astype(np.uint64)
            yield o[lag:][own], _mix(repeats + np.uint64(991))[own].astype(np.int64)


def _char_grams(texts: list[bytes]):
    """Hashes of all runs of CHARS bytes and their documents, about AT_ONCE bytes at a time."""
    grams, owners, size = [], [], 0
    for i, t in enumerate(texts):
        data = np.frombuffer(t.lower(), np.uint8)
        for at in range(0, len(data) - CHARS + 1, AT_ONCE):
            part = data[at : at + AT_ONCE + CHARS - 1].astype(np.uint64)
            n = len(part) - CHARS + 1
            grams.append(sum(part[k : k + n] << np.uint64(8 * k) for k in range(CHARS)))
            owners.append(np.full(n, i))
            size += n
            if size >= AT_ONCE:
                yield np.concatenate(owners), np.concatenate(grams)
                grams, owners, size = [], [], 0
    if grams:
        yield np.concatenate(owners), np.concatenate(grams)


def content_features(texts: list[bytes]):
    """``(documents, buckets)`` arrays for the n-grams of the text itself, some documents at a time."""
    for w, _, o in _groups(texts):
        own = o[1:] == o[:-1]
        pairs = (w[:-1] * np.uint64(3) + w[1:] + np.uint64(22))[own]
        yield np.concatenate([o, o[1:][own]]), _mix(np.concatenate([w + np.uint64(21), pairs]), CONTENT_BITS).astype(np.int64)
    for o, g in _char_grams(texts):
        yield o, _mix(g * np.uint64(_BASE) + np.uint64(23), CONTENT_BITS).astype(np.int64)


#: Each kind of n-gram with its table (first bucket, number of buckets) and its prior.
#: Words are rarer than shapes; a smaller prior than 500 takes few labels' own words for quality.
KINDS = ((features, 0, 1 << BUCKET_BITS, 50.0), (content_features, 1 << BUCKET_BITS, 1 << CONTENT_BITS, 500.0))
BUCKETS = (1 << BUCKET_BITS) + (1 << CONTENT_BITS)
#: N-grams that overlap tell the same several times: a word stands in about that many.
OVERLAP = 10.0
#: The n-grams that a long text counts for; more of the same say little new.
MOST_GRAMS = 2000
#: Toxic text: the prior in n-grams, the least log ratio that counts, what clean text may gather, and how much more weighs.
TOXIC_PRIOR, TOXIC_LEAST, TOXIC_FREE, TOXIC_WEIGHT = 2.0, 2.0, 20.0, 5.0


class Model(NamedTuple):
    """Log ratios per bucket of target to raw text; evidence per bucket of toxic text, and how much of it an n-gram of target text has."""

    ratios: np.ndarray
    toxic: np.ndarray
    rate: float


def ngram_counts(docs: DataFrame, known: DataFrame) -> np.ndarray:
    """Raw, target and toxic counts per bucket of all tables, an array of shape (3, BUCKETS); ``known`` (doc_id, kind): 1 target, 2 toxic."""

    def count(batches):
        forget()
        total = np.zeros((3, BUCKETS), np.int64)
        for batch in batches:
            of_kind = batch.column(1).to_numpy(zero_copy_only=False)
            texts = [x or b"" for x in batch.column(0).to_pylist()]
            for kind, first, n, _ in KINDS:
                part = total[:, first : first + n]
                for of, bucket in kind(texts):
                    part[0] += np.bincount(bucket, minlength=n)
                    for k in (1, 2):
                        part[k] += np.bincount(bucket[of_kind[of] == k], minlength=n)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(t[some]) for t in total)], names=["bucket", "raw", "target", "toxic"])
        give_back()

    marks = F.broadcast(known.select(F.col("doc_id").alias("known_id"), F.col("kind").cast("int").alias("known_kind")))
    marked = docs.select("doc_id", "text").join(marks, F.col("doc_id") == F.col("known_id"), "left")
    own = marked.select(F.col("text").cast("binary"), F.coalesce("known_kind", F.lit(0)).alias("kind"))
    summed = own.mapInArrow(count, "bucket long, raw long, target long, toxic long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"), F.sum("toxic"))
    out = np.zeros((3, BUCKETS), np.int64)
    rows = summed.toArrow()  # as many rows as buckets at most
    bucket, *counts = (c.to_numpy() for c in rows.columns)
    out[:, bucket] = counts
    return out


def log_ratios(counts: np.ndarray, prior: float = 50.0) -> np.ndarray:
    """Log of target over raw probability per bucket; ``prior`` n-grams at raw frequency steady rare ones."""
    raw, target = counts.astype(float)
    if not target.sum():
        return np.zeros(len(raw))
    return np.log((target + prior) / (raw * (target.sum() / max(raw.sum(), 1)) + prior))


def toxic_evidence(target: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Log ratios per bucket of toxic to target text where they are large, else 0, and their mean over the n-grams of target text."""
    if not toxic.sum() or not target.sum():
        return np.zeros(len(toxic)), 0.0
    ratio = np.log((toxic + TOXIC_PRIOR) / (target * (toxic.sum() / target.sum()) + TOXIC_PRIOR))
    ratio[ratio <= TOXIC_LEAST] = 0
    return ratio, float(target @ ratio / target.sum())


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> Model:
    """The models, from all of ``docs`` and at most ``fit_rows`` rows each labelled good and toxic."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) if "toxic" in labels.columns else F.lit(0)
    # Text labelled bad would tell the toxic model what junk looks like. A doc_id that is labelled twice and differently is toxic.
    kind = F.when(toxic == 1, 2).otherwise(1)
    said = labels.where("doc_id IS NOT NULL AND quality = 1").groupBy("doc_id").agg(F.max(kind).alias("kind"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    known = [said.where(F.col("kind") == k).orderBy(*order).limit(fit_rows) for k in (1, 2)]
    counts = ngram_counts(docs, known[0].unionByName(known[1]))
    ratios = np.concatenate([log_ratios(counts[:2, first : first + n], prior) for _, first, n, prior in KINDS])
    _, first, n, _ = KINDS[1]
    return Model(ratios, *toxic_evidence(counts[1, first:], counts[2, first:]))


def with_weights(docs: DataFrame, model: Model, seed: int = 7) -> DataFrame:
    """``docs`` with ``log_weight`` and ``sample_key`` (the log weight plus Gumbel noise)."""
    content = KINDS[1][0]

    @F.arrow_udf("double")
    def weigh(texts: pa.Array) -> pa.Array:
        total, n, toxic, m = (np.zeros(len(texts)) for _ in range(4))
        own = [x or b"" for x in texts.to_pylist()]
        for kind, first, _, _ in KINDS:
            for of, bucket in kind(own):
                total += np.bincount(of, weights=model.ratios[first + bucket], minlength=len(texts))
                n += np.bincount(of, minlength=len(texts))
                if kind is content:
                    toxic += np.bincount(of, weights=model.toxic[bucket], minlength=len(texts))
                    m += np.bincount(of, minlength=len(texts))
        # Long clean text gathers some evidence of toxic text by chance, a few times the mean at most.
        total = total / OVERLAP * np.minimum(1, MOST_GRAMS / np.maximum(n, 1)) - TOXIC_WEIGHT * np.maximum(0, toxic - 4 * model.rate * m - TOXIC_FREE)
        total[n == 0] = -np.inf
        give_back()
        return pa.array(total)

    # From a hash of the doc_id, so that a task that runs again draws the same.
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    weighed = docs.withColumn("log_weight", weigh(F.col("text").cast("binary")))
    return weighed.withColumn("sample_key", F.col("log_weight") - F.log(-F.log(u)))


def kth_largest(keys: DataFrame, k: int, bins: int = 2000, few: int = 10_000) -> float | None:
    """The k-th largest finite value of column ``sample_key``, None if there are not so many."""
    finite = keys.where("sample_key > double('-Infinity')")
    n, low, high = finite.agg(F.count("*"), F.min("sample_key"), F.max("sample_key")).first()
    if not k or n < k:
        return None
    above, inside = 0, n
    while inside > few and low < high:
        step = (high - low) / bins
        at = F.least(F.floor((F.col("sample_key") - low) / step), F.lit(bins - 1)).alias("at")
        rows = finite.where(F.col("sample_key").between(low, high)).groupBy(at).agg(
            F.count("*").alias("n"), F.min("sample_key").alias("low"), F.max("sample_key").alias("high")
        )
        for row in rows.orderBy(F.desc("at")).collect():  # as many rows as bins at most
            if above + row.n >= k:
                low, high, inside = row.low, row.high, row.n
                break
            above += row.n
    if low == high:
        return low
    rest = finite.where(F.col("sample_key").between(low, high)).orderBy(F.desc("sample_key")).limit(few)
    return [r[0] for r in rest.select("sample_key").collect()][k - above - 1]


def sample_size(scored: DataFrame, prior_log_odds: float = 6.0) -> int:
    """The expected number of documents that are like target text: the sum of their odds turned into chances."""
    chance = 1 / (1 + F.exp(-(F.col("log_weight") + prior_log_odds)))
    # As decimals, whose sum doesn't depend on the order.
    return int(scored.agg(F.coalesce(F.round(F.sum(chance.cast("decimal(20, 12)"))), F.lit(0))).first()[0])


def threshold(scored: DataFrame, k: int | None = None, prior_log_odds: float = 6.0) -> float:
    """The key from which on documents are sampled; infinity if none is."""
    if k is None:
        k = sample_size(scored, prior_log_odds)
    found = kth_largest(scored, k)
    if found is None:
        return float("inf") if not k else float("-1e308")
    return found


def resample(
    docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, k: int | None = None, prior_log_odds: float = 6.0, seed: int = 7, carry: list[str] | None = None
) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns (or those of ``carry``), ``log_weight`` and ``sample_key``."""
    rows = _sampled(docs, labels, fit_rows, k, prior_log_odds, seed, carry)
    return rows.select(*unpacked(rows, "log_weight", "sample_key"), "log_weight", "sample_key")


def _sampled(docs, labels, fit_rows=20_000, k=None, prior_log_odds=6.0, seed=7, carry=None) -> DataFrame:
    """``(row, log_weight, sample_key)`` of the sampled rows; what is carried is written once, with the weights, and not hashed again."""
    bound_batches(docs.sparkSession)
    own = docs.select("doc_id", "text", packed(docs if carry is None else docs.select(*carry)))
    model = fit(own, labels, fit_rows)
    scored = materialize(with_weights(own, model, seed).select("row", "log_weight", "sample_key"), "weights")
    if not model.ratios.any():  # nothing is known against any
        prior_log_odds = 1e3
    return scored.where(F.col("sample_key") >= threshold(scored.select("log_weight", "sample_key"), k, prior_log_odds))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return resample(docs, labels, carry=["doc_id"])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sampled(docs, table(spark, sf_dir, "labels")).select("row.*")


QUERIES = {"op10_quality": op10_quality}
ORACLES: dict = {}
