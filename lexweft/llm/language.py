"""Language identification, words first, then ever shorter character n-grams.

A text's words are its runs of letters and marks, lower-cased. A known word scores
its log frequency in each language. A word that isn't known is cut into runs of
five characters (a blank stands before and behind it); if none of them is known,
into runs of four, and so on down to single ones, and scores the log frequencies
of those known, divided by their length, as each character is in that many. The
sums over all words, with the log share of each language in the learned documents,
make the posterior, whose largest value is the score.

Words are counted over the whole of all learned documents, an Arrow batch at a time,
and added up by Spark; n-grams are counted on the table of distinct words and
not on the text again. The model keeps the most frequent words and n-grams, at most
``most`` (word, language) and (n-gram, language) counts each, which bounds what is
sent to executors; a word that isn't among them takes the way of unknown ones.
The bound falls on a power of the fourth root of two, found from a histogram, so
equal counts are kept or left together.

Defined results for odd input: a null text, and one without letters, is ``und``
with score 0, as is any text if nothing could be learned. Words of which not even a
character is known leave the shares of the languages to decide; of equal scores
the smaller language by code point is taken. A null doc_id is learned from; rows
that repeat count as often. Very long texts are an Arrow batch of their own, very long
words are scored whole. Other columns are kept, whatever their names, but for
``lang_pred`` and ``score``, which are replaced. An empty table gives an empty result.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweft.llm.common import bound_batches, give_back, materialize, packed, table, unpacked

LONGEST = 5
#: The most (word, language) and (n-gram, language) counts of a model.
MOST = 300_000
#: Added to each count.
PRIOR = 0.5
#: Scores of words by languages that are held at a time.
CELLS = 1 << 22
UND = "und"
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``(words, code, document)``: the distinct words of ``texts``, and the word and the text of each place."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\pL\pM]+")
    coded = lists.flatten().dictionary_encode()
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    words, code = coded.dictionary, coded.indices.to_numpy()
    good = pc.match_substring_regex(words, r"\pL").to_numpy(zero_copy_only=False)
    number = np.cumsum(good) - 1
    kept = good[code]
    return words.filter(pa.array(good)), number[code[kept]], of[kept]


def grams_of(words: pa.Array):
    """``(n, word, hash)`` arrays of the character n-grams of ``words``, the longest first; the hash tells n, too."""
    sign = np.frombuffer((" " + " ".join(words.to_pylist()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = sign == 32
    blanks = np.cumsum(blank)
    for n in range(LONGEST, 0, -1):
        k = len(sign) - n + 1
        if k < 1 or not len(words):
            continue
        # A run is within one word if it has blanks at its ends only; a blank alone tells nothing.
        inner = blanks[n - 2 : n - 2 + k] - blanks[:k] == 0 if n > 1 else ~blank
        at = np.flatnonzero(inner)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = (h ^ sign[at + j]) * _TIMES
            h ^= h >> np.uint64(29)
        yield n, blanks[at] - 1, h.view(np.int64)


def word_counts(learned: DataFrame) -> DataFrame:
    """``(lang, word, n)`` over all of ``learned`` (text, lang)."""

    def run(batches):
        for batch in batches:
            words, code, of = words_of(batch.column(0))
            langs = batch.column(1).dictionary_encode()
            pair, n = np.unique(langs.indices.to_numpy()[of].astype(np.int64) * max(len(words), 1) + code, return_counts=True)
            lang, word = np.divmod(pair, max(len(words), 1))
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)), words.take(pa.array(word)).cast(pa.string()), pa.array(n)], names=["lang", "word", "n"])
        give_back()

    each = learned.select("text", "lang").mapInArrow(run, "lang string, word string, n long")
    return each.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """``(lang, size, gram, n)`` of the n-grams of ``word_counts``."""

    def run(batches):
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            no, n = langs.indices.to_numpy().astype(np.int64), batch.column(2).to_numpy()
            for size, word, h in grams_of(batch.column(1)):
                order = np.lexsort((h, no[word]))
                lang, gram, count = no[word][order], h[order], n[word][order]
                first = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (gram[1:] != gram[:-1])])) if len(order) else order
                columns = [langs.dictionary.take(pa.array(lang[first])), pa.array(np.full(len(first), size, np.int32)), pa.array(gram[first]), pa.array(np.add.reduceat(count, first) if len(first) else count)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "size", "gram", "n"])
        give_back()

    each = words.select("lang", "word", "n").mapInArrow(run, "lang string, size int, gram long, n long")
    return each.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of ``counts`` with the largest ``n``, ``most`` at most; those of about the same ``n`` stay or go together."""
    level = F.floor(4 * F.log2("n")).cast("int")
    kept, least = 0, None
    for row in counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).orderBy(F.desc("level")).collect():  # 252 rows at most
        kept += row.rows
        if kept > most:
            break
        least = row.level
    return counts.where(level >= least) if least is not None else counts.limit(0)


class Model(NamedTuple):
    """``word_log`` and ``gram_log``: for each known word or n-gram (from ``start`` on) languages and what they have above ``base``, the log frequency of what they lack."""

    langs: list[str]
    shares: np.ndarray
    words: pa.Array
    grams: np.ndarray
    word_log: tuple
    gram_log: tuple


def _logs(number: np.ndarray, kinds: int, lang: np.ndarray, n: np.ndarray, total: np.ndarray, types: float):
    """``(start, lang, above, base)`` for counts ``n`` per ``number`` (ascending) and language."""
    base = np.log(PRIOR / (total + PRIOR * types))
    return np.searchsorted(number, np.arange(kinds + 1)), lang, np.log((n + PRIOR) / PRIOR), base


def fit(learned: DataFrame, most: int = MOST) -> Model:
    """The model of all of ``learned`` (text, lang)."""
    bound_batches(learned.sparkSession)
    own = learned.where("lang IS NOT NULL").select("text", "lang")
    shares = sorted(own.groupBy("lang").agg(F.count("*").alias("n")).collect(), key=lambda r: r.lang)  # a row for each language
    langs = [r.lang for r in shares]
    if not langs:
        return Model([], np.zeros(0), pa.array([], pa.large_string()), np.zeros(0, np.int64), (), ())
    words = materialize(word_counts(own), "words")
    grams = materialize(gram_counts(words), "grams")
    number = {lang: i for i, lang in enumerate(langs)}

    def known(counts: DataFrame, *key: str):
        found = most_frequent(counts, most).orderBy(*key, "lang").toArrow()
        return [found[k].combine_chunks() for k in (*key, "n")], np.array([number[x] for x in found["lang"].to_pylist()], np.int64)

    def totals(counts: DataFrame) -> tuple[np.ndarray, float]:
        out = np.zeros(len(langs))
        for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect():
            out[number[r.lang]] = r.n
        return out, out.sum()

    (word, n), lang = known(words, "word")
    coded = word.cast(pa.large_string()).dictionary_encode()
    all_words, _ = totals(words)
    types = len(coded.dictionary)
    word_log = _logs(coded.indices.to_numpy(), types, lang, n.to_numpy(), all_words, types)

    (size, gram, n), lang = known(grams, "size", "gram")
    order = np.lexsort((lang, gram.to_numpy()))
    each, at, code = np.unique(gram.to_numpy()[order], return_index=True, return_inverse=True)
    sizes = size.to_numpy()[order][at]
    # Frequencies are among runs of the same length, so each length has a base of its own, a row of ``base``.
    base = np.zeros((LONGEST + 1, len(langs)))
    for k in range(1, LONGEST + 1):
        base[k] = np.log(PRIOR / (totals(grams.where(F.col("size") == k))[0] + PRIOR * max(1, (sizes == k).sum())))
    gram_log = (np.searchsorted(code, np.arange(len(each) + 1)), lang[order], np.log((n.to_numpy()[order] + PRIOR) / PRIOR), base)
    docs = np.array([r.n for r in shares], float)
    return Model(langs, np.log(docs / docs.sum()), coded.dictionary, each, word_log, gram_log)


def _above(rows: np.ndarray, number: np.ndarray, log: tuple, out: np.ndarray, weight: float = 1.0) -> None:
    """Adds what the known words or n-grams ``number`` have above the base to ``rows`` of ``out``."""
    start, lang, above, _ = log
    sizes = start[number + 1] - start[number]
    pair = np.repeat(start[number] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    cell = np.repeat(rows, sizes) * out.shape[1] + lang[pair]
    out += np.bincount(cell, above[pair] * weight, out.size).reshape(out.shape)


def word_scores(words: pa.Array, model: Model) -> np.ndarray:
    """The log frequency of each of ``words`` in each language, 0 for those of which nothing is known."""
    out = np.zeros((len(words), len(model.langs)))
    place = pc.fill_null(pc.index_in(words, model.words), -1).to_numpy().astype(np.int64)
    rows = np.flatnonzero(place >= 0)
    _above(rows, place[rows], model.word_log, out)
    out[rows] += model.word_log[3]
    left = np.flatnonzero(place < 0)
    if len(left) and len(model.grams):
        part = np.zeros((len(left), len(model.langs)))
        open_ = np.ones(len(left), bool)
        for n, word, h in grams_of(words.take(pa.array(left))):
            at = np.minimum(np.searchsorted(model.grams, h), len(model.grams) - 1)
            found = open_[word] & (model.grams[at] == h)
            rows = word[found]
            _above(rows, at[found], model.gram_log, part, 1 / n)
            part += np.bincount(rows, minlength=len(left))[:, None] * (model.gram_log[3][n] / n)
            open_[rows] = False
        out[left] = part
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    langs = model.langs

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        words, code, of = words_of(texts)
        total = np.zeros((len(texts), len(langs)))
        some = max(1, CELLS // max(1, len(langs)))
        for at in range(0, len(words) if langs else 0, some):
            scores = word_scores(words.slice(at, some), model)
            here = (code >= at) & (code < at + some)
            for k in range(len(langs)):
                total[:, k] += np.bincount(of[here], scores[code[here] - at, k], len(texts))
        total += model.shares
        said = np.bincount(of, minlength=len(texts)) > 0
        if not langs:
            said[:] = False
        best = total.argmax(1) if langs else np.zeros(len(texts), int)
        odds = np.exp(total - total.max(1, keepdims=True)) if langs else np.ones((len(texts), 1))
        named = pa.array([langs[b] if s else UND for b, s in zip(best.tolist(), said.tolist())], pa.string())
        give_back()
        return pa.StructArray.from_arrays([named, pa.array(np.where(said, 1 / odds.sum(1), 0.0))], ["lang_pred", "score"])

    bound_batches(docs.sparkSession)
    # One projection for the model, one for its fields, so that each text is scored once.
    done = docs.select(packed(docs, "lang_pred", "score"), predict(docs["text"]).alias("found"))
    return done.select(*unpacked(done), "found.lang_pred", "found.score")


def held_out(doc_id: Column) -> Column:
    """Whether a document isn't learned from: by the CRC-32 of its id as text, a quarter of all; a null id as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")


QUERIES = {"op11_language": op11_language}
ORACLES: dict = {}
