"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text above ``huge_chars`` is never encoded as a whole. It is cut into
overlapping chunks that are encoded with offsets, and neighbours are spliced at
a boundary that both prove stable:

* both chunks start a pre-token there, so what the right one yields from there
  on doesn't depend on where it began, and what the left one yields up to there
  doesn't depend on where it ended;
* it lies at least ``MARGIN`` code points inside both, so no special string
  that spans it is seen by one of them only;
* the character is ASCII, or follows a blank, so Unicode composition doesn't
  reach across it.

The ids that both have behind the boundary must agree as well. Where no such
boundary exists, or ids disagree, the overlap is doubled backwards, in the end
to the whole of the left chunk; a text without any boundary thus ends up
encoded as one, which is right if slow.

Shorter texts go through ``PieceEncoder``. Everything happens where a text
lies: no shuffle. Null texts count as empty, with zero tokens. Columns other
than ``doc_id`` and ``text`` are ignored; repeated rows stay repeated; an empty
table gives an empty result.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweft.llm.common import bound_batches, give_back, table
from lexweft.llm.pieces import byte_slices, shared_encoder

MARGIN = 32


class Chunk:
    """Tokens of text[begin:end] with their starts in the whole text."""

    def __init__(self, tokenizer, text, begin, end):
        self.begin, self.end = begin, end
        encoding = tokenizer.encode(text[begin:end], add_special_tokens=False)
        self.ids, self.words = np.array(encoding.ids, np.uint32), encoding.word_ids
        self.starts = np.fromiter((a for a, _ in encoding.offsets), np.int64, len(self.ids)) + begin

    def span(self, low, high):
        """Starts and ids of the tokens that start in [low, high)."""
        i, j = np.searchsorted(self.starts, (low, high))
        return self.starts[i:j], self.ids[i:j]

    def boundaries(self, low, high):
        """Starts of pre-tokens in [low, high]."""
        i, j = np.searchsorted(self.starts, (low, high + 1)).tolist()
        return {int(self.starts[k]) for k in range(i, j) if not k or self.words[k] != self.words[k - 1]}


def _splice(text, left, right):
    """The first proven common boundary of two neighbouring chunks, None if there is none."""
    low, high = right.begin + MARGIN, left.end - MARGIN
    for p in sorted(left.boundaries(low, high) & right.boundaries(low, high)):
        if (text[p] < "\x80" or text[p - 1].isspace()) and all(map(np.array_equal, left.span(p, high), right.span(p, high))):
            return p
    return None


def resynchronised_ids(tokenizer, text: str, chunk_chars: int = 8192, overlap_chars: int = 256) -> np.ndarray:
    """Ids of ``text`` from overlapping chunks, equal to those of the whole text encoded at once."""
    out = []
    n, kept_from = len(text), 0
    left = Chunk(tokenizer, text, 0, min(n, chunk_chars))
    while left.end < n:
        overlap, end = overlap_chars, min(n, left.end + chunk_chars)
        while True:
            begin = max(kept_from, left.end - overlap)
            right = Chunk(tokenizer, text, begin, end)
            if begin == kept_from:  # as wide as can be: it replaces the left chunk
                left = right
                break
            p = _splice(text, left, right)
            if p is not None and p > kept_from:
                out.append(left.span(kept_from, p)[1])
                left, kept_from = right, p
                break
            overlap *= 2
    return np.concatenate([*out, left.span(kept_from, n + 1)[1]])


def count_tokens(
    docs: DataFrame, tokenizer_path: str, huge_chars: int = 8192, chunk_chars: int = 8192, overlap_chars: int = 256
) -> DataFrame:
    """``(doc_id, n_tokens, n_bytes)`` for each row of ``docs``; the tokenizer must drop white space."""

    def run(batches):
        coder = shared_encoder(tokenizer_path, False)
        for batch in batches:
            for some in byte_slices(batch, 1):
                texts = some.column(1)
                huge = pc.greater(pc.utf8_length(texts), huge_chars)
                counts = coder.counts(pc.if_else(huge, "", texts))
                at = pc.indices_nonzero(huge)
                for i, t in zip(at.to_pylist(), texts.take(at).to_pylist()):
                    counts[i] = len(resynchronised_ids(coder.tokenizer, t, chunk_chars, overlap_chars))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(counts, pa.int64()), some.column(2)], names=["doc_id", "n_tokens", "n_bytes"])
        give_back()

    bound_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return own.mapInArrow(run, "doc_id long, n_tokens long, n_bytes long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLES: dict = {}
