"""Exact tokenisation by cached pieces.

A tokenizer of the ``tokenizers`` library works on pre-tokens, so a text may be
cut wherever a pre-token is bound to start, and the pieces encoded on their
own. Natural text repeats its words: the distinct pieces of some megabytes of
text are told apart by Arrow's dictionary encoding, only those are looked up in
a cache, and the ids of all pieces are gathered by number. Each piece is
encoded by the library itself, with its default handling of special strings.

The cache is a hash table in arrays of fixed size, keyed by 128 bits of a
piece's bytes (two multilinear hashes with random weights for each place, where
two pieces agree by chance once in 2^114), so it holds a million pieces in 64 MB
and is asked for all pieces of a slice at once.

``spaced``: the pre-tokenizer drops white space (word_bpe): any blank between
two pieces is a cut. ``leading``: white space is part of the pre-tokens, one
blank leads the word behind it (byte_bpe): a cut is before a blank, or a line
feed, that stands alone between characters that are no white space.
"""

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Where white space meets white space (or an end) in a way that a cut could change.
_UNSAFE = re.compile(r"\s\s|^\s|\s\Z")
#: The same in RE2, and any white space but for the blank and the line feed.
_MAYBE_UNSAFE = r"[ \n][ \n]|\A[ \n]|[ \n]\z|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Pieces that are encoded as one text, their ids told apart by the blank that leads each.
JOINED = 64
#: Bytes of text whose pieces are told apart at a time; a longer text is alone.
AT_ONCE = 4 << 20
#: Bytes of the longest piece that is cached, and slots of the cache; about 30 bytes each.
LONGEST = 64
SLOTS = 1 << 21

_WEIGHTS = np.random.default_rng(7).integers(0, 1 << 64, (2, LONGEST + 1), np.uint64) | np.uint64(1)


def unsafe(texts: pa.Array) -> dict[int, str]:
    """Texts with white space that stands beside white space or an end, by position.

    One pass of RE2 names texts that may be so, by these or by rare white space; Python's meaning of it decides.
    """
    maybe = pc.indices_nonzero(pc.match_substring_regex(texts, _MAYBE_UNSAFE))
    found = zip(maybe.to_pylist(), texts.take(maybe).to_pylist())
    return {i: t for i, t in found if _UNSAFE.search(t)}


def byte_slices(batch: pa.RecordBatch, column: int, most: int = AT_ONCE):
    """Runs of rows of ``batch`` whose strings in ``column`` take ``most`` bytes, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, stop - at)
        at, before = stop, int(ends[stop - 1])


def piece_hashes(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each of ``pieces`` (strings without nulls), and whether it is short enough to have them."""
    _, offsets, data = pieces.buffers()
    ends = np.frombuffer(offsets, np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
    size = np.diff(ends)
    short = size <= LONGEST
    # A piece's length counts as a byte of its own, so no piece is empty and none is the other's start.
    kept = np.where(short, size, 0)
    n = kept + 1
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum()), dtype=np.int32) - np.repeat(first, n).astype(np.int32)
    # The data is read one place on at the end of each piece; that place then takes the length.
    raw = np.append(np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), np.uint8(0))
    byte = raw[np.minimum(place + np.repeat(ends[:-1], n), len(raw) - 1)].astype(np.uint64) + np.uint64(1)
    byte[first + kept] = kept.astype(np.uint64) + np.uint64(300)
    return *(np.add.reduceat(byte * w[place], first) if len(first) else np.zeros(0, np.uint64) for w in _WEIGHTS), short


class PieceTable:
    """Ids of pieces by their hashes, at most three pieces to five slots and eight ids to a piece on average."""

    def __init__(self, slots: int = SLOTS):
        self.mask, self.most = np.uint64(slots - 1), slots * 3 // 5
        self.keys = np.zeros((2, slots), np.uint64)
        self.entry = np.zeros(slots, np.int32)  # 0: empty
        self.start, self.size = np.zeros(self.most + 1, np.int32), np.zeros(self.most + 1, np.uint8)
        self.pool = np.zeros(8 * self.most, np.uint16)
        self.n, self.used = 0, 0

    def clear(self):
        self.entry[:] = 0
        self.n = self.used = 0

    @staticmethod
    def _first_slot(h):
        return (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)

    def find(self, h1, h2):
        """Entry of each key, 0 where there is none."""
        out, left, slot = np.zeros(len(h1), np.int32), np.arange(len(h1)), self._first_slot(h1) & self.mask
        while len(left):
            e = self.entry[slot]
            met = (e > 0) & (self.keys[0][slot] == h1[left]) & (self.keys[1][slot] == h2[left])
            out[left[met]] = e[met]
            on = (e > 0) & ~met
            left, slot = left[on], (slot[on] + np.uint64(1)) & self.mask
        return out

    def add(self, h1, h2, ids: list[bytes]) -> None:
        """Puts distinct absent keys in, as many as there is room for."""
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        ends = self.used + np.cumsum(size)
        k = min(self.most - self.n, int(np.searchsorted(ends, len(self.pool), "right")))
        fits = np.flatnonzero(size[:k] < 256)
        if not len(fits):
            return
        self.pool[self.used : ends[k - 1]] = np.frombuffer(b"".join(ids[:k]), np.uint16)
        entry = np.arange(self.n + 1, self.n + 1 + len(fits), dtype=np.int32)
        self.start[entry], self.size[entry] = (ends - size)[fits], size[fits]
        self.n, self.used = self.n + len(fits), int(ends[k - 1])
        h1, h2 = h1[fits], h2[fits]
        slot = self._first_slot(h1) & self.mask
        left = np.arange(len(fits))
        while len(left):
            free = self.entry[slot] == 0
            at, who = slot[free], left[free]
            self.entry[at] = entry[who]
            won = self.entry[at] == entry[who]
            self.keys[0][at[won]], self.keys[1][at[won]] = h1[who[won]], h2[who[won]]
            on = np.ones(len(left), bool)
            on[np.flatnonzero(free)[won]] = False
            left, slot = left[on], (slot[on] + np.uint64(1)) & self.mask


class PieceEncoder:
    """``encode(texts)`` gives the token ids of all texts, one after another, and how many each has.

    Frequent pieces come early, so a full cache keeps what it has; it starts
    anew when more than a share ``stale`` of a call's distinct pieces miss it.
    """

    def __init__(self, path, leading, slots=SLOTS, stale=0.9):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must be below 65,536")
        self.leading, self.stale = leading, stale
        self.table = PieceTable(slots)
        self.added = None
        if leading:
            self.led = np.zeros(1 << 16, bool)
            self.led[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _told_apart(self, keys: list[str]) -> list[bytes]:
        """Ids of pieces that are encoded as one text with blanks between, told apart by where tokens start."""
        encoding = self.tokenizer.encode(" ".join(keys), add_special_tokens=False)
        n = np.fromiter(map(len, keys), np.int64, len(keys)) + 1
        starts = np.fromiter((a for a, _ in encoding.offsets), np.int64)
        ends = (2 * np.searchsorted(starts, np.cumsum(n))).tolist()
        data = np.array(encoding.ids, "<u2").tobytes()
        return [data[a:z] for a, z in zip([0, *ends[:-1]], ends)]

    def _fresh(self, keys: list[str]) -> list[bytes]:
        """Ids of pieces by their keys; where blanks count, a key is what follows a blank, or starts with a line feed."""
        if not self.leading:
            return [ids for at in range(0, len(keys), JOINED) for ids in self._told_apart(keys[at : at + JOINED])]
        out = [b""] * len(keys)
        lines = [i for i, k in enumerate(keys) if k[:1] == "\n"]
        for i, v in zip(lines, self._whole([keys[i] for i in lines])):
            out[i] = v
        words = [i for i, k in enumerate(keys) if k[:1] != "\n"]
        groups = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        texts = ["".join([" " + keys[i] for i in g]) for g in groups]
        for g, data in zip(groups, self._whole(texts)):
            ids = np.frombuffer(data, "<u2")
            at = np.flatnonzero(self.led[ids]).tolist()
            if len(at) == len(g):
                for i, a, z in zip(g, at, [*at[1:], len(ids)]):
                    out[i] = data[2 * a : 2 * z]
            else:
                for i, v in zip(g, self._whole([" " + keys[i] for i in g])):
                    out[i] = v
        return out

    def _looked_up(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Entries of distinct pieces in the cache, 0 for those that were not there; which those are, and their ids."""
        h1, h2, short = piece_hashes(keys)
        entry = self.table.find(h1, h2) * short
        lacking = np.flatnonzero(entry == 0)
        fresh = self._fresh(keys.take(pa.array(lacking)).to_pylist())
        if self.table.n >= self.table.most and len(lacking) > self.stale * len(keys):
            self.table.clear()
            entry, lacking = np.zeros(len(keys), np.int32), np.arange(len(keys))
            fresh = self._fresh(keys.to_pylist())
        some = np.flatnonzero(short[lacking])
        self.added = h1[lacking[some]], h2[lacking[some]], [fresh[i] for i in some.tolist()]
        return entry, lacking, fresh

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, dict[int, str]]:
        """Keys of all pieces, their number per text, and the texts that must be encoded whole (one piece each)."""
        if not self.leading:
            lists, whole = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " "), {}
        else:
            whole = unsafe(texts)
            if whole:
                odd = np.zeros(len(texts), bool)
                odd[list(whole)] = True
                texts = pc.if_else(pa.array(odd), "", texts)
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), whole

    def _numbered(self, texts: pa.Array):
        """Number of the value of each piece; start and size of each value in a pool of ids; the pool; pieces per text."""
        keys, n, whole = self._cut(texts)
        coded = keys.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        known = len(coded.dictionary)
        heads = []
        if self.leading:
            # The first piece of a text has no blank before it, so it isn't looked up where blanks count.
            first = np.cumsum(n) - n
            heads = self._whole([whole.get(i, k) for i, k in enumerate(keys.take(pa.array(first)).to_pylist())])
            code[first] = known + np.arange(len(first), dtype=np.int32)
        table = self.table
        entry, lacking, fresh = self._looked_up(coded.dictionary)
        start, size = np.zeros(known + len(heads), np.int64), np.zeros(known + len(heads), np.int64)
        start[:known], size[:known] = table.start[entry], table.size[entry]
        # Ids from outside the cache stand behind its pool.
        own = fresh + heads
        where = np.concatenate([lacking, np.arange(known, known + len(heads))])
        size[where] = np.fromiter(map(len, own), np.int64, len(own)) // 2
        start[where] = table.used + np.cumsum(size[where]) - size[where]
        pool = np.concatenate([table.pool[: table.used], np.frombuffer(b"".join(own), np.uint16)])
        return code, start, size, pool, n

    def _remember(self):
        """Puts what was not there into the cache, once the pool of the call is made."""
        self.table.add(*self.added)
        self.added = None

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (u16) of ``texts`` (strings without nulls) and the number of ids of each."""
        if not len(texts):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        code, start, size, pool, pieces = self._numbered(texts)
        self._remember()
        n = size[code]
        ends = np.cumsum(n)
        ids = pool[np.arange(ends[-1]) - np.repeat(ends - n - start[code], n)]
        of_text = ends[np.cumsum(pieces) - 1]
        return ids, np.diff(of_text, prepend=0)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each of ``texts``."""
        if not len(texts):
            return np.zeros(0, np.int64)
        code, _, size, _, pieces = self._numbered(texts)
        self._remember()
        return np.add.reduceat(size[code], np.cumsum(pieces) - pieces)


_ENCODERS: dict = {}


def shared_encoder(path: str, leading: bool) -> PieceEncoder:
    """One encoder for a Python worker's life, so its cache serves all tasks the worker runs; the last one only."""
    key = (path, leading)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(path, leading)
    return _ENCODERS[key]


def forget() -> None:
    """Drops this worker's encoder; for tasks that need none."""
    _ENCODERS.clear()
