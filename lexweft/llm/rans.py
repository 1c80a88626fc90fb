"""Static range asymmetric numeral system (rANS) over 16-bit token ids, in numpy.

A segment holds whole documents. All its blocks share one frequency table; each
block is coded on its own, by interleaved lanes whose states and words are the
block's checkpoint. Any block decodes from its checkpoint alone, so blocks can
be read in parallel, and each carries a CRC of its ids.

Segment (all integers little-endian)::

    magic "LXRS", version u8, lanes u16, block_ids u32, n_ids u64, n_docs u32,
    n_blocks u32, table_bytes u32, docs_bytes u32
    table: zlib of (symbols u16[], frequencies u32[]), preceded by their count u32
    docs:  zlib of (doc_ids i64[], is_null u8[], lengths i64[])
    checkpoints, one per block: ids in the block u32, words u32, first word u64,
                                crc32 of the ids u32
    states: u64[n_blocks][lanes]
    words:  u32[]

States lie in [2^31, 2^63); frequencies sum to 2^18, which leaves room for each
of 65,536 symbols.
"""

import struct
import zlib

import numpy as np

BITS = 18
TOTAL = 1 << BITS
LOW = np.uint64(1 << 31)
LANES = 256
BLOCK_IDS = 1 << 16
_HEAD = struct.Struct("<4sBHIQIIII")
_CHECK = np.dtype([("ids", "<u4"), ("words", "<u4"), ("at", "<u8"), ("crc", "<u4")])


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and frequencies that sum to TOTAL, each at least 1."""
    counts = np.bincount(ids, minlength=1)
    symbols = np.flatnonzero(counts)
    share = counts[symbols] * (TOTAL / counts.sum())
    freqs = np.maximum(1, np.floor(share)).astype(np.int64)
    over = int(freqs.sum() - TOTAL)
    order = np.argsort(-freqs, kind="stable")
    if over < 0:
        freqs[order[0]] -= over
    while over > 0:  # takes from the most frequent, which lose least by it
        room = np.minimum(freqs[order] - 1, np.maximum(1, freqs[order] // 64))
        room[np.cumsum(room) - room >= over] = 0
        last = np.flatnonzero(room)[-1]
        room[last] -= max(0, int(room.sum()) - over)
        freqs[order] -= room
        over -= int(room.sum())
    return symbols.astype(np.uint16), freqs.astype(np.uint32)


def encode_segment(ids: np.ndarray, doc_ids: list, lengths: np.ndarray, lanes: int = LANES, block_ids: int = BLOCK_IDS) -> bytes:
    """One segment for ``ids`` (uint16), the documents' ids (None: null) and their numbers of ids."""
    n = len(ids)
    blocks = -(-n // block_ids)
    symbols, freqs = frequencies(ids) if n else (np.zeros(0, np.uint16), np.zeros(0, np.uint32))
    starts = np.concatenate([[0], np.cumsum(freqs, dtype=np.uint64)[:-1]]) if n else np.zeros(0)
    of_freq, of_start = np.ones(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
    of_freq[symbols], of_start[symbols] = freqs, starts
    steps = block_ids // lanes
    padded = np.zeros(blocks * block_ids, np.uint16)
    padded[:n] = ids
    grid = padded.reshape(blocks, steps, lanes)
    used = (np.arange(blocks * block_ids) < n).reshape(blocks, steps, lanes)
    state = np.full((blocks, lanes), LOW, np.uint64)
    out, emitted = [], []
    for t in range(steps - 1, -1, -1) if n else ():
        s, on = grid[:, t], used[:, t]
        f = of_freq[s]
        spill = on & (state >= f << np.uint64(63 - BITS))
        out.append(state[:, ::-1][spill[:, ::-1]].astype(np.uint32))
        emitted.append(spill.sum(1))
        state = np.where(spill, state >> np.uint64(32), state)
        q = state // f
        # q * TOTAL + (state - q * f), with one division
        state = np.where(on, q * (np.uint64(TOTAL) - f) + state + of_start[s], state)
    words = np.concatenate(out) if out else np.zeros(0, np.uint32)
    per = np.array(emitted, np.int64).reshape(len(emitted), blocks)
    # Steps came out back to front, blocks within a step; a block's words must stand together in reading order.
    block_of = np.concatenate([np.repeat(np.arange(blocks), row) for row in per]) if len(per) else np.zeros(0, np.int64)
    words = words[::-1][np.argsort(block_of[::-1], kind="stable")]
    check = np.zeros(blocks, _CHECK)
    check["ids"] = np.minimum(block_ids, n - np.arange(blocks) * block_ids)
    check["words"] = per.sum(0)
    check["at"] = np.cumsum(check["words"], dtype=np.uint64) - check["words"]
    check["crc"] = [zlib.crc32(ids[i * block_ids : (i + 1) * block_ids].tobytes()) for i in range(blocks)]
    table = zlib.compress(struct.pack("<I", len(symbols)) + symbols.astype("<u2").tobytes() + freqs.astype("<u4").tobytes(), 1)
    null = np.array([d is None for d in doc_ids], np.uint8)
    docs = zlib.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + null.tobytes() + np.asarray(lengths, "<i8").tobytes(), 1)
    head = _HEAD.pack(b"LXRS", 1, lanes, block_ids, n, len(doc_ids), blocks, len(table), len(docs))
    return b"".join([head, table, docs, check.tobytes(), state.astype("<u8").tobytes(), words.astype("<u4").tobytes()])


class Segment:
    """Reads a segment: ``doc_ids``, ``lengths`` and ``ids(first_block, last_block)``."""

    def __init__(self, data: bytes):
        magic, version, self.lanes, self.block_ids, self.n_ids, n_docs, self.n_blocks, table, docs = _HEAD.unpack_from(data)
        if magic != b"LXRS" or version != 1:
            raise ValueError("not a token segment")
        at = _HEAD.size
        raw = zlib.decompress(data[at : at + table])
        (k,) = struct.unpack_from("<I", raw)
        self.symbols, self.freqs = np.frombuffer(raw, "<u2", k, 4), np.frombuffer(raw, "<u4", k, 4 + 2 * k)
        raw = zlib.decompress(data[at + table : at + table + docs])
        ids, null = np.frombuffer(raw, "<i8", n_docs), np.frombuffer(raw, "u1", n_docs, 8 * n_docs)
        self.doc_ids = [None if x else int(d) for d, x in zip(ids, null)]
        self.lengths = np.frombuffer(raw, "<i8", n_docs, 9 * n_docs)
        at += table + docs
        self.check = np.frombuffer(data, _CHECK, self.n_blocks, at)
        at += self.check.nbytes
        self.states = np.frombuffer(data, "<u8", self.n_blocks * self.lanes, at).reshape(self.n_blocks, self.lanes)
        self.words = np.frombuffer(data, "<u4", offset=at + self.states.nbytes)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of blocks ``first`` to ``last`` (exclusive; the end if None), their checksums verified."""
        check = self.check[first:last]
        if not len(check):
            return np.zeros(0, np.uint16)
        slot_of = np.repeat(self.symbols, self.freqs)
        starts = np.zeros(1 << 16, np.uint64)
        freqs = np.zeros(1 << 16, np.uint64)
        starts[self.symbols] = np.cumsum(self.freqs, dtype=np.uint64) - self.freqs
        freqs[self.symbols] = self.freqs
        steps = self.block_ids // self.lanes
        state = self.states[first:last].copy()
        words = np.append(self.words, np.zeros(self.lanes, np.uint32))
        next_word = check["at"].astype(np.int64)
        left = check["ids"].astype(np.int64)[:, None] - np.arange(self.lanes)[None, :]
        out = np.zeros((len(check), steps, self.lanes), np.uint16)
        low = np.uint64(TOTAL - 1)
        for t in range(steps):
            on = left > t * self.lanes
            slot = state & low
            s = slot_of[slot]
            state = np.where(on, freqs[s] * (state >> np.uint64(BITS)) + slot - starts[s], state)
            pull = on & (state < LOW)
            order = np.cumsum(pull, axis=1)
            at = next_word[:, None] + order - 1
            state = np.where(pull, (state << np.uint64(32)) | words[np.where(pull, at, 0)], state)
            next_word += order[:, -1]
            out[:, t] = s
        flat = out.reshape(len(check), -1)
        parts = [flat[i, : check["ids"][i]] for i in range(len(check))]
        for part, crc in zip(parts, check["crc"]):
            if zlib.crc32(part.tobytes()) != crc:
                raise ValueError("a block's checksum doesn't hold")
        return np.concatenate(parts)
