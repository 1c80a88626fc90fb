"""Media columns: signatures, structure and lengths, corrected types, carved parts.

An Aho-Corasick automaton finds all magic bytes of a value in one pass. Each
find is only a claim; a validator of the format walks its structure and either
gives the exact length or rejects it. The format that holds at offset 0 is the
value's type, whatever was declared; formats that hold further in are embedded
media, which can be carved out by offset and length.

Defined results for odd input: a null value has no type and no embedded media.
An empty one has type ``application/x-empty``. A value without a valid format
at offset 0 keeps its declared type, else ``application/octet-stream``. Null ids
and repeated rows are kept as they are. A very long value is held in memory
whole, and signs that end formats are looked for once in it. Other columns are
kept, whatever their names, but for those that ``sniff`` adds, which are replaced.
An empty table gives an empty result.
"""

import bisect
import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweft.llm.common import bound_batches, packed, table, unpacked



class Marks:
    """Where some byte strings stand in a value, each looked for once however many claims ask for it."""

    def __init__(self, data: bytes):
        self.data, self.known = data, {}

    def of(self, sign: bytes) -> list[int]:
        if sign not in self.known:
            self.known[sign] = [m.start() for m in re.finditer(re.escape(sign), self.data)]
        return self.known[sign]

    def zip_ends(self) -> dict[int, int]:
        """End of each archive by where it starts, as its end record says."""
        if "zip" not in self.known:
            self.known["zip"] = found = {}
            for end in self.of(b"PK\x05\x06"):
                if end + 22 <= len(self.data):
                    size, offset, comment = struct.unpack_from("<IIH", self.data, end + 12)
                    first = end - size
                    if first >= offset and self.data[first : first + 4] in (b"PK\x01\x02", b"PK\x05\x06"):
                        found.setdefault(first - offset, min(len(self.data), end + 22 + comment))
        return self.known["zip"]


# --- validators: (data, offset, marks) -> length, or 0 if the structure doesn't hold ---


def _png(d, at, marks):
    p = at + 8
    while p + 12 <= len(d):
        n = int.from_bytes(d[p : p + 4], "big")
        kind = d[p + 4 : p + 8]
        if p + 12 + n > len(d) or zlib.crc32(d[p + 4 : p + 8 + n]) != int.from_bytes(d[p + 8 + n : p + 12 + n], "big"):
            return 0
        if p == at + 8 and kind != b"IHDR":
            return 0
        p += 12 + n
        if kind == b"IEND":
            return p - at
    return 0


def _jpeg(d, at, marks):
    p = at + 2
    while p + 4 <= len(d):
        if d[p] != 0xFF:
            return 0
        kind = d[p + 1]
        if kind == 0xFF:
            p += 1
            continue
        if kind == 0xD9:
            return p + 2 - at
        n = int.from_bytes(d[p + 2 : p + 4], "big")
        if n < 2 or kind < 0xC0:
            return 0
        p += 2 + n
        if kind == 0xDA:  # entropy-coded data up to the next marker that is no restart
            while True:
                p = d.find(b"\xff", p)
                if p < 0 or p + 1 >= len(d):
                    return 0
                if d[p + 1] == 0 or 0xD0 <= d[p + 1] <= 0xD7:
                    p += 2
                else:
                    break
    return p + 2 - at if d[p : p + 2] == b"\xff\xd9" else 0


def _gif(d, at, marks):
    if at + 13 > len(d):
        return 0
    p = at + 13 + (3 << ((d[at + 10] & 7) + 1) if d[at + 10] & 0x80 else 0)

    def blocks(p):
        while p < len(d) and d[p]:
            p += 1 + d[p]
        return p + 1

    while p < len(d):
        if d[p] == 0x3B:
            return p + 1 - at
        if d[p] == 0x21:
            p = blocks(p + 2)
        elif d[p] == 0x2C and p + 10 <= len(d):
            p = blocks(p + 11 + (3 << ((d[p + 9] & 7) + 1) if d[p + 9] & 0x80 else 0))
        else:
            return 0
    return 0


def _riff(d, at, marks):
    if at + 12 > len(d):
        return 0
    n = 8 + int.from_bytes(d[at + 4 : at + 8], "little")
    p, kinds = at + 12, []
    while p + 8 <= min(at + n, len(d)):
        kinds.append(bytes(d[p : p + 4]))
        size = int.from_bytes(d[p + 4 : p + 8], "little")
        p += 8 + size + size % 2
    if at + n > len(d) or p < at + n or p > at + n + 1:
        return 0
    need = {b"WAVE": {b"fmt ", b"data"}, b"AVI ": {b"LIST"}, b"WEBP": set()}.get(bytes(d[at + 8 : at + 12]))
    return n if need is not None and kinds and need <= set(kinds) else 0


def _gzip(d, at, marks):
    """All members that follow one another."""
    end = at
    while d[end : end + 3] == b"\x1f\x8b\x08" and end + 18 <= len(d):
        un, p = zlib.decompressobj(31), end
        try:
            while p < len(d) and not un.eof:
                un.decompress(d[p : p + 65536])
                p += 65536
        except zlib.error:
            break
        if not un.eof:
            break
        end = min(p, len(d)) - len(un.unused_data)
    return end - at


def _zip(d, at, marks):
    return marks.zip_ends().get(at, at) - at


_STARTXREF = re.compile(rb"startxref\s+([0-9]+)\s+\Z")


def _pdf(d, at, marks):
    """To the last end before the next header that a cross reference within leads to: updates and linearised files have several."""
    heads, ends = marks.of(b"%PDF-"), marks.of(b"%%EOF")
    k = bisect.bisect_right(heads, at)
    stop = heads[k] if k < len(heads) else len(d)
    for end in reversed(ends[bisect.bisect_left(ends, at) : bisect.bisect_left(ends, stop)]):
        found = _STARTXREF.search(d[max(at, end - 64) : end])
        if found and re.match(rb"xref|\s*[0-9]+\s+[0-9]+\s+obj", d[at + int(found[1]) : at + int(found[1]) + 40]):
            return end + 5 - at
    return 0


def _ogg(d, at, marks):
    p = at
    while d[p : p + 4] == b"OggS" and p + 27 <= len(d) and d[p + 4] == 0:
        k = d[p + 26]
        n = 27 + k + sum(d[p + 27 : p + 27 + k])
        if p + n > len(d):
            return 0
        last = d[p + 5] & 4
        p += n
        if last:
            return p - at
    return 0


def _midi(d, at, marks):
    if at + 14 > len(d) or int.from_bytes(d[at + 4 : at + 8], "big") != 6:
        return 0
    p = at + 14
    for _ in range(int.from_bytes(d[at + 10 : at + 12], "big")):
        if d[p : p + 4] != b"MTrk" or p + 8 > len(d):
            return 0
        p += 8 + int.from_bytes(d[p + 4 : p + 8], "big")
    return p - at if p <= len(d) else 0


def _bmff(d, at, marks):
    """Boxes of an ISO base media file; the signature stands 4 bytes in."""
    p, kinds = at, []
    while p + 8 <= len(d):
        n, head = int.from_bytes(d[p : p + 4], "big"), 8
        kind = bytes(d[p + 4 : p + 8])
        if n == 1:  # the size stands behind the type
            n, head = int.from_bytes(d[p + 8 : p + 16], "big"), 16
        elif n == 0:  # to the end
            n = len(d) - p
        if n < head or p + n > len(d) or not all(32 <= c < 127 for c in kind):
            break
        kinds.append(kind)
        p += n
    return p - at if kinds[:1] == [b"ftyp"] and len(kinds) > 1 else 0


def _crc_table(poly: int, bits: int) -> list[int]:
    """What a byte adds to a checksum of ``bits`` bits, highest bit first."""
    out = []
    for byte in range(256):
        x = byte << (bits - 8)
        for _ in range(8):
            x = (x << 1) ^ (poly if x >> (bits - 1) else 0)
            x &= (1 << bits) - 1
        out.append(x)
    return out


#: The polynomials of FLAC's header and frame checksums.
_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _flac_header(d, p):
    """``(bytes, samples)`` of the frame header at ``p``, None if there is none that its checksum confirms."""
    if p + 6 > len(d) or d[p] != 0xFF or d[p + 1] & 0xFE != 0xF8 or d[p + 3] & 1:
        return None
    block, rate, lead = d[p + 2] >> 4, d[p + 2] & 15, d[p + 4]
    ones = 8 - (~lead & 0xFF).bit_length()
    if not block or rate == 15 or d[p + 3] >> 4 > 10 or ones in (1, 8):
        return None
    q = p + 4 + max(1, ones)  # the frame's or sample's number, as in UTF-8
    extra = 1 if block == 6 else 2 if block == 7 else 0
    samples = int.from_bytes(d[q : q + extra], "big") + 1 if extra else 192 if block == 1 else 576 << (block - 2) if block < 6 else 256 << (block - 8)
    q += extra + (1 if rate == 12 else 2 if rate in (13, 14) else 0)
    crc = 0
    for byte in d[p:q]:
        crc = _CRC8[crc ^ byte]
    return (q + 1 - p, samples) if q < len(d) and d[q] == crc else None


def _flac_frames(d, p, total: int) -> int:
    """Where the frames that begin at ``p`` end, 0 if they don't. Over a frame with its checksum the checksum is 0."""
    done = 0
    while head := _flac_header(d, p):
        crc, end, n = 0, 0, p + head[0]
        for byte in d[p:n]:
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ byte]
        done += head[1]
        for e in range(n, len(d)):
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ d[e]]
            if not crc and e > n + 1:
                # By chance it is 0 within a frame, too; another frame follows but for the last.
                if total and done >= total:
                    return e + 1
                if _flac_header(d, e + 1):
                    end = e + 1
                    break
                end = end or e + 1
        if not end or total and not _flac_header(d, end):
            return 0
        p = end
    return p if done and not total else 0


def _flac(d, at, marks):
    p, first, total = at + 4, True, 0
    while p + 4 <= len(d):
        kind, n = d[p] & 0x7F, int.from_bytes(d[p + 1 : p + 4], "big")
        if first and (kind != 0 or n != 34):
            return 0
        if first:  # the number of samples; 0 if it wasn't known
            total = int.from_bytes(d[p + 17 : p + 22], "big") & (1 << 36) - 1
        last, first = d[p] & 0x80, False
        p += 4 + n
        if last:
            return max(0, _flac_frames(d, p, total) - at)
    return 0


def _bmp(d, at, marks):
    if at + 26 > len(d):
        return 0
    n, _, start, head = struct.unpack_from("<IIII", d, at + 2)
    return n if head in (12, 40, 52, 56, 108, 124) and 14 + head <= start <= n and at + n <= len(d) else 0


#: type: (magic bytes, where they stand in the format, validator). Fixed values of the formats.
FORMATS = {
    "image/png": ((b"\x89PNG\r\n\x1a\n",), 0, _png),
    "image/jpeg": ((b"\xff\xd8\xff",), 0, _jpeg),
    "image/gif": ((b"GIF87a", b"GIF89a"), 0, _gif),
    "riff": ((b"RIFF",), 0, _riff),
    "application/gzip": ((b"\x1f\x8b\x08",), 0, _gzip),
    "application/zip": ((b"PK\x03\x04",), 0, _zip),
    "application/pdf": ((b"%PDF-",), 0, _pdf),
    "application/ogg": ((b"OggS",), 0, _ogg),
    "audio/midi": ((b"MThd",), 0, _midi),
    "video/mp4": ((b"ftyp",), 4, _bmff),
    "audio/flac": ((b"fLaC",), 0, _flac),
    "image/bmp": ((b"BM",), 0, _bmp),
}
RIFF_TYPES = {b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo", b"WEBP": "image/webp"}


def automaton():
    """All magic bytes; keys are Latin-1 strings, one character a byte."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, (magics, back, check) in FORMATS.items():
        for magic in magics:
            found.add_word(magic.decode("latin-1"), (kind, back + len(magic) - 1, check))
    found.make_automaton()
    return found


def find_media(data: bytes, signatures) -> tuple[list[tuple[int, int, str]], int]:
    """``(offset, length, type)`` of all valid formats that lie in no other embedded one, and the number of magic bytes found.

    The format at offset 0 holds the others; they are looked for inside it too.
    """
    valid, claims, inside, marks = [], 0, 0, Marks(data)
    for end, (kind, back, check) in signatures.iter(data.decode("latin-1")):
        claims += 1
        at = end - back
        if at < 0 or (0 < at < inside):
            continue
        n = check(data, at, marks)
        if n:
            valid.append((at, n, RIFF_TYPES[bytes(data[at + 8 : at + 12])] if kind == "riff" else kind))
            if at:
                inside = at + n
    return sorted(valid), claims


_PART = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("content", pa.binary())])
_MEASURES = ("mean", "spread", "step")
_PAYLOAD = pa.struct([("bytes", pa.int64()), ("sha", pa.string()), ("tail", pa.int64()), *((m, pa.float64()) for m in _MEASURES), ("levels", pa.int64())])
_FOUND = pa.struct([("type", pa.string()), ("length", pa.int64()), ("hits", pa.int64()), ("embedded", pa.list_(_PART)), ("payload", _PAYLOAD)])
FOUND = (
    "struct<type: string, length: long, hits: long, embedded: array<struct<offset: long, length: long, type: string, content: binary>>,"
    " payload: struct<bytes: long, sha: string, tail: long, mean: double, spread: double, step: double, levels: long>>"
)


def _look(carve: bool, digest: bool):
    """A UDF that finds media in each value; with ``digest`` it also reads the samples of whole sound files."""

    @F.arrow_udf(FOUND)
    def look(values: pa.Array) -> pa.Array:
        signatures, rows = automaton(), []
        for v in values:
            data = v.as_py()
            if data is None:
                rows.append(None)
                continue
            valid, claims = find_media(data, signatures)
            length, kind = next(((n, kind) for at, n, kind in valid if at == 0), (None, None if data else "application/x-empty"))
            inner = [
                {"offset": at, "length": n, "type": kind, "content": data[at : at + n] if carve else None} for at, n, kind in valid if at
            ]
            whole = digest and kind == "audio/wav" and length == len(data)
            rows.append({"type": kind, "length": length, "hits": claims, "embedded": inner, "payload": digests(from_wav(data)) if whole else None})
        return pa.array(rows, _FOUND)

    return look


def sniff(df: DataFrame, content: str, declared: str | None = None, carve: bool = False, digest: bool = False) -> DataFrame:
    """``df`` with ``media_type``, ``media_length``, ``type_corrected``, ``magic_hits`` and ``embedded``.

    ``embedded`` lists ``(offset, length, type)``, with the bytes if ``carve``.
    ``payload`` has digests of the samples if ``digest`` and the value is a whole
    sound file.
    """
    bound_batches(df.sparkSession)
    said = F.col(declared) if declared else F.lit(None).cast("string")
    found = df.select(packed(df), said.alias("said"), _look(carve, digest)(F.col(content)).alias("found"))
    own = {
        "media_type": F.when(F.col("found").isNotNull(), F.coalesce("found.type", "said", F.lit("application/octet-stream"))),
        "media_length": F.col("found.length"),
        "type_corrected": F.col("found.type").isNotNull() & ~F.col("found.type").eqNullSafe(F.col("said")),
        "magic_hits": F.col("found.hits"),
        "embedded": F.col("found.embedded"),
    } | ({"payload": F.col("found.payload")} if digest else {})
    return found.select(*unpacked(found, *own), *(c.alias(name) for name, c in own.items()))


# --- payloads stored as 8-bit mono sound ---

PAD_TO = 192
RATE = 8000


def to_wav(payload: bytes) -> bytes:
    """A RIFF/WAVE file whose 8-bit samples are the payload's bytes (of an even number)."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(payload), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    p = 12
    while media[p : p + 4] != b"data":
        n = int.from_bytes(media[p + 4 : p + 8], "little")
        p += 8 + n + n % 2
    return media[p + 8 : p + 8 + int.from_bytes(media[p + 4 : p + 8], "little")]


def store_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media, declared)``: each text, padded with blanks to a positive multiple of 192 bytes, as a sound file.

    What is declared is not the stored form but plain text, as of a column whose types can't be trusted.
    """

    @F.arrow_udf("binary")
    def store(texts: pa.Array) -> pa.Array:
        data = (x.as_py() or b"" for x in texts)
        return pa.array([to_wav(x + b" " * (-len(x) % PAD_TO or (0 if x else PAD_TO))) for x in data], pa.binary())

    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").cast("long"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        store(text).alias("media"),
        F.lit("text/plain").alias("declared"),
    )


def digests(payload: bytes) -> dict:
    """Checksums and features of samples: their mean, deviation and mean step from one to the next, and the CRC-32 of their histogram."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    levels = np.arange(256)
    # From whole numbers, so that the sums are exact in whatever order.
    mean = int(counts @ levels) / len(x)
    square = int(counts @ (levels * levels)) / len(x)
    steps = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))
    return {
        "bytes": len(payload),
        "sha": hashlib.sha256(payload).hexdigest(),
        "tail": zlib.crc32(payload[-16:]),
        "mean": mean,
        "spread": max(0.0, square - mean * mean) ** 0.5,
        "step": steps / max(1, len(x) - 1),
        "levels": zlib.crc32(counts.astype("<i8").tobytes()),
    }


def read_payloads(media: DataFrame) -> DataFrame:
    """Digests of what the stored bytes hold, read back through the sniffed type; a value that is no whole sound file is an error."""
    broken = F.raise_error(F.lit("a stored value is no whole sound file"))
    read = sniff(media, "media", "declared", digest=True)
    return read.withColumn("payload", F.when(F.col("payload").isNotNull(), F.col("payload")).otherwise(broken))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_payloads(store_texts(table(spark, sf_dir, "documents")))
    kinds = F.array_join(F.transform("embedded", lambda e: F.concat_ws(":", e["type"], e["offset"], e["length"])), ",")
    feature = F.format_string(
        "type=%s;corrected=%s;hits=%d;embedded=%d;parts=%s;mean=%.6f;spread=%.6f;step=%.6f;levels=%08x",
        "media_type", "type_corrected", "magic_hits", F.size("embedded"), kinds, "payload.mean", "payload.spread", "payload.step", "payload.levels",
    )
    return read.select(
        "doc_id",
        "n_bytes",
        F.col("payload.bytes").alias("payload_bytes"),
        F.col("payload.sha").alias("payload_sha256"),
        F.col("payload.tail").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


QUERIES = {"op4_media": op4_media}
ORACLES: dict = {}
