import gzip
import hashlib
import io
import statistics
import struct
import time
import wave
import zipfile
import zlib

import numpy as np

from lexweft.llm.media import automaton, find_media, op4_media, read_payloads, sniff, store_texts, to_wav


def _png():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def _zip():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GIF = b"GIF89a\x01\0\x01\0\0\0\0" + b"\x2c\0\0\0\0\x01\0\x01\0\0\x02\x02\x44\x01\0" + b"\x3b"
JPEG = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x03\0\x01\xff\0\x02\xff\xd9"
MIDI = b"MThd\0\0\0\x06\0\0\0\x01\0\x60MTrk\0\0\0\x04\0\xff\x2f\0"
PDF = b"%PDF-1.4\nxref\n0 1\ntrailer\nstartxref\n9\n%%EOF"
UPDATED = PDF + b"\n5 0 obj\nmore\nxref\n0 1\ntrailer\nstartxref\n%d\n%%%%EOF" % len(PDF + b"\n5 0 obj\nmore\n")
MP4 = struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4sQ", 1, b"mdat", 24) + b"x" * 8


def test_formats_and_lengths():
    signs = automaton()
    for kind, data in {
        "image/png": _png(), "image/gif": GIF, "image/jpeg": JPEG, "audio/midi": MIDI, "application/pdf": PDF, "application/zip": _zip(),
        "application/gzip": gzip.compress(b"hello"), "audio/wav": to_wav(b"ab" * 10),
    }.items():
        assert find_media(data, signs)[0] == [(0, len(data), kind)], kind
        assert find_media(b"junk" + data + b"tail", signs)[0][0] == (4, len(data), kind), kind
        assert find_media(data[:-1], signs)[0] == [], kind
    for fake in (b"GIF89a is text", b"PK\x03\x04 no", b"RIFFabcdWAVE", b"%PDF- no end", b"\xff\xd8\xff", b"BM", b"MThd", b"OggS", b"fLaC"):
        assert find_media(fake, signs)[0] == []


def test_several_ends():
    signs = automaton()
    assert find_media(UPDATED, signs)[0] == [(0, len(UPDATED), "application/pdf")]
    assert find_media(PDF + b" and " + UPDATED + b" tail %%EOF", signs)[0] == [(0, len(PDF), "application/pdf"), (len(PDF) + 5, len(UPDATED), "application/pdf")]
    two = gzip.compress(b"hello") + gzip.compress(b"again")
    assert find_media(b"x" + two + b"tail", signs)[0] == [(1, len(two), "application/gzip")]
    assert find_media(MP4, signs)[0] == [(0, len(MP4), "video/mp4")] and find_media(b"junk" + MP4 + b"\0", signs)[0] == [(4, len(MP4), "video/mp4")]
    to_end = MP4[:16] + struct.pack(">I4s", 0, b"mdat") + b"y" * 100
    assert find_media(to_end, signs)[0] == [(0, len(to_end), "video/mp4")]


def test_claims_take_no_square_time():
    signs, began = automaton(), time.time()
    assert find_media(b"%PDF-" * 200_000 + b"PK\x03\x04" * 200_000, signs) == ([], 400_000)
    assert time.time() - began < 20


def test_names_that_clash(spark):
    df = spark.createDataFrame([(None, GIF, "a/b", "x", 1, "p")], "doc_id long, content binary, media_type string, found string, row int, said string")
    out = sniff(df, "content", "media_type")
    r = out.first()
    assert sorted(out.columns) == sorted([*df.columns, "media_length", "type_corrected", "magic_hits", "embedded"])
    assert (r.media_type, r.type_corrected, r.found, r["row"], r.said, r.doc_id) == ("image/gif", True, "x", 1, "p", None)


def test_whole_rows_of_the_query(spark, tmp_path):
    rows = [(1, "text"), (None, None), (3, "a " * 4000), (4, "see GIF89a"), (4, "see GIF89a"), (5, "é"), (6, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for doc_id, text in rows:
        data = (text or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, 8000, 0, "NONE", ""))
            w.writeframes(payload)
        media = out.getvalue()
        feature = f"type=audio/wav;corrected=true;hits={1 + data.count(b'GIF89a')};embedded=0;parts=;mean={sum(payload) / len(payload):.6f}"
        steps = [abs(x - y) for x, y in zip(payload, payload[1:])]
        histogram = b"".join(payload.count(bytes([k])).to_bytes(8, "little") for k in range(256))
        feature += f";spread={statistics.pstdev(payload):.6f};step={sum(steps) / len(steps):.6f};levels={zlib.crc32(histogram):08x}"
        want.append((doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    got = [tuple(r[c] for c in names) for r in op4_media(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_sniff_corrects_and_carves(spark):
    wav = to_wav(b"xx" + _png() + b"y" * (len(_png()) % 2))
    rows = [(1, _png(), "image/jpeg"), (2, wav, "audio/wav"), (3, b"text", "text/plain"), (4, None, "a/b"), (5, b"", None), (6, b"zz" + GIF, None)]
    df = spark.createDataFrame(rows, "doc_id long, content binary, declared string")
    got = {r.doc_id: r for r in sniff(df, "content", "declared", carve=True).collect()}
    assert (got[1].media_type, got[1].type_corrected, got[1].media_length) == ("image/png", True, len(_png()))
    assert (got[2].media_type, got[2].type_corrected) == ("audio/wav", False)
    assert [(e.offset, e.type, bytes(e.content)) for e in got[2].embedded] == [(46, "image/png", _png())]
    assert (got[3].media_type, got[4].media_type, got[5].media_type, got[6].media_type) == ("text/plain", None, "application/x-empty", "application/octet-stream")
    assert [e.type for e in got[6].embedded] == ["image/gif"] and got[4].embedded is None


def test_texts_round_trip(spark):
    texts = [None, "", "a", "x" * 192, "é" * 96 + "b", "GIF89a", "long " * 50000, "same", "same"]
    df = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    rows = {r.doc_id: r for r in read_payloads(store_texts(df)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + b" " * (-len(data) % 192 if data else 192)
        r = rows[i]
        assert (r.n_bytes, r.payload.bytes, r.payload.sha) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.payload.tail == zlib.crc32(padded[-16:]) and r.media_type == "audio/wav" and r.type_corrected
        with wave.open(io.BytesIO(r.media)) as w:
            assert w.readframes(w.getnframes()) == padded and w.getsampwidth() == 1
    assert read_payloads(store_texts(df.limit(0))).count() == 0


def _flac(samples, total=True, block=64):
    """A FLAC stream of 8-bit mono samples, verbatim."""
    from lexweft.llm.media import _CRC8, _CRC16

    def crc(data, table, bits):
        x = 0
        for b in data:
            x = ((x << 8) & ((1 << bits) - 1)) ^ table[(x >> (bits - 8)) ^ b]
        return x.to_bytes(bits // 8, "big")

    info = struct.pack(">HH", block, block) + bytes(6) + ((8000 << 44) | (7 << 36) | (len(samples) if total else 0)).to_bytes(8, "big") + bytes(16)
    out = b"fLaC" + b"\x80" + (34).to_bytes(3, "big") + info
    for no, at in enumerate(range(0, len(samples), block)):
        part = samples[at : at + block]
        number = bytes([no]) if no < 128 else bytes([0xC0 | no >> 6, 0x80 | no & 63])
        head = b"\xff\xf8\x64\x02" + number + bytes([len(part) - 1])
        frame = head + crc(head, _CRC8, 8) + b"\x02" + part
        out += frame + crc(frame, _CRC16, 16)
    return out


def test_flac_ends_where_its_frames_do():
    signs = automaton()
    noise = bytes(np.random.default_rng(4).integers(0, 256, 64 * 150 + 9, np.uint8))
    png = _png()
    for total in (True, False):
        flac = _flac(noise, total)
        found = find_media(b"text " + flac + b"tail" + png, signs)[0]
        assert found == [(5, len(flac), "audio/flac"), (5 + len(flac) + 4, len(png), "image/png")]
        assert find_media(flac, signs)[0] == [(0, len(flac), "audio/flac")]
    assert find_media(_flac(noise)[:-1], signs)[0] == [] and find_media(_flac(noise)[:40], signs)[0] == []
    broken = bytearray(_flac(noise))
    broken[60] ^= 1
    assert find_media(bytes(broken), signs)[0] == []


def test_features_tell_texts_apart():
    from lexweft.llm.media import digests

    a, b, c = (digests(x) for x in (b"abcabc" * 32, b"aabbcc" * 32, b"abdabd" * 32))
    assert a["levels"] == b["levels"] != c["levels"] and a["step"] != b["step"] and a["mean"] == b["mean"]
    assert abs(a["spread"] - np.std(np.frombuffer(b"abcabc" * 32, np.uint8))) < 1e-9 and a == digests(b"abcabc" * 32)
