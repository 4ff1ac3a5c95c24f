"""Media columns: types by signature, confirmed by the formats' structure.

An Aho-Corasick automaton finds all magic bytes of all formats in one pass. A hit counts only
where the format's own headers and lengths hold. The declared type of a column's value is
corrected to what its bytes are, and media that lie within other bytes are carved out.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.common import materialize

#: Payloads are padded with blanks to a positive multiple of this.
UNIT = 192
RATE = 8000
#: Bytes that a compressed member may take in or give out at once.
STEP = 1 << 16


@dataclass(frozen=True)
class Found:
    kind: str
    start: int
    end: int


@lru_cache(maxsize=4)
def _places(b: bytes, mark: bytes) -> np.ndarray:
    """Where ``mark`` stands in ``b``: found once, not again for each start that looks for its end."""
    return np.fromiter((m.start() for m in re.finditer(re.escape(mark), b)), np.int64)


def _next(b: bytes, mark: bytes, at: int) -> int:
    """The first place of ``mark`` from ``at`` on, or -1."""
    found = _places(b, mark)
    i = bisect_left(found, at)
    return int(found[i]) if i < len(found) else -1


def _riff(b: bytes, at: int, form: bytes, firsts: tuple[bytes, ...]) -> int | None:
    """RIFF of another form than WAVE: chunks that fill its size, the first one of ``firsts``."""
    if len(b) - at < 20 or b[at + 8 : at + 12] != form or b[at + 12 : at + 16] not in firsts:
        return None
    end, i = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12
    while i + 8 <= end <= len(b):
        size = struct.unpack_from("<I", b, i + 4)[0]
        i += 8 + size + size % 2
    return end if i == end <= len(b) else None


def _webp(b: bytes, at: int) -> int | None:
    return _riff(b, at, b"WEBP", (b"VP8 ", b"VP8L", b"VP8X"))


def _avi(b: bytes, at: int) -> int | None:
    return _riff(b, at, b"AVI ", (b"LIST",)) if b[at + 20 : at + 24] == b"hdrl" else None


def _ogg(b: bytes, at: int) -> int | None:
    """Pages from one that begins a stream to the one that ends it."""
    i, serial = at, None
    while i + 27 <= len(b) and b[i : i + 5] == b"OggS\0":
        flags, own = b[i + 5], b[i + 14 : i + 18]
        if (serial is None) != bool(flags & 2) or serial not in (None, own):
            return None
        serial = own
        i += 27 + b[i + 26] + sum(b[i + 27 : i + 27 + b[i + 26]])
        if flags & 4:
            return i if i <= len(b) else None
    return None


def _mp4(b: bytes, at: int) -> int | None:
    """Boxes of known types, moov among them."""
    i, seen = at, set()
    while i + 8 <= len(b) and b[i + 4 : i + 8] in BOXES:
        size, head = struct.unpack_from(">I", b, i)[0], 8
        if size == 1 and i + 16 <= len(b):
            size, head = struct.unpack_from(">Q", b, i + 8)[0], 16
        if size < head or i + size > len(b) or (b[i + 4 : i + 8] == b"ftyp" and seen):
            break
        seen.add(b[i + 4 : i + 8])
        i += size
    return i if b"moov" in seen else None


def _wav(b: bytes, at: int) -> int | None:
    """RIFF: size field, WAVE, and chunks that fill it, with fmt before data."""
    if len(b) - at < 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    i, format_seen, data_seen = at + 12, False, False
    if end > len(b):
        return None
    while i + 8 <= end:
        name, size = b[i : i + 4], struct.unpack_from("<I", b, i + 4)[0]
        format_seen |= name == b"fmt " and size >= 16
        data_seen |= name == b"data" and format_seen
        i += 8 + size + size % 2
    return end if data_seen and i == end else None


def _png(b: bytes, at: int) -> int | None:
    """Chunks with right checksums from IHDR to IEND."""
    i, first = at + 8, True
    while i + 12 <= len(b):
        size = struct.unpack_from(">I", b, i)[0]
        name, end = b[i + 4 : i + 8], i + 12 + size
        if end > len(b) or (first and (name != b"IHDR" or size != 13)) or zlib.crc32(b[i + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if name == b"IEND":
            return end
        i, first = end, False
    return None


def _gif(b: bytes, at: int) -> int | None:
    """Screen descriptor, then blocks up to the trailer."""
    if len(b) - at < 14:
        return None
    flags = b[at + 10]
    i = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    images = 0
    while i < len(b):
        mark = b[i]
        if mark == 0x3B:
            return i + 1 if images else None
        if mark == 0x21:
            i += 2
        elif mark == 0x2C and i + 10 < len(b):
            local = b[i + 9]
            i += 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0)
            images += 1
        else:
            return None
        while i < len(b) and b[i]:
            i += 1 + b[i]
        i += 1
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    """Marker segments up to the scan, then the end mark."""
    i = at + 2
    while i + 4 <= len(b) and b[i] == 0xFF:
        mark = b[i + 1]
        size = struct.unpack_from(">H", b, i + 2)[0]
        if size < 2 or mark in (0x00, 0xFF):
            return None
        i += 2 + size
        if mark == 0xDA:
            end = _next(b, b"\xff\xd9", i)
            return end + 2 if end >= 0 else None
    return None


def _pdf(b: bytes, at: int) -> int | None:
    if not (b[at + 5 : at + 6].isdigit() and b[at + 6 : at + 7] == b"."):
        return None
    end = _next(b, b"%%EOF", at)
    return end + 5 if end >= 0 and 0 <= _next(b, b"startxref", at) < end else None


@lru_cache(maxsize=1)
def _archives(b: bytes) -> dict[int, int]:
    """Ends of archives by their starts, as the end records state them; of equal starts the
    last, which holds any archive stored within."""
    out = {}
    for end in _places(b, b"PK\x05\x06").tolist():
        if end + 22 > len(b):
            continue
        size, where, note = struct.unpack_from("<IIH", b, end + 12)
        directory = end - size
        if directory >= where and b[directory : directory + 4] == b"PK\x01\x02" and end + 22 + note <= len(b):
            out[directory - where] = end + 22 + note
    return out


def _zip(b: bytes, at: int) -> int | None:
    """A local header, and an end record whose directory lies within."""
    return _archives(b).get(at) if len(b) - at >= 30 else None


def _gzip(b: bytes, at: int) -> int | None:
    """A member that inflates to its stated checksum and length; nothing inflated is kept."""
    if b[at + 2 : at + 3] != b"\x08":
        return None
    stream, view, i = zlib.decompressobj(31), memoryview(b), at
    try:
        while not stream.eof:
            held = view[i : i + STEP]
            if not stream.decompress(held, STEP) and not held:
                return None
            # At the end both attributes may hold what follows the member.
            i += len(held) - len(stream.unused_data if stream.eof else stream.unconsumed_tail)
    except zlib.error:
        return None
    return i


def _bmp(b: bytes, at: int) -> int | None:
    if len(b) - at < 54:
        return None
    size, spare, where, head = struct.unpack_from("<IIII", b, at + 2)
    return at + size if spare == 0 and head in (12, 40, 52, 56, 64, 108, 124) and 14 + head <= where <= size and at + size <= len(b) else None


def _flac(b: bytes, at: int) -> int | None:
    """Metadata blocks, the stream's first, and then a frame. Frames state no length, so the
    stream goes on to the end of the bytes; ``carve`` ends it where other media begin."""
    if b[at + 4 : at + 5] not in (b"\x00", b"\x80") or b[at + 5 : at + 8] != b"\x00\x00\x22":
        return None
    i, last = at + 4, False
    while not last and i + 4 <= len(b):
        last, i = bool(b[i] & 0x80), i + 4 + int.from_bytes(b[i + 1 : i + 4], "big")
    return len(b) if last and b[i : i + 2] in (b"\xff\xf8", b"\xff\xf9") else None


#: Fixed values of the formats: box types, magic bytes with types and validators, and how far
#: behind its start a format's magic stands.
BOXES = {b"ftyp", b"styp", b"moov", b"moof", b"mfra", b"mdat", b"meta", b"free", b"skip", b"wide", b"uuid", b"sidx", b"udta", b"pdin"}
SIGNATURES = {
    b"RIFF": [("audio/wav", _wav), ("image/webp", _webp), ("video/x-msvideo", _avi)],
    b"OggS": [("application/ogg", _ogg)],
    b"ftyp": [("video/mp4", _mp4)],
    b"\x89PNG\r\n\x1a\n": [("image/png", _png)],
    b"GIF87a": [("image/gif", _gif)],
    b"GIF89a": [("image/gif", _gif)],
    b"\xff\xd8\xff": [("image/jpeg", _jpeg)],
    b"%PDF-": [("application/pdf", _pdf)],
    b"PK\x03\x04": [("application/zip", _zip)],
    b"\x1f\x8b": [("application/gzip", _gzip)],
    b"BM": [("image/bmp", _bmp)],
    b"fLaC": [("audio/flac", _flac)],
}
BEHIND = {b"ftyp": 4}

_AUTOMATON = None


def _automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        _AUTOMATON = ahocorasick.Automaton()
        for magic in SIGNATURES:
            _AUTOMATON.add_word(magic.decode("latin-1"), magic)
        _AUTOMATON.make_automaton()
    return _AUTOMATON


def sniff(b: bytes) -> list[Found]:
    """All confirmed media in ``b``, by start and then the longer first."""
    out = []
    for last, magic in _automaton().iter(b.decode("latin-1")):
        at = last - len(magic) + 1 - BEHIND.get(magic, 0)
        for kind, validate in SIGNATURES[magic] if at >= 0 else ():
            end = validate(b, at)
            if end is not None:
                out.append(Found(kind, at, end))
    return sorted(out, key=lambda f: (f.start, -f.end, f.kind))


def corrected_type(declared: str | None, found: list[Found], size: int) -> str:
    """The type of what starts at byte 0; else the declared one, or plain bytes where it claims
    a format that the bytes don't have."""
    whole = next((f.kind for f in found if f.start == 0), None)
    known = {kind for each in SIGNATURES.values() for kind, _ in each}
    return whole or (declared if declared and declared not in known else "application/octet-stream")


def carve(b: bytes, found: list[Found]) -> list[tuple[str, int, bytes]]:
    """The media that lie within ``b``, other than one that is all of it; of overlapping ones
    the first. A stream without a length ends where the next medium begins."""
    out, free = [], 0
    for i, f in enumerate(found):
        if f.kind == "audio/flac" and i + 1 < len(found):
            f = Found(f.kind, f.start, found[i + 1].start)
        if f.start == 0 and f.end == len(b):
            continue
        if f.start >= free:
            out.append((f.kind, f.start, b[f.start : f.end]))
            free = f.end
    return out


def to_wav(payload: bytes) -> bytes:
    """8-bit mono samples; even lengths need no padding."""
    pad = len(payload) % 2
    return b"RIFF" + struct.pack("<I", 36 + len(payload) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * pad


def from_wav(b: bytes) -> bytes:
    """The samples of the data chunk."""
    i = 12
    while i + 8 <= len(b):
        name, size = b[i : i + 4], struct.unpack_from("<I", b, i + 4)[0]
        if name == b"data":
            return b[i + 8 : i + 8 + size]
        i += 8 + size + size % 2
    raise ValueError("no samples")


def _store_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, 1000):
            batch = whole.slice(k, 1000)
            raw = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").fill_null("").to_pylist()]
            media = [to_wav(r + b" " * ((-len(r)) % UNIT or (0 if r else UNIT))) for r in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(r) for r in raw], pa.int64()), pa.array(["audio/wav"] * len(raw)), pa.array(media, pa.binary())],
                ["doc_id", "n_bytes", "declared", "media"],
            )


def store_texts(docs: DataFrame) -> DataFrame:
    """Texts as media: ``doc_id``, ``n_bytes`` of the text in UTF-8 (null text is empty),
    ``declared`` type and ``media``, a WAV file whose 8-bit samples are the text's bytes and
    blanks up to a positive multiple of 192. Other columns aren't read."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_store_task, "doc_id long, n_bytes long, declared string, media binary")


def inspect(table: DataFrame) -> DataFrame:
    """Add to a table with ``media`` (binary) and ``declared`` columns: ``detected`` type,
    ``corrected`` (whether it differs from the declared one) and ``carved``, the embedded media
    with type, offset and bytes. Null media are empty and plain bytes."""
    kind = "detected string, corrected boolean, carved array<struct<kind:string,start:long,bytes:binary>>"
    keep = [f for f in table.schema.fields if f.name not in ("detected", "corrected", "carved")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carved_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("bytes", pa.binary())]))
        for batch in batches:
            detected, corrected, carved = [], [], []
            for b, declared in zip(batch.column("media").to_pylist(), batch.column("declared").to_pylist(), strict=True):
                found = sniff(b or b"")
                detected.append(corrected_type(declared, found, len(b or b"")))
                corrected.append(detected[-1] != declared)
                carved.append([{"kind": k, "start": s, "bytes": x} for k, s, x in carve(b or b"", found)])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(detected), pa.array(corrected), pa.array(carved, carved_type)], [*names, "detected", "corrected", "carved"])

    return table.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, f"{ddl}, {kind}")


def _feature(media: bytes, payload: bytes, declared: str) -> str:
    found = sniff(media)
    kind = corrected_type(declared, found, len(media))
    x = np.frombuffer(payload, np.uint8)
    embedded = ",".join(f"{k}@{s}+{len(b)}" for k, s, b in carve(media, found)) or "none"
    return f"{kind};samples={len(x)};rate={RATE};mean={int(x.sum()) / max(len(x), 1):.6f};crossings={int(np.count_nonzero(np.diff(x >= 128)))};embedded={embedded}"


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for media, declared in zip(batch.column("media").to_pylist(), batch.column("declared").to_pylist(), strict=True):
            payload = from_wav(media)
            rows["payload_bytes"].append(len(payload))
            rows["payload_sha256"].append(sha256(payload).hexdigest())
            rows["tail_crc32"].append(zlib.crc32(payload[-16:]))
            rows["media_bytes"].append(len(media))
            rows["media_sha256"].append(sha256(media).hexdigest())
            rows["feature"].append(_feature(media, payload, declared))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True))],
            ["doc_id", "n_bytes", *rows],
        )


def media_features(docs: DataFrame) -> DataFrame:
    """Store every text as media in the shared folder, read the stored bytes back and describe
    them. Equal texts have equal values; an empty table gives no rows."""
    stored = materialize(store_texts(docs), "media")
    return stored.mapInArrow(
        _read_task,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
