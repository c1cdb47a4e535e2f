"""Media columns: ISO base media containers, written and read at the box level.

``pack_pcm`` stores bytes losslessly as 8-bit samples in a container; ``probe`` walks the
nested boxes of any such file, decodes the sample tables (also of fragments) and gives
codec, duration and the byte ranges of keyframes without touching payload bytes;
``samples`` cuts the payload out by those tables.

In ``media_columns`` null and empty content give a null probe with ``error`` set; malformed boxes end the walk
with an error, so no file ends a job (``probe`` itself raises ValueError and nothing else). Rows are independent, ids
play no part, and the other columns stay as they are but for one of the new column's name, which is replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import streamed
from .shared import named

FRAME = 192
RATE = 8000
#: Samples of a chunk, which begins with a keyframe, of stored texts.
CHUNK = 16
#: Boxes that hold boxes, with the bytes before the first child. Fixed values of the format.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"udta": 0}
MAX_DEPTH = 16


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(payload: bytes, frame: int = FRAME) -> bytes:
    """The payload with spaces up to a positive multiple of ``frame``."""
    return payload.ljust(max(1, -(-len(payload) // frame)) * frame, b" ")


def pack_pcm(payload: bytes, frame: int = FRAME, rate: int = RATE, chunk: int | None = None) -> bytes:
    """A container with one track of 8-bit mono samples; ``payload`` is a multiple of ``frame``.

    With ``chunk``, samples are grouped in chunks of so many, of which the first is a keyframe; else all are one chunk of keyframes.
    """
    n, rest = divmod(len(payload), frame)
    if rest or not n:
        raise ValueError("payload must be a positive multiple of the frame")
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    entry = _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, rate << 16))
    duration = len(payload)

    per = min(chunk or n, n)
    chunks = -(-n // per)
    runs = [(1, per, 1)] if n % per == 0 else [(1, per, 1), (chunks, n % per, 1)] if chunks > 1 else [(1, n, 1)]

    def moov(offset: int) -> bytes:
        sync = [] if chunk is None else [_full(b"stss", struct.pack(f">I{chunks}I", chunks, *range(1, n + 1, per)))]
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, frame)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", frame, n)),
            _full(b"co64", struct.pack(f">I{chunks}Q", chunks, *range(offset, offset + n * frame, per * frame))),
            *sync,
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        mdhd = _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, rate, duration, 0x55C4, 0), version=1)
        hdlr = _full(b"hdlr", bytes(4), b"soun", bytes(12), b"payload\0")
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ8xhhhH", 0, 0, 1, 0, duration, 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=3)
        mvhd = _full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, rate, duration, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if len(payload) + 8 > 0xFFFFFFFF else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return ftyp + moov(len(ftyp) + len(moov(0)) + len(head)) + head + payload


@dataclass
class Track:
    track_id: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    sync: set[int] | None = None
    tables: dict[bytes, tuple[int, int]] = field(default_factory=dict)

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    def keyframes(self) -> list[tuple[int, int]]:
        """Byte ranges (offset, size) of keyframes; those that adjoin are one range."""
        out: list[tuple[int, int]] = []
        for i, (at, size) in enumerate(zip(self.offsets, self.sizes, strict=True)):
            if self.sync is None or i + 1 in self.sync:
                if out and out[-1][0] + out[-1][1] == at:
                    out[-1] = (out[-1][0], out[-1][1] + size)
                else:
                    out.append((at, size))
        return out


def boxes(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of the content of each box between two places."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("a large size is cut off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} has a wrong size")
        yield kind, at + head, at + size
        at += size


def probe(content: bytes) -> list[Track]:
    """The tracks of a file, sample tables decoded. Raises ValueError on a malformed one."""
    data = memoryview(content)
    tracks: list[Track] = []
    defaults: dict[int, tuple[int, int, int]] = {}

    def walk(at: int, end: int, depth: int, track: Track | None, moof: int) -> None:
        if depth > MAX_DEPTH:
            raise ValueError("boxes are nested too deeply")
        base, current = moof, [0, 0, 0]
        for kind, a, b in boxes(data, at, end):
            if kind in CONTAINERS:
                if kind == b"trak":
                    track = Track()
                    tracks.append(track)
                walk(a + CONTAINERS[kind], b, depth + 1, track, a - 8 if kind == b"moof" else moof)
            elif kind == b"trex" and b - a >= 24:
                t, _, d, s, f = struct.unpack_from(">5I", data, a + 4)
                defaults[t] = (d, s, f)
            elif kind == b"tfhd":
                flags, t = struct.unpack_from(">II", data, a)
                track = next((x for x in tracks if x.track_id == t), None)
                current, p = list(defaults.get(t, (0, 0, 0))), a + 8
                if flags & 1:
                    base, p = struct.unpack_from(">Q", data, p)[0], p + 8
                p += 4 * bool(flags & 2)
                for i, bit in enumerate((8, 16, 32)):
                    if flags & bit:
                        current[i], p = struct.unpack_from(">I", data, p)[0], p + 4
            elif kind == b"trun" and track is not None:
                base = _fragment(data, a, b, track, base, current)
            elif track is not None:
                _leaf(data, kind, a, b, track)

    try:
        walk(0, len(data), 0, None, 0)
        for t in tracks:
            _tables(data, t)
    except (struct.error, IndexError) as e:
        raise ValueError(f"a box is cut off: {e}") from e
    if not tracks:
        raise ValueError("no track")
    return tracks


def _fragment(data: memoryview, a: int, b: int, track: Track, base: int, default: list[int]) -> int:
    flags, n = struct.unpack_from(">II", data, a)
    flags &= 0xFFFFFF
    p, at, first = a + 8, base, None
    if flags & 1:
        at, p = base + struct.unpack_from(">i", data, p)[0], p + 4
    if flags & 4:
        first, p = struct.unpack_from(">I", data, p)[0], p + 4
    if n * 4 * bin(flags & 0xF00).count("1") > b - p:
        raise ValueError("a fragment's table is cut off")
    if not flags & 0xF00 and n > len(data):
        raise ValueError("more samples than bytes")
    sync = track.sync if track.sync is not None else set(range(1, len(track.sizes) + 1))
    for i in range(n):
        values = list(default)
        for j, bit in enumerate((0x100, 0x200, 0x400)):
            if flags & bit:
                values[j], p = struct.unpack_from(">I", data, p)[0], p + 4
        p += 4 * bool(flags & 0x800)
        if i == 0 and first is not None:
            values[2] = first
        track.sizes.append(values[1])
        track.offsets.append(at)
        track.duration += values[0]
        if not values[2] & 0x10000:
            sync.add(len(track.sizes))
        at += values[1]
    track.sync = sync
    return at


def _leaf(data: memoryview, kind: bytes, a: int, b: int, track: Track) -> None:
    if a >= b:
        raise ValueError(f"box {kind!r} is empty")
    if kind == b"tkhd":
        track.track_id = struct.unpack_from(">I", data, a + (20 if data[a] else 12))[0]
    elif kind == b"mdhd":
        track.timescale, track.duration = struct.unpack_from(">IQ" if data[a] else ">II", data, a + (20 if data[a] else 12))
    elif kind == b"hdlr":
        track.handler = bytes(data[a + 8 : a + 12]).decode("latin-1")
    elif kind in (b"stsd", b"stts", b"stsc", b"stsz", b"stz2", b"stco", b"co64", b"stss"):
        track.tables[kind] = (a, b)


def _tables(data: memoryview, track: Track) -> None:
    """Sample sizes, offsets and keyframes from the sample tables."""
    tables = track.tables

    def entries(kind: bytes, shape: str, at: int = 4) -> list[tuple[int, ...]]:
        if kind not in tables:
            return []
        a, b = tables[kind]
        n = struct.unpack_from(">I", data, a + at)[0]
        size = struct.calcsize(">" + shape)
        if a + at + 4 + n * size > b:
            raise ValueError(f"table {kind!r} is cut off")
        return list(struct.iter_unpack(">" + shape, data[a + at + 4 : a + at + 4 + n * size]))

    if b"stsd" in tables:
        a, b = tables[b"stsd"]
        track.codec = next((k.decode("latin-1") for k, _, _ in boxes(data, a + 8, b)), "")
    sizes: list[int] = []
    if b"stsz" in tables:
        one, n = struct.unpack_from(">II", data, tables[b"stsz"][0] + 4)
        if one and n > len(data):
            raise ValueError("more samples than bytes")
        sizes = [one] * n if one else [x[0] for x in entries(b"stsz", "I", 8)]
    elif b"stz2" in tables:
        a, b = tables[b"stz2"]
        bits, n = struct.unpack_from(">II", data, a + 4)
        if n * (bits & 255) > (b - a - 12) * 8:
            raise ValueError("table stz2 is cut off")
        raw = data[a + 12 : b]
        sizes = [(raw[i // 2] >> (4 * (1 - i % 2))) & 15 for i in range(n)] if bits & 255 == 4 else [int.from_bytes(raw[i * (bits & 255) // 8 : (i + 1) * (bits & 255) // 8]) for i in range(n)]
    chunks = [x[0] for x in entries(b"co64", "Q") or entries(b"stco", "I")]
    runs = entries(b"stsc", "III")
    offsets: list[int] = []
    for i, (first, per, _) in enumerate(runs):
        last = runs[i + 1][0] if i + 1 < len(runs) else len(chunks) + 1
        for c in range(first - 1, min(last - 1, len(chunks))):
            at = chunks[c]
            for size in sizes[len(offsets) : len(offsets) + per]:
                offsets.append(at)
                at += size
    if len(offsets) != len(sizes):
        raise ValueError("sample tables disagree")
    if b"stss" in tables:
        track.sync = {x[0] for x in entries(b"stss", "I")} if track.sync is None else {x[0] for x in entries(b"stss", "I")} | {k for k in track.sync if k > len(sizes)}
    track.sizes, track.offsets = sizes + track.sizes, offsets + track.offsets
    if not track.duration:
        track.duration = sum(n * d for n, d in entries(b"stts", "II"))


def samples(content: bytes, track: Track) -> bytes:
    """The payload of a track, cut out by its tables."""
    data, out = memoryview(content), []
    at = size = 0
    for o, s in zip(track.offsets, track.sizes, strict=True):
        if o + s > len(data):
            raise ValueError("a sample lies beyond the file")
        if out is not None and size and at + size == o:
            size += s
        else:
            if size:
                out.append(data[at : at + size])
            at, size = o, s
    if size:
        out.append(data[at : at + size])
    return b"".join(out)


_TRACK = "codec: string, handler: string, timescale: long, duration_s: double, n_samples: long, keyframes: array<struct<offset: long, size: long>>"
_COLUMNS = f"struct<{_TRACK}, error: string, tracks: array<struct<{_TRACK}>>>"


def media_columns(df: DataFrame, content_col: str = "content", out_col: str = "media") -> DataFrame:
    """``df`` and a struct of codec, duration and keyframe byte ranges: the first track's, and those of all in ``tracks``."""
    import pandas as pd

    def probed(column: pd.Series) -> pd.DataFrame:
        names = ["codec", "handler", "timescale", "duration_s", "n_samples", "keyframes"]
        rows = []
        for content in column:
            try:
                tracks = probe(bytes(content) if content is not None else b"")
                every = [(t.codec, t.handler, t.timescale, t.seconds, len(t.sizes), [{"offset": o, "size": s} for o, s in t.keyframes()]) for t in tracks]
                rows.append((*every[0], None, [dict(zip(names, t, strict=True)) for t in every]))
            except ValueError as e:
                rows.append((None,) * 6 + (str(e), None))
        return pd.DataFrame(rows, columns=[*names, "error", "tracks"])

    return df.withColumn(out_col, F.pandas_udf(probed, _COLUMNS, F.PandasUDFType.SCALAR)(F.col(content_col)))


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and ``content``: each text as a container of 8-bit samples.

    A null text is stored as an empty one, a null id stays null, repeated rows are stored each,
    and an empty table gives none. Only the two columns are read; others may have any name.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in streamed(batches, 256):
            part = block.extra["rows"]
            raw = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([pack_pcm(padded(x), chunk=CHUNK) for x in raw], pa.binary())], ["doc_id", "n_bytes", "content"])

    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text")).mapInArrow(pack, "doc_id long, n_bytes long, content binary")


def read_back(stored: DataFrame) -> DataFrame:
    """Payload digests, codec, duration, keyframe byte ranges and their summary of each container, from its own tables."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for content in b.column(2):
                raw = content.as_buffer().to_pybytes()
                track = probe(raw)[0]
                payload = samples(raw, track)
                keys = track.keyframes()
                feature = f"{track.handler}/{track.codec}/{track.timescale}Hz/{track.seconds:.6f}s/{len(track.sizes)} samples/keyframes " + ",".join(f"{o}+{s}" for o, s in keys)
                ranges = [{"offset": o, "size": s} for o, s in keys]
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, track.codec, track.seconds, len(track.sizes), ranges))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_s", "n_samples", "keyframes"])

    return stored.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, n_samples long, keyframes array<struct<offset: long, size: long>>")
