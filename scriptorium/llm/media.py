"""Media columns: ISO base media files with a lossless byte payload.

``wrap`` stores a payload as fixed-size access units of raw 8-bit samples in an
ISO media container (ftyp, moov with full sample tables, mdat). ``inspect``
walks the nested boxes of any such file, a track at a time, decodes its sample
tables and reports codec, timescale, duration and the byte ranges of the key
frames of every track; it never decodes the payload. ``payload`` reads the stored bytes back by the tables.

Defined results: a null text counts as empty and yields one padded unit; equal
texts yield equal files; texts of any length are one file each, which a worker
holds alone; repeated rows give equal rows; null ids and further columns pass
through; an empty table gives an empty one.
``inspect`` and ``payload`` raise ``ValueError`` for a container that is cut
short, lacks a table or contradicts itself; ``media_features`` then gives a row
with an ``error`` and nulls, also for a null file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, small_batches

UNIT = 192
TIMESCALE = 8000
UNITS_A_CHUNK = 8
KEY_EVERY = 16
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size >= 1 << 32:
        return b"".join([struct.pack(">I4sQ", 1, kind, size + 8), *parts])
    return b"".join([struct.pack(">I4s", size, kind), *parts])


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """``data`` with spaces up to a positive multiple of ``unit``."""
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b" ")


def wrap(data: bytes, unit: int = UNIT) -> bytes:
    """An ISO media file whose samples are the ``unit``-byte pieces of ``data``."""
    units, rest = divmod(len(data), unit)
    if rest:
        raise ValueError("the payload is no multiple of the unit")
    chunks, last = divmod(units, UNITS_A_CHUNK)
    runs = [(1, UNITS_A_CHUNK)] * bool(chunks) + [(chunks + 1, last)] * bool(last)
    key = np.arange(1, units + 1, KEY_EVERY, dtype=">u4")
    ticks = units * unit
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp42")
    entry = _box(b"raw ", struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, TIMESCALE << 16))

    def moov(base: int) -> bytes:
        at = base + np.arange(chunks + bool(last), dtype=np.int64) * (UNITS_A_CHUNK * unit)
        wide = bool(len(at)) and int(at[-1]) >= 1 << 32
        offsets = _full(b"co64" if wide else b"stco", struct.pack(">I", len(at)), at.astype(">u8" if wide else ">u4").tobytes())
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, units, unit)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", first, n, 1) for first, n in runs)),
            _full(b"stsz", struct.pack(">II", unit, units)),
            _full(b"stss", struct.pack(">I", len(key)), key.tobytes()),
            offsets,
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        mdhd = _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, ticks & 0xFFFFFFFF, 0x55C4, 0))
        hdlr = _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"bytes\0")
        tkhd = _full(b"tkhd", struct.pack(">IIIIIQHHHH", 0, 0, 1, 0, ticks & 0xFFFFFFFF, 0, 0, 0, 0x100, 0), _MATRIX, bytes(8), flags=7)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, ticks & 0xFFFFFFFF, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    head = 8 if len(data) + 8 < 1 << 32 else 16
    first = moov(0)
    return ftyp + moov(len(ftyp) + len(first) + head) + _box(b"mdat", data)


def boxes(media: bytes, start: int = 0, end: int | None = None, path: str = "") -> Iterator[tuple[str, int, int]]:
    """Every box, depth first: path, where its content starts and ends."""
    end = len(media) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError(f"cut short at {start}")
        size, kind = struct.unpack_from(">I4s", media, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError(f"cut short at {start}")
            size = struct.unpack_from(">Q", media, body)[0]
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has a wrong size")
        name = f"{path}/{kind.decode('latin-1')}"
        yield name, body, start + size
        if kind in _NESTED:
            yield from boxes(media, body, start + size, name)
        start += size


def _table(media: bytes, at: tuple[int, int] | None, skip: int, kind: str, columns: int = 1) -> np.ndarray:
    if at is None:
        return np.zeros((0, columns), np.int64)
    n = struct.unpack_from(">I", media, at[0] + skip - 4)[0]
    if at[0] + skip + n * columns * int(kind[-1]) > at[1]:
        raise ValueError("a table is cut short")
    return np.frombuffer(media, kind, n * columns, at[0] + skip).astype(np.int64).reshape(n, columns)


def inspect(media: bytes) -> list[dict]:
    """Codec, timescale, duration and sample layout of every track in order, from its own tables alone."""
    tracks = [_track(media, a, b) for name, a, b in boxes(media) if name == "/moov/trak"]
    if not tracks:
        raise ValueError("no /moov/trak")
    return tracks


def _track(media: bytes, start: int, end: int) -> dict:
    """One track: nothing outside its box is looked at."""
    found: dict[str, tuple[int, int]] = {}
    for name, a, b in boxes(media, start, end):
        if name in found:
            raise ValueError(f"a track has two {name}")
        found |= {name: (a, b)} if name in _READ else {}
    missing = [t for t in ("stsd", "mdhd", "stsz") if _AT[t] not in found]
    if missing:
        raise ValueError(f"a track without {_AT[missing[0]]}")
    for t, least in (("stsd", 16), ("mdhd", 24), ("stsz", 12)):
        if found[_AT[t]][1] - found[_AT[t]][0] < least:
            raise ValueError(f"{_AT[t]} is cut short")
    at = found[_AT["stsd"]][0]
    codec = media[at + 12 : at + 16].decode("latin-1")
    mdhd = found[_AT["mdhd"]][0]
    timescale = struct.unpack_from(">I", media, mdhd + (20 if media[mdhd] else 12))[0]
    durations = _table(media, found.get(_AT["stts"]), 8, ">u4", 2)
    fixed, count = struct.unpack_from(">II", media, found[_AT["stsz"]][0] + 4)
    if fixed * count > len(media):
        raise ValueError("the samples are longer than the file")
    sizes = np.full(count, fixed, np.int64) if fixed else _table(media, found[_AT["stsz"]], 12, ">u4")[:, 0]
    if _AT["stco"] in found and _AT["co64"] in found:
        raise ValueError("a track has two tables of offsets")
    offsets = _table(media, found[_AT["co64"]], 8, ">u8")[:, 0] if _AT["co64"] in found else _table(media, found.get(_AT["stco"]), 8, ">u4")[:, 0]
    runs = _table(media, found.get(_AT["stsc"]), 8, ">u4", 3)
    if len(sizes) != count or (runs < 1).any() or (np.diff(runs[:, 0]) < 1).any() or (runs[:, 1] > count).any() or (runs[:, 0] > len(offsets)).any():
        raise ValueError("the sample tables disagree")
    ends = np.append(runs[1:, 0] - 1, len(offsets))
    a_chunk = np.repeat(runs[:, 1], np.maximum(ends - (runs[:, 0] - 1), 0))
    if a_chunk.sum() != count:
        raise ValueError("the sample tables disagree")
    chunk = np.repeat(np.arange(len(offsets)), a_chunk)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(a_chunk) - a_chunk
    starts = offsets[chunk] + before - before[first][chunk] if count else before
    sync = _table(media, found[_AT["stss"]], 8, ">u4")[:, 0] - 1 if _AT["stss"] in found else np.arange(count)
    if ((sync < 0) | (sync >= count)).any():
        raise ValueError("a key frame is no sample")
    return {"codec": codec, "timescale": timescale, "duration": int((durations[:, 0] * durations[:, 1]).sum()), "starts": starts, "sizes": sizes, "keys": sync}


_AT = {"mdhd": "/mdia/mdhd", **{t: f"/mdia/minf/stbl/{t}" for t in ("stsd", "stts", "stsz", "stsc", "stss", "stco", "co64")}}
_READ = frozenset(_AT.values())


def payload(media: bytes, tracks: list[dict]) -> bytes:
    """The samples' bytes in order, track after track, by their ranges."""
    out = []
    for track in tracks:
        starts, ends = track["starts"], track["starts"] + track["sizes"]
        if len(ends) and ends.max() > len(media):
            raise ValueError("a sample lies outside the file")
        cut = np.flatnonzero(starts[1:] != ends[:-1]) + 1
        if len(starts):
            out += [media[a:b] for a, b in zip(starts[np.r_[0, cut]], ends[np.r_[cut - 1, len(ends) - 1]], strict=True)]
    return b"".join(out)


def feature(tracks: list[dict]) -> str:
    """Codec, duration and key-frame byte ranges of each track, tracks parted by a bar."""
    parts = []
    for t in tracks:
        ranges = ",".join(f"{a}+{n}" for a, n in zip(t["starts"][t["keys"]].tolist(), t["sizes"][t["keys"]].tolist(), strict=True))
        parts.append(f"codec={t['codec'].strip()};timescale={t['timescale']};duration={t['duration']};samples={len(t['sizes'])};keyframes={ranges}")
    return "|".join(parts)


def to_media(docs: DataFrame, *, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """Replace the text column by its length in bytes and an ISO media file."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col]
    source = docs.select(*rest, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    schema = extended(source.drop("_t"), f"n_bytes long, `{media_col}` binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [t.encode() for t in b.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(map(len, raw), pa.int64()), pa.array([wrap(padded(x)) for x in raw], pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)


def media_features(frame: DataFrame, *, media_col: str = "media") -> DataFrame:
    """Replace the media column by what its tables and its payload, read back, say; ``error`` is null where they can be read."""
    small_batches(frame.sparkSession)
    rest = [c for c in frame.columns if c != media_col]
    source = frame.select(*rest, media_col)
    schema = extended(source.drop(media_col), "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())

    def read(m: bytes | None) -> tuple:
        if m is None:
            return (None,) * 6 + ("no file",)
        own = (len(m), hashlib.sha256(m).hexdigest())
        try:
            tracks = inspect(m)
            data = payload(m, tracks)
        except (ValueError, struct.error) as fault:
            return (None, None, None, *own, None, str(fault))
        return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), *own, feature(tracks), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [read(m) for m in b.column(len(rest)).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return source.mapInArrow(run, schema)
