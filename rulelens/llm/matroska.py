"""Matroska containers: write lossless PCM tracks, parse EBML into packet tables.

`mux` turns a byte payload into one audio track of 8-bit PCM in laced SimpleBlocks,
grouped in clusters and indexed by cues. `demux` walks the EBML tree (variable-length
ids and sizes, unknown sizes included), undoes all four lacings, and gives one row per
packet: track, timestamp, byte range, key flag. Both work on one value at a time in
Arrow batches; no shuffle, so hot sources and lost executors do not matter.

Null and empty values are empty payloads, which still hold one frame of padding.
Equal payloads give equal files: nothing but the payload enters the container.
Malformed containers raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrowio import byte_column, column, map_arrow

# Element ids of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: Bytes of a frame: 72 ms at 8 kHz mono with 8 bits.
FRAME = 576
RATE = 8000
#: Frames in a block and blocks in a cluster; a cluster spans 18.4 s, within 16-bit offsets.
LACE, BLOCKS = 8, 32
PAD = 255


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def _vint(x: int, width: int = 0) -> bytes:
    """A size; the value with all bits set means unknown and is never written."""
    n = width or 1
    while not width and x >= (1 << 7 * n) - 1:
        n += 1
    return (x | 1 << 7 * n).to_bytes(n, "big")


def _element(ident: int, data: bytes) -> bytes:
    return _id(ident) + _vint(len(data)) + data


def _uint(ident: int, x: int) -> bytes:
    return _element(ident, x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big"))


def _float(ident: int, x: float) -> bytes:
    return _element(ident, struct.pack(">d", x))


def _laced(sizes: list[int], kind: int) -> bytes:
    """The lacing head for frames of these sizes; the last size is implied."""
    if kind == NO_LACING:
        return b""
    head = bytes([len(sizes) - 1])
    if kind == XIPH:
        return head + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    if kind == EBML_LACING:
        head += _vint(sizes[0])
        for before, s in zip(sizes, sizes[1:-1], strict=False):
            delta, n = s - before, 1
            while not -(1 << 7 * n - 1) < delta < 1 << 7 * n - 1:
                n += 1
            head += _vint(delta + (1 << 7 * n - 1) - 1, n)
        return head
    return head


def block(frames: list[bytes], offset_ms: int, kind: int | None = None, track: int = 1) -> bytes:
    """A SimpleBlock of frames; kind: the lacing, by default the shortest that fits."""
    sizes = [len(x) for x in frames]
    if kind is None:
        kind = NO_LACING if len(frames) == 1 else FIXED if len(set(sizes)) == 1 else EBML_LACING
    body = _vint(track) + struct.pack(">hB", offset_ms, 0x80 | kind << 1) + _laced(sizes, kind) + b"".join(frames)
    return _element(SIMPLE_BLOCK, body)


_HEAD = _element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2))
_TRACKS = _element(TRACKS, _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _element(AUDIO, _float(SAMPLING_FREQUENCY, RATE) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))))


def padded(payload: bytes, unit: int = FRAME) -> bytes:
    """payload with PAD bytes up to a positive multiple of unit."""
    return payload + bytes([PAD]) * (max(unit, -(-len(payload) // unit) * unit) - len(payload))


def mux(payload: bytes) -> bytes:
    """A Matroska file whose one PCM track holds payload, a positive multiple of FRAME."""
    ms = FRAME * 1000 // RATE
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _float(DURATION, len(frames) * ms) + _element(MUXING_APP, b"rulelens") + _element(WRITING_APP, b"rulelens"))
    parts, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    for first in range(0, len(frames), LACE * BLOCKS):
        inside = frames[first : first + LACE * BLOCKS]
        body = _uint(TIMESTAMP, first * ms) + b"".join(block(inside[i : i + LACE], i * ms) for i in range(0, len(inside), LACE))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, first * ms) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        parts.append(_element(CLUSTER, body))
        at += len(parts[-1])
    parts.append(_element(CUES, b"".join(cues)))
    return _HEAD + _element(SEGMENT, b"".join(parts))


def _read_id(data: bytes, at: int) -> tuple[int, int]:
    n = 9 - data[at].bit_length() if at < len(data) else 9
    if n > 4 or at + n > len(data):
        raise ValueError(f"no element id at byte {at}")
    return int.from_bytes(data[at : at + n], "big"), at + n


def _read_size(data: bytes, at: int) -> tuple[int | None, int]:
    n = 9 - data[at].bit_length() if at < len(data) else 9
    if n > 8 or at + n > len(data):
        raise ValueError(f"no element size at byte {at}")
    x = int.from_bytes(data[at : at + n], "big") ^ 1 << 7 * n
    return (None if x == (1 << 7 * n) - 1 else x), at + n


_TOP = {INFO, TRACKS, CLUSTER, CUES, SEGMENT, EBML}


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the values between two bytes. An unknown size lasts until the next top-level element."""
    while at < end:
        ident, start = _read_id(data, at)
        size, start = _read_size(data, start)
        if size is None:
            stop, peers = start, {SEGMENT, EBML} if ident == SEGMENT else _TOP
            while stop < end:
                inner, value = _read_id(data, stop)
                if inner in peers:
                    break
                length, value = _read_size(data, value)
                if length is None and inner == CLUSTER:
                    length = 0
                if length is None:
                    raise ValueError(f"nested unknown size at byte {stop}")
                stop = value + length
        else:
            stop = start + size
        if stop > end:
            raise ValueError(f"element {ident:x} at byte {at} runs past its parent")
        yield ident, start, stop
        at = stop


def _sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Frame sizes of a block, and where its first frame starts."""
    if kind == NO_LACING:
        return [end - at], at
    n, at = data[at] + 1, at + 1
    if kind == FIXED:
        if (end - at) % n:
            raise ValueError("fixed lacing with a rest")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for i in range(n - 1):
        if kind == XIPH:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            before = at
            size, at = _read_size(data, at)
            size = (1 << 7 * (at - before)) - 1 if size is None else size
            if i:
                size = sizes[-1] + size - (1 << 7 * (at - before) - 1) + 1
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing larger than its block")
    return sizes, at


def parse(data: bytes) -> dict:
    """packets (track, timestamp in ns, start, length, key), tracks, clusters, cues, duration in ns."""
    out: dict = {"packets": [], "tracks": {}, "clusters": [], "cues": [], "duration": 0}
    whole = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0
    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML head")
    scale = 1_000_000
    for ident, start, end in top:
        if ident != SEGMENT:
            continue
        for kind, a, b in elements(data, start, end):
            if kind == INFO:
                got = {i: (x, y) for i, x, y in elements(data, a, b)}
                scale = whole(*got[TIMESTAMP_SCALE]) if TIMESTAMP_SCALE in got else scale
                out["duration"] = round(real(*got[DURATION]) * scale) if DURATION in got else 0
            elif kind == TRACKS:
                for i, x, y in elements(data, a, b):
                    if i == TRACK_ENTRY:
                        got = {k: (p, q) for k, p, q in elements(data, x, y)}
                        audio = {k: (p, q) for k, p, q in elements(data, *got[AUDIO])} if AUDIO in got else {}
                        out["tracks"][whole(*got[TRACK_NUMBER])] = {"codec": data[slice(*got[CODEC_ID])].decode(), "rate": real(*audio[SAMPLING_FREQUENCY]) if SAMPLING_FREQUENCY in audio else 0, "bits": whole(*audio[BIT_DEPTH]) if BIT_DEPTH in audio else 0}
            elif kind == CUES:
                for i, x, y in elements(data, a, b):
                    if i == CUE_POINT:
                        got = {k: (p, q) for k, p, q in elements(data, x, y)}
                        spot = {k: (p, q) for k, p, q in elements(data, *got[CUE_POSITIONS])}
                        out["cues"].append((whole(*got[CUE_TIME]) * scale, start + whole(*spot[CUE_CLUSTER])))
            elif kind == CLUSTER:
                base = 0
                out["clusters"].append((a, b))
                for i, x, y in elements(data, a, b):
                    if i == TIMESTAMP:
                        base = whole(x, y)
                        continue
                    if i == BLOCK_GROUP:
                        x, y = next(((p, q) for k, p, q in elements(data, x, y) if k == BLOCK), (0, 0))
                    elif i != SIMPLE_BLOCK:
                        continue
                    if y <= x:
                        continue
                    track, at = _read_size(data, x)
                    offset, flags = struct.unpack(">hB", data[at : at + 3])
                    sizes, at = _sizes(data, at + 3, y, flags >> 1 & 3)
                    about = out["tracks"].get(track)
                    step = 0
                    for size in sizes:
                        out["packets"].append((track, (base + offset) * scale + step, at, size, bool(flags & 0x80)))
                        at += size
                        if about and about["rate"] and about["bits"]:
                            step += round(size * 8 / about["bits"] / about["rate"] * 1e9)
    return out


def payload_of(data: bytes, table: dict, track: int = 1) -> bytes:
    """The track's packets in order of time."""
    rows = sorted((t, a, n) for k, t, a, n, _ in table["packets"] if k == track)
    return b"".join(data[a : a + n] for _, a, n in rows)


def store_media(df: DataFrame, key: str = "doc_id", value: str = "text") -> DataFrame:
    """(key, n_bytes, media): each value, padded, as a Matroska file."""

    def run(batches):
        for batch in batches:
            data, starts, lengths = byte_column(column(batch, value))
            raw = data.tobytes()
            media = [mux(padded(raw[a : a + n])) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, key), pa.array(lengths, pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    return map_arrow(df.select(key, value), run, f"{key} {df.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def packet_table(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per packet: key, track, timestamp_ns, start, length, is_key."""

    def run(batches):
        for batch in batches:
            rows = [(k, *p) for k, m in zip(column(batch, key).to_pylist(), column(batch, "media").to_pylist(), strict=True) if m for p in parse(m)["packets"]]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [batch.schema.field(key).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [key, "track", "timestamp_ns", "start", "length", "is_key"])

    return map_arrow(media.select(key, "media"), run, f"{key} {media.schema[key].dataType.simpleString()}, track long, timestamp_ns long, start long, length long, is_key boolean")


def feature(payload: bytes, table: dict) -> str:
    """Counts of the container and sums of the samples, all whole numbers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"packets={len(table['packets'])};clusters={len(table['clusters'])};cues={len(table['cues'])};ms={table['duration'] // 1_000_000};sum={int(x.sum())};energy={int((x * x).sum())};peak={int(np.abs(x).max())};crossings={crossings}"


def media_digest(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the stored bytes give when they are read back: sizes, checksums and the feature."""
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            rows = []
            for m in column(batch, "media").to_pylist():
                table = parse(m)
                payload = payload_of(m, table)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(payload, table)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([column(batch, key), column(batch, "n_bytes"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    return map_arrow(media.select(key, "n_bytes", "media"), run, f"{key} {media.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
