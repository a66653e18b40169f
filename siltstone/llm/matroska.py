"""Matroska media columns: a muxer for 8-bit samples and an EBML parser that yields packet tables.

`mux` stores a payload as one PCM track (unsigned 8-bit, mono, 8 kHz): EBML header, Info, Tracks, Clusters of laced
SimpleBlocks, Cues. `parse` walks any Matroska bytes: variable-length ids and sizes, unknown sizes, SimpleBlocks and
BlockGroups, no, Xiph, EBML and fixed-size lacing, and cue points. Everything is row-local, so no operator here shuffles.

Defined results. Null media or text: a null media gives no packets and error `empty`; a null text is an empty one.
Bytes that end early or break the format: the packets found so far, with the reason in `error`. Repeated rows: the same
result for each. Empty tables: empty results. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import pieces

UNIT = 192
FRAME = 5 * UNIT
FRAMES_A_BLOCK = 8
BLOCKS_A_CLUSTER = 16
RATE = 8000

# Fixed values of the public Matroska specification: element ids.
EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SCALE, DURATION, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, LACING, CODEC = 0x2AD7B1, 0x4489, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
DEFAULT_DURATION, SAMPLING, CHANNELS, BIT_DEPTH, MUXING_APP, WRITING_APP = 0x23E383, 0xB5, 0x9F, 0x6264, 0x4D80, 0x5741
EBML_VERSION, EBML_READ, MAX_ID, MAX_SIZE, DOCTYPE = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282
DOCTYPE_VERSION, DOCTYPE_READ = 0x4287, 0x4285

MASTERS = frozenset({EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS})
TOP = frozenset({INFO, TRACKS, CLUSTER, CUES})


def _id(number: int) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big")


def size_bytes(value: int, length: int = 0) -> bytes:
    """A size as a variable-length integer; the value of all ones is reserved for `unknown`."""
    if not length:
        length = 1
        while value >= (1 << 7 * length) - 1:
            length += 1
    return ((1 << 7 * length) | value).to_bytes(length, "big")


def element(number: int, body: bytes) -> bytes:
    return _id(number) + size_bytes(len(body)) + body


def _uint(number: int, value: int) -> bytes:
    return element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _float(number: int, value: float) -> bytes:
    return element(number, struct.pack(">d", value))


def lace(frames: list[bytes], kind: str) -> tuple[int, bytes]:
    """The lacing bits of a block's flags, and the block's body after its header."""
    if kind == "none":
        return 0, frames[0]
    count, sizes = bytes([len(frames) - 1]), [len(x) for x in frames]
    if kind == "fixed":
        return 4, count + b"".join(frames)
    if kind == "xiph":
        head = b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
        return 2, count + head + b"".join(frames)
    head = size_bytes(sizes[0]) if len(sizes) > 1 else b""
    for before, now in zip(sizes, sizes[1:-1]):
        length = next(k for k in range(1, 9) if abs(now - before) < (1 << 7 * k - 1) - 1)
        head += size_bytes(now - before + (1 << 7 * length - 1) - 1, length)
    return 6, count + head + b"".join(frames)


_HEADER = element(
    EBML,
    _uint(EBML_VERSION, 1) + _uint(EBML_READ, 1) + _uint(MAX_ID, 4) + _uint(MAX_SIZE, 8) + element(DOCTYPE, b"matroska") + _uint(DOCTYPE_VERSION, 4) + _uint(DOCTYPE_READ, 2),
)
_FRAME_NS = FRAME * 1_000_000_000 // RATE
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + _uint(DEFAULT_DURATION, _FRAME_NS)
        + element(AUDIO, _float(SAMPLING, float(RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8)),
    ),
)


def mux(payload: bytes, lacing: str = "auto", frame: int = FRAME) -> bytes:
    """A Matroska file whose only track holds `payload`. `auto` laces equal frames fixed and others by EBML."""
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    info = element(INFO, _uint(SCALE, 1_000_000) + _float(DURATION, len(payload) * 1000 / RATE) + element(MUXING_APP, b"siltstone") + element(WRITING_APP, b"siltstone"))
    parts, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    a_cluster = FRAMES_A_BLOCK * BLOCKS_A_CLUSTER
    for first in range(0, len(frames), a_cluster):
        start = first * frame * 1000 // RATE
        body = [_uint(TIMESTAMP, start)]
        for k in range(first, min(len(frames), first + a_cluster), FRAMES_A_BLOCK):
            held = frames[k : min(k + FRAMES_A_BLOCK, first + a_cluster)]
            kind = lacing
            if lacing == "auto":
                kind = "none" if len(held) == 1 else "fixed" if len(held[0]) == len(held[-1]) else "ebml"
            if kind == "none":
                for i, one in enumerate(held):
                    body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", (k + i) * frame * 1000 // RATE - start, 0x80) + one))
                continue
            bits, laced = lace(held, kind)
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", k * frame * 1000 // RATE - start, 0x80 | bits) + laced))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, start) + element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEADER + element(SEGMENT, b"".join(parts))


@dataclass
class Parsed:
    scale: int = 1_000_000
    duration: float = 0.0
    clusters: int = 0
    tracks: dict[int, dict] = field(default_factory=dict)
    #: (track, timestamp in ns, key frame, first byte, bytes, cluster's number)
    packets: list[tuple[int, int, bool, int, int, int]] = field(default_factory=list)
    #: (time in ns, track, the cluster's first byte in the file)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    error: str = ""


class Broken(ValueError):
    pass


def read_vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int]:
    """A variable-length integer and the place after it; -1 for an unknown size."""
    if at >= len(data) or not data[at]:
        raise Broken("no variable-length integer")
    length = 9 - data[at].bit_length()
    if at + length > len(data):
        raise Broken("cut variable-length integer")
    value = int.from_bytes(data[at : at + length], "big")
    if keep_marker:
        return value, at + length
    value ^= 1 << 7 * length
    return (-1 if value == (1 << 7 * length) - 1 else value), at + length


def lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """The sizes of a block's frames, and the first frame's place."""
    if kind == 0:
        return [end - at], at
    if at >= end:
        raise Broken("no lace count")
    count, at = data[at] + 1, at + 1
    if kind == 4:
        if (end - at) % count:
            raise Broken("uneven fixed lacing")
        return [(end - at) // count] * count, at
    sizes = []
    for k in range(count - 1):
        if kind == 2:
            n = 0
            while True:
                if at >= end:
                    raise Broken("cut Xiph lacing")
                n, at = n + data[at], at + 1
                if data[at - 1] != 255:
                    break
        else:
            before = at
            n, at = read_vint(data, at, False)
            if k:
                n += sizes[-1] - (1 << 7 * (at - before) - 1) + 1
        sizes.append(n)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Broken("lace sizes exceed the block")
    return sizes, at


def parse(data: bytes) -> Parsed:
    """Walk the elements without recursion: `ends` holds the open masters' ends."""
    out = Parsed()
    if not data:
        out.error = "empty"
        return out
    segment = cluster_time = 0
    entry: dict = {}
    cue: list[int] = [0, 0, 0]
    open_: list[tuple[int, int]] = []
    at, raw = 0, []

    def close(number: int) -> None:
        if number == TRACK_ENTRY:
            out.tracks[entry.get("number", 0)] = dict(entry)
        elif number == CUE_POSITIONS:
            out.cues.append(tuple(cue))

    try:
        while True:
            while open_ and at >= open_[-1][1]:
                close(open_.pop()[0])
            if at >= len(data):
                break
            number, body = read_vint(data, at, True)
            size, body = read_vint(data, body, False)
            while open_ and open_[-1][1] == len(data) and (number in TOP or number == SEGMENT) and open_[-1][0] != SEGMENT:
                close(open_.pop()[0])  # a top element ends one of unknown size
            end = len(data) if size < 0 else body + size
            if end > len(data):
                if number not in MASTERS:
                    raise Broken("element exceeds the file")
                out.error, end = "master exceeds the file", len(data)
            if number in MASTERS:
                open_.append((number, end))
                if number == SEGMENT:
                    segment = body
                elif number == CLUSTER:
                    out.clusters += 1
                elif number == TRACK_ENTRY:
                    entry = {}
                at = body
                continue
            if number == TIMESTAMP:
                cluster_time = int.from_bytes(data[body:end], "big")
            elif number in (SIMPLE_BLOCK, BLOCK):
                track, head = read_vint(data, body, False)
                if head + 3 > end:
                    raise Broken("cut block")
                offset, flags = struct.unpack_from(">hB", data, head)
                sizes, first = lace_sizes(data, head + 3, end, flags & 6)
                raw.append([track, cluster_time + offset, bool(flags & 0x80) or number == BLOCK, first, sizes, out.clusters - 1])
            elif number == REFERENCE and raw:
                raw[-1][2] = False
            elif number == SCALE:
                out.scale = int.from_bytes(data[body:end], "big")
            elif number == DURATION:
                out.duration = struct.unpack(">d" if end - body == 8 else ">f", data[body:end])[0]
            elif number == TRACK_NUMBER:
                entry["number"] = int.from_bytes(data[body:end], "big")
            elif number == TRACK_TYPE:
                entry["type"] = int.from_bytes(data[body:end], "big")
            elif number == CODEC:
                entry["codec"] = data[body:end].decode("ascii", "replace")
            elif number == DEFAULT_DURATION:
                entry["frame_ns"] = int.from_bytes(data[body:end], "big")
            elif number == CUE_TIME:
                cue[0] = int.from_bytes(data[body:end], "big")
            elif number == CUE_TRACK:
                cue[1] = int.from_bytes(data[body:end], "big")
            elif number == CUE_CLUSTER:
                cue[2] = int.from_bytes(data[body:end], "big") + segment
            at = end
        while open_:
            close(open_.pop()[0])
    except (Broken, struct.error) as error:
        out.error = str(error)
    out.cues = [(time * out.scale, track, place) for time, track, place in out.cues]
    for track, time, key, first, sizes, cluster in raw:
        step = out.tracks.get(track, {}).get("frame_ns", 0)
        for k, n in enumerate(sizes):
            out.packets.append((track, time * out.scale + k * step, key, first, n, cluster))
            first += n
    return out


def track_bytes(data: bytes, parsed: Parsed, track: int = 1) -> bytes:
    return b"".join(data[first : first + n] for number, _, _, first, n, _ in parsed.packets if number == track)


def padded(raw: bytes) -> bytes:
    """Spaces up to a positive multiple of 192."""
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def feature(payload: bytes, parsed: Parsed) -> str:
    """Counts of the container and whole-number statistics of the samples that were read back."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"packets={len(parsed.packets)};clusters={parsed.clusters};cues={len(parsed.cues)};ms={round(parsed.duration)};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings};peak={int(np.abs(x).max())}"


def _replaced(df: DataFrame, names: set[str]) -> list[str]:
    return [c for c in df.columns if c.lower() not in names]


def mux_column(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of `df`, and `media`: the text's padded UTF-8 bytes as a Matroska file."""
    kept = [F.col(f"`{c}`") for c in _replaced(df, {"media"})]
    source = df.select(*kept, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("media"))
    schema = source.select(*kept, F.col("media").cast("binary").alias("media")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "media"):
            made = [mux(padded(t.encode())) for t in batch.column("media").to_pylist()]
            yield batch.set_column(batch.num_columns - 1, "media", pa.array(made, pa.binary()))

    return source.mapInArrow(run, schema)


def packet_table(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """One row per packet: the key, packet's number, track, codec, timestamp, key-frame flag, byte range and cluster."""
    schema = df.select(F.col(f"`{key}`").alias("key")).schema.fields[0].dataType.simpleString()
    columns = f"`{key}` {schema}, packet int, track int, codec string, timestamp_ns long, is_key boolean, byte_offset long, byte_length long, cluster int, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "media"):
            keys, rows = [], []
            for k, data in enumerate(batch.column(1).to_pylist()):
                parsed = parse(data or b"")
                for i, (track, time, is_key, first, n, cluster) in enumerate(parsed.packets):
                    keys.append(k)
                    rows.append((i, track, parsed.tracks.get(track, {}).get("codec"), time, is_key, first, n, cluster, parsed.error or None))
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            names = ["packet", "track", "codec", "timestamp_ns", "is_key", "byte_offset", "byte_length", "cluster", "error"]
            columns = list(zip(*rows)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))], [key, *names])

    return df.select(F.col(f"`{key}`"), F.col(f"`{media}`").alias("media")).mapInArrow(run, columns)


def media_digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Mux each whole text, parse the stored bytes, and digest what was read back. One pass, no shuffle."""
    schema = df.select(F.col(f"`{key}`")).schema.fields[0].dataType.simpleString()
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    columns = f"`{key}` {schema}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "media_text"):
            rows = []
            for value in batch.column(1):
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                media = mux(padded(raw))
                parsed = parse(media)
                payload = track_bytes(media, parsed)
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, parsed)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("media_text")).mapInArrow(run, columns)
