"""Media columns in Matroska: payload bytes to a PCM track and back, and packet tables.

A payload is cut into frames of one size and muxed as 8-bit PCM: EBML header, segment with info,
one track, clusters of laced SimpleBlocks and a cue for every cluster. ``parse`` reads any such
file: variable-length ids and sizes, unknown sizes, Void elements, SimpleBlock and BlockGroup, and
the four kinds of lacing; it gives one packet a frame with timestamp, track and byte range. A laced frame's timestamp is its
block's and the frames' durations before it: shares of the block group's duration, or the track's default duration.

Defined cases: null text counts as empty text; an empty text gives one frame of padding; equal
texts give equal bytes; a null file has no packets and a digest of nulls; other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

FRAME = 576
PAD = 255
SAMPLE_RATE = 48_000
FRAMES_A_BLOCK = 8
FRAMES_A_CLUSTER = 1024

# Matroska element ids.
EBML = 0x1A45DFA3
EBML_VERSION = 0x4286
EBML_READ_VERSION = 0x42F7
EBML_MAX_ID_LENGTH = 0x42F2
EBML_MAX_SIZE_LENGTH = 0x42F3
DOC_TYPE = 0x4282
DOC_TYPE_VERSION = 0x4287
DOC_TYPE_READ_VERSION = 0x4285
SEGMENT = 0x18538067
INFO = 0x1549A966
TIMESTAMP_SCALE = 0x2AD7B1
DURATION = 0x4489
MUXING_APP = 0x4D80
WRITING_APP = 0x5741
TRACKS = 0x1654AE6B
TRACK_ENTRY = 0xAE
TRACK_NUMBER = 0xD7
TRACK_UID = 0x73C5
TRACK_TYPE = 0x83
FLAG_LACING = 0x9C
DEFAULT_DURATION = 0x23E383
CODEC_ID = 0x86
AUDIO = 0xE1
SAMPLING_FREQUENCY = 0xB5
CHANNELS = 0x9F
BIT_DEPTH = 0x6264
CLUSTER = 0x1F43B675
TIMESTAMP = 0xE7
SIMPLE_BLOCK = 0xA3
BLOCK_GROUP = 0xA0
BLOCK = 0xA1
BLOCK_DURATION = 0x9B
CUES = 0x1C53BB6B
CUE_POINT = 0xBB
CUE_TIME = 0xB3
CUE_TRACK_POSITIONS = 0xB7
CUE_TRACK = 0xF7
CUE_CLUSTER_POSITION = 0xF1

MASTERS = {SEGMENT, CLUSTER, BLOCK_GROUP, TRACKS, TRACK_ENTRY, AUDIO, INFO, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES}

NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


class Packet(NamedTuple):
    cluster: int
    block: int
    track: int
    timestamp: int
    lacing: int
    keyframe: bool
    offset: int
    length: int


class Media(NamedTuple):
    packets: list[Packet]
    cues: list[tuple[int, int, int]]
    clusters: int
    timestamp_scale: int
    codec: str
    bit_depth: int
    duration: float


# writing ---------------------------------------------------------------------------------------


def vint(value: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones in a width means an unknown size and is avoided."""
    need = 1
    while value >= (1 << 7 * need) - 1:
        need += 1
    width = max(width, need)
    return ((1 << 7 * width) | value).to_bytes(width, "big")


def signed_vint(value: int) -> bytes:
    width = 1
    while not -((1 << 7 * width - 1) - 1) <= value <= (1 << 7 * width - 1) - 1:
        width += 1
    return ((1 << 7 * width) | (value + (1 << 7 * width - 1) - 1)).to_bytes(width, "big")


def element(ident: int, data: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def unsigned(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes], lacing: int) -> bytes:
    if lacing == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == EBML_LACING:
        head += vint(len(frames[0])) + b"".join(signed_vint(len(b) - len(a)) for a, b in zip(frames[:-2], frames[1:-1], strict=True))
    return head + b"".join(frames)


def mux(payload: bytes, frame: int = FRAME, frames_a_block: int = FRAMES_A_BLOCK, frames_a_cluster: int = FRAMES_A_CLUSTER) -> bytes:
    """A Matroska file whose only track carries ``payload``; the blocks go through the kinds of lacing in turn."""
    ms = frame * 1000 // SAMPLE_RATE or 1
    n = max(1, -(-len(payload) // frame))
    head = element(
        EBML,
        unsigned(EBML_VERSION, 1) + unsigned(EBML_READ_VERSION, 1) + unsigned(EBML_MAX_ID_LENGTH, 4) + unsigned(EBML_MAX_SIZE_LENGTH, 8)
        + element(DOC_TYPE, b"matroska") + unsigned(DOC_TYPE_VERSION, 4) + unsigned(DOC_TYPE_READ_VERSION, 2),
    )
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", float(n * ms))) + element(MUXING_APP, b"docloom") + element(WRITING_APP, b"docloom"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", float(SAMPLE_RATE))) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + unsigned(FLAG_LACING, 1) + unsigned(DEFAULT_DURATION, ms * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    parts, position, cues = [info, tracks], len(info) + len(tracks), []
    for base in range(0, n, frames_a_cluster):
        blocks = [unsigned(TIMESTAMP, base * ms)]
        for b, at in enumerate(range(base, min(n, base + frames_a_cluster), frames_a_block)):
            frames = [payload[k * frame : (k + 1) * frame] for k in range(at, min(n, base + frames_a_cluster, at + frames_a_block))]
            even = len({len(f) for f in frames}) == 1
            lacing = NO_LACING if len(frames) == 1 else (FIXED, XIPH, EBML_LACING)[b % 3] if even else (XIPH, EBML_LACING)[b % 2]
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", (at - base) * ms, 0x80 | lacing << 1) + _laced(frames, lacing)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, base * ms) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, position))))
        parts.append(cluster)
        position += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


# reading ---------------------------------------------------------------------------------------


def read_id(data: bytes, at: int) -> tuple[int, int]:
    first = data[at]
    if not first:
        raise ValueError(f"no element id at {at}")
    width = 9 - first.bit_length()
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_vint(data: bytes, at: int) -> tuple[int, int, int]:
    """Value without its marker, the place after it, and the width."""
    first = data[at]
    if not first:
        raise ValueError(f"a size of more than 8 bytes at {at}")
    width = 9 - first.bit_length()
    return int.from_bytes(data[at : at + width], "big") & ((1 << 7 * width) - 1), at + width, width


def _frame_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    if lacing == NO_LACING:
        return [end - at], at
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % count:
            raise ValueError("fixed lacing does not divide the block")
        return [(end - at) // count] * count, at
    if lacing == XIPH:
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif count > 1:
        value, at, _ = read_vint(data, at)
        sizes.append(value)
        for _ in range(count - 2):
            value, at, width = read_vint(data, at)
            sizes.append(sizes[-1] + value - ((1 << 7 * width - 1) - 1))
    sizes.append(end - at - sum(sizes))
    if sizes[-1] < 0:
        raise ValueError("laced frames are longer than their block")
    return sizes, at


def parse(data: bytes) -> Media:
    """The packets and cues of a Matroska file."""
    packets: list[Packet] = []
    cues: list[tuple[int, int, int]] = []
    durations: dict[int, int] = {}  # of a frame, in nanoseconds, by track
    state = {"track": 0, "frame": 0, "cluster": -1, "block": -1, "time": 0, "scale": 1_000_000, "codec": "", "depth": 0, "duration": 0.0, "segment": 0, "cue": [0, 0, 0]}

    def block(at: int, end: int, simple: bool) -> None:
        track, at, _ = read_vint(data, at)
        relative, flags = struct.unpack_from(">hB", data, at)
        lacing = flags >> 1 & 3
        sizes, at = _frame_sizes(data, at + 3, end, lacing)
        state["block"] += 1
        each = durations.get(track, 0)
        for i, size in enumerate(sizes):
            time = state["time"] + relative + i * each // state["scale"]
            packets.append(Packet(state["cluster"], state["block"], track, time, lacing, bool(flags & 0x80) if simple else True, at, size))
            at += size

    def spread(first: int, duration: int) -> None:
        """A block group's own duration goes before its track's."""
        n = len(packets) - first
        for i in range(1, n):
            packets[first + i] = packets[first + i]._replace(timestamp=packets[first].timestamp + i * duration // n)

    def walk(at: int, end: int, inside: int) -> int:
        while at < end:
            start = at
            ident, at = read_id(data, at)
            if inside == CLUSTER and (ident in TOP_LEVEL or ident == SEGMENT):
                return start  # a cluster of unknown size ends where the next one begins
            size, at, width = read_vint(data, at)
            unknown = size == (1 << 7 * width) - 1
            stop = end if unknown else at + size
            if stop > end:
                raise ValueError(f"element {ident:x} at {start} is cut off")
            if ident == SEGMENT:
                state["segment"] = at
            elif ident == CLUSTER:
                state["cluster"] += 1
            if ident in MASTERS:
                first = len(packets)
                state.update({BLOCK_GROUP: {"length": None}, TRACK_ENTRY: {"track": 0, "frame": 0}}.get(ident, {}))
                got = walk(at, stop, ident)
                if ident == CUE_POINT:
                    cues.append(tuple(state["cue"]))
                elif ident == TRACK_ENTRY and state["frame"]:
                    durations[state["track"]] = state["frame"]
                elif ident == BLOCK_GROUP and state["length"] is not None:
                    spread(first, state["length"])
                at = got if unknown else stop
                continue
            if ident == SIMPLE_BLOCK or ident == BLOCK:
                block(at, stop, ident == SIMPLE_BLOCK)
            elif ident == TIMESTAMP:
                state["time"] = int.from_bytes(data[at:stop], "big")
            elif ident in (TRACK_NUMBER, DEFAULT_DURATION, BLOCK_DURATION):
                state[{TRACK_NUMBER: "track", DEFAULT_DURATION: "frame", BLOCK_DURATION: "length"}[ident]] = int.from_bytes(data[at:stop], "big")
            elif ident == TIMESTAMP_SCALE:
                state["scale"] = int.from_bytes(data[at:stop], "big")
            elif ident == CODEC_ID:
                state["codec"] = data[at:stop].decode("ascii")
            elif ident == BIT_DEPTH:
                state["depth"] = int.from_bytes(data[at:stop], "big")
            elif ident == DURATION:
                state["duration"] = struct.unpack(">d" if size == 8 else ">f", data[at:stop])[0]
            elif ident in (CUE_TIME, CUE_TRACK, CUE_CLUSTER_POSITION):
                state["cue"][(CUE_TIME, CUE_TRACK, CUE_CLUSTER_POSITION).index(ident)] = int.from_bytes(data[at:stop], "big")
            at = stop
        return at

    if data[:4] != EBML.to_bytes(4, "big"):
        raise ValueError("no EBML header")
    walk(0, len(data), 0)
    segment = state["segment"]
    cues = [(time, track, position + segment) for time, track, position in cues]
    return Media(packets, cues, state["cluster"] + 1, state["scale"], state["codec"], state["depth"], state["duration"])


def demux(data: bytes, media: Media | None = None, track: int = 1) -> bytes:
    media = media or parse(data)
    return b"".join([data[p.offset : p.offset + p.length] for p in media.packets if p.track == track])


# columns ---------------------------------------------------------------------------------------


def padded(text: str | None, multiple: int = FRAME, pad: int = PAD) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(multiple, -(-len(raw) // multiple) * multiple)
    return len(raw), raw + bytes([pad]) * (size - len(raw))


def features(data: bytes, media: Media, payload: bytes) -> str:
    """Packets, blocks, clusters, cues that point at a cluster, duration in ms, and the samples' mean, deviation and crossings of the middle."""
    samples = np.frombuffer(payload, np.uint8)
    high = samples >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    good = sum(data[position : position + 4] == CLUSTER.to_bytes(4, "big") for _, _, position in media.cues)
    blocks = media.packets[-1].block + 1 if media.packets else 0
    return f"packets={len(media.packets)};blocks={blocks};clusters={media.clusters};cues={good};ms={media.duration:.0f};mean={samples.mean():.4f};std={samples.std():.4f};cross={crossings}"


def media_column(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each text's padded UTF-8 as a Matroska file."""
    kind = docs.schema[key].dataType.simpleString()

    def step(keys, texts) -> Iterator[tuple]:
        for k, t in zip(keys, texts, strict=True):
            n, payload = padded(t)
            yield k, n, mux(payload)

    return map_rows(docs.select(F.col(key), F.col(text).cast("string").alias("text")), [key, "text"], f"`{key}` {kind}, n_bytes long, media binary", step)


def digest(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads the stored bytes back: what was muxed, its hashes and its features."""
    kind = media.schema[key].dataType.simpleString()

    def step(keys, sizes, files) -> Iterator[tuple]:
        for k, n, data in zip(keys, sizes, files, strict=True):
            if data is None:
                yield k, n, *[None] * 6
                continue
            found = parse(data)
            payload = demux(data, found)
            yield k, n, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), sha256(data).hexdigest(), features(data, found, payload)

    return map_rows(media, [key, "n_bytes", "media"], f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", step)


def packet_table(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row a packet: timestamp, track, lacing and byte range in the file. A null file has no packets."""
    kind = media.schema[key].dataType.simpleString()

    def step(keys, files) -> Iterator[tuple]:
        for k, data in zip(keys, files, strict=True):
            if data is not None:
                yield from ((k, i, *packet) for i, packet in enumerate(parse(data).packets))

    return map_rows(media, [key, column], f"`{key}` {kind}, packet int, cluster int, block int, track int, timestamp long, lacing int, keyframe boolean, offset long, length long", step)
