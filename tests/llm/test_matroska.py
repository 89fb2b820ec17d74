import random
import struct
import zlib
from hashlib import sha256

import pytest

from docloom.llm import matroska as M


@pytest.mark.parametrize("value", [0, 1, 126, 127, 128, 16382, 16383, 1 << 20, (1 << 35) + 7])
def test_variable_length_integers(value):
    raw = M.vint(value)
    assert M.read_vint(raw, 0)[:2] == (value, len(raw))


@pytest.mark.parametrize("lacing", [M.XIPH, M.EBML_LACING])
def test_lacing_of_uneven_frames(lacing):
    frames = [bytes([i]) * n for i, n in enumerate([300, 1, 0, 255, 700, 256])]
    block = M._laced(frames, lacing)
    sizes, at = M._frame_sizes(block, 0, len(block), lacing)
    assert sizes == [len(f) for f in frames] and block[at:] == b"".join(frames)


@pytest.mark.parametrize("n", [1, 576, 577, 576 * 8, 576 * 9 + 5, 576 * 3000])
def test_mux_and_demux(n):
    payload = random.Random(n).randbytes(n)
    data = M.mux(payload)
    media = M.parse(data)
    assert M.demux(data, media) == payload and media.codec == "A_PCM/INT/LIT" and media.bit_depth == 8
    assert [p.timestamp for p in media.packets] == [12 * i for i in range(len(media.packets))]
    assert all(data[at : at + 4] == M.CLUSTER.to_bytes(4, "big") for _, _, at in media.cues) and len(media.cues) == media.clusters


def test_unknown_sizes_block_groups_and_void():
    block = b"\x81" + struct.pack(">hB", 5, 0) + b"abc"
    cluster = M.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + M.unsigned(M.TIMESTAMP, 100) + M.element(0xEC, b"void") + M.element(M.BLOCK_GROUP, M.element(M.BLOCK, block))
    data = M.element(M.EBML, b"") + M.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster + cluster
    media = M.parse(data)
    assert media.clusters == 2 and [(p.cluster, p.timestamp, data[p.offset : p.offset + p.length]) for p in media.packets] == [(0, 105, b"abc"), (1, 105, b"abc")]


def test_durations_of_laced_frames():
    laced = b"\x81" + struct.pack(">hB", 5, M.FIXED << 1) + b"\x02abcabcabc"
    group = M.element(M.BLOCK_GROUP, M.element(M.BLOCK, laced) + M.unsigned(M.BLOCK_DURATION, 30))
    tracks = M.element(M.TRACKS, M.element(M.TRACK_ENTRY, M.unsigned(M.TRACK_NUMBER, 1) + M.unsigned(M.DEFAULT_DURATION, 7_000_000)))
    data = M.element(M.EBML, b"") + M.element(M.SEGMENT, tracks + M.element(M.CLUSTER, M.unsigned(M.TIMESTAMP, 100) + M.element(M.SIMPLE_BLOCK, laced) + group + M.element(M.BLOCK_GROUP, M.element(M.BLOCK, laced))))
    assert [p.timestamp for p in M.parse(data).packets] == [105, 112, 119, 105, 115, 125, 105, 112, 119]


def test_damaged_files_are_told():
    with pytest.raises(ValueError):
        M.parse(b"RIFF")
    with pytest.raises(ValueError):
        M.parse(M.mux(b"x" * 5000)[:-40])


def test_digest_of_the_column(odd):
    rows = M.digest(M.media_column(odd)).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id is None:
            continue
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert len({r.media_sha256 for r in rows if r.doc_id in (4, 5)}) == 1
    assert M.media_column(odd.limit(0)).count() == 0
    none = odd.limit(1).selectExpr("doc_id", "0L as n_bytes", "cast(null as binary) as media", "1 as packet")
    assert [tuple(r)[2:] for r in M.digest(none).collect()] == [(None,) * 6] and M.packet_table(none).count() == 0
    table = M.packet_table(M.media_column(odd.where("doc_id = 6")))
    assert table.agg({"length": "sum"}).first()[0] == [r for r in rows if r.doc_id == 6][0].payload_bytes
