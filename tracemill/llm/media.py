"""Matroska media columns: mux payloads, parse files into packet tables.

The parser walks EBML elements (variable-length ids and sizes, unknown sizes
included), reads clusters with SimpleBlocks and BlockGroups, undoes the three
kinds of lacing and collects the cues.  A packet is described by its track,
timestamp, flags and byte range in the file, so a reader can fetch any packet
without parsing again.

Null media give no packet rows; damaged media give one row whose ``error`` says
what was wrong and whose other packet columns are null.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from tracemill.llm.common import map_texts

# Element ids, fixed by the Matroska specification (RFC 9559).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
EBML_FIELDS = ((0x4286, 1), (0x42F7, 1), (0x42F2, 4), (0x42F3, 8), (0x4282, b"matroska"), (0x4287, 4), (0x4285, 2))

_PARENTS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
#: Elements that may stand directly in a Segment; they end a cluster of unknown size.
_TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

RATE = 8000
FRAME = 512
FRAMES_A_BLOCK = 8
BLOCKS_A_CLUSTER = 16


class MediaError(ValueError):
    """The bytes are not a readable Matroska file."""


# ------------------------------------------------------------------ writing


def size_vint(value: int, width: int = 0) -> bytes:
    """A size as a variable-length integer, in the least width or a given one."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes | int | float | str) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    elif isinstance(body, float):
        body = struct.pack(">d", body)
    elif isinstance(body, str):
        body = body.encode()
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size_vint(len(body)) + body


def lace(frames: list[bytes], kind: int) -> bytes:
    """Frames of one block behind their lacing header."""
    if kind == NO_LACING:
        return frames[0]
    sizes, head = [len(f) for f in frames], bytes([len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING:
        head += size_vint(sizes[0])
        for before, n in zip(sizes, sizes[1:-1]):
            step = n - before
            width = next(w for w in range(1, 9) if abs(step) < 1 << 7 * w - 1)
            head += size_vint(step + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """An 8-bit mono PCM Matroska file that holds ``payload`` as its samples.

    Frames of FRAME samples are laced into blocks; the lacing goes through
    none, Xiph, fixed and EBML so that every reader path is used.
    """
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    clusters, at, turn = [], 0, 0
    while at < len(frames):
        start = at * FRAME * 1000 // RATE
        blocks = [element(CLUSTER_TIMESTAMP, start)]
        while at < len(frames) and len(blocks) <= BLOCKS_A_CLUSTER:
            kind = (NO_LACING, XIPH, FIXED, EBML_LACING)[turn % 4]
            group = frames[at : at + (1 if kind == NO_LACING else FRAMES_A_BLOCK)]
            if len(group) == 1:
                kind = NO_LACING
            elif kind == FIXED and len(group[-1]) != len(group[0]):
                kind = EBML_LACING
            relative = at * FRAME * 1000 // RATE - start
            head = size_vint(1) + struct.pack(">hB", relative, 0x80 | kind << 1)
            blocks.append(element(SIMPLE_BLOCK, head + lace(group, kind)))
            at += len(group)
            turn += 1
        clusters.append((start, element(CLUSTER, b"".join(blocks))))
    info = element(INFO, element(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, "tracemill") + element(WRITING_APP, "tracemill") + element(DURATION, len(payload) * 1000 / RATE))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, float(RATE)) + element(CHANNELS, 1) + element(BIT_DEPTH, 8))
    entry = element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(FLAG_LACING, 1) + element(CODEC_ID, "A_PCM/INT/LIT")
    tracks = element(TRACKS, element(TRACK_ENTRY, entry + element(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + audio))
    body, cues, position = [info, tracks], [], len(info) + len(tracks)
    for start, cluster in clusters:
        place = element(CUE_TRACK, 1) + element(CUE_CLUSTER_POSITION, position)
        cues.append(element(CUE_POINT, element(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, place)))
        body.append(cluster)
        position += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    head = element(EBML, b"".join(element(k, v) for k, v in EBML_FIELDS))
    return head + element(SEGMENT, b"".join(body))


# ------------------------------------------------------------------ reading


@dataclass
class Packet:
    track: int
    timestamp_ms: float
    keyframe: bool
    lacing: int
    cluster: int
    offset: int
    size: int


@dataclass
class Media:
    packets: list[Packet] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, byte offset in the file
    scale: int = 1_000_000


def read_vint(data: bytes, at: int, end: int, keep_marker: bool = False) -> tuple[int, int, int]:
    """(value, next position, width) of the variable-length integer at ``at``."""
    if at >= end or not data[at]:
        raise MediaError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise MediaError(f"integer cut short at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    return value if keep_marker else value & (1 << 7 * width) - 1, at + width, width


def walk(data: bytes, at: int, end: int, parent: int = 0) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements in a range; an unknown size reaches to the next sibling."""
    while at < end:
        kind, body, _ = read_vint(data, at, end, True)
        if parent == CLUSTER and kind in _TOP:
            return
        size, body, width = read_vint(data, body, end)
        if size == (1 << 7 * width) - 1:
            stop = _unknown_end(data, body, end) if kind == CLUSTER else end
        else:
            stop = body + size
        if stop > end:
            raise MediaError(f"element {kind:#x} at byte {at} reaches beyond its parent")
        yield kind, body, stop
        at = stop


def _unknown_end(data: bytes, at: int, end: int) -> int:
    while at < end:
        kind, body, _ = read_vint(data, at, end, True)
        if kind in _TOP:
            return at
        size, body, _ = read_vint(data, body, end)
        at = body + size
    return end


def unlace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames of a block whose data are data[at:end]."""
    if kind == NO_LACING:
        return [(at, end - at)]
    if at >= end:
        raise MediaError(f"lacing header cut short at byte {at}")
    n, at, sizes = data[at] + 1, at + 1, []
    if kind == FIXED:
        if (end - at) % n:
            raise MediaError(f"fixed lacing does not divide the block at byte {at}")
        sizes = [(end - at) // n] * n
    else:
        for i in range(n - 1):
            if kind == XIPH:
                size = 0
                while at < end and data[at] == 255:
                    size, at = size + 255, at + 1
                if at >= end:
                    raise MediaError(f"lacing header cut short at byte {at}")
                size, at = size + data[at], at + 1
            else:
                value, at, width = read_vint(data, at, end)
                size = sizes[-1] + value - ((1 << 7 * width - 1) - 1) if i else value
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) > end:
        raise MediaError(f"laced sizes do not fit the block that ends at byte {end}")
    found = []
    for size in sizes:
        found.append((at, size))
        at += size
    return found


def demux(data: bytes) -> Media:
    """Packets, tracks, clusters and cues of a Matroska file."""
    media, end, segment = Media(), len(data), None
    for kind, at, stop in walk(data, 0, end):
        if kind == SEGMENT:
            segment = at
            for child, a, b in walk(data, at, stop):
                if child == INFO:
                    for k, x, y in walk(data, a, b):
                        if k == TIMESTAMP_SCALE:
                            media.scale = int.from_bytes(data[x:y], "big")
                elif child == TRACKS:
                    _tracks(data, a, b, media)
                elif child == CLUSTER:
                    _cluster(data, a, b, media)
                elif child == CUES:
                    _cues(data, a, b, media, segment)
    if segment is None:
        raise MediaError("no segment")
    return media


def _tracks(data: bytes, at: int, end: int, media: Media) -> None:
    for kind, a, b in walk(data, at, end):
        if kind != TRACK_ENTRY:
            continue
        entry: dict = {"frame_ms": 0.0}
        for k, x, y in walk(data, a, b):
            if k == TRACK_NUMBER:
                entry["number"] = int.from_bytes(data[x:y], "big")
            elif k == CODEC_ID:
                entry["codec"] = data[x:y].decode(errors="replace")
            elif k == DEFAULT_DURATION:
                entry["frame_ms"] = int.from_bytes(data[x:y], "big") / 1e6
        media.tracks[entry.get("number", 0)] = entry


def _cluster(data: bytes, at: int, end: int, media: Media) -> None:
    base, index = 0, len(media.clusters)
    media.clusters.append(at)
    for kind, a, b in walk(data, at, end, CLUSTER):
        if kind == CLUSTER_TIMESTAMP:
            base = int.from_bytes(data[a:b], "big")
        elif kind == SIMPLE_BLOCK:
            _block(data, a, b, media, base, index, None)
        elif kind == BLOCK_GROUP:
            parts = list(walk(data, a, b))
            key = all(k != 0xFB for k, _, _ in parts)  # no reference block: a key frame
            for k, x, y in parts:
                if k == BLOCK:
                    _block(data, x, y, media, base, index, key)


def _block(data: bytes, at: int, end: int, media: Media, base: int, index: int, key: bool | None) -> None:
    track, at, _ = read_vint(data, at, end)
    if at + 3 > end:
        raise MediaError(f"block cut short at byte {at}")
    relative, flags = struct.unpack(">hB", data[at : at + 3])
    kind = flags >> 1 & 3
    step = media.tracks.get(track, {}).get("frame_ms", 0.0)
    start = (base + relative) * media.scale / 1e6
    for i, (offset, size) in enumerate(unlace(data, at + 3, end, kind)):
        media.packets.append(Packet(track, start + i * step, bool(flags & 0x80) if key is None else key, kind, index, offset, size))


def _cues(data: bytes, at: int, end: int, media: Media, segment: int) -> None:
    for kind, a, b in walk(data, at, end):
        time, places = 0, []
        for k, x, y in walk(data, a, b):
            if k == CUE_TIME:
                time = int.from_bytes(data[x:y], "big")
            elif k == CUE_TRACK_POSITIONS:
                place = {i: int.from_bytes(data[p:q], "big") for i, p, q in walk(data, x, y)}
                places.append((place.get(CUE_TRACK, 0), segment + place.get(CUE_CLUSTER_POSITION, 0)))
        media.cues += [(time, track, where) for track, where in places]


# ------------------------------------------------------------------ operators


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of a text and zero bytes up to a positive multiple of 64; the unpadded length."""
    raw = (text or "").encode()
    return raw + bytes(max(64, -len(raw) % 64 + len(raw)) - len(raw)), len(raw)


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A ``media`` BINARY column for each row; a null text is stored as an empty one."""

    def make():
        def apply(batch: pa.RecordBatch) -> dict:
            texts = batch.column(1).to_pylist()
            found = [padded(t) for t in texts]
            return {"doc_id": batch.column(0), "n_bytes": [n for _, n in found], "media": [mux(p) for p, _ in found]}

        return apply

    picked = [docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")]
    return map_texts(docs, picked, "text", "doc_id long, n_bytes long, media binary", make)


def packet_table(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row for each packet: track, timestamp, flags and byte range."""
    kind = media.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, packet int, track int, timestamp_ms double, keyframe boolean, lacing int, cluster int, byte_offset long, byte_size long, error string"
    names = ["packet", "track", "timestamp_ms", "keyframe", "lacing", "cluster", "byte_offset", "byte_size", "error"]

    def make():
        def apply(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {n: [] for n in [key, *names]}
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data is None:
                    continue
                try:
                    rows = [(i, p.track, p.timestamp_ms, p.keyframe, p.lacing, p.cluster, p.offset, p.size, None) for i, p in enumerate(demux(data).packets)]
                except MediaError as e:
                    rows = [(None,) * 8 + (str(e),)]
                for row in rows:
                    out[key].append(k)
                    for n, v in zip(names, row):
                        out[n].append(v)
            return out

        return apply

    return map_texts(media, [media[key], media[column].alias("_media")], "_media", schema, make)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets int, n_clusters int"


def digest(data: bytes) -> dict:
    """What one stored file yields when it is read back through its packet table."""
    media = demux(data)
    payload = b"".join(data[p.offset : p.offset + p.size] for p in media.packets)
    kinds = [sum(p.lacing == k for p in media.packets) for k in range(4)]
    seekable = all(where in {c - _head(data, c) for c in media.clusters} for _, _, where in media.cues)
    half = sum(payload[::2])
    feature = f"packets={len(media.packets)};clusters={len(media.clusters)};lacing={'/'.join(map(str, kinds))};cues={len(media.cues)};seek={int(seekable)};last_ms={media.packets[-1].timestamp_ms:.0f};sum={sum(payload)};even={half};max={max(payload)}"
    return {
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-64:]),
        "media_bytes": len(data),
        "media_sha256": hashlib.sha256(data).hexdigest(),
        "feature": feature,
        "n_packets": len(media.packets),
        "n_clusters": len(media.clusters),
    }


def _head(data: bytes, body: int) -> int:
    """Bytes of id and size in front of a cluster's body."""
    return next(4 + w for w in range(1, 9) if body >= 4 + w and data[body - 4 - w : body - w] == CLUSTER.to_bytes(4, "big") and 9 - data[body - w].bit_length() == w)


def media_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as Matroska, read the file back and return its digest.

    One row a document.  Null and empty texts are stored as 64 zero bytes;
    repeated rows repeat their result; columns beside id and text are ignored.
    """

    def make():
        def apply(batch: pa.RecordBatch) -> dict:
            rows = []
            for t in batch.column(1).to_pylist():
                payload, n = padded(t)
                rows.append(digest(mux(payload)) | {"n_bytes": n})
            return {"doc_id": batch.column(0)} | {k: [r[k] for r in rows] for k in rows[0]}

        return apply

    picked = [docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")]
    return map_texts(docs, picked, "text", DIGEST, make)
