"""Matroska media columns: bytes stored as 8-bit PCM tracks, and packet tables read from EBML.

The reader knows elements of variable length, unknown sizes, clusters, simple blocks and
block groups, the three lacings and cues; elements that it doesn't know are passed over.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packaudit.llm.common import slices

# Element ids of the Matroska specification
EBML, DOC_TYPE, SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
DEFAULT_DURATION = 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

#: Payload bytes are padded to a multiple of this.
UNIT = 64
#: Bytes of a frame, frames of a block, blocks of a cluster; samples a second.
FRAME, LACED, BLOCKS, RATE = 512, 8, 16, 8000

NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


def _id(element: int) -> bytes:
    return element.to_bytes((element.bit_length() + 7) // 8, "big")


def _size(n: int) -> bytes:
    width = 1
    while n >= (1 << (7 * width)) - 1:
        width += 1
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def _element(element: int, *body: bytes) -> bytes:
    data = b"".join(body)
    return _id(element) + _size(len(data)) + data


def _uint(element: int, n: int) -> bytes:
    return _element(element, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _signed(n: int) -> bytes:
    """A difference of EBML lacing: a size with an offset that makes it positive."""
    width = 1
    while abs(n) >= (1 << (7 * width - 1)) - 1:
        width += 1
    return (n + (1 << (7 * width - 1)) - 1 | 1 << (7 * width)).to_bytes(width, "big")


def _block(frames: list[bytes], relative: int, kind: int) -> bytes:
    """A simple block of track 1; laced where it has several frames."""
    sizes = [len(f) for f in frames]
    if len(frames) == 1:
        kind, head = NO_LACING, b""
    elif kind == FIXED and len(set(sizes)) == 1:
        head = bytes([len(frames) - 1])
    elif kind == XIPH:
        head = bytes([len(frames) - 1]) + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    else:
        kind = EBML_LACING
        head = bytes([len(frames) - 1]) + _size(sizes[0]) + b"".join(_signed(b - a) for a, b in zip(sizes[:-2], sizes[1:-1], strict=True))
    return _element(SIMPLE_BLOCK, b"\x81", struct.pack(">hB", relative, 0x80 | kind << 1), head, *frames)


def mux(payload: bytes) -> bytes:
    """A file with one track of unsigned 8-bit samples; blocks take the three lacings in turn."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000), _element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)))
    audio = _element(AUDIO, _element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)), _uint(CHANNELS, 1), _uint(BIT_DEPTH, 8))
    tracks = _element(
        TRACKS,
        _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1), _uint(TRACK_UID, 1), _uint(TRACK_TYPE, 2), _uint(FLAG_LACING, 1), _uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE), _element(CODEC_ID, b"A_PCM/INT/LIT"), audio),
    )
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    for c in range(0, len(frames), LACED * BLOCKS):
        start = c * FRAME * 1000 // RATE
        blocks = [
            _block(frames[b : b + LACED], b * FRAME * 1000 // RATE - start, (b // LACED) % 3 + 1)
            for b in range(c, min(c + LACED * BLOCKS, len(frames)), LACED)
        ]
        cluster = _element(CLUSTER, _uint(TIMESTAMP, start), *blocks)
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, start), _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1), _uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    return _element(EBML, _element(DOC_TYPE, b"matroska")) + _element(SEGMENT, *parts, _element(CUES, *cues))


def _vint(data: bytes, at: int, marker: bool) -> tuple[int, int]:
    """(value, next position); an id keeps its length marker. All data bits set: an unknown size, -1."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"no variable-length integer at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if not marker:
        value &= (1 << (7 * width)) - 1
        if value == (1 << (7 * width)) - 1:
            value = -1
    return value, at + width


def _elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of the element, start of its body, end of its body) of each element."""
    while at < end:
        start = at
        element, at = _vint(data, at, True)
        size, at = _vint(data, at, False)
        stop = end if size < 0 else at + size
        if size < 0 and element == CLUSTER:  # ends where the next top-level element begins
            stop = at
            while stop < end and not any(data.startswith(_id(x), stop) for x in (CLUSTER, CUES, INFO, TRACKS)):
                _, body = _vint(data, stop, True)
                n, body = _vint(data, body, False)
                stop = body + n
        if stop > end and element not in (SEGMENT, CLUSTER, BLOCK_GROUP):
            raise ValueError(f"the element at byte {start} ends beyond its parent")
        # of a container that is cut off, what is there is read first
        yield element, start, at, min(stop, end)
        if stop > end:
            raise ValueError(f"the element at byte {start} is cut off")
        at = stop


def _number(data: bytes, at: int, stop: int) -> int:
    return int.from_bytes(data[at:stop], "big")


def _laced(data: bytes, at: int, stop: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of each frame of a block's body."""
    if kind == NO_LACING:
        return [(at, stop - at)]
    n, at = data[at], at + 1
    if kind == FIXED:
        size = (stop - at) // (n + 1)
        return [(at + i * size, size) for i in range(n + 1)]
    sizes: list[int] = []
    for i in range(n):
        if kind == XIPH:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            before = at
            size, at = _vint(data, at, False)
            if i:
                size += sizes[-1] - (1 << (7 * (at - before) - 1)) + 1
        sizes.append(size)
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return [*out, (at, stop - at)]


def parse(data: bytes) -> dict:
    """Tracks, packets, cues and clusters of a file; what can't be read ends the tables, with an `error`.

    packets: (track, timestamp_ms, byte offset, bytes, lacing, cluster's position in the segment).
    The frames of a laced block follow one another at the track's default duration, if it states one.
    """
    out: dict = {"tracks": [], "packets": [], "cues": [], "clusters": 0, "error": None}
    scale, packets = 1_000_000, out["packets"]
    frame_ns: dict[int, int] = {}  # of each track that states it
    try:
        for top, _, top_at, top_stop in _elements(data, 0, len(data)):
            if top != SEGMENT:
                continue
            for element, start, at, stop in _elements(data, top_at, top_stop):
                if element == INFO:
                    scale = next((_number(data, a, s) for e, _, a, s in _elements(data, at, stop) if e == TIMESTAMP_SCALE), scale)
                elif element == TRACKS:
                    for _, _, a, s in (x for x in _elements(data, at, stop) if x[0] == TRACK_ENTRY):
                        own = {e: data[b:t] for e, _, b, t in _elements(data, a, s)}
                        number = int.from_bytes(own.get(TRACK_NUMBER, b""), "big")
                        frame_ns[number] = int.from_bytes(own.get(DEFAULT_DURATION, b""), "big")
                        out["tracks"].append((int.from_bytes(own.get(TRACK_NUMBER, b""), "big"), own.get(CODEC_ID, b"").decode("latin1")))
                elif element == CLUSTER:
                    out["clusters"] += 1
                    base = 0
                    for e, _, a, s in _elements(data, at, stop):
                        if e == TIMESTAMP:
                            base = _number(data, a, s)
                            continue
                        if e == BLOCK_GROUP:
                            e, a, s = next(((x, b, t) for x, _, b, t in _elements(data, a, s) if x == BLOCK), (0, 0, 0))
                        if e not in (SIMPLE_BLOCK, BLOCK):
                            continue
                        track, a = _vint(data, a, False)
                        relative, flags = struct.unpack_from(">hB", data, a)
                        kind = flags >> 1 & 3
                        time = (base + relative) * scale // 1_000_000
                        step = frame_ns.get(track, 0)
                        packets += [(track, time + i * step // 1_000_000, offset, size, kind, start - top_at) for i, (offset, size) in enumerate(_laced(data, a + 3, s, kind))]
                elif element == CUES:
                    for _, _, a, s in _elements(data, at, stop):
                        time, places = 0, []
                        for e, _, b, t in _elements(data, a, s):
                            if e == CUE_TIME:
                                time = _number(data, b, t)
                            elif e == CUE_TRACK_POSITIONS:
                                own = {x: _number(data, y, z) for x, _, y, z in _elements(data, b, t)}
                                places.append((own.get(CUE_TRACK, 0), own.get(CUE_CLUSTER_POSITION, 0)))
                        out["cues"] += [(time * scale // 1_000_000, *p) for p in places]
    except (ValueError, IndexError, struct.error) as e:
        out["error"] = str(e)
    return out


PACKET = "struct<track:bigint,timestamp_ms:bigint,offset:bigint,size:bigint,lacing:int,cluster:bigint>"
CUE = "struct<timestamp_ms:bigint,track:bigint,cluster:bigint>"
_PACKET = pa.struct([("track", pa.int64()), ("timestamp_ms", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("lacing", pa.int32()), ("cluster", pa.int64())])
_CUE = pa.struct([("timestamp_ms", pa.int64()), ("track", pa.int64()), ("cluster", pa.int64())])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, zeros up to a positive multiple of 64, as a file.

    A null text counts as empty (64 zeros). Nulls in the id and repeated rows stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            files = [mux(t + bytes(-len(t) % UNIT if t else UNIT)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"]
            )

    rows = docs.select(docs[id_col].cast("long").alias("_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_t"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """stored with tables read from the media column: packets, cues, and what the packets hold.

    Adds packets and cues (arrays, in file order), payload (the packets' byte ranges of the first
    track, joined), feature (counts as text) and media_error (null if the whole file was read).
    A null or broken file has what could be read before the fault.
    """
    kept = [c for c in stored.columns if c not in ("packets", "cues", "payload", "feature", "media_error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, files in slices(batches, media_col):
            rows = [parse(f) for f in files]
            payloads, features = [], []
            for f, r in zip(files, rows, strict=True):
                first = r["packets"][0][0] if r["packets"] else None
                payloads.append(b"".join([f[o : o + n] for t, _, o, n, _, _ in r["packets"] if t == first]))
                kinds = [sum(p[4] == k for p in r["packets"]) for k in range(4)]
                features.append(
                    f"tracks={len(r['tracks'])};clusters={r['clusters']};cues={len(r['cues'])};packets={len(r['packets'])};"
                    f"laced={','.join(map(str, kinds))};last_ms={r['packets'][-1][1] if r['packets'] else -1};"
                    f"largest={max((p[3] for p in r['packets']), default=0)}"
                )
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(batch.schema.get_field_index(c)) for c in kept),
                    pa.array([r["packets"] for r in rows], pa.list_(_PACKET)),
                    pa.array([r["cues"] for r in rows], pa.list_(_CUE)),
                    pa.array(payloads, pa.binary()),
                    pa.array(features, pa.string()),
                    pa.array([r["error"] for r in rows], pa.string()),
                ],
                names=[*kept, "packets", "cues", "payload", "feature", "media_error"],
            )

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in stored.schema if f.name in kept)
    filled = stored.withColumn(media_col, F.coalesce(F.col(media_col), F.lit(b"")))
    return filled.select(kept).mapInArrow(run, f"{fields}packets array<{PACKET}>, cues array<{CUE}>, payload binary, feature string, media_error string")


def packet_table(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per packet of a table that read() returned: id, its place, timestamp, track and byte range."""
    return media.select(id_col, F.posexplode("packets").alias("packet", "_p")).select(id_col, "packet", "_p.*")


def media_columns(docs: DataFrame) -> DataFrame:
    """The stored texts and what is read back from them, one row per document."""
    return read(store(docs))
