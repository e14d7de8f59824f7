"""Matroska as a media column: a writer and a parser of EBML, clusters, lacing and cues.

``parse`` reads a file into packet rows (track, timestamp, cluster, lacing,
byte range), track rows and cue rows.  It knows sizes of 1 to 8 bytes, unknown
sizes of segments and clusters, simple blocks and block groups, and no, Xiph,
EBML and fixed-size lacing; unknown elements are stepped over.  ``mux`` writes
8-bit mono PCM: frames of ``FRAME`` bytes, up to eight in a block (fixed-size
lacing where equal, else EBML lacing), clusters of up to sixteen blocks, and
one cue a cluster.  Nothing in a file depends on time or chance.

Defined cases: null text counts as empty, whose payload is 64 zero bytes; a null
doc_id stays null; repeated rows give repeated rows; an empty table gives no
rows; other columns are not read; a damaged file raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, read, spark_schema

#: Element ids of the format.
EBML, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, LACING, FRAME_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383
AUDIO, RATE, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
#: Fixed: elements that end a cluster or segment of unknown size.
TOP_LEVEL = (CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469)

FRAME, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER, SAMPLE_RATE = 1024, 8, 16, 8000


# --- writing ---------------------------------------------------------------

def element_id(number: int) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big")


def size_bytes(value: int, width: int = 0) -> bytes:
    """A variable-length size in its shortest form, or in ``width`` bytes; all ones is reserved."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(number: int, body: bytes) -> bytes:
    return element_id(number) + size_bytes(len(body)) + body


def unsigned(number: int, value: int) -> bytes:
    return element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced_block(track: int, relative: int, frames: list[bytes], lacing: str = "", flags: int = 0x80) -> bytes:
    """The body of a block; lacing: none, xiph, ebml or fixed (default: none for one frame, fixed if equal, else ebml)."""
    sizes = [len(f) for f in frames]
    lacing = lacing or ("none" if len(frames) == 1 else "fixed" if len(set(sizes)) == 1 else "ebml")
    code = {"none": 0, "xiph": 1, "fixed": 2, "ebml": 3}[lacing]
    head = size_bytes(track) + struct.pack(">hB", relative, flags | code << 1)
    if lacing == "none":
        return head + frames[0]
    head += bytes([len(frames) - 1])
    if lacing == "xiph":
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif lacing == "ebml":
        head += size_bytes(sizes[0])
        for before, s in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(s - before) < (1 << 7 * w - 1) - 1)
            head += size_bytes(s - before + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


_HEADER = element(EBML, unsigned(0x4286, 1) + unsigned(0x42F7, 1) + unsigned(0x42F2, 4) + unsigned(0x42F3, 8) + element(DOC_TYPE, b"matroska") + unsigned(DOC_VERSION, 4) + unsigned(DOC_READ_VERSION, 2))
_TRACKS = element(TRACKS, element(TRACK, unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + unsigned(LACING, 1) + unsigned(FRAME_DURATION, FRAME * 1_000_000_000 // SAMPLE_RATE) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))))


def mux(payload: bytes) -> bytes:
    """8-bit mono PCM at 8 kHz as a Matroska file."""
    milliseconds = lambda at: at * 1000 // SAMPLE_RATE
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / SAMPLE_RATE)) + element(MUXER, b"strandlake") + element(WRITER, b"strandlake"))
    parts, cues, at = [info, _TRACKS], [], len(info) + len(_TRACKS)
    per_block, per_cluster = FRAME * FRAMES_A_BLOCK, FRAME * FRAMES_A_BLOCK * BLOCKS_A_CLUSTER
    for c in range(0, len(payload), per_cluster):
        begin = milliseconds(c)
        body = [unsigned(TIMESTAMP, begin)]
        for b in range(c, min(c + per_cluster, len(payload)), per_block):
            chunk = payload[b : min(b + per_block, c + per_cluster)]
            body.append(element(SIMPLE_BLOCK, laced_block(1, milliseconds(b) - begin, [chunk[i : i + FRAME] for i in range(0, len(chunk), FRAME)])))
        cues.append(element(CUE, unsigned(CUE_TIME, begin) + element(CUE_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER, at) + unsigned(CUE_RELATIVE, len(body[0])))))
        cluster = element(CLUSTER, b"".join(body))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEADER + element(SEGMENT, b"".join(parts))


# --- reading ---------------------------------------------------------------

def read_id(data: bytes, at: int) -> tuple[int, int]:
    width = 9 - data[at].bit_length() if at < len(data) else 9
    if width > 4 or at + width > len(data):
        raise ValueError(f"no element id at byte {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """The value (None: unknown) and the next byte's place."""
    width = 9 - data[at].bit_length() if at < len(data) else 9
    if width > 8 or at + width > len(data):
        raise ValueError(f"no size at byte {at}")
    value = int.from_bytes(data[at : at + width], "big") & ((1 << 7 * width) - 1)
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def elements(data: bytes, at: int, end: int, closing: tuple[int, ...] = ()):
    """(id, body start, body end, start) of the elements in a range; stops before an id in ``closing``."""
    while at < end:
        start = at
        number, at = read_id(data, at)
        if number in closing:
            return
        size, body = read_size(data, at)
        if size is None:
            if number not in (SEGMENT, CLUSTER):
                raise ValueError(f"element {number:x} has no size")
            at = end if number == SEGMENT else max([body, *(e for _, _, e, _ in elements(data, body, end, TOP_LEVEL))])
        else:
            at = body + size
        if at > end:
            raise ValueError(f"element {number:x} at byte {start} passes its parent's end")
        yield number, body, at, start


def number_in(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def real_in(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0


def frames_of(data: bytes, a: int, b: int) -> tuple[int, int, int, str, list[tuple[int, int]]]:
    """track, relative timestamp, flags, lacing and byte ranges of the frames of the block body data[a:b]."""
    track, at = read_size(data, a)
    if at + 3 > b or track is None:
        raise ValueError(f"block at byte {a} is cut off")
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = ("none", "xiph", "fixed", "ebml")[flags >> 1 & 3]
    if lacing == "none":
        return track, relative, flags, lacing, [(at, b)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == "fixed":
        if (b - at) % count:
            raise ValueError(f"block at byte {a}: frames of unequal size")
        sizes = [(b - at) // count] * count
    else:
        for i in range(count - 1):
            if lacing == "xiph":
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            else:
                value, after = read_size(data, at)
                if value is None:
                    raise ValueError(f"block at byte {a}: reserved lace size")
                size = value if i == 0 else sizes[-1] + value - ((1 << 7 * (after - at) - 1) - 1)
                at = after
            sizes.append(size)
        sizes.append(b - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"block at byte {a}: frames pass its end")
    ranges = []
    for size in sizes:
        ranges.append((at, at + size))
        at += size
    return track, relative, flags, lacing, ranges


def parse(data: bytes) -> dict:
    """{"doc_type", "timestamp_scale", "duration", "tracks", "packets", "cues"}.

    packets: (track, timestamp in scale units, cluster, lacing, frame in block,
    keyframe, start, size, duration or None); cues: (time, track, cluster
    position, relative position), positions as bytes after the segment's start.
    """
    out: dict = {"doc_type": None, "timestamp_scale": 1_000_000, "duration": None, "tracks": [], "packets": [], "cues": [], "clusters": []}
    for number, a, b, _ in elements(data, 0, len(data)):
        if number == EBML:
            for n, x, y, _ in elements(data, a, b):
                if n == DOC_TYPE:
                    out["doc_type"] = data[x:y].rstrip(b"\0").decode("ascii")
        elif number == SEGMENT:
            _segment(data, a, b, out)
    if out["doc_type"] is None:
        raise ValueError("no EBML header")
    return out


def _segment(data: bytes, a: int, b: int, out: dict) -> None:
    for number, x, y, start in elements(data, a, b):
        if number == INFO:
            for n, p, q, _ in elements(data, x, y):
                if n == TIMESTAMP_SCALE:
                    out["timestamp_scale"] = number_in(data, p, q)
                elif n == DURATION:
                    out["duration"] = real_in(data, p, q)
        elif number == TRACKS:
            out["tracks"] += [_track(data, p, q) for n, p, q, _ in elements(data, x, y) if n == TRACK]
        elif number == CLUSTER:
            _cluster(data, x, y, out)
            out["clusters"].append(start - a)
        elif number == CUES:
            for n, p, q, _ in elements(data, x, y):
                if n == CUE:
                    out["cues"] += _cue(data, p, q)


def _track(data: bytes, a: int, b: int) -> dict:
    found = {"number": 0, "type": 0, "codec": "", "rate": 8000.0, "channels": 1, "bit_depth": None, "frame_ns": 0}
    for n, p, q, _ in elements(data, a, b):
        if n == TRACK_NUMBER:
            found["number"] = number_in(data, p, q)
        elif n == TRACK_TYPE:
            found["type"] = number_in(data, p, q)
        elif n == FRAME_DURATION:
            found["frame_ns"] = number_in(data, p, q)
        elif n == CODEC:
            found["codec"] = data[p:q].rstrip(b"\0").decode("ascii")
        elif n == AUDIO:
            for m, s, t, _ in elements(data, p, q):
                if m == RATE:
                    found["rate"] = real_in(data, s, t)
                elif m == CHANNELS:
                    found["channels"] = number_in(data, s, t)
                elif m == BIT_DEPTH:
                    found["bit_depth"] = number_in(data, s, t)
    return found


def _cluster(data: bytes, a: int, b: int, out: dict) -> None:
    begin, index = 0, len(out["clusters"])
    frame_ns = {t["number"]: t["frame_ns"] for t in out["tracks"]}
    lag = lambda track, i: i * frame_ns.get(track, 0) // out["timestamp_scale"]
    for n, p, q, _ in elements(data, a, b):
        if n == TIMESTAMP:
            begin = number_in(data, p, q)
        elif n == SIMPLE_BLOCK:
            track, relative, flags, lacing, ranges = frames_of(data, p, q)
            out["packets"] += [(track, begin + relative + lag(track, i), index, lacing, i, bool(flags & 0x80), s, e - s, None) for i, (s, e) in enumerate(ranges)]
        elif n == BLOCK_GROUP:
            inner = {m: (s, e) for m, s, e, _ in elements(data, p, q)}
            if BLOCK in inner:
                track, relative, flags, lacing, ranges = frames_of(data, *inner[BLOCK])
                lasts = number_in(data, *inner[BLOCK_DURATION]) if BLOCK_DURATION in inner else None
                out["packets"] += [(track, begin + relative + lag(track, i), index, lacing, i, REFERENCE not in inner, s, e - s, lasts) for i, (s, e) in enumerate(ranges)]


def _cue(data: bytes, a: int, b: int) -> list[tuple]:
    time, places = 0, []
    for n, p, q, _ in elements(data, a, b):
        if n == CUE_TIME:
            time = number_in(data, p, q)
        elif n == CUE_POSITIONS:
            inner = {m: number_in(data, s, e) for m, s, e, _ in elements(data, p, q)}
            places.append((inner.get(CUE_TRACK), inner.get(CUE_CLUSTER), inner.get(CUE_RELATIVE)))
    return [(time, *place) for place in places]


def payload_of(data: bytes, parsed: dict, track: int = 1) -> bytes:
    return b"".join([data[s : s + n] for t, _, _, _, _, _, s, n, _ in parsed["packets"] if t == track])


# --- on tables -------------------------------------------------------------

def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes((-len(raw)) % 64 if raw else 64)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text), media (a Matroska file with the padded text as samples)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            pairs = [padded(t) for t in batch.column("text").to_pylist()]
            step = 512
            for i in range(0, len(pairs), step):
                part = pairs[i : i + step]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, len(part)), pa.array([n for n, _ in part], pa.int64()), pa.array([mux(p) for _, p in part], pa.binary())], names=["doc_id", "n_bytes", "media"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, n_bytes long, media binary")


PACKET_FIELDS = "doc_id long, track long, timestamp long, cluster long, lacing string, frame long, keyframe boolean, start long, size long, duration long"


def packet_table(media: DataFrame) -> DataFrame:
    """One row per frame of the column ``media``: PACKET_FIELDS."""
    schema = arrow_schema(PACKET_FIELDS)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()):
                if data is not None and (rows := parse(data)["packets"]):
                    columns = [[doc_id] * len(rows), *map(list, zip(*rows))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return media.select("doc_id", "media").mapInArrow(run, spark_schema(PACKET_FIELDS))


FEATURE_FIELDS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(payload: bytes, parsed: dict) -> str:
    import numpy as np

    x = np.frombuffer(payload, dtype=np.uint8)
    steps = np.diff(x.view(np.int8).astype(np.int16))
    quarters = np.bincount(x >> 6, minlength=4)
    last = parsed["packets"][-1]
    return f"packets={len(parsed['packets'])};clusters={len(parsed['clusters'])};cues={len(parsed['cues'])};last_ms={last[1]};sum={int(x.sum(dtype=np.int64))};peak={int(x.max())};travel={int(np.abs(steps).sum(dtype=np.int64))};quarters={'/'.join(map(str, quarters.tolist()))}"


def media_features(media: DataFrame) -> DataFrame:
    """FEATURE_FIELDS from the stored files: each is parsed and its payload put together from its packets."""
    schema = arrow_schema(FEATURE_FIELDS)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for doc_id, n_bytes, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                parsed = parse(data)
                payload = payload_of(data, parsed)
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(payload, parsed)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, spark_schema(FEATURE_FIELDS))


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store(read(spark, sf_dir, "documents")))
