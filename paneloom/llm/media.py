"""ISO base media files: write a payload as fixed-size samples of one track, and index a file by walking its nested
boxes and decoding its sample tables. Payload bytes are never decoded to learn codec, duration or keyframe ranges.

Defined results: a NULL text is the empty text; the empty text is stored as one sample of zeros; NULL or malformed
media give NULL index columns and the reason in `error`, as do fragmented files; `index` reads the first track, `read_index` any; repeated rows give repeated results; only the named columns
are read, so further columns never clash.
"""

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paneloom.llm.common import small_batches

UNIT = 64            # bytes of one sample
CHUNK = 256          # samples of one chunk
SYNC = 16            # one sample in so many is listed as a point of random access
RATE = 8000          # 8-bit samples a second
CONTAINERS = {b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf"}
PACKED = "id long, n_bytes long, payload_bytes long, media binary"
INDEX = ("id long, n_bytes long, payload_bytes long, media_bytes long, media_sha256 string, codec string, "
         "timescale long, duration long, n_samples long, keyframes array<struct<offset:long,size:long>>, "
         "payload_sha256 string, tail_crc32 long, error string")


def padded(data: bytes) -> bytes:
    """The bytes, with zeros up to a positive multiple of a sample."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version=0, flags=0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
FTYP = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")


def write_media(payload: bytes) -> bytes:
    """A file of one track of 8-bit samples: type, data, then the tables that locate the data."""
    n, ticks = len(payload) // UNIT, len(payload)
    mdat = box(b"mdat", payload)
    start = len(FTYP) + len(mdat) - len(payload)
    offsets = start + np.arange(0, n, CHUNK, dtype=np.int64) * UNIT
    whole, rest = divmod(n, CHUNK)
    runs = ([(1, CHUNK, 1)] if whole else []) + ([(whole + 1, rest, 1)] if rest else [])
    sync = np.arange(1, n + 1, SYNC)
    wide = offsets[-1] >= 1 << 32
    entry = box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, RATE << 16))
    table = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, n, UNIT)),
        full(b"stss", struct.pack(">I", len(sync)), sync.astype(">u4").tobytes()),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", UNIT, n)),
        full(b"co64" if wide else b"stco", struct.pack(">I", len(offsets)), offsets.astype(">u8" if wide else ">u4").tobytes()))
    media = box(
        b"mdia",
        full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, ticks, 0x55C4, 0), version=1),
        full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"samples\0"),
        box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table))
    track = box(b"trak", full(b"tkhd", struct.pack(">QQIIQ8xhhhH", 0, 0, 1, 0, ticks, 0, 0, 0x100, 0), MATRIX, bytes(8), version=1, flags=7), media)
    head = full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, RATE, ticks, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
    return FTYP + mdat + box(b"moov", head, track)


def walk(data, start=0, end=None, path=()):
    """(path of kinds, body start, body end) of each box, those inside containers included."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("box header is cut")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError("box header is cut")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError("box reaches beyond its parent")
        yield (*path, kind), start + head, start + size
        if kind in CONTAINERS:
            yield from walk(data, start + head, start + size, (*path, kind))
        start += size


def tracks(data) -> list:
    """For each track in file order, where the first box of each kind lies; boxes of different tracks never mix."""
    found = []
    for path, a, b in walk(data):
        if path[-1] == b"moof":
            raise ValueError("fragmented: samples of moof boxes are not decoded")
        if path == (b"moov", b"trak"):
            found.append({})
        elif path[:2] == (b"moov", b"trak"):
            found[-1].setdefault(path[-1], (a, b))
    return found


def read_index(data, track=0) -> dict:
    """What the tables of one track say: codec, timescale, duration, and each sample's place."""
    every = tracks(data)
    found = every[track] if track < len(every) else {}
    for kind in (b"mdhd", b"stsd", b"stts", b"stsc", b"stsz"):
        if kind not in found:
            raise ValueError(f"no {kind.decode()} box")

    def table(kind, width, at=4, dtype=">u4"):
        a, b = found[kind]
        n = struct.unpack_from(">I", data, a + at)[0]
        rows = np.frombuffer(data, dtype, offset=a + at + 4, count=n * width).astype(np.int64)
        return rows.reshape(n, width)

    a = found[b"mdhd"][0]
    timescale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] else struct.unpack_from(">II", data, a + 12)
    codec = bytes(data[found[b"stsd"][0] + 12:found[b"stsd"][0] + 16]).decode("latin-1")
    same, n = struct.unpack_from(">II", data, found[b"stsz"][0] + 4)
    sizes = np.full(n, same, np.int64) if same else table(b"stsz", 1, 8)[:, 0]
    chunks = table(b"co64", 1, dtype=">u8")[:, 0] if b"co64" in found else table(b"stco", 1)[:, 0]
    runs = table(b"stsc", 3)
    last = np.append(runs[1:, 0], len(chunks) + 1)
    per_chunk = np.repeat(runs[:, 1], last - runs[:, 0])
    if per_chunk.sum() != n or len(per_chunk) != len(chunks):
        raise ValueError("sample tables disagree")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk
    offsets = np.repeat(chunks, per_chunk) + before - np.repeat(before[first] if n else first, per_chunk)
    if n and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
        raise ValueError("a sample lies outside the file")
    sync = table(b"stss", 1)[:, 0] - 1 if b"stss" in found else np.arange(n)
    if len(sync) and not (0 <= sync.min() and sync.max() < n):
        raise ValueError("a sync sample is out of range")
    return {"codec": codec, "timescale": timescale, "duration": duration, "offsets": offsets, "sizes": sizes, "sync": sync}


def read_payload(data, index: dict) -> bytes:
    """The samples in order; neighbours in the file are copied in one piece."""
    offsets, sizes = index["offsets"], index["sizes"]
    if not len(offsets):
        return b""
    ends = offsets + sizes
    cut = np.flatnonzero(offsets[1:] != ends[:-1])
    starts, stops = offsets[np.append(0, cut + 1)], ends[np.append(cut, len(ends) - 1)]
    return b"".join(bytes(data[a:b]) for a, b in zip(starts.tolist(), stops.tolist()))


def pack(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One media file for each row, its payload the padded UTF-8 text."""
    def run(batches):
        for b in small_batches(batches):
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = (t or "").encode("utf-8", "surrogatepass")
                payload = padded(raw)
                out.append((i, len(raw), len(payload), write_media(payload)))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["id", "n_bytes", "payload_bytes", "media"])

    return df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text")).mapInArrow(run, PACKED)


def index(media: DataFrame) -> DataFrame:
    """Reads the stored files of `pack`, or any frame with columns id, n_bytes, payload_bytes and media."""
    def one(i, n, p, data):
        empty = (None,) * 7
        if data is None:
            return (i, n, p, None, None, *empty, "no media")
        digest = hashlib.sha256(data).hexdigest()
        try:
            x = read_index(data)
            payload = read_payload(data, x)
        except (ValueError, struct.error, IndexError) as e:
            return (i, n, p, len(data), digest, *empty, str(e) or "malformed")
        keys = [{"offset": a, "size": s} for a, s in zip(x["offsets"][x["sync"]].tolist(), x["sizes"][x["sync"]].tolist())]
        return (i, n, p, len(data), digest, x["codec"], x["timescale"], x["duration"], len(x["sizes"]), keys,
                hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), None)

    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 3 + [pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())])), pa.string(), pa.int64(), pa.string()]
    names = [x.strip().split(" ")[0] for x in INDEX.replace("<struct<offset:long,size:long>>", "").split(",")]

    def run(batches):
        for b in small_batches(batches):
            rows = [one(*r) for r in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return media.select("id", "n_bytes", "payload_bytes", "media").mapInArrow(run, INDEX)
