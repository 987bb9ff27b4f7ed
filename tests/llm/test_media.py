import hashlib
import zlib

import pytest

from paneloom.llm import media


def test_round_trip_of_sizes():
    for n in (0, 1, 63, 64, 65, 16384, 16385, 70000):
        p = media.padded(bytes(i % 251 for i in range(n)))
        assert len(p) >= 64 and len(p) % 64 == 0 and len(p) - n < 64 + 64 * (n == 0)
        data = media.write_media(p)
        x = media.read_index(data)
        assert media.read_payload(data, x) == p
        assert (x["codec"], x["timescale"], x["duration"]) == ("raw ", 8000, len(p))
        for k in x["sync"][:3]:
            assert data[x["offsets"][k]:x["offsets"][k] + 64] == p[k * 64:k * 64 + 64]


def test_walk_finds_nested_boxes_and_refuses_cut_files():
    data = media.write_media(media.padded(b"abc"))
    paths = [p for p, *_ in media.walk(data)]
    assert (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stss") in paths
    with pytest.raises(ValueError):
        list(media.walk(data[:-5]))


def test_spread_chunks_and_varied_sizes():
    """A file with two chunks apart and samples of their own sizes, tables first and 64-bit boxes."""
    import struct
    a, b = b"AAAAABB", b"CCC"
    def build(base):
        table = media.box(
            b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(8))), media.full(b"stts", struct.pack(">III", 1, 3, 10)),
            media.full(b"stsc", struct.pack(">I3I3I", 2, 1, 2, 1, 2, 1, 1)), media.full(b"stsz", struct.pack(">II3I", 0, 3, 5, 2, 3)),
            media.full(b"stco", struct.pack(">I2I", 2, base, base + 20)), media.full(b"stss", struct.pack(">I2I", 2, 1, 3)))
        mdia = media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIII", 0, 0, 600, 30)), media.box(b"minf", table))
        return media.box(b"moov", media.box(b"trak", mdia))
    head = build(0)
    base = len(head) + 16
    data = build(base) + struct.pack(">I4sQ", 1, b"mdat", 16 + 40) + (a + bytes(13) + b + bytes(17))
    x = media.read_index(data)
    assert (x["codec"], x["timescale"], x["duration"]) == ("avc1", 600, 30)
    assert x["offsets"].tolist() == [base, base + 5, base + 20] and x["sync"].tolist() == [0, 2]
    assert media.read_payload(data, x) == a + b


def test_frame_with_odd_rows(spark):
    rows = [(1, "abc", "x"), (1, "abc", "y"), (2, "", "x"), (3, None, "x"), (None, "é" * 70000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    packed = media.pack(df)
    got = media.index(packed).collect()
    assert len(got) == 5
    for r in got:
        text = {1: "abc", 2: "", 3: "", None: "é" * 70000}[r["id"]]
        p = media.padded(text.encode())
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-64:])
        assert r["n_bytes"] == len(text.encode()) and r["error"] is None
    assert media.index(media.pack(df.limit(0))).count() == 0
    bad = spark.createDataFrame([(1, 1, 64, bytearray(b"1234567")), (2, 1, 64, None)], media.PACKED)
    assert {r["id"]: r["error"] for r in media.index(bad).collect()} == {1: "box header is cut", 2: "no media"}


def test_tables_of_different_tracks_do_not_mix():
    data = media.write_media(bytes(range(256)) * 40)
    trak = next((a - 8, b) for path, a, b in media.walk(data) if path == (b"moov", b"trak"))
    moov = next((a, b) for path, a, b in media.walk(data) if path == (b"moov",))
    track = data[trak[0]:trak[1]]
    two = data[:moov[0] - 8] + media.box(b"moov", data[moov[0]:trak[0]], track.replace(b"stss", b"free"), track)
    first, second = media.read_index(two), media.read_index(two, 1)
    assert first["sync"].tolist() == list(range(160)) and second["sync"].tolist() == list(range(0, 160, media.SYNC))
    assert first["offsets"].tolist() == second["offsets"].tolist()
    for bad, say in ((two + media.box(b"moof"), "fragmented"), (media.FTYP, "no mdhd")):
        with pytest.raises(ValueError, match=say):
            media.read_index(bad)
