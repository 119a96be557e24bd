import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import jpeg


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=5))
def test_round_trip_by_both_decoders(texts):
    sent = [jpeg.padded(t) for t in texts]
    files = jpeg.encode(sent)
    for p, f, (frame, planes) in zip(sent, files, jpeg.decode(files)):
        assert jpeg.payload(planes, len(p)) == p
        assert f == jpeg.encode([p])[0]  # a file does not depend on its batch
        plain, slow = jpeg.decode_plain(f)
        assert all((a == b).all() for a, b in zip(planes, slow)) and (plain.width, plain.height) == (frame.width, frame.height)


def test_transform():
    """The whole-number inverse against the definition, and colours of flat blocks."""
    rng = np.random.default_rng(1)
    z = rng.integers(-60, 60, (3, 64))
    u = np.arange(8)
    basis = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)
    for row, made in zip(z, (z.astype(float) @ jpeg.INVERSE) / (1 << 20)):
        natural = np.zeros(64)
        natural[jpeg.ZIGZAG] = row
        assert np.abs(basis @ natural.reshape(8, 8) @ basis.T - made.reshape(8, 8)).max() < 1e-3
    assert list(jpeg.ZIGZAG[:10]) == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG) == list(range(64))
    frame, planes = jpeg.decode(jpeg.encode([b"\xff" * 576]))[0]
    for p in planes:
        p[:] = 0
    assert (jpeg.tensor(frame, planes) == 128).all()
    planes[2][:, 0] = 8 * 100  # red difference 100
    assert jpeg.tensor(frame, planes)[0, 0].tolist() == [255, 57, 128]
    assert jpeg.tensor(frame, planes).shape == (frame.height, frame.width, 3)


class Writer:
    """Bits of a scan written by hand."""

    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value, f"0{n}b") if n else ""

    def data(self):
        bits = self.bits + "1" * (-len(self.bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")


def test_scans_of_other_writers():
    """Interleaved DC, zero runs, runs of ended bands, and refinement that brings new coefficients."""
    symbols = bytes([0x00, 0x01, 0x02, 0x11, 0xF0, 0x10, 0x21])  # codes 0.. of 3 bits
    tables = b"".join(jpeg._segment(0xC4, bytes([k]) + bytes([0, 0, 7, *[0] * 13]) + symbols) for k in (0x00, 0x10))
    quant = jpeg._segment(0xDB, b"\0" + bytes([3] * 64))
    frame = jpeg._segment(0xC2, bytes([8, 0, 8, 0, 16, 2, 1, 0x11, 0, 2, 0x11, 0]))
    code = {s: i for i, s in enumerate(symbols)}
    dc = Writer()
    for size, bits in ((2, 0b11), (0, 0), (1, 0), (1, 1)):  # Y0 +3, Cb0 0, Y1 -1, Cb1 +1 as differences
        dc.put(code[size], 3)
        dc.put(bits, size)
    ac = Writer()  # component 0: block 0 has +2 at 2 after a run of one, then the band ends for two blocks
    ac.put(code[0x11], 3), ac.put(1, 1), ac.put(code[0x10], 3), ac.put(0, 1)
    fine = Writer()  # refine: block 0 gets a new -1 at 3 after one zero at 1 passing the old one at 2 (bit 1)
    fine.put(code[0x11], 3), fine.put(0, 1), fine.put(1, 1), fine.put(code[0x00], 3)
    fine.put(code[0xF0], 3), fine.put(code[0x01], 3), fine.put(1, 1)  # block 1: 16 zeros, then a new +1 at 17
    fine.put(code[0x00], 3)
    scans = [
        (bytes([2, 1, 0, 2, 0, 0, 0, 0]), dc), (bytes([1, 1, 0, 1, 63, 0x01]), ac), (bytes([1, 1, 0, 1, 63, 0x10]), fine),
    ]
    data = b"\xff\xd8" + quant + frame + tables + b"".join(jpeg._segment(0xDA, h) + w.data() for h, w in scans) + b"\xff\xd9"
    made, planes = jpeg.decode([data])[0]
    y, cb = planes
    assert y[:, 0].tolist() == [3, 2] and cb[:, 0].tolist() == [0, 1]
    assert {i: int(v) for i, v in enumerate(y[0]) if v and i} == {2: 3, 3: -1} and {i: int(v) for i, v in enumerate(y[1]) if v and i} == {17: 1}
    assert jpeg.Frame(data).quant[0][5] == 3


def test_query(spark):
    rows = {r["doc_id"]: (r["text"] or "").encode() for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()}
    seen = {}
    got = jpeg.op8_media(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows)
    for r in got:
        sent = jpeg.padded(rows[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(rows[r.doc_id]), len(sent), hashlib.sha256(sent).hexdigest())
        assert r.tail_crc32 == zlib.crc32(sent[-32:]) and r.media_sha256 == hashlib.sha256(jpeg.encode([sent])[0]).hexdigest()
        assert seen.setdefault(rows[r.doc_id], (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "é" * 100_000), (4, "a" * 576), (4, "a" * 576)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, media string")
    got = jpeg.with_media(df).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4, 4]
    for r in got:
        sent = jpeg.padded((r.text or "").encode())
        frame, planes = jpeg.decode_plain(bytes(r["media_"])) if len(sent) < 5000 else jpeg.decode([bytes(r["media_"])])[0]
        assert bytes(r.payload) == sent and r.media == "x"
        assert np.array_equal(np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3), jpeg.tensor(frame, planes))
    assert jpeg.with_media(df.limit(0)).count() == 0
