import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from pointloom.llm import jpeg


class Writer:
    """Bits of one scan, with fixed eight-bit Huffman codes for all symbols."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def symbol(self, s):
        self.put(SYMBOLS.index(s), 8)

    def signed(self, v):
        n = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << n) - 1, n)

    def data(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


SYMBOLS = [r << 4 | s for r in range(16) for s in range(11)]
LOW = lambda v, low: int(abs(v) >> low) * (1 if v > 0 else -1)


def table(ident):
    return jpeg._segment(0xC4, bytes([ident, *[0] * 7, len(SYMBOLS), *[0] * 8, *SYMBOLS]))


def ac_first(blocks, first, last, low):
    w, run = Writer(), 0

    def end():
        nonlocal run
        while run:
            n = min(run.bit_length() - 1, 14)
            w.symbol(n << 4)
            w.put(run - (1 << n) if run < 1 << (n + 1) else (1 << n) - 1, n)
            run -= run if run < 1 << (n + 1) else (1 << (n + 1)) - 1

    for b in blocks:
        zeros = 0
        for k in range(first, last + 1):
            v = LOW(b[k], low)
            if not v:
                zeros += 1
                continue
            end()
            while zeros > 15:
                w.symbol(0xF0)
                zeros -= 16
            w.symbol(zeros << 4 | abs(v).bit_length())
            w.signed(v)
            zeros = 0
        if zeros:
            run += 1
    end()
    return w.data()


def ac_refine(blocks, first, last, low):
    w = Writer()
    for b in blocks:
        k, fix, zeros = first, [], 0
        fresh = [k for k in range(first, last + 1) if abs(b[k]) >> low == 1]
        stop = max(fresh, default=first - 1)
        for k in range(first, last + 1):
            v = abs(int(b[k])) >> low
            if v > 1:
                fix.append(v & 1)
            elif not v:
                zeros += 1
                if zeros == 16 and k < stop:
                    w.symbol(0xF0)
                    for x in fix:
                        w.put(x, 1)
                    fix, zeros = [], 0
            else:
                w.symbol(zeros << 4 | 1)
                w.put(int(b[k] > 0), 1)
                for x in fix:
                    w.put(x, 1)
                fix, zeros = [], 0
        if zeros or fix:
            w.symbol(0)
            for x in fix:
                w.put(x, 1)
    return w.data()


def encode(width, height, sampling, coefs):
    """A file with every kind of progressive scan from whole component arrays (padded size)."""
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    head = b"\xff\xd8" + jpeg._segment(0xDB, bytes([0, *range(1, 65)])) + jpeg._segment(0xE0, b"JFIF")
    head += jpeg._segment(0xC2, struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
    head += table(0x00) + table(0x10)
    rows, cols = -(-height // (8 * vmax)), -(-width // (8 * hmax))
    order = [(i, (r * v + y) * cols * h + c * h + x) for r in range(rows) for c in range(cols) for i, (h, v) in enumerate(sampling) for y in range(v) for x in range(h)]
    names = b"".join(bytes([i + 1, 0]) for i in range(len(sampling)))
    scan = lambda n, names, first, last, approx, data: jpeg._segment(0xDA, bytes([n]) + names + bytes([first, last, approx])) + data
    w, before = Writer(), [0] * len(sampling)
    for i, k in order:
        v = int(coefs[i][k][0]) >> 1
        w.symbol(abs(v - before[i]).bit_length())
        w.signed(v - before[i])
        before[i] = v
    out = [head, scan(len(sampling), names, 0, 0, 1, w.data())]
    w = Writer()
    for i, k in order:
        w.put(int(coefs[i][k][0]) & 1, 1)
    for i, (h, v) in enumerate(sampling):
        wide, high = -(-width * h // (8 * hmax)), -(-height * v // (8 * vmax))
        own = [coefs[i][r * cols * h + c] for r in range(high) for c in range(wide)]
        for first, last in ((1, 5), (6, 63)):
            out.append(scan(1, bytes([i + 1, 0]), first, last, 2, ac_first(own, first, last, 2)))
            out.append(scan(1, bytes([i + 1, 0]), first, last, 0x21, ac_refine(own, first, last, 1)))
        out.append(scan(1, bytes([i + 1, 0]), 1, 63, 0x10, ac_refine(own, 1, 63, 0)))
    out.append(scan(len(sampling), names, 0, 0, 0x10, w.data()))
    return b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize("width,height,sampling", [(16, 16, [(1, 1)]), (40, 24, [(2, 2), (1, 1), (1, 1)]), (33, 17, [(2, 1), (1, 1), (1, 1)]), (9, 30, [(1, 1)] * 3)])
def test_all_kinds_of_scans(width, height, sampling):
    rng = np.random.default_rng(width)
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    coefs = []
    for h, v in sampling:
        wide, high = -(-width // (8 * hmax)) * h, -(-height // (8 * vmax)) * v
        c = rng.integers(-40, 40, (wide * high, 64)) * (rng.random((wide * high, 64)) < rng.choice([0.02, 0.3, 0.9], (wide * high, 1)))
        inside_w, inside_h = -(-width * h // (8 * hmax)), -(-height * v // (8 * vmax))
        outside = [r * wide + x for r in range(high) for x in range(wide) if r >= inside_h or x >= inside_w]
        c[outside, 1:] = 0  # single scans don't hold these
        coefs.append(c)
    image = jpeg.decode(encode(width, height, sampling, coefs))
    for part, c in zip(image.parts, coefs, strict=True):
        assert (part.coef == c).all()
    assert jpeg.rgb(image).shape == (height, width, 3)


def test_store_round_trip_and_both_readers(monkeypatch):
    rnd = random.Random(1)
    for n in (1, 2, 3, 7, 40):
        payload = bytes(rnd.randrange(256) for _ in range(192 * n))
        file = jpeg.store(payload)
        fast = jpeg.decode(file)
        assert jpeg.read_back(fast) == payload
        with monkeypatch.context() as m:
            m.setattr(jpeg, "_plain_scan", lambda *a: False)
            slow = jpeg.decode(file)
        assert all((a.coef == b.coef).all() for a, b in zip(fast.parts, slow.parts, strict=True))
    for payload in (b"\xff" * 192, b"\0" * 384):
        assert jpeg.read_back(jpeg.decode(jpeg.store(payload))) == payload


def test_inverse_transform():
    coef = np.zeros(64)
    coef[0] = 80
    assert np.allclose(coef @ jpeg.BASIS / 8192, 10)
    rng = np.random.default_rng(0)
    block = rng.normal(size=(8, 8))
    x = np.arange(8)
    c = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    assert np.allclose((c @ block @ c.T).reshape(64)[jpeg.ZIGZAG] @ jpeg.BASIS / 8192, block.reshape(64), atol=1e-2)
    assert jpeg.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2] and jpeg.ZIGZAG[-1] == 63


def test_frame(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (1, "abc"), (None, "é" * 500), (5, "x" * 192)]
    got = jpeg.media(spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, feature string")).collect()
    assert len(got) == 6
    for (i, t), r in zip(rows, got, strict=True):
        data = (t or "").encode()
        payload = data + b" " * ((-len(data) % 192) or (192 if not data else 0))
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_bytes > len(payload) and r.media_sha256 == hashlib.sha256(jpeg.store(payload)).hexdigest()
    assert got[1][1:] == got[2][1:] and got[0] == got[3]
    files = spark.createDataFrame([(1, bytearray(jpeg.store(b"a" * 192))), (2, None), (3, bytearray(b"junk"))], "id long, data binary")
    shapes = {r.id: (r.height, r.width, r.pixels and len(r.pixels)) for r in jpeg.tensors(files, "id", "data").collect()}
    assert shapes == {1: (16, 16, 768), 2: (None, None, None), 3: (None, None, None)}
    assert jpeg.media(files.selectExpr("id as doc_id", "'x' as text").limit(0)).count() == 0
