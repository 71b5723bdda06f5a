"""Progressive JPEG columns: coefficient arrays gathered over the scans, then full-resolution RGB tensors.

``decode`` reads any 8-bit progressive file with Huffman coding: spectral selection and successive approximation,
interleaved or single-component scans, restart intervals, end-of-band runs. ``rgb`` turns the coefficients into pixels:
an exact inverse transform (integers in float64, so results don't depend on how many blocks are done at once), chroma
brought to full size by repetition, and integer colour conversion.

``store`` keeps bytes without loss as coefficients of such a file with 4:2:0 sampling: a byte b is the coefficient
256 + b, all of one magnitude class, so each scan has one Huffman symbol and a fixed number of bits per coefficient.
Scans made that way are read by array operations; all others bit by bit.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow


def _zigzag() -> np.ndarray:
    """Place in the 8 x 8 block of each coefficient in zigzag order."""
    cells = sorted(((i + j, j if (i + j) % 2 == 0 else i, i, j) for i in range(8) for j in range(8)))
    return np.array([i * 8 + j for _, _, i, j in cells])


ZIGZAG = _zigzag()
_SCALE = 1 << 13


def _basis() -> np.ndarray:
    """Pixel values, in units of 1 / _SCALE, of each coefficient in zigzag order."""
    x = np.arange(8)
    c = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return np.rint(np.einsum("ui,vj->uvij", c, c).reshape(64, 64)[ZIGZAG] * _SCALE)


BASIS = _basis()


class Component:
    def __init__(self, ident: int, h: int, v: int, table: int):
        self.ident, self.h, self.v, self.table = ident, h, v, table

    def shape(self, width: int, height: int, hmax: int, vmax: int) -> None:
        self.wide, self.high = -(-width * self.h // (8 * hmax)), -(-height * self.v // (8 * vmax))  # blocks that single scans hold
        self.across, self.down = -(-width // (8 * hmax)) * self.h, -(-height // (8 * vmax)) * self.v  # with those that fill up
        self.coef = np.zeros((self.down * self.across, 64), np.int32)


class Image:
    """Coefficients of each component, in zigzag order, and the quantisation tables."""

    width = height = 0
    comment = b""

    def __init__(self):
        self.parts: list[Component] = []
        self.quant: dict[int, np.ndarray] = {}


class Bits:
    """Bits of one restart interval, with stuffing removed."""

    def __init__(self, data: bytes):
        self.data, self.at, self.bit, self.held = data, 0, 0, 0

    def one(self) -> int:
        if not self.bit:
            self.held = self.data[self.at] if self.at < len(self.data) else 0
            self.at, self.bit = self.at + 1, 8
        self.bit -= 1
        return self.held >> self.bit & 1

    def many(self, n: int) -> int:
        x = 0
        for _ in range(n):
            x = x << 1 | self.one()
        return x

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.one()
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("not a Huffman code")

    def signed(self, n: int) -> int:
        x = self.many(n)
        return x if not n or x >> (n - 1) else x - (1 << n) + 1


def decode(data: bytes) -> Image:
    """Read all scans. Raises ValueError for what isn't a progressive 8-bit Huffman JPEG."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    image, codes, restart, at = Image(), {}, 0, 2
    while at < len(data) - 1:
        if data[at] != 0xFF:
            raise ValueError("no marker")
        kind = data[at + 1]
        at += 2
        if kind == 0xD9:
            return image
        size = struct.unpack_from(">H", data, at)[0]
        body = data[at + 2 : at + size]
        at += size
        if kind == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                image.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide == 2 else np.uint8, 64, 1).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif kind == 0xC2:
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            image.parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            for p in image.parts:
                p.shape(image.width, image.height, max(q.h for q in image.parts), max(q.v for q in image.parts))
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not progressive")
        elif kind == 0xC4:
            while body:
                counts, k, code, table = body[1:17], 17, 0, {}
                for n in range(16):
                    for _ in range(counts[n]):
                        table[n + 1, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                codes[body[0]], body = table, body[k:]
        elif kind == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif kind == 0xFE:
            image.comment = body
        elif kind == 0xDA:
            end = m.start() if (m := _MARKER.search(data, at)) else len(data)
            n = body[0]
            chosen = [(next(p for p in image.parts if p.ident == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
            first, last, approx = body[1 + 2 * n : 4 + 2 * n]
            _scan(image, chosen, codes, first, last, approx >> 4, approx & 15, restart, data[at:end])
            at = end
    return image


_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S)


def _scan(image: Image, chosen: list, codes: dict, first: int, last: int, high: int, low: int, restart: int, data: bytes) -> None:
    part, tables = chosen[0]
    table = codes.get(tables >> 4 if not first else 16 | tables & 15, {})
    if len(chosen) == 1 and part.wide == part.across and part.high == part.down and _plain_scan(part.coef, table, first, last, high, low, restart, data):
        return
    if len(chosen) == 1:
        blocks = [(part, table, r * part.across + c) for r in range(part.high) for c in range(part.wide)]
        units = [[b] for b in blocks]
    else:
        p0 = image.parts[0]
        rows, cols = p0.down // p0.v, p0.across // p0.h
        units = [[(p, codes.get(t >> 4, {}), (r * p.v + y) * p.across + c * p.h + x) for p, t in chosen for y in range(p.v) for x in range(p.h)] for r in range(rows) for c in range(cols)]
    runs = [x.replace(b"\xff\x00", b"\xff") for x in re.split(rb"\xff[\xd0-\xd7]", data)] if restart else [data.replace(b"\xff\x00", b"\xff")]
    step = restart or len(units)
    for n, run in enumerate(runs):
        bits, before, skip = Bits(run), {}, [0]
        for unit in units[n * step : (n + 1) * step]:
            for p, t, k in unit:
                if first:
                    (_refine_ac if high else _first_ac)(bits, t, p.coef[k], first, last, low, skip)
                elif high:
                    p.coef[k, 0] |= bits.one() << low
                else:
                    before[p.ident] = before.get(p.ident, 0) + bits.signed(bits.symbol(t))
                    p.coef[k, 0] = before[p.ident] * (1 << low)


def _first_ac(bits: Bits, codes: dict, coef: np.ndarray, first: int, last: int, low: int, skip: list[int]) -> None:
    if skip[0]:
        skip[0] -= 1
        return
    k = first
    while k <= last:
        s = bits.symbol(codes)
        zeros, size = s >> 4, s & 15
        if size:
            k += zeros
            coef[k] = bits.signed(size) * (1 << low)
            k += 1
        elif zeros < 15:
            skip[0] = (1 << zeros) + bits.many(zeros) - 1
            return
        else:
            k += 16


def _refine_ac(bits: Bits, codes: dict, coef: np.ndarray, first: int, last: int, low: int, skip: list[int]) -> None:
    def correct(k: int) -> None:
        if bits.one() and not abs(int(coef[k])) >> low & 1:
            coef[k] += (1 << low) if coef[k] > 0 else -(1 << low)

    k = first
    while k <= last and not skip[0]:
        s = bits.symbol(codes)
        zeros, new = s >> 4, 0
        if s & 15:
            new = (1 << low) if bits.one() else -(1 << low)
        elif zeros < 15:
            skip[0] = (1 << zeros) + bits.many(zeros)
            break
        while k <= last:
            if coef[k]:
                correct(k)
            elif not zeros:
                break
            else:
                zeros -= 1
            k += 1
        if new and k <= last:
            coef[k] = new
        k += 1
    if skip[0]:
        for j in range(k, last + 1):
            if coef[j]:
                correct(j)
        skip[0] -= 1


def _plain_scan(coef: np.ndarray, table: dict, first: int, last: int, high: int, low: int, restart: int, data: bytes) -> bool:
    """Read a scan as ``store`` writes them by array operations; False if it isn't one."""
    n, wide = len(coef), last - first + 1
    raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)
    if high:
        if first:
            if table != {(1, 0): 0} or restart or len(raw) != 8 * n or wide != 63 or not (coef[:, 1:] > 0).all():
                return False
            bits = np.unpackbits(raw.reshape(n, 8), axis=1)
            if bits[:, 0].any():
                return False
            coef[:, 1:] |= bits[:, 1:].astype(np.int32) << low
        else:
            if restart or len(raw) != -(-n // 8):
                return False
            coef[:, 0] |= np.unpackbits(raw, count=n).astype(np.int32) << low
        return True
    if table != {(1, 0): 7} or (not first and (restart != 1 or wide != 1)) or (first and restart):
        return False
    if not first:
        raw = np.frombuffer(data + b"\xff\xd0", np.uint8)
        if len(raw) != 3 * n or not (raw.reshape(n, 3)[:, 1] == 255).all():
            return False
        raw = raw.reshape(n, 3)[:, :1]
    elif len(raw) != n * wide:
        return False
    raw = raw.reshape(n, wide)
    if (raw >> 6 != 1).any():  # code 0, then seven bits of which the first is set
        return False
    coef[:, first : last + 1] = raw.astype(np.int32) << low
    return True


def rgb(image: Image) -> np.ndarray:
    """Full-resolution pixels, height x width x 3 (one component: grey)."""
    hmax, vmax = max(p.h for p in image.parts), max(p.v for p in image.parts)
    planes = []
    for p in image.parts:
        values = (p.coef * image.quant[p.table]).astype(np.float64) @ BASIS
        pixels = np.clip(np.floor((values + _SCALE // 2) / _SCALE) + 128, 0, 255).astype(np.int32)
        plane = pixels.reshape(p.down, p.across, 8, 8).transpose(0, 2, 1, 3).reshape(p.down * 8, p.across * 8)
        planes.append(plane.repeat(vmax // p.v, 0).repeat(hmax // p.h, 1)[: image.height, : image.width])
    if len(planes) < 3:
        return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    half = 1 << 15
    out = np.stack((y + (91881 * cr + half >> 16), y - (22554 * cb + 46802 * cr - half >> 16), y + (116130 * cb + half >> 16)), 2)
    return np.clip(out, 0, 255).astype(np.uint8)


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, kind, len(body) + 2) + body


def _one_symbol(table: int, symbol: int) -> bytes:
    return _segment(0xC4, bytes([table, 1, *[0] * 15, symbol]))


_HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0, *[1] * 64]))
_TABLES = _one_symbol(0x00, 7) + _one_symbol(0x10, 7) + _one_symbol(0x11, 0)
_NO_RESTART = _segment(0xDD, b"\0\0")


def store(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients hold the payload: a positive multiple of 64 bytes."""
    blocks = len(payload) // 64
    units = -(-blocks // 6)  # of 16 x 16 pixels: four blocks of luma, one of each chroma
    across = 1
    while across * across < units:
        across += 1
    down = -(-units // across)
    units = across * down
    coef = np.zeros((units * 6, 64), np.int32)
    coef.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    coef += 256
    out = [_HEAD, _segment(0xFE, struct.pack(">Q", len(payload))), _segment(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), _TABLES]
    parts = ((1, coef[: 4 * units]), (2, coef[4 * units : 5 * units]), (3, coef[5 * units :]))

    def scan(ident: int, tables: int, first: int, last: int, approx: int, data: bytes) -> None:
        out.extend((_segment(0xDA, bytes([1, ident, tables, first, last, approx])), data))

    out.append(_segment(0xDD, b"\0\1"))  # each block starts anew, so a DC difference is the value
    for ident, c in parts:
        each = np.empty((len(c), 3), np.uint8)
        each[:, 0] = c[:, 0] >> 2
        each[:, 1] = 255
        each[:, 2] = 0xD0 + np.arange(len(c)) % 8
        scan(ident, 0, 0, 0, 2, each.tobytes()[:-2])
    out.append(_NO_RESTART)
    for first, last in ((1, 5), (6, 63)):
        for ident, c in parts:
            scan(ident, 0, first, last, 2, (c[:, first : last + 1] >> 2).astype(np.uint8).tobytes())
    for low in (1, 0):
        for ident, c in parts:
            bits = (c >> low & 1).astype(np.uint8)
            dc = np.packbits(np.concatenate((bits[:, 0], np.ones(-len(c) % 8, np.uint8))))
            scan(ident, 0, 0, 0, (low + 1) << 4 | low, dc.tobytes().replace(b"\xff", b"\xff\x00"))
            bits[:, 0] = 0  # the code for the end of the band, then a bit for each coefficient
            scan(ident, 1, 1, 63, (low + 1) << 4 | low, np.packbits(bits, axis=1).tobytes().replace(b"\xff", b"\xff\x00"))
    out.append(b"\xff\xd9")
    return b"".join(out)


def read_back(image: Image) -> bytes:
    """The payload that ``store`` put in."""
    coef = np.concatenate([p.coef for p in image.parts]) - 256
    return coef.astype(np.uint8).tobytes()[: struct.unpack(">Q", image.comment)[0]]


def features(pixels: np.ndarray) -> str:
    """Height, width, mean of each channel in thousandths, and CRC of the tensor."""
    sums = pixels.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // (pixels.shape[0] * pixels.shape[1])
    return f"{pixels.shape[0]}x{pixels.shape[1]}:" + ",".join(map(str, sums.tolist())) + f":{zlib.crc32(pixels.tobytes()):08x}"


def tensors(files: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """RGB tensors of JPEG files: id, height, width, pixels (row by row, three bytes each).

    Null data, and what isn't a progressive JPEG, give nulls.
    """

    def one(data):
        try:
            x = rgb(decode(bytes(data)))
        except (ValueError, IndexError, struct.error, StopIteration, KeyError):
            return None, None, None
        return x.shape[0], x.shape[1], x.tobytes()

    def make():
        return lambda columns: [list(c) for c in zip(*[one(d) if d is not None else (None, None, None) for d in columns[0]], strict=True)] if columns[0] else [[], [], []]

    return map_arrow(files, [id_col], [data_col], make, [("height", pa.int32(), "int"), ("width", pa.int32(), "int"), ("pixels", pa.binary(), "binary")])


UNIT = 192


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts as stored files: id, sizes and digests of the text's padded bytes as read back, of the file, and features.

    Null text counts as empty; an empty text is one unit of padding. Repeated rows give repeated results.
    """

    def one(text):
        data = (text or "").encode("utf-8", "surrogatepass")
        payload = data + b" " * (-len(data) % UNIT if data else UNIT)
        file = store(payload)
        image = decode(file)
        back = read_back(image)
        return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(file), hashlib.sha256(file).hexdigest(), features(rgb(image))

    def make():
        return lambda columns: [list(c) for c in zip(*map(one, columns[0]), strict=True)] if columns[0] else [[]] * 7

    kinds = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    return map_arrow(docs, [id_col], [text_col], make, [(n, pa.int64() if k == "long" else pa.string(), k) for n, k in kinds.items()])
