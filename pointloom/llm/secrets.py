"""Secret scan through nested encodings.

A worklist starts with the text itself. Each layer is scanned for the three kinds of secret, then all that looks encoded
in it is decoded into new layers, which go on the worklist, until nothing new appears:

* percent, backslash (u, U, x and octal) and numeric character escapes: the whole layer with its escapes undone, as they may
  cover a part of a secret only. An escape of an escape's first character is undone to the end at once;
* base64 runs of 16 characters or more (fewer can't hold a secret of any kind), also over lines of equal length, and hex
  dumps: their bytes. A run may begin after a path's ``/`` or another sign that is a digit as well: it is read from there, too;
* UTF-16 in bytes: its characters;
* gzip, zlib, bzip2 and xz streams, wherever they begin: what they unpack to, in windows of about ``WINDOW`` bytes, to the end
  of the stream, so that a bomb can't take a worker's memory. Windows end where no run of an encoding goes on; a run of over
  ``LONGEST`` windows is cut between whole groups of digits. A stream inside a stream that goes on beyond a window is
  unpacked as it comes. A broken or truncated stream is read as far as it goes.

Bytes are layers of one character each (code points 0 to 255): the patterns are ASCII, so no decoded text has to be valid in
any encoding. A layer whose content was met before at the same place is not opened again, so cycles end. Every layer
keeps the range of the text that each character came from; findings are reported in those terms (all that comes out of
a compressed stream has the range of the stream).

Null text counts as empty; empty texts have no findings. Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_arrow, release

KINDS = ("assign", "access", "hex")
#: Bytes of an unpacked stream that are scanned at once, by how many windows overlap, and how many windows a run may fill.
WINDOW, OVERLAP, LONGEST = 1 << 23, 1 << 16, 6

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
#: Where an assign match can begin; a text without any is not searched further.
_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_PERCENT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
_ESCAPE = re.compile(r"\\(?:u005[cC]|u\{5[cC]\}|x5[cC]|134)*(u\{[0-9A-Fa-f]{1,6}\}|u[0-9A-Fa-f]{4}|U000[0-9A-Fa-f]{5}|x[0-9A-Fa-f]{2}|[0-3][0-7]{2})")
_ENTITY = re.compile(r"&(?:#38;|#[xX]26;)*(#(?:[0-9]{2,7}|[xX][0-9A-Fa-f]{2,6});)")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_NEXT_LINE = re.compile(r"\r?\n[ \t]*([A-Za-z0-9+/_-]+={0,2})")
_DUMP = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){12,}(?![0-9A-Fa-f])")
_STREAM = re.compile(r"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x78[\x01\x5e\x9c\xda]|\A[\x08\x18\x28\x38\x48\x58\x68\x78][\x00-\xff]")
_STREAM_BYTES = re.compile(_STREAM.pattern.encode("latin-1"))
#: Bytes of which runs of encodings are made.
_RUN = np.zeros(256, bool)
_RUN[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-%\\&#;{}\r\n", np.uint8)] = True
_BYTES = re.compile(r"[\x00-\xff]*")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the findings in one layer, leftmost and non-overlapping within a kind."""
    found = []
    if _KEYWORD.search(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return found


def unpacker(data: bytes):
    """A decompressor for data that begins like gzip, zlib, bzip2 or xz."""
    if data.startswith(b"\x1f\x8b\x08"):
        return zlib.decompressobj(31)
    if data.startswith(b"BZh"):
        return bz2.BZ2Decompressor()
    if data.startswith(b"\xfd7zXZ\x00"):
        return lzma.LZMADecompressor()
    if len(data) > 2 and data[0] & 0x8F == 0x08 and (data[0] << 8 | data[1]) % 31 == 0:
        return zlib.decompressobj()
    return None


def unpacked(chunks: Iterator[bytes], size: int, used: list[int] | None = None, rest: list[bytes] | None = None) -> Iterator[bytes]:
    """Bytes of a compressed stream, at most ``size`` at a time, as far as it is sound; members that follow one another are one stream.

    used: gets the number of bytes that the stream took of what was given; rest: those of them that it did not take.
    """
    tool, left, given = None, b"", 0
    try:
        for chunk in chunks:
            given += len(chunk)
            left += chunk
            while left or tool is not None:
                if tool is None:
                    if (tool := unpacker(left)) is None:
                        return
                out = tool.decompress(left, size)
                left = getattr(tool, "unconsumed_tail", b"")
                if out:
                    yield out
                if tool.eof:
                    left = tool.unused_data
                    tool = None
                    if not left:
                        break
                elif not out and (not left or getattr(tool, "needs_input", False)):
                    break
    except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError):
        return
    finally:
        if used is not None:
            used.append(given - len(left))
        if rest is not None:
            rest.append(left)


def goes_on(data: bytes) -> int | None:
    """Where a compressed stream begins that is sound as far as ``data`` goes and ends beyond it."""
    reach = 0
    for m in _STREAM_BYTES.finditer(data):
        if m.start() < reach or unpacker(part := data[m.start() : m.start() + 64]) is None:
            continue
        tool, left, made = unpacker(part), memoryview(data)[m.start() :], 0
        try:
            while not tool.eof:
                out = tool.decompress(left, 1 << 20)
                left = getattr(tool, "unconsumed_tail", b"")
                made += len(out)
                if not out and (not left or getattr(tool, "needs_input", False)):
                    break
        except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError):
            continue
        if tool.eof:
            reach = len(data) - len(tool.unused_data)
        elif made or m[0][:1] in b"\x1fB\xfd" or len(data) - m.start() < 1024:  # bzip2 and xz give nothing before a block is whole
            return m.start()
    return None


def windows(chunks: Iterator[bytes], size: int, overlap: int) -> Iterator[bytes]:
    """The stream in windows, each of which begins with the end of the one before; streams that go on beyond a window are unpacked."""
    held, limit = b"", size
    for chunk in chunks:
        held += chunk
        while len(held) >= limit:
            stream = goes_on(held)
            if stream is not None and len(held) - stream >= 1024:
                if stream:
                    yield held[:stream]
                rest: list[bytes] = []
                yield from windows(unpacked(chain([held[stream:]], chunks), size, rest=rest), size, overlap)
                held, limit = rest[0], size
                continue
            breaks = np.flatnonzero(~_RUN[np.frombuffer(held, np.uint8)])
            run = int(breaks[-1]) + 1 if len(breaks) else 0  # where the run that the window ends in begins
            cut = run if stream is None else min(run, stream)
            if cut > overlap:
                yield held[:cut]
                held, limit = held[cut - overlap :], size
            elif len(held) < LONGEST * size:
                limit = min(LONGEST * size, len(held) + size)
            else:  # a run too long to hold: whole groups of its digits stay together
                yield held
                held, limit = held[run + (len(held) - overlap - run) // 4 * 4 :], size
    yield held


def undone(text: str, pattern: re.Pattern, change, flat: bool = False) -> tuple[str, tuple] | None:
    """The text with all matches of an escape replaced by one character each, and where each character came from (flat: nowhere in particular)."""
    found = [(m.start(), m.end(), change(m[1])) for m in pattern.finditer(text)]
    if not found:
        return None
    out, at = [], 0
    for s, e, c in found:
        out += [text[at:s], c]
        at = e
    out.append(text[at:])
    if flat:
        return "".join(out), (0, 1)
    n = len(text)
    gone = np.zeros(n + 1, np.int32)
    ends = np.arange(1, n + 1)
    for s, e, _ in found:
        gone[s + 1] += 1
        gone[e] -= 1
        ends[s] = e
    starts = np.flatnonzero(np.cumsum(gone[:n]) == 0)
    return "".join(out), (starts, ends[starts])


def _code(digits: str, base: int) -> str:
    n = int(digits, base)
    return chr(n) if n < 0x110000 else "\ufffd"


def _entity(x: str) -> str:
    return _code(x[2:-1], 16) if x[1] in "xX" else _code(x[1:-1], 10)


def _escape(x: str) -> str:
    return _code(x, 8) if x[0] in "0123" else _code(x[1:].strip("{}"), 16)


def _base64_layer(text: str, lines: list[tuple[int, int]], flat: bool = False) -> tuple[str, tuple] | None:
    """Bytes of base64 digits on these lines (start, end), with no padding but at the end."""
    digits = "".join(text[a:b] for a, b in lines).rstrip("=")
    if len(digits) % 4 == 1 or "=" in digits:
        return None
    try:
        data = base64.b64decode(digits.replace("-", "+").replace("_", "/") + "=" * (-len(digits) % 4), validate=True)
    except binascii.Error:
        return None
    if flat:
        return data.decode("latin-1"), (0, 1)
    place = np.concatenate([np.arange(a, b) for a, b in lines])
    at = np.arange(len(data))
    return data.decode("latin-1"), (place[at * 4 // 3], place[np.minimum(-(-(at + 1) * 4 // 3), len(digits)) - 1] + 1)


def _starts(run: str) -> list[int]:
    """Where else than at its start a base64 run may begin, one place for each way to group its digits."""
    found: dict[int, int] = {}
    for m in re.finditer(r"[/_+-]", run):
        if m.end() % 4 and m.end() % 4 not in found and len(run) - m.end() >= 16:
            found[m.end() % 4] = m.end()
            if len(found) == 3:
                break
    return sorted(found.values())


def opened(text: str, window: int = WINDOW, overlap: int = OVERLAP, flat: bool = False) -> Iterator[tuple[str, tuple]]:
    """Layers inside a layer: their text, and the range in this layer of each character (two arrays) or of all (two numbers).

    flat: ranges don't matter, as all of this layer has one.
    """
    if "%" in text and (got := undone(text, _PERCENT, lambda x: chr(int(x, 16)), flat)):
        yield got
    if "\\" in text and (got := undone(text, _ESCAPE, _escape, flat)):
        yield got
    if "&#" in text and (got := undone(text, _ENTITY, _entity, flat)):
        yield got
    done = 0
    for m in _BASE64.finditer(text):
        if (got := _base64_layer(text, [m.span()], flat)) is not None:
            yield got
        for k in _starts(m[0]):
            a, b = m.start() + k, m.start() + len(m[0].rstrip("="))
            if (got := _base64_layer(text, [(a, b - ((b - a) % 4 == 1))], flat)) is not None:
                yield got
        if m.end() <= done or m[0].endswith("=") or len(m[0]) % 4:
            continue
        lines, wide = [m.span()], len(m[0])
        while (n := _NEXT_LINE.match(text, lines[-1][1])) and len(n[1]) <= wide:
            lines.append(n.span(1))
            if len(n[1]) < wide or n[1].endswith("="):
                break
        if len(lines) > 1:
            done = lines[-1][1]
            for some in (lines, lines[:-1] if len(lines) > 2 else []):  # the last line may be none of them
                if some and (got := _base64_layer(text, some, flat)) is not None:
                    yield got
    for m in _DUMP.finditer(text):
        at = None if flat else np.arange(m.start(), m.end(), 2)
        yield bytes.fromhex(m[0]).decode("latin-1"), (0, 1) if flat else (at, at + 2)
    if "\0" in text:
        for order in (0, 1):  # the high bytes of ASCII characters in UTF-16 are 0
            for m in re.finditer(r"(?:[^\0]\0){6,}" if order else r"(?:\0[^\0]){6,}", text):
                at = None if flat else np.arange(m.start(), m.end(), 2)
                yield m[0][1 - order :: 2], (0, 1) if flat else (at, at + 2)
    reach = -1
    for m in _STREAM.finditer(text):
        if m.start() < reach:
            continue
        data = _BYTES.match(text, m.start())[0].encode("latin-1")
        if unpacker(data) is None:
            continue
        used: list[int] = []
        if not sum(map(len, unpacked(iter([data]), window, used))):  # a first pass, to know where the stream ends
            continue
        reach = m.start() + used[0]
        for part in windows(unpacked(iter([data]), window), window, overlap):
            yield part.decode("latin-1"), (m.start(), reach)


def _through(outer: tuple | None, inner: tuple) -> tuple:
    """Ranges in the text, from ranges in a layer and that layer's own."""
    if outer is None:
        return inner
    if not isinstance(outer[0], np.ndarray):
        return outer
    s, e = inner
    return (outer[0][s], outer[1][e - 1]) if isinstance(s, np.ndarray) else (int(outer[0][s]), int(outer[1][e - 1]))


def _range(place: tuple, s: int, e: int) -> tuple[int, int]:
    return (int(place[0][s]), int(place[1][e - 1])) if isinstance(place[0], np.ndarray) else place


def _content(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def findings(text: str, window: int = WINDOW, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, int]], set[tuple[int, int, int]], int]:
    """Findings in the text itself, those of all layers mapped to the text, and the number of layers below it."""
    base = scan(text)
    found, seen, work, layers = set(base), {(_content(text), 0, len(text))}, [(text, None)], 0
    while work:
        layer, place = work.pop()
        for inner, where in opened(layer, window, overlap, place is not None and not isinstance(place[0], np.ndarray)):
            if not inner:
                continue
            where = _through(place, where)
            if (key := (_content(inner), *_range(where, 0, len(inner)))) in seen:
                continue
            seen.add(key)
            layers += 1
            for a, kind, b in scan(inner):
                s, e = _range(where, a, b)
                found.add((s, kind, e))
            work.append((inner, where))
    return base, found, layers


def joined(found) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, counts by kind and digest of the plain findings, all spans, layers opened."""

    def make():
        def run(columns):
            out: list[list] = [[] for _ in range(6)]
            for text in columns[0]:
                base, found, layers = findings(text or "")
                kinds = [k for _, k, _ in base]
                row = kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), layers
                for values, v in zip(out, row, strict=True):
                    values.append(v)
            return out

        return run

    new = [*[(f"n_{k}", pa.int64(), "long") for k in KINDS], ("base_sha256", pa.string(), "string"), ("spans", pa.string(), "string"), ("n_layers", pa.int64(), "long")]
    return map_arrow(docs, [id_col], [text_col], make, new)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Replaces every finding in ``text``, of any layer, by ``mark``; the other columns stay. Null text stays null."""

    @F.pandas_udf("string")
    def clean(texts):
        release()

        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for s, _, e in sorted(findings(text)[1]):
                if s >= at:
                    out += [text[at:s], mark]
                at = max(at, e)
            return "".join([*out, text[at:]]) if out else text

        return texts.map(one)

    return docs.withColumn("text", clean(column("text")))
