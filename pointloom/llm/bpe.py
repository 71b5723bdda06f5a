"""Byte-level BPE by a given rank file: encoding from overlapping chunks, decoding by joining bytes.

A text is cut into overlapping chunks. Each is pre-tokenised on its own; two neighbours are stitched at the first
place in their overlap where both have a pre-token boundary, from which on they agree, since a match depends only on
what follows it. The first chunk's boundaries close to its end are not trusted, as text beyond could move them. Where
no boundary is shared (a run longer than the overlap), the second chunk is pre-tokenised again from the first one's
last safe boundary. So the pieces are always those of the whole text.

Texts of up to ``LONG`` characters are chunked inside one task. Longer ones become rows of chunks that are dealt out
to all tasks for pre-tokenising, and meet again by document for stitching.

Null text counts as empty. Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashIndex, column, map_arrow, mix, worker_tool

CHUNK, OVERLAP, LONG = 1 << 16, 1 << 10, 1 << 20
#: Characters before a chunk's end in which its boundaries are not trusted; a match looks at most this far ahead.
MARGIN = 4
#: Units a worker remembers; then it starts over, which bounds its memory.
REMEMBERED = 200_000


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a tiktoken file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Merge the pair of lowest rank, the leftmost of equals, until none is left: a heap over a linked list, n log n."""
    from heapq import heapify, heappop, heappush

    n = len(piece)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heappush(heap, (r, h, stop))
    return tuple([ranks[piece[i : end[i]]] for i in range(n) if alive[i]])


class Encoder:
    """Ranks, the way to cut a text into units of whole pieces, and the units' ids met so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import public_tokenizers

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.usual = pattern == public_tokenizers.PATTERN
        self.vocab: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.names = [str(i) for i in range(len(self.vocab))]
        self.known: dict[str, tuple[int, ...]] = {}
        # every pair of tokens that makes a token
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = HashIndex(mix(np.array([p for p, _ in pairs], np.uint64)))
        self.made = np.array([r for _, r in pairs] + [NONE], np.int32)
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)

    def units(self, text: str) -> list[str]:
        """Cuts a text at some of its pieces' boundaries.

        Where white space is a single space or line feed between other characters, no match goes on over a space, so
        each space begins a unit; else, and with any other pattern than the tokenizers' own, the units are the pieces.
        """
        if not self.usual:
            return self.pattern.findall(text)
        parts = text.split(" ")
        if "" in parts or " \n" in text or "\n " in text or _OTHER_SPACE.search(text):
            return self.pattern.findall(text)
        return [parts[0], *[" " + p for p in parts[1:]]]

    def learn(self, texts: list[list[str]]) -> None:
        """Find the ids of all units not known yet."""
        new = set().union(*texts) - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*texts)
        # a run of letters, with or without a space before, is one piece (isalpha is the pattern's letter class)
        words = [u for u in new if u[1:].isalpha() and (u[0] == " " or u[0].isalpha())] if self.usual else []
        mixed = [(u, [p.encode("utf-8", "surrogatepass") for p in self.pattern.findall(u)]) for u in new.difference(words)]
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        get = self.ranks.get
        todo = [p for p in {*coded, *[p for _, ps in mixed for p in ps]} if p not in self.ranks]
        short = sorted([p for p in todo if len(p) <= 32], key=len)
        ids: dict[bytes, tuple[int, ...]] = {}
        for at in range(0, len(short), 8192):
            ids.update(zip(short[at : at + 8192], self.merge_many(short[at : at + 8192]), strict=True))
        ids.update((p, merge_long(p, self.ranks)) for p in todo if len(p) > 32)
        one = lambda p: ids[p] if (r := get(p)) is None else (r,)
        self.known.update(zip(words, map(one, coded), strict=True))
        self.known.update((u, tuple(chain.from_iterable(map(one, ps)))) for u, ps in mixed)

    def merge_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """merge_long() of many short pieces at once: a row for each, one merge in every row at a time."""
        wide = max(map(len, pieces))
        flat = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in pieces), np.uint8).reshape(-1, wide)
        size = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(wide) < size[:, None], self.single[flat], np.int32(-1))
        done: list = [None] * len(pieces)
        rows = np.arange(len(pieces))
        made = self._made(ids[:, :-1], ids[:, 1:]) if wide > 1 else np.full((len(pieces), 1), NONE, np.int32)
        while len(rows):
            at = made.argmin(1)
            low = made[np.arange(len(rows)), at]
            ended = low == NONE
            if ended.any():
                for r, x in zip(rows[ended], ids[ended].tolist(), strict=True):
                    done[r] = tuple(x[: x.index(-1)] if -1 in x else x)
                go = ~ended
                rows, ids, made, at, low = rows[go], ids[go], made[go], at[go], low[go]
                if not len(rows):
                    break
            k = np.arange(len(rows))
            ids[k, at] = low
            cols = np.arange(ids.shape[1] - 1)
            ids = np.concatenate((np.take_along_axis(ids, cols + (cols > at[:, None]), 1), np.full((len(rows), 1), -1, np.int32)), 1)
            if made.shape[1] > 1:
                cols = np.arange(made.shape[1] - 1)
                made = np.concatenate((np.take_along_axis(made, cols + (cols >= at[:, None]), 1), np.full((len(rows), 1), NONE, np.int32)), 1)
            else:
                made[:] = NONE
            made[k, at] = self._made(ids[k, at], ids[k, np.minimum(at + 1, ids.shape[1] - 1)])
            left = np.flatnonzero(at > 0)
            made[left, at[left] - 1] = self._made(ids[left, at[left] - 1], ids[left, at[left]])
        return done

    def _made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that two tokens make, or NONE; -1 is no token."""
        out = np.full(a.shape, NONE, np.int32)
        both = (a >= 0) & (b >= 0)
        out[both] = self.made[self.pairs.find(mix(a[both].astype(np.uint64) << np.uint64(32) | b[both].astype(np.uint64)))]
        return out

    def encode(self, texts: list[list[str]]) -> list[list[int]]:
        """Ids of texts given as units."""
        self.learn(texts)
        get = self.known.__getitem__
        return [list(chain.from_iterable(map(get, units))) for units in texts]

    def finish(self, texts: list[list[str]], out: str) -> list[tuple]:
        ids = self.encode(texts)
        return [(x,) for x in ids] if out == "ids" else [_digest(x, self.names, self.vocab) for x in ids]


NONE = 1 << 30
_OTHER_SPACE = re.compile(r"[^\S \n]")


def encoder(ranks: bytes, pattern: str) -> Encoder:
    """The encoder of a worker process; made once."""
    return worker_tool("bpe", (hashlib.sha256(ranks).digest(), pattern), lambda: Encoder(load_ranks(ranks), pattern))


def cut(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """Overlapping chunks with their starts."""
    return [(0, text)] if len(text) <= chunk else [(at, text[at : at + chunk]) for at in range(0, len(text) - overlap, chunk - overlap)]


def stitch(chunks: Iterator[tuple[int, str, list[str] | None]], split: Callable[[str], list[str]]) -> Iterator[list[str]]:
    """The whole text's pieces (or units of them) from its chunks' starts, texts and pieces, in order; one chunk is held at a time."""
    held: tuple[int, str, list[str]] | None = None
    for start, text, found in chunks:
        found = split(text) if found is None else found
        if held is None:
            held = start, text, found
            continue
        at, before, pieces = held
        stop = at + len(before)
        ends = list(accumulate(map(len, pieces), initial=at))
        safe = [k for k, p in enumerate(ends) if p <= stop - MARGIN]
        here = {p: k for k, p in enumerate(accumulate(map(len, found), initial=start)) if p <= stop}
        k = next((k for k in safe if ends[k] in here), None)
        if k is not None:
            yield pieces[:k]
            held = start, text, found[here[ends[k]] :]
            held = ends[k], text[ends[k] - start :], held[2]
        else:
            k = safe[-1] if safe else 0
            yield pieces[:k]
            both = before[ends[k] - at :] + text[stop - start :]
            held = ends[k], both, split(both)
    if held is not None:
        yield held[2]


def _digest(ids: list[int], names: list[str], vocab: list[bytes]) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(b"".join(map(vocab.__getitem__, ids))).hexdigest()


SCHEMAS = {
    "ids": [("ids", pa.list_(pa.int32()), "array<int>")],
    "digest": [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")],
}


def encode(docs: DataFrame, ranks: bytes, pattern: str, out: str = "ids", id_col: str = "doc_id", text_col: str = "text", long: int = LONG, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Token ids of every whole text, as an array (``out="ids"``) or as count and digests of ids and of the decoded bytes.

    ranks: content of a rank file, of fixed size and broadcast. Returns ``id_col`` and the columns of ``SCHEMAS[out]``.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(ranks)
    fields = SCHEMAS[out]
    texts = docs.select(column(id_col).alias("id"), F.coalesce(column(text_col), F.lit("")).alias("t"))

    def make():
        tool = encoder(held.value, pattern)

        def run(columns):
            texts = [tool.units(t) if len(t) <= chunk else list(chain.from_iterable(stitch(((a, c, None) for a, c in cut(t, chunk, overlap)), tool.units))) for t in columns[0]]
            return list(map(list, zip(*tool.finish(texts, out), strict=True))) if texts else [[] for _ in fields]

        return run

    short = map_arrow(texts.where(F.length("t") <= long), ["id"], ["t"], make, fields, "bpe")

    # long texts: a row for each chunk, dealt out to pre-tokenise, then brought together by document
    step = chunk - overlap
    rows = texts.where(F.length("t") > long).select("id", F.xxhash64("t").alias("h"), F.length("t").alias("n"), "t")
    rows = rows.select("id", "h", "n", F.explode(F.expr(f"transform(sequence(0, n - {overlap} - 1, {step}), x -> struct(x as at, substring(t, cast(x as int) + 1, {chunk}) as t))")).alias("c")).select("id", "h", "n", "c.at", "c.t")
    rows = rows.repartition(F.col("h"), F.col("at"))

    def make_ends():
        tool = encoder(held.value, pattern)
        return lambda columns: [[[len(p) for p in tool.units(t)] for t in columns[0]]]

    parts = map_arrow(rows, ["id", "h", "n", "at", "t"], ["t"], make_ends, [("lens", pa.list_(pa.int32()), "array<int>")], "bpe")
    parts = parts.repartition("id", "h", "n").sortWithinPartitions("id", "h", "n", "at")

    def gather(batches):
        from itertools import groupby

        tool = encoder(held.value, pattern)

        def stream():
            for b in batches:
                kind.append(b.schema.field(0).type)
                yield from zip(*[c.to_pylist() for c in b.columns], strict=True)

        kind: list[pa.DataType] = []
        for key, group in groupby(stream(), key=lambda r: r[:3]):
            copies = [0]

            def chunks(group=group, copies=copies):
                last = -1
                for _, _, _, at, t, lens in group:
                    copies[0] += at == 0  # a repeated row repeats each of its chunks
                    if at != last:
                        last = at
                        ends = list(accumulate(lens, initial=0))
                        yield at, t, [t[a:b] for a, b in zip(ends, ends[1:])]

            got = tool.finish([list(chain.from_iterable(stitch(chunks(), tool.units)))], out)[0]
            yield pa.RecordBatch.from_arrays([pa.array([v] * copies[0], k) for v, k in zip((key[0], *got), (kind[0], *(k for _, k, _ in fields)), strict=True)], names=["id", *(n for n, _, _ in fields)])

    together = parts.mapInArrow(gather, ", ".join([f"id {dict(texts.dtypes)['id']}", *(f"{n} {k}" for n, _, k in fields)]))
    return short.unionByName(together).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, ranks: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Raw bytes of each row's ids, joined; null or empty ids give no bytes. Returns ``id_col`` and ``bytes``."""
    held = tokens.sparkSession.sparkContext.broadcast(ranks)

    def make():
        vocab = {v: k for k, v in load_ranks(held.value).items()}
        return lambda columns: [[b"".join(map(vocab.__getitem__, ids or ())) for ids in columns[0]]]

    return map_arrow(tokens, [id_col], [ids_col], make, [("bytes", pa.binary(), "binary")])
