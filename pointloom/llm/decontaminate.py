"""Benchmark passages in documents, by the q-gram lemma on diagonal bands.

Texts are lower-cased, and every run of characters other than ASCII letters and digits and those above 0x7F becomes
one space. An item of L characters may differ from a stretch of a document by k = 7 % of L edits. Then they share at
least L + 1 - q - q * k q-grams, whose diagonals (place in the document less place in the item) lie within k of each
other. So hits are counted in bands of 2k diagonals, each overlapping the next by k; a band with enough hits is
filtered again by the lemma for q = 4 (a tighter bound, without regard to diagonals) and then verified by alignment of the
item with the stretch under the band, in which no path can leave it. k is at most (L - 10) / 10, one less than 7 % give for
items of 15 to 19 and of 29 characters: with more edits the lemma promises them nothing.

Where many items share a phrase that stands often in a document, the hits are counted in sections of the document that
overlap by more than a band is long, so that no more than ``MOST_HITS`` are held at once.

The items are read in blocks of at most ``BLOCK_CHARS`` characters, so that what is broadcast has a bound; each block
is one more narrow map over the documents. There is no shuffle, so no document, source or passage can be hot.

Null and empty texts hold nothing; items without characters match nothing; items shorter than q must be equal to a run
of whole words. Items of equal text are all reported. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import best_ends
from .common import U64, HashIndex, codepoints, column, map_arrow, mix

Q, EDITS, BLOCK_CHARS = 10, 0.07, 1 << 21
#: Length of the grams that bands are filtered by, and of hits that are held at once.
FINE, MOST_HITS = 4, 1 << 22

_ALNUM = np.array([chr(i).isalnum() for i in range(128)])


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised text with a space at either edge, and the place of each in the text."""
    low = text.lower()
    units = codepoints(low)
    plain = units < 128
    solid = ~plain
    solid[plain] = _ALNUM[units[plain]]
    keep = solid.copy()
    keep[1:] |= solid[:-1]  # the first of a run of others
    if len(keep):
        keep[0] = solid[0]
    at = np.flatnonzero(keep)
    out = np.full(len(at) + 2, 32, np.uint32)
    out[1:-1] = np.where(solid[at], units[at], 32)
    if len(low) != len(text):  # lower case can be longer
        at = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])[at] if sum(len(c.lower()) for c in text) == len(low) else np.minimum(at, len(text) - 1)
    at = np.concatenate(([0], at, [len(text)]))
    if len(out) > 2 and out[-2] == 32:
        out, at = out[:-1], at[:-1]
    return out, at


def gram_hashes(units: np.ndarray) -> np.ndarray:
    """Hashes of all q-grams, for q = 10."""
    if len(units) < Q:
        return np.zeros(0, U64)
    b, b2, b4 = (U64(pow(0x9E3779B97F4A7C15, n, 1 << 64)) for n in (1, 2, 4))
    u = units.astype(U64)
    h2 = u[:-1] * b + u[1:]
    h4 = h2[:-2] * b2 + h2[2:]
    h8 = h4[:-4] * b4 + h4[4:]
    return h8[:-2] * b2 + h2[8:]


def budget(length: int) -> tuple[int, int]:
    """Edits allowed for an item of this length, and the q-grams that then are shared at least."""
    k = min(int(EDITS * length), max(0, (length - Q) // Q))
    return k, length + 1 - Q - Q * k


class Items:
    """An index of the q-grams of a block of items."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids, self.units, self.short = ids, [], []
        grams, owner, place = [np.zeros(0, U64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for n, text in enumerate(texts):
            u = normalise(text)[0]
            u = u[1:-1]
            self.units.append(u.astype(np.uint32))
            if 0 < len(u) < Q:
                self.short.append(n)
            h = gram_hashes(u)
            grams.append(h), owner.append(np.full(len(h), n, np.int32)), place.append(np.arange(len(h), dtype=np.int32))
        h, owner, place = map(np.concatenate, (grams, owner, place))
        order = np.argsort(h, kind="stable")
        self.owner, self.place = owner[order], place[order]
        keys, self.first, self.many = np.unique(h[order], return_index=True, return_counts=True)
        self.index = HashIndex(mix(keys))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[mix(keys) >> U64(42)] = True
        bound = [budget(len(u)) for u in self.units]
        self.k = np.array([b[0] for b in bound], np.int64)
        self.least = np.array([max(1, b[1]) for b in bound], np.int64)
        self.longest = max(map(len, self.units), default=0)
        self.fewest = int(self.least[[n for n, u in enumerate(self.units) if len(u) >= Q]].min()) if any(len(u) >= Q for u in self.units) else 0

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of each item held by the text, at its closest place in each band."""
        if not text:
            return []
        units, at = normalise(text)
        found = []
        for n in self.short:
            found += self._equal(n, units, at)
        h = mix(gram_hashes(units))
        hits = np.flatnonzero(self.bits[h >> U64(42)])
        if not self.fewest or len(hits) < self.fewest:
            return found
        got = self.index.find(h[hits])
        hits, got = hits[got >= 0], got[got >= 0]
        if len(hits) < self.fewest:
            return found
        seen: dict[int, tuple] = {}
        fine, fine_at = self._fine(units), {}
        for key in self._bands(hits, got).tolist():
            n, low = key >> 40, ((key & (1 << 40) - 1) - (1 << 20))
            k, length = int(self.k[n]), len(self.units[n])
            a = low * max(k, 1)
            a, b = max(0, a - k), min(len(units), a + 2 * max(k, 1) + length + k)
            if n not in fine_at:  # where each place's gram stands among those of the item
                own = np.unique(self._fine(self.units[n]))
                spot = np.minimum(np.searchsorted(own, fine), len(own) - 1)
                fine_at[n] = np.concatenate(([0], np.cumsum(own[spot] == fine)))
                while len(fine_at) * len(units) > MOST_HITS and len(fine_at) > 1:
                    del fine_at[next(iter(fine_at))]
            if fine_at[n][max(a, b - FINE + 1)] - fine_at[n][a] < length + 1 - FINE - FINE * k:
                continue
            stretch = units[a:b].tolist()
            item = self.units[n].tolist()
            best = best_ends(item, stretch, k)
            if best is None:
                continue
            end = best[1]
            back = best_ends(item[::-1], stretch[:end][::-1], best[0])
            start = end - back[1]
            s, e = int(at[a + start]), int(at[a + end - 1]) + 1
            if (n, s, e) not in seen:
                seen[n, s, e] = (self.ids[n], s, e, best[0])
        return sorted(found + list(seen.values()))

    @staticmethod
    def _fine(units: np.ndarray) -> np.ndarray:
        """Hashes of all grams of FINE units."""
        h = np.zeros(max(0, len(units) - FINE + 1), U64)
        for i in range(FINE):
            h = h * U64(0x9E3779B97F4A7C15) + units[i : i + len(h)].astype(U64)
        return h

    def _bands(self, hits: np.ndarray, got: np.ndarray) -> np.ndarray:
        """item << 40 | band of the bands with enough hits, from the places of hits in the text and their grams' numbers."""
        total = np.cumsum(self.many[got])
        reach = self.longest + 4 * int(self.k.max(initial=0)) + Q
        if len(hits) and total[-1] > MOST_HITS and hits[-1] - hits[0] > 4 * reach:
            middle = int(np.searchsorted(total, total[-1] // 2))
            middle = min(max(int(hits[middle]), int(hits[0]) + 2 * reach), int(hits[-1]) - 2 * reach)
            left, right = hits < middle + reach, hits >= middle - reach
            if not left.all() and not right.all():
                return np.union1d(self._bands(hits[left], got[left]), self._bands(hits[right], got[right]))
        many = self.many[got]
        where = np.repeat(hits, many)
        k = np.repeat(self.first[got] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        item, diagonal = self.owner[k].astype(np.int64), where - self.place[k]
        band = diagonal // np.maximum(self.k[item], 1)
        # each hit counts in the band that begins at its step and in the one before, which both hold it
        keys = item << 40 | (band + (1 << 20))
        keys, counts = np.unique(keys, return_counts=True)
        both, where = np.unique(np.concatenate((keys, keys - 1)), return_inverse=True)
        counts = np.bincount(where, np.concatenate((counts, counts)), len(both)).astype(np.int64)
        return both[counts >= self.least[both >> 40]]

    def _equal(self, n: int, units: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        want = np.array([32, *self.units[n], 32], np.uint32)
        if len(want) > len(units):
            return []
        places = np.flatnonzero((np.lib.stride_tricks.sliding_window_view(units, len(want)) == want).all(1))
        return [(self.ids[n], int(at[p + 1]), int(at[p + len(want) - 2]) + 1, 0) for p in places.tolist()]


def blocks(items: DataFrame, id_col: str, text_col: str, chars: int) -> Iterator[tuple[list[int], list[str]]]:
    """The items in blocks of about this many characters, each of bounded size."""
    usable = items.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    total = usable.agg(F.sum(F.length("t"))).first()[0] or 0
    n = int(-(-total // chars))
    for b in range(n):
        part = usable.where(F.pmod(F.xxhash64("id", "t"), F.lit(n)) == b).orderBy("id", "t").collect()
        yield [r.id for r in part], [r.t for r in part]


def find_passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each row of ``docs``: id, n_items, items (their ids, sorted), spans (item:start:end:edits in code points)."""
    found = pa.list_(pa.struct([("item", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("d", pa.int64())]))
    ddl = "array<struct<item:long,s:long,e:long,d:long>>"
    df = docs.select(column(id_col).alias("id"), column(text_col).alias("t"), F.lit(None).cast(ddl).alias("found"))
    for ids, texts in blocks(items, item_col, item_text, block_chars):
        held = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def make(held=held):
            index = Items(*held.value)

            def run(columns):
                out = []
                for text, before in zip(*columns, strict=True):
                    more = [{"item": i, "s": s, "e": e, "d": d} for i, s, e, d in index.find(text)]
                    out.append((before or []) + more)
                return [out]

            return run

        df = map_arrow(df, ["id", "t"], ["t", "found"], make, [("found", found, ddl)])
    every = F.array_sort(F.coalesce("found", F.array().cast(ddl)))
    ids = F.array_distinct(F.transform(every, lambda x: x["item"]))
    return df.select(
        F.col("id").alias(id_col), F.size(ids).cast("long").alias("n_items"), F.array_join(ids, ",").alias("items"),
        F.array_join(F.transform(every, lambda x: F.concat_ws(":", x["item"], x["s"], x["e"], x["d"])), ",").alias("spans"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item. A filter in place, without a join."""
    out = docs
    for ids, texts in blocks(items, item_col, item_text, block_chars):
        out = out.where(_clean(docs.sparkSession.sparkContext.broadcast((ids, texts)))(column(text_col)))
    return out


def _clean(held):
    """Whether a text holds none of the broadcast items."""

    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Items(*held.value)
        for part in parts:
            yield part.map(lambda t: not index.find(t or "")).astype(bool)

    return F.pandas_udf(clean, "boolean")
