"""Exact token counts at every prefix of a text, by dynamic programming over a piece model's merges.

A sequence of tokens is what merging gives if, and only if, each two neighbours stay apart when they are merged by
themselves. So the last token of each prefix is the one piece ending there that may follow the last token of what is
before it, and the prefix has one token more: every prefix gets its exact count from shorter ones, in one pass.

No merge reaches over a space that follows another character, over a character that stands in no longer piece, or from a
letter to a sign that no piece has after a letter. Texts are cut at such places into units, counts of units are remembered, and a text's counts are its units' counts, added up.

Counts are kept as rows of up to ``WIDTH`` prefixes, so a row stays small however long its text is. Questions about
truncation and budgets are answered from them with Spark functions, without the model.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, worker_tool

SPACE = "▁"
#: Prefixes in one row; units and pairs that a worker remembers, after which it starts over.
WIDTH, REMEMBERED, PAIRS = 1 << 16, 400_000, 1 << 20
#: Longer units aren't remembered.
LONG_UNIT = 64
LETTER = r"[^\W\d_]"


class Counter:
    """The pieces of a model, and counts at every prefix of the units met so far."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        kinds = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if sp.normalize("Ａ \n b ") != f"{SPACE}Ａ{SPACE}\n{SPACE}b{SPACE}":
            raise ValueError("the model changes texts before it cuts them; only white-space marks are supported")
        if any(sp.is_unused(i) for i in kinds):
            raise ValueError("models with unused pieces aren't supported")
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in kinds}
        self.names = list(self.score)
        self.found = ahocorasick.Automaton()
        for n, piece in enumerate(self.names):
            self.found.add_word(piece, (len(piece), n))
        self.found.make_automaton()
        inner = {c for p in self.score if len(p) > 1 for c in p}
        bars = re.escape("".join(c for c in map(chr, range(128)) if c not in inner))
        # signs that no piece has after a letter
        signs = [c for c in map(chr, range(33, 127)) if c in inner and not c.isalnum() and not any(re.search(f"{LETTER}{re.escape(c)}", p) for p in self.score)]
        if any(SPACE in p.lstrip(SPACE) for p in self.score):  # pieces over several words: cut at bars alone
            self.cut = re.compile(f"[{bars}]?[^{bars}]+|[{bars}]")
        else:
            signs = re.escape("".join(signs)) or bars
            rest = f"[^{SPACE}{bars}{signs}]*(?:(?<!{LETTER})[{signs}][^{SPACE}{bars}{signs}]*)*"
            self.cut = re.compile(f"(?:{SPACE}+|[{bars}]|(?<={LETTER})[{signs}]){rest}|[^{SPACE}{bars}{signs}]{rest}")
        self.units = Units(self.unit)
        self.after: dict[int, dict[int, bool]] = {}
        self.asked = 0

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text: the two neighbours with the best joint score are merged, the leftmost of equals, until none is left."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def followers(self, piece: int) -> dict[int, bool]:
        """Which pieces may follow a piece (or begin a unit, for -1), as far as it has been asked; the piece itself is under -2."""
        got = self.after.get(piece)
        if got is None:
            got = self.after[piece] = {-2: piece}
        return got

    def follows(self, before: dict[int, bool], piece: int) -> bool:
        """Finds out whether a piece may follow. Numbers beyond the pieces' are characters that are no piece."""
        text = [self.names[n] if n < len(self.names) else chr(n - len(self.names)) for n in (before[-2], piece) if n >= 0]
        got = before[piece] = self.merged("".join(text)) == text
        self.asked += 1
        return got

    def unit(self, text: str) -> np.ndarray:
        """Token counts of all prefixes of a unit but the empty one."""
        if self.asked > PAIRS:
            self.after, self.asked = {}, 0
        size = len(text)
        last, count = [self.followers(-1)] * (size + 1), [0] * (size + 1)  # followers of the last token of each prefix
        followers, follows, others = self.followers, self.follows, len(self.names)
        done = 0
        for at, (length, piece) in self.found.iter(text):  # all pieces, by where they end
            if done > at:
                continue  # this end has its last token
            while done < at:  # no piece may end there: a token for each byte of the character
                count[done + 1] = count[done] + len(text[done].encode("utf-8", "surrogatepass"))
                last[done + 1] = followers(others + ord(text[done]))
                done += 1
            start = at + 1 - length
            before = last[start]
            ok = before.get(piece)
            if follows(before, piece) if ok is None else ok:
                done = at + 1
                last[done] = followers(piece)
                count[done] = count[start] + 1
        while done < size:
            count[done + 1] = count[done] + len(text[done].encode("utf-8", "surrogatepass"))
            last[done + 1] = followers(others + ord(text[done]))
            done += 1
        return np.array(count[1:], np.int32)

    def counts(self, text: str) -> np.ndarray:
        """Token counts of the first 1, 2, ... characters of a text."""
        if not text:
            return np.zeros(0, np.int32)
        found = list(map(self.units.__getitem__, self.cut.findall(SPACE + text.replace(" ", SPACE))))
        out = np.concatenate(found)
        sizes = np.array(list(map(len, found)))
        before = np.cumsum(out[np.cumsum(sizes) - 1])
        out[sizes[0] :] += np.repeat(before[:-1], sizes[1:]).astype(np.int32)
        return out[1:]  # the mark before the text is no character of it


class Units(dict):
    """Counts of the units met so far; of those not met lately, the older half is forgotten."""

    def __init__(self, make: Callable[[str], np.ndarray]):
        self.make, self.older = make, {}

    def __missing__(self, unit: str) -> np.ndarray:
        got = self.older.get(unit)
        if got is None:
            got = self.make(unit)
        if len(unit) <= LONG_UNIT:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[unit] = got
        return got


def counter(model: bytes) -> Counter:
    """The counter of a worker process; made once."""
    return worker_tool("pieces", hashlib.sha256(model).digest(), lambda: Counter(model))


def prefix_counts(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Token counts at every prefix of every whole text, in rows of ``width`` prefixes.

    model: content of a piece model, of fixed size and broadcast. Returns ``id_col``, ``text_hash``, ``n_bytes`` (UTF-8),
    ``start``, ``counts`` (``counts[i]``, from 0, is the exact count of the text's first ``start + i + 1`` characters)
    and ``last``, true in the last row of a text. Null text counts as empty, and an empty one has a single row without
    counts. Repeated rows repeat all their rows; null ids stay; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    asked = docs.select(column(id_col).alias("id"), F.xxhash64(text).alias("h"), F.octet_length(text).cast("long").alias("b"), text.alias("t"))
    kind = dict(asked.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(held.value)

        def batch(rows: list[tuple], ids: pa.Array) -> pa.RecordBatch:
            at, hashes, sizes, starts, values, last = zip(*rows, strict=True)
            offsets = np.zeros(len(values) + 1, np.int32)
            np.cumsum([len(v) for v in values], out=offsets[1:])
            counts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))
            return pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at)), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(starts, pa.int64()), counts, pa.array(last, pa.bool_())],
                names=["id", "text_hash", "n_bytes", "start", "counts", "last"],
            )

        for b in batches:
            ids, rows, held_back = b.column(0), [], 0
            for i, (h, n, t) in enumerate(zip(*(b.column(k) for k in (1, 2, 3)), strict=True)):
                found = tool.counts(t.as_py())
                for at in range(0, max(1, len(found)), width):
                    part = found[at : at + width]
                    rows.append((i, h.as_py(), n.as_py(), at, part, at + width >= len(found)))
                    held_back += len(part)
                    if held_back >= 1 << 20:  # bounds what a batch takes
                        yield batch(rows, ids)
                        rows, held_back = [], 0
            if rows:
                yield batch(rows, ids)

    out = asked.mapInArrow(run, f"id {kind}, text_hash long, n_bytes long, start long, counts array<int>, last boolean")
    return out.withColumnRenamed("id", id_col)


def totals(prefixes: DataFrame, limit: int, id_col: str = "doc_id") -> DataFrame:
    """Bytes and tokens of each text, and whether it has more than ``limit`` tokens; a row for each last row of ``prefix_counts``."""
    n = F.coalesce(F.try_element_at("counts", F.lit(-1)), F.lit(0)).cast("long")
    return prefixes.where("last").select(column(id_col), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))


def tokens_of(prefixes: DataFrame, asked: DataFrame, id_col: str = "doc_id", chars_col: str = "n_chars") -> DataFrame:
    """Tokens of the first ``chars_col`` characters of the texts named by ``asked`` (id_col, chars_col).

    Null, zero and negative numbers of characters give 0 tokens; beyond the end, the whole text counts. Ids without a
    text have no row, and null ids meet none. Repeated questions are answered once, and texts that share an id apart.
    """
    asked = asked.select(column(id_col).alias("_id"), column(chars_col).alias("_n")).distinct()
    width = F.size("counts")
    at = F.greatest(F.coalesce("_n", F.lit(0)).cast("long"), F.lit(0).cast("long"))
    here = F.when((at > F.col("start")) & (at <= F.col("start") + width), F.element_at("counts", F.greatest(at - F.col("start"), F.lit(1).cast("long")).cast("int")))
    beyond = F.when(F.col("last") & (at > F.col("start") + width) & (width > 0), F.element_at("counts", -1))
    found = prefixes.join(asked, column(id_col) == F.col("_id"))
    found = found.groupBy(column(id_col), "text_hash", "_n").agg(F.coalesce(F.max(F.coalesce(here, beyond)), F.lit(0)).cast("long").alias("n_tokens"))
    return found.select(column(id_col), "text_hash", F.col("_n").alias(chars_col), "n_tokens")


def fitting(prefixes: DataFrame, budget: int, id_col: str = "doc_id") -> DataFrame:
    """The longest prefix of each text that has at most ``budget`` tokens: (id_col, text_hash, n_chars, n_tokens).

    A longer prefix can have fewer tokens than a shorter one, so the last fitting place decides. A text of which nothing
    fits gets 0 and 0. Repeated rows are answered once; texts that share an id, apart.
    """
    # each row gives its own last fitting place; the latest of a text is its answer
    place = F.array_max(F.transform("counts", lambda c, i: F.when(c <= budget, i + 1)))
    best = F.when(place.isNotNull(), F.struct((F.col("start") + place).alias("n_chars"), F.element_at("counts", place).cast("long").alias("n_tokens")))
    found = prefixes.withColumn("_best", best).groupBy(column(id_col), "text_hash").agg(F.max("_best").alias("_best"))
    return found.select(column(id_col), "text_hash", *[F.coalesce(F.col(f"_best.{c}"), F.lit(0)).cast("long").alias(c) for c in ("n_chars", "n_tokens")])


def packed(prefixes: DataFrame, window: int, id_col: str = "doc_id") -> DataFrame:
    """Windows of ``window`` tokens that each text fills, and tokens of the last one: (id_col, n_windows, last_tokens); empty texts fill none."""
    total = totals(prefixes, window, id_col)
    full = F.ceil(F.col("n_tokens") / window)
    return total.select(column(id_col), full.alias("n_windows"), (F.col("n_tokens") - F.greatest(full - 1, F.lit(0)) * window).alias("last_tokens"))
