"""Trie of conversation prefixes, held as a table of nodes with minimal perfect slots.

A node is a distinct sequence of turns that some conversation begins with. Conversations come as blocks of up to
``BLOCK`` turns, which tasks put together into shards of bounded size. In a shard, the distinct prefix digests get slots
0, 1, ... by a minimal perfect hash; each slot keeps its digest, its parent's and its last turn's key, and every row that
is scattered to a slot is compared with them, so no two prefixes can share one unseen. Counts are scattered into flat
arrays and summed from the deepest nodes up, through an array of parent slots. What shards find adds up by digest.

Sums over subtrees are taken in two passes, each of them linear in the conversations, so that no pass has to follow the
trie over shards. The first gives members, ends and, for each node, the bytes below it counted once for each member. It
also tells each node's owner, its smallest member; a conversation owns the tail of its path. In the second pass each
conversation brings what it owns (bytes counted once for each node, leaves, children) to all nodes of its path.

Paths are cut at depths that are multiples of ``BLOCK``. What lies beyond the cut reaches a block as sums from a table
of its conversation's blocks, so a conversation of any length is dealt out like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators.rounds import running_within

from .common import CRC_TABLE, Tables, column, crc_of, mix

BLOCK, SHARD = 1 << 10, 1 << 16
#: Prefix digests are polynomials of the turns' keys modulo a Mersenne prime.
PRIME, BASE = (1 << 127) - 1, 0x5DEECE66D1B54A32D192ED03A6E2B9F1
ROOT = (1).to_bytes(16, "big")
U64 = np.uint64


def turn_rows(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, key, bytes): turns by digests of role and text; null role or text is empty, rows without a conversation go."""
    role, text = (F.coalesce(column(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    return conversations.select(column(id_col).cast("long").alias("conv"), column(turn_col).alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes")).where("conv is not null")


def _packed(turns: DataFrame, block: int) -> DataFrame:
    """(conv, block, turns): runs of ``block`` turns in order of turn, null first, equal ones by key."""
    placed = running_within(turns, ["conv"], [F.col("turn").asc_nulls_first(), F.col("key").asc()], {"pos": F.lit(1).cast("long")})
    run = F.array_sort(F.collect_list(F.struct("pos", "key", "bytes")))
    return placed.groupBy("conv", F.floor((F.col("pos") - 1) / block).alias("block")).agg(run.alias("turns"))


def _plain(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["key"].alias("key"), t["bytes"].alias("bytes")))


def blocks(conversations: DataFrame, block: int = BLOCK, **names: str) -> DataFrame:
    """Conversations as they are: (conv, block, depth, turns), depth being that of the node before the first turn."""
    return _packed(turn_rows(conversations, **names), block).select("conv", "block", (F.col("block") * block).alias("depth"), _plain(F.col("turns")).alias("turns"))


def rebuilt(conversations: DataFrame, family: int = 5, most: int = 9, block: int = BLOCK, **names: str) -> DataFrame:
    """Blocks of conversations whose beginnings are those of their family's first.

    Conversation c starts with the first h turns of c - c mod ``family`` (with all it has, if fewer; with none, if there
    is no such conversation), then has its own turns after its first h; h is crc32 of c as text, modulo ``most``. The
    remainder is never negative. Conversations left without turns stay, as one empty block.
    """
    tables = Tables()
    if most > block:
        raise ValueError("beginnings must lie within one block")
    packed = tables.keep(_packed(turn_rows(conversations, **names), block), "packed")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("long")
    base = F.col("conv") - F.pmod("conv", F.lit(family))
    first = packed.where("block = 0")
    heads = first.where(base == F.col("conv")).select(F.col("conv").alias("base"), F.slice("turns", 1, most).alias("head"))
    begun = first.withColumn("base", base).join(heads, "base", "left")
    lent = F.when(h > 0, F.slice(F.coalesce("head", F.array()), 1, F.greatest(h, F.lit(1)).cast("int"))).otherwise(F.array())
    own = F.filter("turns", lambda t: t["pos"] > h)
    begun = begun.select("conv", "block", F.lit(0).cast("long").alias("depth"), _plain(F.concat(lent, own)).alias("turns"), F.size(lent).cast("long").alias("lent"))
    begun = tables.keep(begun, "begun")
    later = packed.where("block > 0").join(begun.select("conv", "lent"), "conv")  # a row for each block of a long conversation
    later = later.select("conv", "block", (F.col("block") * block - h + F.col("lent")).alias("depth"), _plain(F.col("turns")).alias("turns"))
    return begun.drop("lent").unionByName(later)


def extend(digest: int, keys: list[bytes]) -> list[int]:
    """Digests of a prefix lengthened by one turn after the other."""
    out = []
    for k in keys:
        digest = (digest * BASE + int.from_bytes(k, "big") + 1) % PRIME
        out.append(digest)
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block: what it adds to a digest (from 0), its turns and bytes."""
    for b in batches:
        turns = b.column(3).to_pylist()
        added = [extend(0, [t["key"] for t in ts])[-1].to_bytes(16, "big") if ts else bytes(16) for ts in turns]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(added, pa.binary()), pa.array([len(ts) for ts in turns], pa.int64()), pa.array([sum(t["bytes"] for t in ts) for ts in turns], pa.int64())], names=["conv", "block", "added", "n", "bytes"])


def _carried(frame):
    """Of a conversation's blocks: digest and bytes before each, bytes after it, and which is the last."""
    frame = frame.sort_values("block")
    before, digest = [], 1
    for added, n in zip(frame["added"], frame["n"], strict=True):
        before.append(digest.to_bytes(16, "big"))
        digest = (digest * pow(BASE, int(n), PRIME) + int.from_bytes(added, "big")) % PRIME
    ends = frame["bytes"].cumsum()
    return frame.assign(digest=before, upto=ends - frame["bytes"], after=ends.iloc[-1] - ends, last=np.arange(len(frame)) == len(frame) - 1)[["conv", "block", "digest", "upto", "after", "last"]]


def carried(found: DataFrame) -> DataFrame:
    """Blocks with what lies before and after them in their conversation; only those of several blocks need a look-up."""
    several = found.where("block > 0").select("conv").distinct()
    sums = found.join(several, "conv", "left_semi").select("conv", "block", "depth", "turns").mapInArrow(_sums, "conv long, block long, added binary, n long, bytes long")
    carry = sums.groupBy("conv").applyInPandas(_carried, "conv long, block long, digest binary, upto long, after long, last boolean")
    zero = F.lit(0).cast("long")
    return found.join(carry, ["conv", "block"], "left").select(
        "conv", "block", "depth", "turns", F.coalesce("digest", F.lit(ROOT)).alias("digest"), F.coalesce("upto", zero).alias("upto"), F.coalesce("after", zero).alias("after"), F.coalesce("last", F.lit(True)).alias("last")
    )


class Slots:
    """A minimal perfect hash of distinct 16-byte digests, each of which is kept in its slot.

    In every round the digests left over are hashed into twice as many places as there are; those alone at theirs are
    settled. The slot is the number of settled places before.
    """

    def __init__(self, digests: np.ndarray):
        """digests: distinct, (n, 2) unsigned 64-bit integers."""
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, settled = digests, 0
        while len(left):
            if len(self.levels) > 200:
                raise ValueError("digests are not distinct")
            size = 2 * len(left)
            at = self._place(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((alone, settled + np.cumsum(alone) - 1))
            settled += int(alone.sum())
            left = left[~alone[at]]
        self.digests = np.zeros((len(digests), 2), U64)
        self.digests[self._slot(digests)] = digests
        if len(digests) and not (self.digests[self._slot(digests)] == digests).all():
            raise ValueError("two digests share a slot")

    @staticmethod
    def _place(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(digests[:, 0] ^ mix(digests[:, 1] + U64(level + 1))) % U64(size)).astype(np.int64)

    def _slot(self, digests: np.ndarray) -> np.ndarray:
        out = np.full(len(digests), -1, np.int64)
        todo = np.arange(len(digests))
        for level, (alone, slot) in enumerate(self.levels):
            at = self._place(digests[todo], level, len(alone))
            hit = alone[at]
            out[todo[hit]] = slot[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        return out

    def find(self, digests: np.ndarray) -> np.ndarray:
        """Slot of each digest; -1 if it has none, which the digest kept there tells."""
        out = self._slot(digests)
        if len(self.digests):
            out[(self.digests[out] != digests).any(axis=1)] = -1
        return out


def _pairs(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), ">u8").reshape(-1, 2).astype(U64)


class Shard:
    """Paths of some blocks, cut at multiples of ``size`` turns, and the arrays of their nodes."""

    def __init__(self, size: int):
        self.size = size
        self.digest, self.parent, self.key = [], [], []  # of each turn
        self.depth, self.bytes, self.upto, self.conv, self.row = [], [], [], [], []
        self.ends: list[tuple] = []  # of each piece of a path: its last turn's place here (-1: none), its block's row, bytes after it, bytes from its start on
        self.tops: list[tuple] = []  # of each piece: digest and depth of the node before it
        self.rows: list[tuple] = []

    def add(self, row: dict) -> None:
        """row: a block with what is carried, and what a pass needs beside."""
        keys = [t["key"] for t in row["turns"]]
        nbytes = [t["bytes"] for t in row["turns"]]
        digests = [d.to_bytes(16, "big") for d in extend(int.from_bytes(row["digest"], "big"), keys)]
        before, depth, upto, left = row["digest"], row["depth"], row["upto"], sum(nbytes) + row["after"]
        r, at = len(self.rows), 0
        self.rows.append(row)
        while True:
            n = min(self.size - depth % self.size, len(keys) - at)
            self.tops.append((before, depth))
            place, whole = len(self.digest), left
            for i in range(at, at + n):
                upto += nbytes[i]
                left -= nbytes[i]
                self.digest.append(digests[i])
                self.parent.append(digests[i - 1] if i else row["digest"])
                self.upto.append(upto)
            self.key += keys[at : at + n]
            self.bytes += nbytes[at : at + n]
            self.depth += range(depth + 1, depth + n + 1)
            self.conv += [row["conv"]] * n
            self.row += [r] * n
            self.ends.append((place + n - 1 if n else -1, r, left, whole))
            at, depth = at + n, depth + n
            if at >= len(keys):
                return
            before = digests[at - 1]

    def build(self) -> None:
        """Slots, and for each slot its depth and its parent's slot (-1: none within the shard)."""
        n = len(self.digest)
        own, up = _pairs(self.digest), _pairs(self.parent)
        top = _pairs([d for d, _ in self.tops])
        self.slots = Slots(np.unique(np.concatenate((own, top)), axis=0))
        self.n = len(self.slots.digests)
        self.at, self.top = self.slots.find(own), self.slots.find(top)
        key = _pairs(self.key)
        depth = np.array(self.depth, np.int64)
        self.level = np.full(self.n, -1, np.int64)
        self.level[self.top] = [d for _, d in self.tops]
        self.level[self.at] = depth
        self.above, self.last = np.zeros((self.n, 2), U64), np.zeros((self.n, 2), U64)
        self.above[self.at], self.last[self.at] = up, key
        if not ((self.above[self.at] == up).all() and (self.last[self.at] == key).all() and (self.level[self.at] == depth).all()):
            raise ValueError("two prefixes have the same digest")
        self.up = np.full(self.n, -1, np.int64)
        linked = np.zeros(self.n, bool)
        linked[self.at] = (depth - 1) % self.size > 0
        linked[self.at[depth == 1]] = True
        at = np.flatnonzero(linked)
        self.up[at] = self.slots.find(self.above[at])
        step = np.where(self.level > 0, (self.level - 1) % self.size + 1, 0)
        order = np.argsort(step, kind="stable")
        self.steps = [s for s in np.split(order, np.flatnonzero(np.diff(step[order])) + 1) if n][::-1]

    def scattered(self, slots, values) -> np.ndarray:
        out = np.zeros(self.n, np.int64)
        np.add.at(out, slots, values)
        return out

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Values of each node and of all nodes below it in the shard, from the deepest up."""
        out = values.copy()
        for s in self.steps:
            s = s[self.up[s] >= 0]
            np.add.at(out, self.up[s], out[s])
        return out

    def least(self, values: np.ndarray) -> np.ndarray:
        out = values.copy()
        for s in self.steps:
            s = s[self.up[s] >= 0]
            np.minimum.at(out, self.up[s], out[s])
        return out

    def binary(self, pairs: np.ndarray) -> pa.Array:
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(pairs), [None, pa.py_buffer(pairs.astype(">u8").tobytes())]).cast(pa.binary())

    def stops(self) -> np.ndarray:
        """Slot where each piece of a path ends: its last turn's, or, without turns, the node before it."""
        return np.array([self.at[e[0]] if e[0] >= 0 else self.top[k] for k, e in enumerate(self.ends)], np.int64)

    def pieces(self) -> tuple[np.ndarray, ...]:
        """Of each piece: its block's row, bytes after it, bytes from its start on, whether it counts, whether it begins within a stretch.

        An empty piece counts at the root alone. A block may begin within a stretch of ``size`` turns; the stretch's
        earlier nodes then have the conversation from the block before, so what flows to them is taken off again.
        """
        row, after, whole = (np.array([e[k] for e in self.ends], np.int64) for k in (1, 2, 3))
        depth = np.array([d for _, d in self.tops], np.int64)
        filled = np.array([e[0] >= 0 for e in self.ends], bool)
        return row, after, whole, filled | (depth == 0), filled & (depth % self.size > 0)


NONE = np.iinfo(np.int64).max


def _members(s: Shard) -> pa.RecordBatch:
    """First pass: members, ends and bytes below each node, counted once for each member."""
    s.build()
    stop = s.stops()
    rows, after, whole, some, within = s.pieces()
    conv = np.array([r["conv"] for r in s.rows], np.int64)[rows]
    full = np.array([r["last"] for r in s.rows], bool)[rows] & np.append(rows[1:] != rows[:-1], True)
    n = s.scattered(stop[some], 1)
    np.add.at(n, s.top[within], -1)
    n = s.summed(n)
    low = np.full(s.n, NONE)
    np.minimum.at(low, stop[some], conv[some])
    low = s.least(low)
    below = s.scattered(s.at, np.array(s.bytes, np.int64))
    np.add.at(below, stop[some], after[some])
    np.add.at(below, s.top[within], -whole[within])
    below = s.summed(below)
    size, upto = np.zeros(s.n, np.int64), np.zeros(s.n, np.int64)
    size[s.at], upto[s.at] = s.bytes, s.upto
    ended = s.scattered(stop[full], 1)
    order = np.argsort(stop[full], kind="stable")
    bounds = np.zeros(s.n + 1, np.int32)
    np.cumsum(ended, out=bounds[1:])
    ends = pa.ListArray.from_arrays(pa.array(bounds), pa.array(conv[full][order]))
    have = pa.array(np.flatnonzero((n > 0) | (ended > 0)))
    columns = [s.binary(s.slots.digests), pa.array(s.level), s.binary(s.above), s.binary(s.last), pa.array(size), pa.array(upto), pa.array(low), pa.array(n), pa.array(ended), pa.array(below), ends]
    names = ["digest", "depth", "parent", "key", "bytes", "upto", "conv", "n_convs", "n_ends", "below", "ends"]
    return pa.RecordBatch.from_arrays([c.take(have) for c in columns], names=names)


MEMBERS = "digest binary, depth long, parent binary, key binary, bytes long, upto long, conv long, n_convs long, n_ends long, below long, ends array<long>"


def _owned(s: Shard) -> pa.RecordBatch:
    """Second pass: leaves, children and bytes of the nodes below each node, counted once for each node."""
    s.build()
    stop = s.stops()
    rows, after, whole, some, within = s.pieces()
    start = np.array([NONE if r["start"] is None else r["start"] for r in s.rows], np.int64)
    skipped = np.array([r["skipped"] or 0 for r in s.rows], np.int64)  # bytes of a path before what its conversation owns
    total = np.array([r["upto"] + sum(t["bytes"] for t in r["turns"]) + r["after"] for r in s.rows], np.int64)
    row = np.array(s.row, np.int64)
    mine = np.array(s.depth, np.int64) >= start[row] if len(row) else np.zeros(0, bool)
    net = s.scattered(s.at[mine], np.array(s.bytes, np.int64)[mine])
    # what is owned beyond a piece's end: all that is left, less what comes before the owned part begins
    most = np.where(start[rows] == NONE, 0, total[rows] - skipped[rows])
    np.add.at(net, stop[some], np.minimum(after, most)[some])
    np.add.at(net, s.top[within], -np.minimum(whole, most)[within])
    net = s.summed(net)
    leaf = np.array([bool(r["leaf"]) for r in s.rows], bool)[rows]
    leaves = s.scattered(stop[some & leaf], 1)  # each piece of the path has the leaf at or beyond its end
    np.add.at(leaves, s.top[within & leaf], -1)
    leaves = s.summed(leaves)
    parents = s.slots.find(s.above[s.at[mine]]) if len(row) else np.zeros(0, np.int64)
    children = s.scattered(parents, 1)
    have = pa.array(np.flatnonzero((net > 0) | (leaves > 0) | (children > 0)))
    columns = [s.binary(s.slots.digests), pa.array(net), pa.array(leaves), pa.array(children)]
    return pa.RecordBatch.from_arrays([c.take(have) for c in columns], names=["digest", "net", "n_leaves", "n_children"])


OWNED = "digest binary, net long, n_leaves long, n_children long"


def _sharded(size: int, shard: int, finish: Callable[[Shard], pa.RecordBatch]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Shard(size)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                for row in b.slice(at, 64).to_pylist():
                    now.add(row)
                    if len(now.digest) + len(now.rows) >= shard:
                        yield finish(now)
                        now = Shard(size)
        if now.rows:
            yield finish(now)

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of each node's joined pieces, which come in order; one piece is held at a time."""
    digest, state = None, None
    done: list[tuple] = []
    for b in batches:
        for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if d != digest:
                if digest is not None:
                    done.append((digest, state.hexdigest()))
                digest, state = d, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], names=["digest", "ends_sha256"])
        done = []
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([digest], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["digest", "ends_sha256"])


def nodes(found: DataFrame, id_col: str = "conv_id", block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """A row for each node of the trie of conversations given as blocks (``blocks`` or ``rebuilt``, with the same ``block``).

    Columns: ``id_col`` (smallest member), depth, parent's ``id_col`` (named parent_<id_col>; null at the root), n_convs
    (members), n_children, n_leaves, saved_tokens and ends_sha256. Without conversations there are no nodes. Repeated
    rows of a conversation are turns of it, one after the other.
    """
    tables = Tables()
    found = tables.keep(carried(tables.keep(found, "blocks")), "carried")
    parts = tables.keep(found.mapInArrow(_sharded(block, shard, _members), MEMBERS), "members")
    same = [F.min(c).alias(c) for c in ("depth", "parent", "key", "bytes", "upto", "conv")]
    differ = F.max("depth") + F.min("depth") * -1 + (F.min("parent") != F.max("parent")).cast("int") + (F.min("key") != F.max("key")).cast("int")
    trie = parts.groupBy("digest").agg(*same, *[F.sum(c).alias(c) for c in ("n_convs", "n_ends", "below")], differ.alias("differ"))
    trie = trie.withColumn("depth", F.when(F.col("differ") == 0, F.col("depth")).otherwise(F.raise_error(F.lit("two prefixes have the same digest")))).drop("differ", "key")
    trie = tables.keep(trie, "trie")

    # what each conversation owns: its path from depth `start` on
    chains = trie.groupBy("conv").agg(F.min(F.struct("depth", "digest", "parent")).alias("first"), F.min(F.col("upto") - F.col("bytes")).alias("skipped"), F.max(F.col("n_ends") == F.col("n_convs")).alias("leaf"))
    again = found.join(chains.select("conv", F.col("first.depth").alias("start"), "skipped", "leaf"), "conv", "left").mapInArrow(_sharded(block, shard, _owned), OWNED)
    once = again.groupBy("digest").agg(*[F.sum(c).alias(c) for c in ("net", "n_leaves", "n_children")])

    # ends: ids in pieces of 4,096 by value, hashed one after the other
    ends = parts.where("n_ends > 0").select("digest", F.explode("ends").alias("conv")).groupBy("digest", F.shiftright("conv", 12).alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv")), ",").alias("ids"))
    ends = ends.repartition("digest").sortWithinPartitions("digest", "piece").select("digest", "ids").mapInArrow(_hashed, "digest binary, ends_sha256 string")

    # a parent has the same owner, but where an owned path begins: there, one row a conversation looks it up
    root = trie.where("depth = 0").head()
    begins = chains.select("first.*").where("depth > 0")
    above = trie.select(F.col("digest").alias("parent"), F.col("conv").alias("parent_conv"))
    heads = begins.where("depth > 1").join(above, "parent").select("digest", "parent_conv")
    heads = heads.unionByName(begins.where("depth = 1").select("digest", F.lit(root.conv if root else None).cast("long").alias("parent_conv")))
    all_nodes = trie.join(heads, "digest", "left").join(once, "digest", "left").join(ends, "digest", "left")
    all_nodes = all_nodes.withColumn("parent_conv", F.coalesce("parent_conv", F.when(F.col("depth") > 0, F.col("conv"))))
    zero = F.lit(0).cast("long")
    return all_nodes.select(
        F.col("conv").alias(id_col), "depth", F.col("parent_conv").alias(f"parent_{id_col}"), "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("n_leaves", zero).alias("n_leaves"),
        (F.col("below") - F.coalesce("net", zero)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def oracle(family: int = 5, most: int = 9) -> str:
    """The query in DuckDB SQL."""
    return f"""
with recursive {CRC_TABLE},
t as (select conv_id, key, bytes, row_number() over (partition by conv_id order by turn nulls first, key) pos from (
  select conv_id, turn, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) key, octet_length(encode(coalesce(text, ''))) bytes
  from conversations where conv_id is not null)),
c as (select conv_id, {crc_of("cast(conv_id as varchar)")} % {most} h from (select distinct conv_id from t), crc),
r as (select conv_id, key, bytes, row_number() over (partition by conv_id order by src, pos) d from (
  select c.conv_id, 0 src, pos, key, bytes from c join t on t.conv_id = c.conv_id - ((c.conv_id % {family} + {family}) % {family}) and pos <= h
  union all select conv_id, 1, pos, key, bytes from t join c using (conv_id) where pos > h)),
p as (select conv_id, d, bytes, string_agg(key, '') over (partition by conv_id order by d) g from r union all select conv_id, 0, 0, '' from c),
n as (select g, any_value(d) d, min(conv_id) conv, count(*) n, any_value(bytes) bytes from p group by g),
up as (select n.g, p.g parent from n join p on p.conv_id = n.conv and p.d = n.d - 1),
kids as (select parent g, count(*) k from up group by parent),
sums as (select p.g, sum((n.n - 1) * n.bytes) saved, sum(case when k is null then 1 else 0 end) leaves from n left join kids using (g) join p on p.conv_id = n.conv and p.d <= n.d group by p.g),
ends as (select g, sha256(string_agg(cast(conv_id as varchar), ',' order by conv_id)) e from p join (select conv_id, max(d) d from p group by conv_id) using (conv_id, d) group by g)
select n.conv conv_id, cast(n.d as bigint) as depth, m.conv parent_conv_id, cast(n.n as bigint) n_convs, cast(coalesce(k, 0) as bigint) n_children, cast(leaves as bigint) n_leaves,
  cast(saved as bigint) saved_tokens, coalesce(e, sha256('')) ends_sha256
from n left join up using (g) left join n m on m.g = up.parent left join kids on kids.g = n.g join sums on sums.g = n.g left join ends on ends.g = n.g"""
