"""Near copies by Order MinHash, verified by banded alignment.

A text's words (ASCII letters and digits and everything above, lower-cased) give its 5-word shingles, each labelled
with its occurrence number. Each of ``SKETCHES`` hash functions picks the two least of them and keeps them in text
order; both hashes in that order make one key. Texts that share a key are candidates. Two texts are linked if the edit
similarity of their word sequences, 1 - distance / longer length, is at least 0.8. Texts under ``SHORT`` words, where
two edits can leave no shingle whole, have further keys: their words without any one of them, from ten words on without
any two, and all of them. Two such texts that are alike share one of these for certain.

Texts with equal word sequences are one from the start (so thousands of copies cost one row each). Then

1. each bucket (the texts of one key) names its least and its greatest member, and each text is aligned with at most two
   of those that its buckets name, so the alignments grow with the number of texts whatever the size of a group;
2. classes found so far are contracted, and buckets of one class are done;
3. in what is left all pairs of different classes are tried: in small buckets by a join, in large ones by blocks of members
   against blocks, dealt to many tasks. No bucket is capped, so no pair that shares a key is left untried.

Pairs whose lengths, or whose words counted in bins, differ by more than the edits allowed are left out before alignment.
Classes are the connected components of the links, found by large-star and small-star steps on tables.

Word sequences are told apart by 64-bit hashes and words within an alignment by 32-bit ones (two words differ but agree
once in 2**32 pairs of words). Null texts and texts without words are alike to nothing. Rows with the same id count as
separate rows; ids of any type that Spark can order and other columns of any name are fine.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .align import distance_within
from .common import U64, Tables, byte_table, column, fresh, map_arrow, mix, spans, utf8, word_hashes

SHINGLE, SKETCHES, SIMILARITY = 5, 128, 0.8
#: Texts of fewer words have keys that no two edits can all break.
SHORT = 15
#: Texts of 12 to so many words have keys of two rare words.
FEW = 75
#: Bins that words are counted in, to tell texts apart that can't be alike before they are aligned.
BINS = 64
#: Buckets of at most ``WHOLE`` members are joined with themselves; larger ones are cut into blocks of about so many members and words.
WHOLE, BLOCK, BLOCK_WORDS = 16, 4096, 1 << 20
#: Bins for the words of a block's members: few for all pairs, then more for those that are left.
BLOCK_BINS = 64, 512

_SEEDS = mix(np.arange(1, 1025, dtype=U64))
_XOR = (_SEEDS >> U64(32)).astype(np.uint32)[:, None]
_ODD = mix(np.arange(2001, 3025, dtype=U64)).astype(np.uint32)[:, None] | np.uint32(1)


def two_least(h: np.ndarray, sketches: int) -> tuple[np.ndarray, np.ndarray]:
    """For each hash function the places of the two least of ``h``, many functions at a time (one place twice if there is one)."""
    short = (h >> U64(32)).astype(np.uint32)
    a, b = np.zeros(sketches, np.int64), np.zeros(sketches, np.int64)
    step = max(1, (1 << 16) // len(h))
    for s in range(0, sketches, step):
        e = min(s + step, sketches)
        x = short ^ _XOR[s:e]
        x *= _ODD[s:e]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        a[s:e] = x.argmin(1)
        if len(h) > 1:
            x[np.arange(e - s), a[s:e]] = 0xFFFFFFFF
            b[s:e] = x.argmin(1)
    return a, b


def sketch(words: np.ndarray, k: int = SHINGLE, sketches: int = SKETCHES) -> np.ndarray:
    """Keys of one text from the hashes of its words; at least one word."""
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, U64)
    for i in range(k):
        h = mix(h + words[i : i + n])
    h = labelled(h)
    a, b = two_least(h, sketches)
    return mix(h[np.minimum(a, b)] * U64(3) + h[np.maximum(a, b)] + _SEEDS[:sketches])


def shortened(words: np.ndarray) -> np.ndarray:
    """Further keys of a text under ``SHORT`` words: hashes of all its words, of all but one, and from ten words on of all but two."""
    n = len(words)
    out = {sequence_hash(words)}
    for gone in range(1, 2 + (n >= 10)):
        out.update(sequence_hash(np.delete(words, list(c))) for c in combinations(range(n), gone) if n > gone)
    return mix(np.array(sorted(out), np.int64).view(U64) ^ U64(0x5851F42D4C957F2D))


def labelled(h: np.ndarray) -> np.ndarray:
    """Hashes told apart by their occurrence number."""
    order = np.argsort(h, kind="stable")
    run = h[order]
    first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    number = np.empty(len(h), U64)
    number[order] = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return mix(h ^ (number * U64(0x9E3779B97F4A7C15)))


def rare_pairs(words: np.ndarray, sizes: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Keys of two words each: all pairs of the rarest, a fifth of them (what the edits may touch) and two more."""
    tokens = labelled(words)
    take = np.lexsort((tokens, -sizes))[: int((1 - similarity) * len(words) + 1e-9) + 2]
    i, j = np.triu_indices(len(take), 1)
    return mix(tokens[take[i]] * U64(3) + tokens[take[j]] + U64(0x2545F4914F6CDD1D))


def keys_of(words: np.ndarray, sketches: int = SKETCHES, sizes: np.ndarray | None = None) -> np.ndarray:
    """All keys of a text with at least one word, those of the sketches first and in their order; sizes: lengths of the words."""
    found = [sketch(words, SHINGLE, sketches)]
    if len(words) < SHORT:
        found.append(shortened(words))
    if 12 <= len(words) <= FEW:
        found.append(rare_pairs(words, np.zeros(len(words), np.int64) if sizes is None else sizes))
    return np.concatenate(found)


def words_of(text: str | None, table: np.ndarray) -> np.ndarray:
    return word_hashes(utf8(text.lower()), table) if text else np.zeros(0, U64)


def word_sizes(text: str, table: np.ndarray) -> np.ndarray:
    """Bytes of each word of a text."""
    start, end = spans(table[utf8(text.lower())])
    return end - start


def sequence_hash(words: np.ndarray) -> int | None:
    """One number for a whole word sequence; None without words."""
    if not len(words):
        return None
    return int(mix(words + mix(np.arange(1, len(words) + 1, dtype=np.uint64))).sum(dtype=U64).view(np.int64))


#: Tables of at most so many rows of one number are broadcast.
SMALL = 4_000_000


def narrowed(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of df whose key is among ``keys`` (a table on disk): broadcast if that is small, else by a shuffled join."""
    return df.join(F.broadcast(keys) if keys.count() <= SMALL else keys, on, "left_semi")


def _sketches(docs: DataFrame, sketches: int) -> DataFrame:
    """(id, row, text's hash, words' hash u, number of words, their counts by bin, keys, words); u is null without words."""

    def make():
        table = byte_table("alnum")

        def run(columns):
            us, ns, bags, keys, words = [], [], [], [], []
            for text in columns[0]:
                w = words_of(text, table)
                ns.append(len(w))
                us.append(sequence_hash(w))
                bags.append(np.minimum(np.bincount((w >> U64(58)).astype(np.int64), minlength=BINS), 32767).astype(np.int16))
                keys.append(keys_of(w, sketches, word_sizes(text, table) if 12 <= len(w) <= FEW else None).view(np.int64) if len(w) else None)
                words.append((w >> U64(32)).astype(np.uint32).view(np.int32))
            return [us, ns, bags, keys, words]

        return run

    new = [("u", pa.int64(), "long"), ("n", pa.int32(), "int"), ("bag", pa.list_(pa.int16()), "array<short>"), ("keys", pa.list_(pa.int64()), "array<long>"), ("words", pa.list_(pa.int32()), "array<int>")]
    return map_arrow(docs, ["id", "row", "hash"], ["text"], make, new)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) of texts (u, words), those with at least this edit similarity."""
    left = texts.select(F.col("u").alias("a"), F.col("words").alias("wa"))
    right = texts.select(F.col("u").alias("b"), F.col("words").alias("wb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb")

    def run(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                x, y = a[i].values.to_numpy(zero_copy_only=False).tolist(), b[i].values.to_numpy(zero_copy_only=False).tolist()
                most = int((1 - similarity) * max(len(x), len(y)) + 1e-9)
                keep.append(distance_within(x, y, most) is not None)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def surplus(a: Column, b: Column) -> Column:
    """How far the counts of a exceed those of b; each edit changes it by one at most."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.greatest(x.cast("int") - y.cast("int"), F.lit(0))), F.lit(0), lambda t, x: t + x)


def near(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) of texts (u, n, bag), those that may be alike by length and words."""
    side = lambda x: texts.select(F.col("u").alias(x), F.col("n").alias(f"n{x}"), F.col("bag").alias(f"bag{x}"))
    edits = F.floor(F.greatest("na", "nb") * (1 - similarity) + 1e-9)
    both = pairs.join(side("b"), "b").join(side("a"), "a").where(F.abs(F.col("na") - F.col("nb")) <= edits)
    return both.where((surplus(F.col("baga"), F.col("bagb")) <= edits) & (surplus(F.col("bagb"), F.col("baga")) <= edits)).select("a", "b")


def _bags(words: list[np.ndarray], bins: int) -> np.ndarray:
    out = np.zeros((len(words), bins), np.float32)
    for r, w in enumerate(words):
        out[r] = np.bincount(mix(w.astype(np.int64).view(U64)).astype(np.int64) & (bins - 1), minlength=bins)
    return out


def links_in(key: int, u: np.ndarray, label: np.ndarray, keys: np.ndarray, words: list[np.ndarray], block: np.ndarray, i: int, j: int, similarity: float) -> list[tuple[int, int]]:
    """Links between the members of block i and those of block j (or within i) of one bucket that join all that can be joined.

    Every pair is tried here unless its ends have one label already, at first or by the links found here, or share an
    earlier sketch's key (``keys``: a row for each member): that key's bucket, which is as open as this one, tries it.
    """
    order = np.argsort([len(w) for w in words], kind="stable")
    u, label, keys, block, words = u[order], label[order].copy(), keys[order], block[order], [words[r] for r in order]
    n = np.array([len(w) for w in words], np.int64)
    few, many = (_bags(words, bins) for bins in BLOCK_BINS)
    ones = [np.ones(bins, np.float32) for bins in BLOCK_BINS]
    # a pair is tried from its end in block i; within one block from the shorter
    right = np.flatnonzero(block == j)
    sizes, right_few = n[right], few[right]
    lists, out = {}, []
    get = lambda r: lists[r] if r in lists else lists.setdefault(r, words[r].tolist())
    for x in np.flatnonzero(block == i):
        # lengths that can be alike lie in one stretch of the sorted members
        low, high = np.searchsorted(sizes, [int(n[x] * similarity - 1e-6), int(n[x] / similarity + 1e-6) + 1])
        if i == j:
            low = max(low, int(np.searchsorted(right, x)) + 1)
        for at in range(low, high, 1024):
            part = slice(at, min(high, at + 1024))
            c = right[part]
            most = ((1 - similarity) * np.maximum(n[c], n[x]) + 1e-9).astype(np.int64)
            over = np.maximum(right_few[part] - few[x], 0) @ ones[0]
            ok = (label[c] != label[x]) & (np.maximum(over, over - (n[c] - n[x])) <= most)
            c, most = c[ok], most[ok]
            if len(c):
                same = keys[c] == keys[x]
                ok = ~same.any(1) | (keys[x][same.argmax(1)] == key)
                c, most = c[ok], most[ok]
                over = np.maximum(many[c] - many[x], 0) @ ones[1]
                ok = np.maximum(over, over - (n[c] - n[x])) <= most
            for y, m in zip(c[ok].tolist(), most[ok].tolist(), strict=True) if len(c) else ():
                if label[y] != label[x] and distance_within(get(x), get(y), m) is not None:
                    out.append((int(max(u[x], u[y])), int(min(u[x], u[y]))))
                    label[label == label[y]] = label[x]
    return out


def all_pairs(members: DataFrame, texts: DataFrame, words: DataFrame, tried: DataFrame, similarity: float, tables: Tables, whole: int = WHOLE, block: int = BLOCK) -> DataFrame:
    """Links (a, b) such that no pair of a bucket with different labels and this similarity is left unjoined.

    members: (key, u, n, label); texts: (u, n, bag); words: (u, words, keys of its sketches); tried: pairs (a, b) that are
    settled already.
    """
    sizes = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"), F.sum("n").alias("total")).where("low <> high").select("key", "size", "total")
    open_ = tables.keep(members.join(sizes, "key"), "open")
    few = open_.where(F.col("size") <= whole).select("key", "u", "label")
    pairs = few.join(few.toDF("key", "v", "other"), "key").where("u > v and label <> other").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()
    found = verified(near(pairs.join(tried, ["a", "b"], "left_anti"), texts, similarity), words, similarity)
    many = open_.where(F.col("size") > whole).join(words, "u")
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("total") / BLOCK_WORDS))
    many = many.select("key", "u", "label", "keys", "words", blocks.alias("blocks"), F.pmod(F.xxhash64("u"), blocks).alias("block"))
    many = many.select("key", "u", "label", "keys", "words", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o"))
    many = many.select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "u", "label", "keys", "words")

    def run(table: pa.Table) -> pa.Table:
        t = {c: table.column(c).combine_chunks() for c in table.column_names}
        ws = [w.values.to_numpy(zero_copy_only=False) for w in t["words"]]
        keys = np.stack([k.values.to_numpy(zero_copy_only=False) for k in t["keys"]])
        key, i, j = (t[c][0].as_py() for c in ("key", "i", "j"))
        got = links_in(key, t["u"].to_numpy(), t["label"].to_numpy(), keys, ws, t["block"].to_numpy(), i, j, similarity)
        return pa.table({"a": pa.array([a for a, _ in got], pa.int64()), "b": pa.array([b for _, b in got], pa.int64())})

    return tables.keep(found.union(many.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")), "links")


def relabelled(labels: DataFrame, new: DataFrame, tables: Tables) -> DataFrame:
    """Labels (node, label) after links (a, b) have joined their classes; nodes that are their own label have no row."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    between = new.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    moved = components(between, tables=tables).select(F.col("node").alias("was"), F.col("label").alias("to"))
    old = labels.join(moved, labels["label"] == moved["was"], "left").select("node", F.coalesce("to", "label").alias("label"))
    return tables.keep(old.union(moved.join(labels, moved["was"] == labels["node"], "left_anti")), "labels")


def components(edges: DataFrame, name: str = "components", tables: Tables | None = None) -> DataFrame:
    """Connected components of (a, b) edges as (node, label), the label being the least node; both columns long.

    Nodes that are their own label have no row. Large-star and small-star steps go on until the edges are stars.
    """
    tables = tables or Tables()
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = tables.keep(small, name)
        inner = edges.select(F.col("a").alias("x"), F.lit(0).alias("up")).union(edges.select("b", F.lit(1)).distinct())
        if not inner.groupBy("x").agg(F.count("*").alias("n")).where("n > 1").head(1):  # each node has one label, which has none
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketches: int = SKETCHES, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each row of ``docs``: id, class_id (least id of its class), n_words, class_size, is_kept (one row of each class).

    A text without words is a class of its own, whose class_id is its own id.
    """
    found = _classes(docs, id_col, text_col, sketches, similarity)
    return found.select(F.col("id").alias(id_col), "class_id", "n_words", "class_size", "is_kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketches: int = SKETCHES, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one of each class of near copies stays."""
    found = _classes(docs, id_col, text_col, sketches, similarity)
    key, mark = fresh(docs, "kept_id", "text_hash")
    kept = found.where("is_kept").select(F.col("id").alias(key), F.col("hash").alias(mark)).distinct()
    own = fresh(docs.withColumn(key, F.lit(0)).withColumn(mark, F.lit(0)), "own_hash")[0]
    marked = docs.withColumn(own, F.xxhash64(column(text_col)))
    out = marked.join(kept, column(id_col).eqNullSafe(column(key)) & (column(own) == column(mark)), "left_semi")
    if found.where("n_words > 0").groupBy("id", "hash").count().where("count > 1").head(1):  # repeated rows
        words = F.coalesce(column(text_col).rlike("[A-Za-z0-9\\x{80}-\\x{10FFFF}]"), F.lit(False))
        out = out.where(words).dropDuplicates([id_col, own]).union(out.where(~words))
    return out.drop(own)


def _classes(docs: DataFrame, id_col: str, text_col: str, sketches: int, similarity: float) -> DataFrame:
    tables = Tables()
    rows = docs.select(column(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.xxhash64(column(text_col)).alias("hash"), column(text_col).alias("text"))
    found = tables.keep(_sketches(rows, sketches), "sketches")
    texts = tables.keep(found.where("u is not null").groupBy("u").agg(F.first("n").alias("n"), F.first("bag").alias("bag"), F.first("keys").alias("keys")), "texts")
    keys = texts.select("u", F.explode(F.array_distinct("keys")).alias("key"))
    shared = tables.keep(keys.groupBy("key").count().where("count > 1").select("key"), "shared")
    members = tables.keep(narrowed(keys, shared, "key"), "members")
    sides = texts.select("u", "n", "bag")
    needed = tables.keep(members.select("u").distinct(), "needed")
    words = narrowed(found.select("u", "words", F.slice("keys", 1, sketches).alias("keys")), needed, "u").dropDuplicates(["u"])
    words = tables.keep(words, "words")
    rows = tables.keep(found.select("id", "row", "hash", "n", "u"), "rows")
    tables.drop("sketches")
    # each text with the least and with the greatest of those named by its buckets that it may be like
    named = members.join(members.groupBy("key").agg(F.min("u").alias("low"), F.max("u").alias("high")), "key")
    named = named.select(F.col("u").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a <> b").distinct()
    pairs = near(named, sides, similarity).groupBy("a").agg(F.min("b").alias("x"), F.max("b").alias("y"))
    pairs = pairs.select("a", F.explode(F.array("x", "y")).alias("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    tried = tables.keep(pairs, "pairs")
    links = tables.keep(verified(tried, words, similarity), "links")
    labels = components(links, tables=tables)
    label = texts.select("u", "n").join(labels.select(F.col("node").alias("u"), "label"), "u", "left").select("u", "n", F.coalesce("label", "u").alias("label"))
    new = all_pairs(members.select("key", "u").join(label, "u"), sides, words, tried, similarity, tables)
    if new.head(1):
        labels = relabelled(labels, new, tables)
    own = rows.join(labels, rows["u"] == labels["node"], "left")
    own = own.select("id", "row", "hash", "n", F.coalesce("label", "u").alias("c"))
    tops = own.where("c is not null").groupBy("c").agg(F.min(F.struct("id", "row")).alias("top"), F.count("*").alias("size"))
    out = own.join(tops, "c", "left").select(
        "id", "hash", F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("top.id")).alias("class_id"), F.col("n").cast("long").alias("n_words"),
        F.coalesce("size", F.lit(1)).cast("long").alias("class_size"), F.coalesce(F.col("top.row") == F.col("row"), F.lit(True)).alias("is_kept"),
    )
    out = Tables().keep(out, "classes")
    tables.drop("texts", "rows", "needed", "shared", "members", "words", "pairs", "links", "components", "open", "labels")
    return out
