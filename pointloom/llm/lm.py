"""Language-model scoring: exact smoothed unigrams, and a hashed maximum-entropy model.

Tokens are the runs of other than white space, A-Z lower-cased, and one end for each text. All training tokens are
counted by key (a 64-bit hash of the token); counts stay a table. The model factors a token's probability into that of
its class given the tokens before it, that of its item within the class given the same, and its own smoothed share of the
item. The SINGLE commonest tokens are items of their own; the others fall into ENDINGS items by their last three bytes.
Items with like neighbours share a class. Both softmaxes run over hashed features: the token before, the one before that
(a skip), and both together; rare tokens count as their endings there. The number of weights follows that of distinct
training tokens, up to ``MOST`` (4 * MOST rows of SIDE). All training texts take part in everything: their tokens'
keys are saved once, and once as codes of four bytes; from these come the counts of which item stands before which, for the classes, the
observed counts by feature, and in each of ``ROUNDS`` steps the expected ones. Tasks sum over their share of the texts,
like contexts at once; these sums are added up in Spark, and the driver, which holds the model of bounded size, moves the
weights.

For scoring, the counts of the commonest tokens (at most ``FREQUENT``, whatever the input's size) are broadcast; the
rare ones are joined with the table of counts, where by choice no key is hot. Null text counts as empty and has one
token, its end. Repeated rows count as often as they stand there; rows without an id are training rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, U64, HashIndex, Tables, byte_table, map_arrow, materialise, mix, pieces, prefix, span_hash, spans, utf8

FREQUENT = 1 << 18
#: Items are the commonest tokens one by one, and the rest by a hash of how they end; SIDE classes hold SIDE items each.
SINGLE, ENDINGS, SIDE = 512, 512, 32
ITEMS = SINGLE + ENDINGS
KINDS = 3
#: A quarter of the rows of weights: a 64th of the distinct tokens, in whole STEPs, within these bounds.
FEWEST, MOST, STEP = 1 << 12, 1 << 16, 1 << 10
#: Tokens seen so often have features of their own, the commonest first, as many as a quarter of the rows.
COMMON = 3
#: DAMP is for sums over all training texts.
ROUNDS, RATE, DAMP, MOST_WEIGHT = 4, 0.6, 20.0, 12.0
#: Tokens whose sums are made at once, and whose odds are; tokens of which like contexts are put together.
STRETCH, BLOCK, BATCH = 1 << 17, 1 << 13, 1 << 21
#: Key of the end of a text, and of what stands before its first token.
END, BEFORE = U64(0x5BD1E9955BD1E000), U64(0x27D4EB2F16566001)
#: Tokens a task takes on at least before there are more tasks than cores, so that sums stay small beside the texts.
SHARE = 1 << 26
#: Parts that the sums are dealt out in, and tasks whose sums one task adds up at first.
PARTS, WIDE = 32, 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = byte_table("solid")
_LOW = U64(ENDINGS - 1)
_ONES = np.ones(SIDE, np.float32)


def token_keys(text: str | None) -> np.ndarray:
    """Keys of a text's tokens, the end included: a hash whose low bits depend on the last three bytes alone."""
    out = []
    for _, units, inside in pieces(u := _LOWER[utf8(text or "")], _SOLID[u]):
        starts, ends = spans(inside)
        last = np.zeros(len(ends), U64)
        for back in range(1, 4):
            at = ends - back
            last = last * U64(257) + np.where(at >= starts, units[np.maximum(at, 0)].astype(U64) + U64(1), U64(0))
        out.append((span_hash(prefix(units), starts, ends) & ~_LOW) | (mix(last) >> U64(64 - 9)))
    return np.concatenate([*out, [END]]).astype(U64)


def packed(texts: list) -> list[bytes]:
    return [token_keys(t).tobytes() for t in texts]


def unpacked(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens of several texts one after another, and how many each has."""
    return np.frombuffer(b"".join(rows), U64), np.array([len(r) // 8 for r in rows], np.int64)


def before(values: np.ndarray, lens: np.ndarray, first) -> tuple[np.ndarray, np.ndarray]:
    """The value one place before, and the one two places before, each within its text."""
    start = np.cumsum(lens) - lens
    one, two = np.empty_like(values), np.empty_like(values)
    one[1:], two[2:] = values[:-1], values[:-2]
    one[start], two[start], two[start[lens > 1] + 1] = first, first, first
    return one, two


def by_context(near: np.ndarray) -> np.ndarray:
    """Place of each item in a row of SIDE classes of SIDE items, from counts of which item stands before which.

    The items are halved again and again at the median of the main direction of their contexts, so that items with like
    neighbours come into one class. Ties are broken by the items' order.
    """
    both = np.sqrt(np.concatenate((near, near.T), 1))
    both /= np.maximum(np.linalg.norm(both, axis=1, keepdims=True), 1e-9)
    groups = [np.arange(len(near))]
    while len(groups) < SIDE:
        halves = []
        for g in groups:
            x = both[g] - both[g].mean(0)
            _, axes = np.linalg.eigh(x @ x.T)
            along = axes[:, -1] * np.sign(axes[np.argmax(np.abs(axes[:, -1])), -1])
            order = g[np.argsort(along, kind="stable")]
            halves += [order[: len(g) // 2], order[len(g) // 2 :]]
        groups = halves
    place = np.empty(len(near), np.int64)
    place[np.concatenate(groups)] = np.arange(len(near))
    return place


class Model:
    """Weights of a softmax over classes and of one over a class's items, by hashed features of the tokens before."""

    def __init__(self, known: np.ndarray, item_counts: np.ndarray, size: int):
        """known: keys of common tokens, commonest first; item_counts: training tokens of each item."""
        self.known, self.size, self.item_counts = known, size, item_counts.astype(np.float64)
        self.index = None
        # a token's code is its place among the known ones, or comes after them by its ending; the last one is BEFORE
        self.context_of = np.concatenate((known, np.arange(ENDINGS, dtype=U64), [BEFORE])).astype(U64)
        endings = SINGLE + (known & _LOW).astype(np.int64)
        self.item_of = np.concatenate((np.where(np.arange(len(known)) < SINGLE, np.arange(len(known)), endings), SINGLE + np.arange(ENDINGS)))
        self.arrange(np.arange(ITEMS))
        self.weights = np.zeros((4 * size, SIDE), np.float32)  # half for classes, half for items

    def __getstate__(self):
        return self.__dict__ | {"index": None}

    def arrange(self, place: np.ndarray) -> None:
        self.place = place
        n = np.empty(ITEMS)
        n[place] = self.item_counts + 0.5
        n = n.reshape(SIDE, SIDE)
        self.class_bias = np.log(n.sum(1) / n.sum()).astype(np.float32)
        self.item_bias = np.log(n / n.sum(1, keepdims=True)).astype(np.float32)

    def codes(self, keys: np.ndarray) -> np.ndarray:
        if self.index is None:
            self.index = HashIndex(self.known)
        at = self.index.find(keys)
        return np.where(at >= 0, at, len(self.known) + (keys & _LOW).astype(np.int64)).astype(np.int32)

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's item, and what it counts as in a context: itself if common, else its ending."""
        codes = self.codes(keys)
        return self.item_of[codes], self.context_of[codes]

    def rows(self, one: np.ndarray, two: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the weights active after two contexts: KINDS columns for the class, and KINDS for the item in it."""
        hashes = np.stack((mix(one + U64(1)), mix(two + U64(2)), mix(mix(one + U64(3)) + two)), 1)
        inner = mix(hashes + (classes.astype(U64) * U64(BASES[0]))[:, None])
        return self.row_of(hashes), self.row_of(inner) + np.int32(2 * self.size)

    def row_of(self, hashes: np.ndarray) -> np.ndarray:
        """Hashes spread evenly over the 2 * size rows of a level."""
        return (((hashes >> U64(32)) * U64(2 * self.size)) >> U64(32)).astype(np.int32)

    def odds(self, rows: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the logarithm of each lane's odds, the odds, and their sum; the weights' bound keeps them finite."""
        z = self.weights[rows[:, 0]]
        z += self.weights[rows[:, 1]]
        z += self.weights[rows[:, 2]]
        z += bias
        e = np.exp(z)
        return z, e, e @ _ONES

    def levels(self, keys: np.ndarray, lens: np.ndarray):
        """For stretches of tokens, first the classes' level, then the items': (level, slice, rows, lane that came, row of the biases, biases)."""
        place, contexts = np.empty(len(keys), np.int32), np.empty(len(keys), U64)
        stretches = [slice(at, at + STRETCH) for at in range(0, len(keys), STRETCH)]
        for s in stretches:
            item, contexts[s] = self.look_up(keys[s])
            place[s] = self.place[item]
        one, two = before(contexts, lens, BEFORE)
        for s in stretches:
            classes, lane = np.divmod(place[s], SIDE)
            outer, inner = self.rows(one[s], two[s], classes)
            yield 0, s, outer, classes, np.zeros_like(classes), self.class_bias[None]
            yield 1, s, inner, lane, classes, self.item_bias

    def contexts(self, codes: np.ndarray, lens: np.ndarray, places: bool):
        """Distinct contexts of each BATCH of tokens, in order: the two codes before, what came (its place, or its class alone), how often."""
        base, first = len(self.context_of), len(self.context_of) - 1
        of, width = (self.place, ITEMS) if places else (self.place // SIDE, SIDE)
        of = of[self.item_of]
        one, two = before(codes, lens, first)
        for at in range(0, len(codes), BATCH):
            s = slice(at, at + BATCH)
            x = one[s].astype(np.int64)
            x *= base
            x += two[s]
            x *= width
            x += of[codes[s]]
            x.sort()
            start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            n = np.diff(np.r_[start, len(x)])
            both, came = np.divmod(x[start], width)
            yield *np.divmod(both, base), came, n

    def observed(self, codes: np.ndarray, lens: np.ndarray, sums: np.ndarray) -> None:
        """Add what came, by lane and row; then, for the items' rows, the classes by row."""
        flat, width = sums.reshape(-1), sums.shape[1]
        for one, two, place, n in self.contexts(codes, lens, True):
            classes, lane = np.divmod(place, SIDE)
            for at in range(0, len(n), STRETCH):
                s = slice(at, at + STRETCH)
                outer, inner = self.rows(self.context_of[one[s]], self.context_of[two[s]], classes[s])
                for k in range(KINDS):
                    for way, row in ((classes, outer[:, k]), (lane, inner[:, k]), (classes, inner[:, k] + 2 * self.size)):
                        np.add.at(flat, way[s] * width + row, n[s].astype(sums.dtype))

    def expected_at_first(self, observed: np.ndarray) -> np.ndarray:
        """What ``expected`` gives while all weights are 0, from the sums of ``observed``."""
        share = lambda bias: np.exp(bias) / np.exp(bias).sum(-1, keepdims=True)
        level = 2 * self.size
        return np.concatenate((share(self.class_bias)[:, None] * observed[:, :level].sum(0), share(self.item_bias).T @ observed[:, 2 * level :]), 1)

    def expected(self, codes: np.ndarray, lens: np.ndarray, sums: np.ndarray) -> None:
        """Add what the model expects in these contexts, by lane and row: classes once for each pair of tokens before, items once for each class after it."""
        for one, two, classes, n in self.contexts(codes, lens, False):
            first = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
            for at in range(0, len(first), STRETCH):
                k = first[at : at + STRETCH]
                end = first[at + STRETCH] if at + STRETCH < len(first) else len(n)
                outer, _ = self.rows(self.context_of[one[k]], self.context_of[two[k]], classes[k])
                self._expect(outer, np.add.reduceat(n[k[0] : end], k - k[0]), None, sums, 0)
            for at in range(0, len(n), STRETCH):
                s = slice(at, at + STRETCH)
                _, inner = self.rows(self.context_of[one[s]], self.context_of[two[s]], classes[s])
                self._expect(inner, n[s], classes[s], sums, 1)

    def _expect(self, rows: np.ndarray, n: np.ndarray, owner: np.ndarray | None, sums: np.ndarray, level: int) -> None:
        part = np.empty((SIDE, len(n)), np.float32)
        for at in range(0, len(n), BLOCK):
            b = slice(at, at + BLOCK)
            _, e, total = self.odds(rows[b], self.class_bias[None] if owner is None else self.item_bias[owner[b]])
            np.multiply(e.T, n[b].astype(np.float32) / total, out=part[:, b])
        near = slice(2 * self.size * level, 2 * self.size * (level + 1))
        flat, weights = (rows.T - near.start).astype(np.int64).ravel(), np.empty((KINDS, len(n)))
        for k in range(SIDE):
            weights[:] = part[k]
            sums[k, near] += np.bincount(flat, weights.ravel(), 2 * self.size)

    def gradients(self, keys: np.ndarray, lens: np.ndarray, sums: np.ndarray, seen: np.ndarray) -> None:
        """Add observed less expected counts by lane and row, and how often each row was active."""
        codes, came, model = self.codes(keys), np.zeros((SIDE, 6 * self.size), sums.dtype), np.zeros_like(sums)
        self.observed(codes, lens, came)
        self.expected(codes, lens, model)
        came = came[:, : 4 * self.size]
        sums += came - model
        seen += came.sum(0)

    def step(self, sums: np.ndarray, seen: np.ndarray) -> None:
        """One step: each weight moves by a share of the log of observed over expected counts, both damped.

        The expected count is taken from the row's own weights alone.
        """
        level = 2 * self.size
        for at in [*range(0, level, 1 << 12), *range(level, 2 * level, 1 << 12)]:
            part = slice(at, min(at + (1 << 12), level if at < level else 2 * level))
            w = self.weights[part]
            prior = np.exp(w + (self.class_bias if at < level else np.log(np.exp(self.item_bias).mean(0))))
            expected = seen[part, None] * prior / prior.sum(1, keepdims=True)
            moved = w + RATE * np.log((np.maximum(expected + sums[:, part].T, 0) + DAMP) / (expected + DAMP))
            self.weights[part] = np.clip(moved, -MOST_WEIGHT, MOST_WEIGHT)

    def scores(self, keys: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """log10 probability of each token's item."""
        out = np.zeros(len(keys))
        for _, s, rows, lane, owner, bias in self.levels(keys, lens):
            here = out[s]
            for at in range(0, len(lane), BLOCK):
                part = slice(at, at + BLOCK)
                z, _, total = self.odds(rows[part], bias[owner[part]])
                here[part] += z[np.arange(len(z)), lane[part]] - np.log(total)
        return out / np.log(10)


def count_tokens(docs: DataFrame) -> DataFrame:
    """(key, c) over all texts' packed ``tokens``; summed within a task before the shuffle."""

    def make():
        def run(columns):
            keys, counts = np.unique(unpacked(columns[0])[0], return_counts=True)
            return [keys.view(np.int64), counts]

        return run

    return map_arrow(docs, [], ["tokens"], make, [("key", pa.int64(), "long"), ("c", pa.int64(), "long")]).groupBy("key").agg(F.sum("c").alias("c"))


def halved(x: np.ndarray) -> bytes:
    """float32 numbers rounded to their upper 16 bits."""
    u = x.astype(np.float32).view(np.uint32)
    return ((u + np.uint32(0x7FFF) + ((u >> np.uint32(16)) & np.uint32(1))) >> np.uint32(16)).astype(np.uint16).tobytes()


def doubled(b: bytes) -> np.ndarray:
    return (np.frombuffer(b, np.uint16).astype(np.uint32) << np.uint32(16)).view(np.float32)


def _add_up(sums: DataFrame, *keys: str) -> DataFrame:
    """Add up the rows' number arrays by key, one row at a time."""

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            for part, way, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                k = (part, way if "way" in keys else 0)
                total[k] = total.get(k, 0) + doubled(x.as_buffer())
        for (part, way), x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([way], pa.int32()), pa.array([halved(x)], pa.binary())], names=["part", "way", "x"])

    return sums.repartition(*keys).mapInArrow(run, "part int, way int, x binary")


def coded(docs: DataFrame, model: Model, tables: Tables) -> DataFrame:
    """The codes of each text's tokens, as 32-bit numbers."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = held.value

        def run(columns):
            keys, lens = unpacked(columns[0])
            return [[c.tobytes() for c in np.split(model.codes(keys), np.cumsum(lens)[:-1])] if len(lens) else []]

        return run

    return tables.keep(map_arrow(docs, [], ["tokens"], make, [("codes", pa.binary(), "binary")]), "codes")


def summed(texts: DataFrame, shape: tuple[int, int], tasks: int, add) -> np.ndarray:
    """An array to which every task adds for its texts' codes, by ``add(codes, lens, array)``; the last size must divide by PARTS."""

    def run(batches):
        from pyspark import TaskContext

        total, waiting, n = None, [], 0

        def flush():
            nonlocal total, waiting, n
            total = np.zeros(shape, np.float32) if total is None else total
            add(np.concatenate(waiting), np.array([len(w) for w in waiting]), total)
            waiting, n = [], 0

        for b in batches:
            for x in b.column(0):
                waiting.append(np.frombuffer(x.as_buffer(), np.int32))
                n += len(waiting[-1])
                if n >= BATCH:
                    flush()
        if waiting:
            flush()
        if total is not None:
            way = TaskContext.get().partitionId() // WIDE
            for i, x in enumerate(np.split(total, PARTS, 1)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([way], pa.int32()), pa.array([halved(x)], pa.binary())], names=["part", "way", "x"])

    sums = texts.coalesce(tasks).mapInArrow(run, "part int, way int, x binary")
    if tasks > WIDE:
        sums = _add_up(sums, "part", "way")
    total = np.zeros(shape, np.float32)
    parts = np.split(total, PARTS, 1)
    for r in _add_up(sums, "part").collect():  # the model's size at most
        parts[r.part][:] = doubled(r.x).reshape(shape[0], -1)
    return total


def train(docs: DataFrame, model: Model, n_tokens: int, rounds: int = ROUNDS) -> Model:
    """Classes, then gradient steps, each over all texts of (tokens) with n_tokens tokens."""
    context = docs.sparkSession.sparkContext
    tasks = max(context.defaultParallelism, n_tokens // SHARE)
    tables = Tables()
    codes = coded(docs, model, tables)

    def over_all(shape, method):
        held = context.broadcast(model)
        sums = summed(codes, shape, tasks, lambda *args: method(held.value, *args))
        held.destroy()
        return sums

    def neighbours(model, codes, lens, near):
        item = model.item_of[codes]
        one, _ = before(item, lens, -1)
        near += np.bincount(item[one >= 0] * ITEMS + one[one >= 0], minlength=ITEMS * ITEMS).reshape(ITEMS, ITEMS)

    model.arrange(by_context(over_all((ITEMS, ITEMS), neighbours)))
    observed = over_all((SIDE, 6 * model.size), Model.observed)
    came = observed[:, : 4 * model.size]
    expected, seen = model.expected_at_first(observed), came.sum(0)
    for turn in range(rounds):
        if turn:
            expected = over_all((SIDE, 4 * model.size), Model.expected)
        model.step(came - expected, seen)
    tables.drop("codes")
    return model


def score(docs: DataFrame, held_out: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all texts by what the rows where the boolean column ``held_out`` is false teach.

    A row for each row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("id"), F.col(held_out).alias("held_out"), F.col(text_col).alias("text"))
    # the keys are taken once: all passes start from them
    tables = Tables()
    d = tables.keep(map_arrow(d, ["id", "held_out"], ["text"], lambda: lambda columns: [packed(columns[0])], [("tokens", pa.binary(), "binary")]), "tokens")
    training = d.where(~F.col("held_out"))
    counts = materialise(count_tokens(training), "counts")
    ending = F.col("key").bitwiseAND(ENDINGS - 1).cast("int")
    level = F.floor(F.log2("c")).cast("int")
    by_level = {r.l: r.n for r in counts.groupBy(level.alias("l")).agg(F.count("*").alias("n")).collect()}
    cutoff, n_frequent = 0, sum(by_level.values())
    while n_frequent > FREQUENT:  # leave out the rarest levels
        n_frequent -= by_level.get(cutoff, 0)
        cutoff += 1
    frequent = counts.where(F.col("c") >= float(1 << cutoff)).toArrow()
    keys, c = frequent["key"].to_numpy(), frequent["c"].to_numpy().astype(np.float64)
    order = np.lexsort((keys, -c))
    keys, c = keys[order].view(np.uint64), c[order]
    del frequent
    single = keys[:SINGLE]
    totals = {r.h: (r.n, r.v) for r in counts.where(~F.col("key").isin(single.view(np.int64).tolist())).groupBy(ending.alias("h")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    n_train = int(sum(n for n, _ in totals.values()) + c[:SINGLE].sum())
    n_types = int(sum(v for _, v in totals.values()) + len(single))
    others = np.array([totals.get(h, (0, 0)) for h in range(ENDINGS)], np.float64)
    in_item = others[:, 0] + 0.5 * (others[:, 1] + 1)
    whole = n_train + 0.5 * (n_types + 1)
    first = np.zeros(SINGLE)
    first[: len(single)] = c[: len(single)]
    size = min(MOST, max(FEWEST, -(-n_types // 64 // STEP) * STEP))
    known = keys[: max(len(single), min(size, int((c >= COMMON).sum())))]
    model = train(training.select("tokens"), Model(known, np.concatenate((first, others[:, 0])), size), n_train)

    held = spark.sparkContext.broadcast((model, keys, c))

    def make():
        model, keys, c = held.value
        index = HashIndex(keys)
        base_of = np.log10((c + 0.5) / whole)
        share_of = np.log10((c + 0.5) / in_item[(keys & _LOW).astype(np.int64)]) if len(keys) else c
        share_of[: min(SINGLE, len(keys))] = 0  # alone in their item

        def run(columns):
            found, lens = unpacked(columns[0])
            owner = np.repeat(np.arange(len(lens)), lens)
            at = index.find(found)
            known = at >= 0
            by_text = lambda x, o: np.bincount(o, x, minlength=len(lens))
            base = by_text(base_of[at[known]], owner[known])
            full = by_text(model.scores(found, lens), owner) + by_text(share_of[at[known]], owner[known])
            rare, whose = found[~known], owner[~known]
            ends = np.cumsum(np.bincount(whose, minlength=len(lens)))
            rare_keys, rare_n = [], []
            for a, b in zip(np.concatenate(([0], ends[:-1])), ends, strict=True):
                k, n = np.unique(rare[a:b], return_counts=True)
                rare_keys.append(k.view(np.int64))
                rare_n.append(n.astype(np.int32))
            return [lens, by_text(np.ones(known.sum()), owner[known]).astype(np.int64), base, full, rare_keys, rare_n]

        return run

    new = [("n_tokens", pa.int64(), "long"), ("n_known", pa.int64(), "long"), ("base", pa.float64(), "double"), ("full", pa.float64(), "double"), ("keys", pa.list_(pa.int64()), "array<long>"), ("tf", pa.list_(pa.int32()), "array<int>")]
    scored = materialise(map_arrow(d.withColumn("row", F.monotonically_increasing_id()), ["row", "id", "held_out"], ["tokens"], make, new), "scored")
    tables.drop("tokens")
    rare = scored.select("row", F.explode(F.arrays_zip("keys", "tf")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.tf").alias("tf"))
    few = counts.where(F.col("c") < float(1 << cutoff))
    joined = rare.join(few, "key", "left").select("row", "tf", F.coalesce("c", F.lit(0)).alias("c"), ending.alias("h"))
    denominators = F.array(*[F.lit(float(x)) for x in in_item])
    more = joined.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known"),
        F.sum(F.col("tf") * F.log10((F.col("c") + 0.5) / F.lit(float(whole)))).alias("b"),
        F.sum(F.col("tf") * F.log10((F.col("c") + 0.5) / F.element_at(denominators, F.col("h") + 1))).alias("f"),
    )
    return scored.drop("keys", "tf").join(more, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("full") + F.coalesce("f", F.lit(0.0))).alias("score"),
    )
