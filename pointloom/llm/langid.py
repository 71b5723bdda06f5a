"""Language identification by words first, then ever shorter character n-grams.

A word known in some language scores by its log frequency in each; a word unknown everywhere is scored by the mean
log frequency of its 5-grams (with its edges as spaces), or if none is known by its 4-grams, and so on down to letters.
The language with the best mean over the words wins.

Counting runs in Spark over a bounded sample of labelled rows (``PER_LANGUAGE`` rows of each language, picked by a
hash of id and text). The model keeps the features of the highest counts, at most ``MOST_CELLS`` numbers over all
languages whatever the lengths of the texts, so it can be collected and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HashIndex, Tables, codepoints, map_arrow, mix, pieces, powers, prefix, span_hash, spans

LONGEST = 5
#: Bound of the labelled rows of a language that the model is fitted on.
PER_LANGUAGE = 2500
#: Bound of the number of languages; more are an error.
MOST_LANGUAGES = 256
#: Bound of the model: features times languages.
MOST_CELLS = 1 << 24
#: Features seen less often in the sample are left out.
LEAST_COUNT = 2
#: What a feature costs in a language that lacks it: minus log10 of a frequency.
PENALTY = 7.0

_letter: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letter:
        _letter.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letter[0]


def words(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of a text: prefix sums over lower-case letters with spaces between, and where words start and end."""
    units = codepoints(text.lower())
    inside = letters()[units]
    for _, u, i in pieces(units, inside):
        padded = np.full(len(u) + 2, 32, np.uint32)
        padded[1:-1][i] = u[i]
        s, e = spans(i)
        yield prefix(padded), s + 1, e + 1


def grams(pre: np.ndarray, s: np.ndarray, e: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of words with a space at either edge, and the word each belongs to."""
    many = np.maximum(e - s + 3 - n, 0)
    owner = np.repeat(np.arange(len(s)), many)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + (s - 1)[owner]
    return tag(span_hash(pre, at, at + n), n), owner


def tag(h: np.ndarray, n: int) -> np.ndarray:
    """Keeps n-grams apart from words."""
    return mix(h + np.uint64(n))


class Model:
    """Minus log10 frequencies, a row for each word or n-gram and a column for each language."""

    def __init__(self, languages: list[str], keys: np.ndarray, costs: np.ndarray):
        self.languages, self.keys, self.costs = languages, keys, costs
        self.index: HashIndex | None = None

    def __getstate__(self):
        return self.languages, self.keys, self.costs

    def __setstate__(self, state):
        self.__init__(*state)

    def scores(self, text: str) -> tuple[np.ndarray, int]:
        """Summed costs in each language, and the number of words they come from."""
        if self.index is None:
            self.index = HashIndex(self.keys)
        total, n_words = np.zeros(len(self.languages)), 0
        for pre, s, e in words(text):
            got = self.index.find(span_hash(pre, s, e))
            total += self.costs[got[got >= 0]].sum(0, dtype=np.float64)
            n_words += int((got >= 0).sum())
            left = np.flatnonzero(got < 0)
            s, e = s[left], e[left]
            for n in range(LONGEST, 0, -1):
                if not len(s):
                    break
                h, owner = grams(pre, s, e, n)
                got = self.index.find(h)
                owner, got = owner[got >= 0], got[got >= 0]
                many = np.bincount(owner, minlength=len(s))
                total += (self.costs[got] / many[owner][:, None]).sum(0, dtype=np.float64)
                n_words += int((many > 0).sum())
                s, e = s[many == 0], e[many == 0]
            total += PENALTY * len(s)
            n_words += len(s)
        return total, n_words

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not letters()[codepoints(text)].any():
            return "und", 0.0
        total, n = self.scores(text)
        if not n:
            return "und", 0.0
        mean = total / n
        best = int(mean.argmin())
        return self.languages[best], float(1 / np.exp((mean[best] - mean) * np.log(10)).sum())


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", per_language: int = PER_LANGUAGE, cells: int = MOST_CELLS) -> Model:
    """Count words and n-grams of a bounded sample of the rows where ``train`` holds and text and lang aren't null.

    An empty table, or one without labels, gives a model that answers ``und``. Ties and repeated rows just count.
    """
    labelled = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col(id_col).alias("id"), "text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32))
    at = {k: i for i, k in enumerate(languages)}
    # a share of the hashes' whole range, which stays above 0 however many rows a language has
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / sizes[k])))])
    place = F.shiftrightunsigned(F.xxhash64("id", "text"), 1).cast("double") / float(1 << 63)
    sample = labelled.where(place <= share[F.col("lang")])

    def make():
        def count(columns):
            out: dict[str, list] = {}
            for text, lang in zip(*columns, strict=True):
                for pre, s, e in words(text):
                    out.setdefault(lang, []).append((0, span_hash(pre, s, e)))
                    for n in range(1, LONGEST + 1):
                        out[lang].append((n, grams(pre, s, e, n)[0]))
            rows: list[list] = [[], [], [], []]
            for lang, found in out.items():
                for n in range(LONGEST + 1):
                    keys, counts = np.unique(np.concatenate([h for k, h in found if k == n]), return_counts=True)
                    for r, x in zip(rows, ([at[lang]] * len(keys), [n] * len(keys), keys.view(np.int64).tolist(), counts.tolist()), strict=True):
                        r.extend(x)
            return rows

        return count

    new = [("lang", pa.int32(), "int"), ("n", pa.int32(), "int"), ("key", pa.int64(), "long"), ("c", pa.int64(), "long")]
    counts = map_arrow(sample, [], ["text", "lang"], make, new).groupBy("lang", "n", "key").agg(F.sum("c").alias("c")).where(F.col("c") >= LEAST_COUNT)
    tables = Tables()
    counts = tables.keep(counts, "features")
    # the rarest go, a whole level of counts at a time, until what the model holds has its bound
    level = F.floor(F.log2("c")).cast("int")
    by_level = {r.l: r.n for r in counts.groupBy(level.alias("l")).agg(F.count("*").alias("n")).collect()}
    cutoff, left = 0, sum(by_level.values())
    while left * len(languages) > cells:
        left -= by_level.get(cutoff, 0)
        cutoff += 1
    kept = counts.where(F.col("c") >= float(1 << cutoff))
    total = {(r.lang, r.n): r.t for r in kept.groupBy("lang", "n").agg(F.sum("c").alias("t")).collect()}  # frequencies are relative to the features kept
    totals = F.create_map(*[x for (lang, n), t in total.items() for x in (F.lit(lang * 8 + n), F.lit(float(t)))]) if total else F.create_map(F.lit(0), F.lit(1.0))
    cost = F.least(-F.log10(F.col("c") / totals[F.col("lang") * 8 + F.col("n")]), F.lit(PENALTY)).cast("float")
    rows = kept.select("lang", "key", cost.alias("cost")).toArrow()
    tables.drop("features")
    keys, row = np.unique(rows["key"].to_numpy().view(np.uint64), return_inverse=True)
    costs = np.full((len(keys), len(languages)), PENALTY, np.float32)
    costs[row, rows["lang"].to_numpy()] = rows["cost"].to_numpy()
    return Model(languages, keys, costs)


def identify(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str] = ("lang_pred", "score"), text_col: str = "text") -> DataFrame:
    """Adds a language and a score (0 to 1), under ``names``, to the columns ``keep``; null or letterless text is ``und`` with score 0."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = held.value

        def run(columns):
            found = [model.predict(t) for t in columns[0]]
            return [[f[0] for f in found], [f[1] for f in found]]

        return run

    return map_arrow(docs, keep, [text_col], make, [(names[0], pa.string(), "string"), (names[1], pa.float64(), "double")])
