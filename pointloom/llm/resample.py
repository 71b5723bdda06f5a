"""Importance resampling towards a target distribution, with exact weights from bit-sliced counts.

Features of a text are runs of its words, hashed into buckets. A bucket's gain is the log ratio of its smoothed shares
in the target and in the documents, as an integer. A text's weight is the mean gain of its features. The sum of gains is
taken bit-sliced: the counts of a text's buckets become planes, the k-th holding bit k of each count; the gains' sizes
become planes too, one set for positive and one for negative gains. A pair of planes has popcount(a AND b) buckets in
common, each of which adds 2 to the power of the planes' places, so the sums are exact integers.

Drawing without replacement takes the highest weight plus Gumbel noise, which depends on seed and id alone.

Null text has no words; its weight is 0 and, like any text of few words, it isn't drawn. Repeated rows count and rank as
often as they occur, next to each other; ties go to the lesser id, a null id first. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.rounds import running

from .common import CRC_TABLE, Tables, column, crc_of, map_arrow

BUCKETS, NGRAM, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Features that a worker remembers; texts whose counts are sliced at once.
REMEMBERED, BLOCK = 400_000, 64


class Buckets(dict):
    """Bucket of each feature, worked out when it is first met."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        got = self[feature] = crc32(feature) % self.n
        return got


def words(text: str) -> list[bytes]:
    """Maximal runs of letters, digits and everything outside ASCII, A-Z lower-cased."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def features(tokens: list[bytes], longest: int) -> Iterator[bytes]:
    """Runs of 1 to ``longest`` consecutive words, joined by a space."""
    yield from tokens
    for n in range(2, longest + 1):
        for i in range(len(tokens) - n + 1):
            yield b" ".join(tokens[i : i + n])


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = NGRAM) -> DataFrame:
    """(bucket, n) over all texts: each task adds up its own, so at most ``buckets`` rows a task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for t in b.column(0):
                if t.is_valid:
                    total += np.bincount(np.fromiter(map(known.__getitem__, features(words(t.as_py()), longest)), np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return texts.select(column(text_col)).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket: floor(1000 ln of the ratio of add-one shares)."""
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((corpus.get(b, 0) + 1.0) * t_all))) for b in range(buckets)], np.int64)


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of non-negative integers: (bits, rows, words of 64 bits), from an array (rows, columns)."""
    rows, columns = values.shape
    bits = int(values.max(initial=0)).bit_length()
    wide = -columns % 64
    out = np.empty((bits, rows, (columns + wide) // 64), np.uint64)
    for k in range(bits):
        plane = np.packbits((values >> k & 1).astype(np.uint8), axis=1)
        out[k] = np.pad(plane, ((0, 0), (0, out.shape[2] * 8 - plane.shape[1]))).view(np.uint64)
    return out


class Slices:
    """Planes of the gains, held by each worker: as many as gains have bits, of as many bits as there are buckets."""

    def __init__(self, gain: np.ndarray):
        self.buckets = len(gain)
        self.signed = [(sign, planes(np.maximum(sign * gain, 0)[None])[:, 0]) for sign in (1, -1)]

    def sums(self, counts: np.ndarray) -> np.ndarray:
        """Sum of count times gain over the buckets, for each row of counts (rows, buckets); exact."""
        total = np.zeros(len(counts), np.int64)
        for k, plane in enumerate(planes(counts)):
            some = np.flatnonzero(plane.any(axis=1))
            part = plane[some]
            for sign, gain in self.signed:
                for j, g in enumerate(gain):
                    total[some] += (sign << (k + j)) * np.bitwise_count(part & g).sum(axis=1, dtype=np.int64)
        return total


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = NGRAM) -> DataFrame:
    """(id_col, n_words, n_features, weight): the floored mean gain of each text's features; without any, 0."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def make():
        tool, known = Slices(held.value), Buckets(len(held.value))

        def run(columns: list[list]) -> list[list]:
            n_words, n_features, out = [], [], []
            for at in range(0, len(columns[0]), BLOCK):
                rows = []
                for t in columns[0][at : at + BLOCK]:
                    tokens = words(t or "")
                    n_words.append(len(tokens))
                    rows.append(np.fromiter(map(known.__getitem__, features(tokens, longest)), np.int64))
                counts = np.stack([np.bincount(r, minlength=tool.buckets) for r in rows])
                sizes = counts.sum(axis=1)
                n_features += sizes.tolist()
                out += (tool.sums(counts) // np.maximum(sizes, 1)).tolist()
            return [n_words, n_features, out]

        return run

    return map_arrow(docs, [id_col], [text_col], make, [("n_words", pa.int64(), "long"), ("n_features", pa.int64(), "long"), ("weight", pa.int64(), "long")])


def noise(id_col: str, seed: int):
    """Gumbel noise in thousandths, from the first 8 hex digits of sha256 of ``seed:id`` (a null id counts as empty)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(column(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, longest: int = NGRAM,
    least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """Every row of ``docs`` with its weight and score, and its rank if it is drawn.

    Of the rows with at least ``least_words`` words, ``percent`` of a hundred (floored) with the highest scores are
    drawn. Returns (id_col, n_features, weight, score, rank). Counts of all documents and targets meet in a table of
    ``buckets`` rows, the only thing that the driver holds. Ranks come from running counts over ranges of the order,
    so no task sees all rows.
    """
    tables = Tables()
    corpus = {r.bucket: r.n for r in bucket_counts(docs, text_col, buckets, longest).collect()}
    wanted = {r.bucket: r.n for r in bucket_counts(target, target_col, buckets, longest).collect()}
    found = weights(docs, gains(corpus, wanted, buckets), id_col, text_col, longest)
    found = found.select(column(id_col).alias("_id"), "n_words", "n_features", "weight", (F.col("weight") + noise(id_col, seed)).alias("score"))
    # the row's own number tells equal rows apart, so that the order has no large ties
    found = tables.keep(found.withColumn("_row", F.monotonically_increasing_id()), "weights")
    fit = F.col("n_words") >= least_words
    draw = found.where(fit).count() * percent // 100
    ranked = running(found.where(fit), [F.col("score").desc(), F.col("_id").asc_nulls_first(), F.col("_row").asc()], {"rank": F.lit(1).cast("long")})
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = found.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(F.col("_id").alias(id_col), "n_features", "weight", "score", "rank")


def oracle(buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> str:
    """The query in DuckDB SQL, for features of one word; crc32 runs over a table of remainders made by rule."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{word}')"
    return f"""
with recursive {CRC_TABLE},
docs as (select row_number() over () rid, doc_id, {split} words from documents),
corpus as (select rid, unnest(words) w from docs),
target as (select unnest({split}) w from benchmark),
distinct_words as (select distinct w from (select w from corpus union all select w from target)),
bucket as (select w, {crc_of("w")} % {buckets} b from distinct_words, crc),
s as (select b, count(*) n from corpus join bucket using (w) group by b),
t as (select b, count(*) n from target join bucket using (w) group by b),
gain as (select b, cast(floor(1000 * ln(cast(coalesce(t.n, 0) + 1 as double) * ((select coalesce(sum(n), 0) from s) + {buckets})
    / (cast(coalesce(s.n, 0) + 1 as double) * ((select coalesce(sum(n), 0) from t) + {buckets})))) as bigint) g from s full join t using (b)),
sums as (select rid, cast(sum(g) as bigint) g from corpus join bucket using (w) join gain using (b) group by rid),
scored as (select rid, doc_id, len(words) n, cast(case when len(words) = 0 then 0 else floor(coalesce(g, 0) / len(words)) end as bigint) weight,
  cast('0x' || substr(sha256('{seed}:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) h from docs left join sums using (rid)),
final as (select doc_id, n, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) score from scored),
ranked as (select *, row_number() over (partition by n >= {least_words} order by score desc, doc_id nulls first) r from final)
select doc_id, cast(n as bigint) n_features, weight, score,
  case when n >= {least_words} and r <= (select count(*) from final where n >= {least_words}) * {percent} // 100 then r end as rank from ranked"""
