"""Shared helpers: narrow Arrow maps over texts, and vectorised hashing of the words of a text."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Base of the polynomial hashes; odd, so it has an inverse modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Units hashed at once; longer texts are cut between words.
CHUNK = 1 << 21


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that no column of ``df`` has (Spark compares names without case)."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """A column by its plain name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


_tools: dict[str, tuple] = {}


def worker_tool(kind: str, key, make: Callable):
    """What a worker process makes once and keeps from task to task: one tool at a time, made anew for another key."""
    if kind not in _tools or _tools[kind][0] != key:
        _tools.clear()
        _tools[kind] = key, make()
    return _tools[kind][1]


def release(kind: str | None = None) -> None:
    """Drop the tool of another kind, which an earlier stage left in this worker."""
    others = [k for k in _tools if k != kind]
    for k in others:
        del _tools[k]
    if others:
        gc.collect()


def map_arrow(
    df: DataFrame, keep: list[str], columns: list[str], make: Callable[[], Callable[[list[list]], list[list]]], new: list[tuple[str, pa.DataType, str]], tool: str | None = None
) -> DataFrame:
    """A narrow map: ``make()`` runs once per task and returns a function from a batch's column lists to result lists.

    The columns ``keep`` go through as they are, of whatever type; ``new`` names what is added (name, Arrow type, Spark
    type). Only ``keep`` and ``columns`` are read, so other columns (also ones with clashing names) never reach Python.
    Names may repeat between ``keep`` and ``columns``, and within the result if the caller wants them to. ``tool``: the
    kind of ``worker_tool`` that ``make`` uses; workers let others go.
    """
    kinds = dict(df.dtypes)
    width = len(keep)
    names = [f"c{i}" for i in range(width + len(new))]
    ddl = ", ".join(f"c{i} {kind}" for i, kind in enumerate([*(kinds[c] for c in keep), *(k for _, _, k in new)]))
    types = [t for _, t, _ in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(tool)
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # bounds what Python objects take
                part = batch.slice(at, 256)
                out = f([c.to_pylist() for c in part.columns[width:]])
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *(pa.array(v, t) for v, t in zip(out, types, strict=True))], names=names)

    asked = df.select(*[column(c).alias(f"k{i}") for i, c in enumerate(keep)], *[column(c).alias(f"v{i}") for i, c in enumerate(columns)])
    return asked.mapInArrow(run, ddl).toDF(*keep, *(n for n, _, _ in new))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise a 64-bit hash (splitmix64)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse, modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        base = BASES[which]

        def table(b: int) -> np.ndarray:
            out = np.full(size, b, U64)
            out[0] = 1
            return np.multiply.accumulate(out)

        have = _powers[which] = (table(base), table(pow(base, -1, 1 << 64)))
    return have


def prefix(units: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums from which the hash of any span follows."""
    n = len(units)
    out = np.zeros(n + 1, U64)
    np.cumsum((units.astype(U64) + U64(1)) * powers(n + 1, which)[0][:n], out=out[1:])
    return out


def span_hash(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of spans; equal for equal units wherever the span stands."""
    return mix((pre[ends] - pre[starts]) * powers(len(pre), which)[1][starts])


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def pieces(units: np.ndarray, inside: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut long texts between words: (offset, units, inside) with every word whole in one piece."""
    at, n = 0, len(units)
    while n - at > size:
        gaps = np.flatnonzero(~inside[at : at + size])
        if len(gaps):
            cut = at + int(gaps[-1]) + 1
        else:
            later = np.flatnonzero(~inside[at + size :])
            cut = at + size + int(later[0]) + 1 if len(later) else n
        yield at, units[at:cut], inside[at:cut]
        at = cut
    yield at, units[at:], inside[at:]


def word_hashes(units: np.ndarray, table: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes, in text order, of the maximal runs of units for which ``table`` is True."""
    out = []
    for _, u, i in pieces(units, table[units]):
        s, e = spans(i)
        out.append(span_hash(prefix(u, which), s, e, which))
    return np.concatenate(out) if len(out) > 1 else out[0]


def utf8(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def byte_table(kind: str) -> np.ndarray:
    """Which bytes belong to a word: 'alnum' (ASCII letters, digits, all above 0x7F) or 'solid' (all but space and 0x09-0x0D)."""
    t = np.ones(256, bool)
    if kind == "alnum":
        t[:128] = [chr(i).isalnum() for i in range(128)]
    else:
        t[[32, *range(9, 14)]] = False
    return t


class HashIndex:
    """Finds 64-bit keys in a fixed set: open addressing with linear probing, all in numpy."""

    def __init__(self, keys: np.ndarray):
        """keys: distinct."""
        n = len(keys)
        bits = max(4, (4 * n).bit_length())
        self.mask, self.shift = U64((1 << bits) - 1), U64(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int32)
        self.keys = keys.astype(U64)
        todo, at = np.arange(n, dtype=np.int32), self.keys >> self.shift
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of several for one slot the last one stays
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + U64(1)) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.keys) or not len(h):
            return out
        at = h >> self.shift
        got = self.slots[at]
        same = (got >= 0) & (self.keys[got] == h)
        out[same] = got[same]
        todo = np.flatnonzero((got >= 0) & ~same)
        at = at[todo]
        while len(todo):
            at = (at + U64(1)) & self.mask
            got = self.slots[at]
            same = (got >= 0) & (self.keys[got] == h[todo])
            out[todo[same]] = got[same]
            go = (got >= 0) & ~same
            todo, at = todo[go], at[go]
        return out


#: DuckDB SQL for CRC-32: a table of remainders made by rule (needs ``with recursive``), and the checksum of a string by it.
CRC_TABLE = """bits(b, k, v) as (select b, 0, b from range(256) t(b) union all
  select b, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
crc as (select list(v order by b) remainders from bits where k = 8)"""


def crc_of(text: str) -> str:
    """The SQL of a string's unsigned CRC-32, in a query that joins ``crc``."""
    data = f"list_transform(range(0, octet_length(encode({text}))), lambda i: cast('0x' || substr(hex(encode({text})), cast(2 * i + 1 as int), 2) as bigint))"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {data}), lambda c, x: xor(c >> 8, remainders[(xor(c, x) & 255) + 1])), 4294967295)"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``, or on a local master a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _local[app] = _local.get(app) or tempfile.mkdtemp(prefix="spark-tables-")
    return f"{root}/pointloom-tables"


_local: dict[str, str] = {}


class Tables:
    """Tables written to the shared folder; later steps start from there, and a lost executor costs no more than that.

    ``keep`` writes one and reads it again; ``drop`` removes those that nothing will read any more. The one that a query's
    result is read from stays for the owner of the folder to clear.
    """

    def __init__(self):
        self.paths: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        spark = df.sparkSession
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove all tables kept under these names; what is read from them must have been written by then."""
        spark = SparkSession.getActiveSession()
        for path in [p for p in self.paths if p.rpartition("/")[2].rpartition("-")[0] in names]:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            self.paths.remove(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """One table of ``Tables``, which stays."""
    return Tables().keep(df, name)
