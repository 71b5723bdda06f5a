"""NPY and NPZ arrays as a Spark data source whose partitions are ranges of rows.

The driver reads headers alone; each task seeks to its rows, so one file of any size is shared among tasks. Members of an
NPZ that are compressed can't be sought in: each is one task's, read as a stream.
"""

from __future__ import annotations

import fnmatch
import glob
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of rows in a partition, and rows in a batch.
PART_BYTES, BATCH = 64 << 20, 1 << 14


def _open(path: str):
    """A file that can be sought in: of a mounted folder, or of a store that Arrow knows by its scheme."""
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _paths(pattern: str) -> list[str]:
    if "://" not in pattern:
        return sorted(glob.glob(pattern)) if glob.has_magic(pattern) else [pattern]
    from pyarrow import fs

    if not glob.has_magic(pattern):
        return [pattern]
    folder, _, last = pattern.rpartition("/")
    store, name = fs.FileSystem.from_uri(folder)
    scheme = pattern.partition("://")[0]
    return sorted(f"{scheme}://{f.path}" for f in store.get_file_info(fs.FileSelector(name)) if fnmatch.fnmatch(f.base_name, last))


@dataclass
class Rows(InputPartition):
    """Rows ``start`` to ``stop`` of an array of ``count`` rows of ``width`` numbers that begins at byte ``at`` (of its member, if that is packed)."""

    path: str
    member: str
    packed: bool
    at: int
    kind: str
    count: int
    width: int
    by_columns: bool
    start: int
    stop: int


def header(f, name: str) -> tuple[str, int, int, bool]:
    """Type, rows, numbers in a row and whether columns come first; the file is left at the first number."""
    version = np.lib.format.read_magic(f)
    shape, by_columns, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if kind.hasobject or kind.kind not in "biuf":
        raise ValueError(f"{name}: only arrays of plain numbers are read")
    if len(shape) > 2 and by_columns:
        raise ValueError(f"{name}: arrays of more than two dimensions must have their last index fastest")
    count = shape[0] if shape else 1
    return kind.str, count, int(np.prod(shape[1:], dtype=np.int64)), by_columns and len(shape) == 2


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.paths = [p for given in options["path"].split("\n") for p in _paths(given)]
        self.part_bytes, self.member, self.columns = int(options.get("partbytes", PART_BYTES)), options.get("member"), names[3:]

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            with _open(path) as f:
                if f.read(2) != b"PK":
                    f.seek(0)
                    out += self._ranges(path, "", False, f, path)
                    continue
                f.seek(0)
                with zipfile.ZipFile(f) as z:
                    for info in z.infolist():
                        name = info.filename.removesuffix(".npy")
                        if self.member in (None, name):
                            packed = info.compress_type != zipfile.ZIP_STORED
                            with z.open(info) as m:
                                found = self._ranges(path, name, packed, m, f"{path}: {name}")
                            if not packed:  # the member's bytes follow its own header within the file
                                f.seek(info.header_offset + 26)
                                lengths = f.read(4)
                                start = info.header_offset + 30 + int.from_bytes(lengths[:2], "little") + int.from_bytes(lengths[2:], "little")
                                for r in found:
                                    r.at += start
                            out += found
        return out

    def _ranges(self, path: str, member: str, packed: bool, f, name: str) -> list[Rows]:
        kind, count, width, by_columns = header(f, name)
        if width < len(self.columns):
            raise ValueError(f"{name}: not a matrix of {len(self.columns)} columns")
        step = count if packed else max(1, self.part_bytes // max(1, width * np.dtype(kind).itemsize))
        return [Rows(path, member, packed, f.tell(), kind, count, width, by_columns, a, min(count, a + step)) for a in range(0, count, max(1, step))]

    def read(self, part: Rows | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there are no rows
            return
        kind, want = np.dtype(part.kind), len(self.columns)
        with _open(part.path) as f:
            if part.packed:
                with zipfile.ZipFile(f) as z, z.open(f"{part.member}.npy" if f"{part.member}.npy" in z.namelist() else part.member) as m:
                    m.read(part.at)
                    if part.by_columns:  # a column lies in one stretch, so all of the member is held
                        whole = np.frombuffer(m.read(), kind).reshape(part.width, part.count)
                        for a in range(0, part.count, BATCH):
                            yield self._batch(part, a, whole[:want, a : a + BATCH])
                        return
                    for a in range(0, part.count, BATCH):
                        n = min(BATCH, part.count - a)
                        yield self._batch(part, a, self._exactly(m, n * part.width, kind).reshape(n, part.width).T[:want])
                return
            for a in range(part.start, part.stop, BATCH):
                n = min(BATCH, part.stop - a)
                if part.by_columns:
                    columns = []
                    for c in range(want):
                        f.seek(part.at + (c * part.count + a) * kind.itemsize)
                        columns.append(self._exactly(f, n, kind))
                    yield self._batch(part, a, columns, n)
                else:
                    f.seek(part.at + a * part.width * kind.itemsize)
                    yield self._batch(part, a, self._exactly(f, n * part.width, kind).reshape(n, part.width).T[:want])

    @staticmethod
    def _exactly(f, count: int, kind: np.dtype) -> np.ndarray:
        data = f.read(count * kind.itemsize)
        if len(data) < count * kind.itemsize:
            raise ValueError("the file ends within an array")
        return np.frombuffer(data, kind)

    def _batch(self, part: Rows, first: int, columns, n: int | None = None) -> pa.RecordBatch:
        n = len(columns[0]) if n is None else n
        numbers = [pa.array(np.ascontiguousarray(c).astype("float64")) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array([part.member] * n), pa.array(np.arange(first, first + n)), *numbers], names=["path", "member", "row", *self.columns])


class ArraySource(DataSource):
    """Options: path (patterns, one a line), member (of NPZ files; all by default), partbytes."""

    @classmethod
    def name(cls) -> str:
        return "pointloom_arrays"

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(dict(self.options), schema.names)


def read_arrays(spark: SparkSession, paths: str | list[str], columns: list[str], member: str | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """(path, member, row, columns...) of the first columns of NPY files, or of the arrays in NPZ files (``member``: one of them).

    Arrays of one dimension have one column; of more than two, all further ones count as columns. Objects (pickles) and
    records are refused.
    """
    spark.dataSource.register(ArraySource)
    ddl = ", ".join(["path string, member string, row long", *[f"`{c}` double" for c in columns]])
    given = [paths] if isinstance(paths, str) else paths
    given = [p if "://" in p else os.path.abspath(p) for p in given]
    r = spark.read.format("pointloom_arrays").schema(ddl).option("partbytes", part_bytes)
    return (r.option("member", member) if member is not None else r).option("path", "\n".join(given)).load()
