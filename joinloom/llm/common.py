"""What the operators share: tables in the shared folder, shipped code and byte-level text arrays.

Joins with one row a key on one side are left to Spark: adaptive execution broadcasts that side below its threshold and
otherwise splits the partitions of hot keys.

Text arrays: an Arrow string column is one byte buffer plus offsets, so the operators work on whole batches
in numpy without building Python strings.  ``pieces`` cuts a batch into runs of whole documents of about
``limit`` bytes; that bounds the size of the intermediate arrays, which are several times the text.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import fresh_path, shared_dir  # noqa: F401

# Words are runs of bytes outside ASCII white space; UTF-8 continuation bytes never fall in that range.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

PIECE_BYTES = 1 << 20
PARTS = 16
_U = np.uint64
_SHIPPED: set[str] = set()


#: Spark fills Arrow batches by rows; by bytes, long texts take no more memory than short ones.
BATCH_BYTES = "4m"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, whatever their working directory is, and bound the session's batches."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="joinloom-")) / "joinloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors.  Its shuffle files go at once."""
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    made = spark.read.schema(df.schema).parquet(path)
    made.jl_path = path
    return made


#: Rows of a table of a few numbers each that may be broadcast.
SMALL_ROWS = 20_000


def small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows: its other side then isn't dealt out anew."""
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


def unused(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column has it."""
    have = {c.lower() for c in columns}
    while name in have:
        name += "_"
    return name


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing will read again."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.jl_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give back the memory that a finished task leaves in its worker."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` by ``work``; workers outlive their tasks, so each task gives its memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


# --- tables added up over all rows ------------------------------------------------------------------------------

_PART = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("docs", T.LongType()), T.StructField("packed", T.BinaryType())])


def total(df: DataFrame, fill: Callable[[np.ndarray, pa.RecordBatch], None], size: int, kind: type, add: np.ufunc) -> tuple[np.ndarray, int]:
    """A table of ``size`` numbers, filled by task and added up by part, and the number of rows."""

    def emit(tables: dict[int, np.ndarray], docs: dict[int, int]) -> pa.RecordBatch:
        packed = [zlib.compress(np.ascontiguousarray(t).tobytes(), 1) for t in tables.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(tables), pa.int32()), pa.array([docs.get(p, 0) for p in tables], pa.int64()), pa.array(packed, pa.binary())], names=_PART.names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros(size, kind), 0
        for batch in batches:
            n += len(batch)
            fill(table, batch)
        if n:
            yield emit(dict(enumerate(np.split(table, PARTS))), {0: n})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        docs: dict[int, int] = {}
        for batch in batches:
            for part, n, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(zlib.decompress(packed), kind)
                tables[part] = add(tables[part], x) if part in tables else x
                docs[part] = docs.get(part, 0) + n
        if tables:
            yield emit(tables, docs)

    out, n = np.zeros((PARTS, size // PARTS), kind), 0
    for part, docs, packed in arrow(arrow(df, count, _PART).repartition(PARTS, "part"), gather, _PART).collect():
        out[part] = np.frombuffer(zlib.decompress(packed), kind)
        n += docs
    return out.reshape(-1), n


# --- text as arrays -------------------------------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(at: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer document stands alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = int(np.searchsorted(at, at[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(seed * 1_000_003)) * _U(0x9E3779B97F4A7C15))


_VALUE = seeded(256, 1)
_BASE = 0xD1342543DE82EF95
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        size = 1 << max(16, (n - 1).bit_length())
        got = np.full(size, base, _U)
        got[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(got, out=got)
        if size <= 1 << 24:
            _POWERS[base] = got
    return got[:n]


class Hashes:
    """Hashes of any substring of ``data`` from one prefix sum of base powers modulo 2**64."""

    def __init__(self, data: np.ndarray, base: int = _BASE):
        n = len(data)
        self.base = base
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(_VALUE[data] * _powers(base, n), out=self.sums[1:])
        self.inverse = pow(base, -1, 1 << 64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(0, _U)
        return mix((self.sums[end] - self.sums[start]) * _powers(self.inverse, int(start.max()) + 1)[start])

    def every(self, width: int) -> np.ndarray:
        """The hash of the ``width`` bytes from each position on."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, _U)
        return mix((self.sums[width:] - self.sums[:n]) * _powers(self.inverse, n))


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of the first word of each document (and of the end)."""
    at = at - at[0]
    full = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    prev = np.empty_like(full)
    prev[:1] = False
    prev[1:] = full[:-1]
    start = np.flatnonzero(full & (~prev | first[:-1]))
    nxt = np.empty_like(full)
    nxt[-1:] = False
    nxt[:-1] = full[1:]
    end = np.flatnonzero(full & (~nxt | first[1:])) + 1
    return start, end, np.searchsorted(start, at)

