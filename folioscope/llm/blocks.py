"""Vectorised text primitives shared by the operators of this subpackage.

A task walks its Arrow batches in blocks of 256 KiB of UTF-8 (one
longer text is a block of its own), so memory is bounded by the block and not
by the partition.  All hashes are polynomials modulo 2**64 taken from one
running sum, followed by a mixing step.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

BLOCK_BYTES = 1 << 18


_lean = False


def lean() -> None:
    """For workers: arrays over 512 KiB go back to the system when they are freed, as a worker process lives on between tasks."""
    global _lean
    libc = None if _lean else ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 1 << 19)  # M_MMAP_THRESHOLD
        pa.set_memory_pool(pa.system_memory_pool())
    _lean = True


U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15
_MULT_INV = pow(_MULT, -1, 1 << 64)
_BYTE = np.random.default_rng(20240817).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Words of everything but space, tab, LF, VT, FF and CR.
SOLID = np.ones(256, bool)
SOLID[32] = False
SOLID[9:14] = False

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers and their inverses, up to n at least."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, BLOCK_BYTES + 1)
        out = []
        for base in (_MULT, _MULT_INV):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers = out[0], out[1]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def running(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over values, one longer than them."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of each [lo, hi) of the sequence that prefix was made from."""
    return mix((prefix[hi] - prefix[lo]) * powers(len(prefix))[1][lo] + (hi - lo).astype(np.uint64))


class Words:
    """Words of a block: starts and ends in bytes, hashes, and each text's range of words."""

    def __init__(self, block: "Block", kind: np.ndarray):
        data, offs, n = block.low, block.offs, len(block.low)
        inside = kind[data]
        heads = offs[:-1][offs[:-1] < n]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[heads] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[heads[heads > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.start, offs)
        self.counts = np.diff(self.bounds)
        self.block = block

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hashes(self) -> np.ndarray:
        return span_hash(self.block.prefix, self.start, self.end)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def bytes_of(self, lo: int, hi: int) -> bytes:
        """The words lo to hi, lower-cased, a space between each."""
        raw = self.block.low
        return b" ".join(raw[a:b].tobytes() for a, b in zip(self.start[lo:hi], self.end[lo:hi], strict=True))

    def grams(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """Hash of each n consecutive words, by the first; those that leave their text are at fault and for the caller to drop."""
        if len(hashes) < n:
            return np.empty(0, np.uint64)
        at = np.arange(len(hashes) - n + 1)
        return span_hash(running(hashes), at, at + n)

    def whole(self, n: int) -> np.ndarray:
        """Which n-grams stay in one text."""
        if len(self) < n:
            return np.empty(0, bool)
        last = np.repeat(self.bounds[1:], self.counts)
        return np.arange(len(self) - n + 1) + n <= last[: len(self) - n + 1]


class Block:
    """Consecutive texts of a batch as bytes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs
        self._low = self._prefix = None

    def __len__(self) -> int:
        return len(self.offs) - 1

    @property
    def low(self) -> np.ndarray:
        if self._low is None:
            self._low = LOWER[self.data]
        return self._low

    @property
    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            self._prefix = running(_BYTE[self.low])
        return self._prefix

    def words(self, kind: np.ndarray = ALNUM) -> Words:
        return Words(self, kind)

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


def block_of(texts: list[bytes]) -> Block:
    return Block(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))


def raw_prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums over bytes as they are, for span_hash."""
    return running(_BYTE[data])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offs is not None else np.zeros(1, np.int64)
    if not len(column):
        offs = np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offs - offs[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """Row ranges of at most limit bytes of text, or of one row, each with its block."""
    data, offs = buffers(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, lo + 16384, n)
        yield lo, hi, Block(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def map_blocks(df: DataFrame, text: str, keep: list[str], fields: str, make: Callable[[], Callable[[Block], list]], limit: int = BLOCK_BYTES) -> DataFrame:
    """keep's columns, and those that make()(block) returns, a list or array for each of fields; names may clash."""
    small_batches(df.sparkSession)
    made = StructType.fromDDL(fields)
    names = [*keep, *made.names]
    schema = StructType([StructField(f"_{i}", t) for i, t in enumerate([df.schema[k].dataType for k in keep] + [f.dataType for f in made.fields])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        lean()
        fn = make()
        kinds = [to_arrow_type(f.dataType) for f in made.fields]
        for batch in batches:
            at = batch.schema.names.index(text)
            for lo, hi, block in blocks(batch.column(at), limit):
                cols = fn(block)
                arrays = [batch.column(batch.schema.names.index(k)).slice(lo, hi - lo) for k in keep]
                arrays += [c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema).toDF(*names)


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array whose i-th list is values[bounds[i]:bounds[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of flags over each [bounds[i], bounds[i + 1])."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, as in tests, one of our own, if all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        import tempfile

        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")

        found = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on this session sends at most so many rows at once to Python, which bounds a task's memory where rows hold whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage and lets several readers share it.

    The shuffle files of the write go when it is done, and not when the driver
    next collects garbage.
    """
    import uuid

    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = out, path
    return out


_PATHS: dict[int, tuple[DataFrame, str]] = {}  # of tables that stored() wrote and nobody has dropped


def dropped(*tables: DataFrame) -> None:
    """Remove the files of tables that stored() returned and nothing reads any more."""
    for df in tables:
        _, path = _PATHS.pop(id(df), (None, None))
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def known() -> set[int]:
    """What stored tables there are, for dropped_since."""
    return set(_PATHS)


def dropped_since(before: set[int], *but: DataFrame) -> None:
    """Remove all tables written since then but these."""
    dropped(*[df for k, (df, _) in list(_PATHS.items()) if k not in before and all(df is not x for x in but)])
