"""What the training-data operators share: code shipping, shared folders, Arrow rows, word boundaries."""

from __future__ import annotations

import ctypes
import gc
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.python import ship

#: Rows in one Arrow batch sent to Python; texts can be long, so it is far below Spark's default.
BATCH_ROWS = 1000


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def prepare(spark: SparkSession) -> None:
    """Let executors import this package, and bound the Arrow batches they are sent."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship(spark)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's checkpoint folder, which all executors share."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "/tmp/checkpoints/barloom"  # one machine, as in tests
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it again, which cuts lineage and survives lost executors."""
    spark = session_of(df)
    path = shared_folder(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Seconds without a task after which a Python worker gives its memory back.
IDLE_S = 3.0
#: What drops this process's caches; a task that uses one keeps it to its end.
_caches: list[Callable[[], None]] = []
_idle: threading.Timer | None = None
_running = 0
_lock = threading.Lock()


def cached_here(clear: Callable[[], None]) -> None:
    """Have `clear` called when this process has been idle for IDLE_S: workers outlive the stages they are used in."""
    if clear not in _caches:
        _caches.append(clear)


def _release() -> None:
    with _lock:
        if _running:
            return
        for clear in _caches:
            clear()
        _caches.clear()
        _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def releasing(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """function over batches; memory that is kept for the next task goes if none comes."""
    global _idle, _running
    with _lock:
        _running += 1
        if _idle is not None:
            _idle.cancel()
    try:
        yield from function(batches)
    finally:
        with _lock:
            _running -= 1
            if _idle is not None:
                _idle.cancel()
            _idle = threading.Timer(IDLE_S, _release)
            _idle.daemon = True
            _idle.start()


def map_rows(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    prepare(session_of(df))
    return df.mapInArrow(lambda batches: releasing(function, batches), schema)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: The bytes of the class \x20\x09-\x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a whole string column without nulls, and the n + 1 offsets into them."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - at[0] if len(at) else np.zeros(1, np.int64)


def pieces(at: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges that hold at most about `most` bytes, one row at least."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of rows with offsets `at` (at[0] = 0), and the first word of each row (n + 1)."""
    space = _SPACE[raw]
    inside = ~space
    start, end = inside.copy(), inside.copy()
    start[1:] &= space[:-1]
    end[:-1] &= space[1:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    start[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, at)


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_BASE = 0x9E6C63D0676A9A99
_powers: list[np.ndarray] = []


def byte_table(rng: np.random.Generator) -> np.ndarray:
    """A random odd 64-bit number for each byte."""
    return rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _MIX[0]
    x = (x ^ x >> np.uint64(29)) * _MIX[1]
    return x ^ x >> np.uint64(32)


def _base_powers(n: int) -> list[np.ndarray]:
    both = _powers[:]  # the list may be emptied meanwhile
    if not both or len(both[0]) < n:
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, 1 << 21), base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = both
    return both


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end] for many spans, from one running sum of a polynomial in the bytes' numbers."""
    power, inverse = _base_powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * power[: len(raw)], dtype=np.uint64, out=sums[1:])
    return mixed((sums[end] - sums[start]) * inverse[start])
