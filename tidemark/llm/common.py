"""What the operators share: the word pattern, the shared folder, and numpy views of Arrow text columns."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULT = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}
Tables = list[tuple[SparkSession, str]]
#: Tables of the process, and those of the scopes that are open in this thread or task of an event loop.
_kept: Tables = []
_scopes: contextvars.ContextVar[tuple[Tables, ...]] = contextvars.ContextVar("scopes", default=(_kept,))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only a local session may lack one; it gets a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _drop(tables: Tables) -> None:
    for spark, path in tables:
        with contextlib.suppress(Exception):
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


atexit.register(lambda: _drop(_kept))


def _write(df: DataFrame, tables: Tables) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    tables.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors. It is removed when the
    innermost scope() ends, or else when Python does."""
    return _write(df, _scopes.get()[-1])


@contextlib.contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written within the block are removed at its end. What is to outlive it goes through the function given.
    Threads have scopes of their own."""
    outer, own = _scopes.get(), []
    before = _scopes.set((*outer, own))
    try:
        yield lambda df: _write(df, outer[-1])
    finally:
        _scopes.reset(before)
        _drop(own)


def mapped(df: DataFrame, scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(scan, schema) for rows with texts: 1,000 rows at most go over at once (a setting of the session that
    is only lowered), and a worker gives its free memory back when its task ends, as other stages use it again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name, "10000")) <= 1000:
        df.sparkSession.conf.set(name, "1000")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from scan(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):
                ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(run, schema)


def held_out(id_col: str, mod: int, is_out: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder is_out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == is_out, F.lit(False))


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with at most limit bytes of text and so many rows each, or a single longer row."""
    text = batch.column(column)
    lengths = np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64)
    first = total = 0
    for i, n in enumerate(lengths.tolist()):
        if i > first and (total + n > limit or i - first >= rows):
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    if first < len(lengths):
        yield batch.slice(first)


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column (null: none), and where each row starts and the last ends."""
    text = pc.fill_null(text.cast(pa.large_binary()), b"")
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_spans(buf: np.ndarray, off: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of each row's first word (one more entry than rows). between: whether
    each byte stands between words."""
    inside = ~between[buf]
    before = np.zeros(len(buf), dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(buf), dtype=bool)
    after[:-1] = inside[1:]
    cuts = off[1:-1]
    before[cuts[cuts < len(buf)]] = False
    after[cuts[cuts > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int, inverse: bool) -> np.ndarray:
    key = "inverse" if inverse else "power"
    if len(_powers.get(key, ())) < max(1, n):
        base = np.full(1 << max(12, math.ceil(math.log2(n + 1))), pow(int(_MULT), -1, 1 << 64) if inverse else _MULT, dtype=np.uint64)
        base[0] = 1
        _powers[key] = np.multiply.accumulate(base)
    return _powers[key][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash() takes the hash of any run of values."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power(len(values), False), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs [start, end), equal for equal runs wherever they stand."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    return mix((prefix[ends] - prefix[starts]) * _power(len(prefix), True)[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
