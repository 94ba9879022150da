"""Shared helpers: Arrow plumbing, byte-level word tables, checkpoints."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: White space between words: 0x20 and 0x09 to 0x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done, step = 1, base
    while done < n:
        m = min(done, n - done)
        out[done : done + m] = out[:m] * U64(step)
        step = step * step % 2**64
        done += m
    return out


_BASE, _STRETCH = 0x9E3779B97F4A7C15, 65536
_POW, _DOWN = _powers(_BASE, _STRETCH), _powers(pow(_BASE, -1, 2**64), _STRETCH)
_POW_HIGH = 0xD1342543DE82EF95
_SHINGLE = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-shift-multiply rounds)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def string_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the rows' offsets in them; a null row is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = col.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 4 << 20):
    """Row ranges of at most ``limit`` bytes, or one row that is longer."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


class Words:
    """Words of consecutive rows, by default ``[^\\x20\\x09-\\x0D]+``: start, end and 64-bit hash (if ``hashed``) of each, and each row's first."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, between: np.ndarray = WHITE, hashed: bool = True):
        self.rows = len(offsets) - 1
        n = len(data)
        white = between[data]
        begin = np.empty(n + 1, bool)
        if n:
            begin[0], begin[1:n] = True, white[:-1]
            begin[n] = False
            begin[offsets[:-1][offsets[:-1] < n]] = True
            begin[:n] &= ~white
        else:
            begin[:] = False
        self.start = np.flatnonzero(begin)
        if not len(self.start):
            self.end = self.start
            self.hash = np.zeros(0, np.uint64)
            self.first = np.zeros(self.rows + 1, np.int64)
            return
        stop = np.empty(n, bool)
        stop[-1] = True
        stop[:-1] = white[1:]
        inner = offsets[1:-1]
        stop[inner[inner > 0] - 1] = True
        stop &= ~white
        self.end = np.flatnonzero(stop) + 1
        if hashed:
            self.hash = mix(self._sums(data, _BYTE[LOWER] if lower else _BYTE) + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, offsets)

    def _sums(self, data: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Of each word, the sum of its bytes' values times the powers of their places: differences of sums over a stretch of the data."""
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            a = self.start[i]
            j = int(np.searchsorted(self.end, a + _STRETCH, "right"))
            if j > i:
                vals = values[data[a : self.end[j - 1]]]
                vals *= _POW[: len(vals)]
                sums = np.empty(len(vals) + 1, np.uint64)
                sums[0] = 0
                np.cumsum(vals, out=sums[1:])
                first = self.start[i:j] - a
                out[i:j] = (sums[self.end[i:j] - a] - sums[first]) * _DOWN[first]
            else:  # a word longer than a stretch
                j = i + 1
                at = np.arange(self.end[i] - a)
                vals = values[data[a : self.end[i]]] * _POW[at % _STRETCH]
                out[i] = (vals * _powers(_POW_HIGH, len(at) // _STRETCH + 1)[at // _STRETCH]).sum(dtype=np.uint64)
            i = j
        return out

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie in one row."""
        m = len(self.hash)
        if m < k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h = np.zeros(m - k + 1, np.uint64)
        for i in range(k):
            h += self.hash[i : m - k + 1 + i] * _SHINGLE[i]
        row = np.repeat(np.arange(self.rows), np.diff(self.first))
        return mix(h), row[: m - k + 1] == row[k - 1 :]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a folder of our own only in local mode where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
    if not os.environ.get("LOOMDEX_SHARED"):
        os.environ["LOOMDEX_SHARED"] = "file://" + tempfile.mkdtemp(prefix="loomdex-shared-")
    return os.environ["LOOMDEX_SHARED"]


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomdex/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    settle(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def settle(spark: SparkSession) -> None:
    """Lets the driver forget plans that nothing refers to, so their shuffle files go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*dfs: DataFrame) -> None:
    """Remove tables of ``stored`` that no later plan reads."""
    for df in dfs:
        path = getattr(df, "stored_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def only(df: DataFrame, **cols: str) -> DataFrame:
    """The named columns cast to the named types, whatever else the table holds."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in cols.items()])


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def trim() -> None:
    """Give memory that a task no longer uses back to the system: workers live on, and the next stage's tasks need it."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def per_batch(df: DataFrame, fn, schema: str, limit: int = 4 << 20, text: str = "text", end=None) -> DataFrame:
    """``fn(pa.Table of at most ``limit`` text bytes or one row) -> pa.Table | dict`` over all rows; ``end()`` after a task's last."""

    def run(batches):
        for batch in batches:
            sizes = string_buffer(batch.column(batch.schema.get_field_index(text)))[1]
            for a, b in slices(sizes, limit):
                out = fn(batch.slice(a, b - a))
                if out is not None and len(out):
                    yield out
        if end:
            end()
        trim()

    return df.mapInArrow(run, schema)
