"""Scratch tables in the cluster's shared folder, and word and shingle hashes over Arrow text columns."""

from __future__ import annotations

import ctypes
import itertools
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

MAX_CHUNK_BYTES = 1 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, most: int = 1000) -> SparkSession:
    """Send at most so many rows to Python at once, from now on in this session: texts are long, and both sides hold a batch."""
    now = int(spark.conf.get(BATCH_ROWS))
    if now <= 0 or now > most:
        spark.conf.set(BATCH_ROWS, str(most))
    return spark


def fresh(name: str, *frames: DataFrame) -> str:
    """name, with as many underscores as it takes to be no column of the frames, whatever the case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Tables written for a query in the folder that spark.checkpoint.dir names; lineage is cut by reading them back.

    Where the setting is absent, a temporary folder is used if Spark runs on this machine alone, and an error raised if
    not. What a query's lazy result still reads is deleted when the driver's JVM ends, the rest by drop().
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="tidewave-")
        self.spark, self.root = small_batches(spark), f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._path(self.root)[0].deleteOnExit(self._path(self.root)[1])

    def _path(self, where: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def save(self, df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
        """Write df as Parquet and read it back. Shuffle files of the write go as soon as it is over.

        batch_rows: how many rows are sent to Python at once meanwhile.
        """
        mine = {CLEANUP: "true"} | ({BATCH_ROWS: str(batch_rows)} if batch_rows else {})
        was = {k: self.spark.conf.get(k) for k in mine}
        try:
            for k, v in mine.items():
                self.spark.conf.set(k, v)
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        finally:
            for k, v in was.items():
                self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for n in names:
            fs, p = self._path(f"{self.root}/{n}")
            fs.delete(p, True)


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):
    _trim = None


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task, next to those of other tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def chunks(batches: Iterator[pa.RecordBatch], col: str, most: int = MAX_CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most so many bytes of text; a longer text stands alone. No row is left out."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(b.column(col)), 0), dtype=np.int64)
        at, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > at and total + n > most:
                yield b.slice(at, i - at)
                at, total = i, 0
            total += n
        yield b.slice(at)
        release()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    a = pa.compute.fill_null(texts, "").cast(pa.large_binary())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if len(a) else np.zeros(0, np.uint8)
    return data, off - off[0]


_RNG = np.random.default_rng(20240817)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_POW: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 2 * MAX_CHUNK_BYTES:  # longer ones are for a single very long text
            _POW[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit hangs on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of data[start:end] for each span, by one prefix sum; fold takes A-Z as a-z."""
    return value_hashes((_FOLD if fold else _BYTE)[data], start, end)


def value_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of a sequence of 64-bit values."""
    n = len(values)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(_BASE, n), out=prefix[1:])
    back = powers(pow(_BASE, -1, 2**64), n + 1)
    return mix((prefix[end] - prefix[start]) * back[start] ^ (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of some texts. first has len(texts) + 1 entries: text i has words first[i] to first[i+1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(self.first)


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(texts: pa.Array, fold: bool = False) -> Words:
    data, off = buffers(texts)
    n = len(data)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.ones(n, bool)
    before[1:] = ~solid[:-1]
    after = np.ones(n, bool)
    after[:-1] = ~solid[1:]
    start = np.flatnonzero(solid & (before | edge[:-1]))
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    first = np.searchsorted(start, off)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, start, end, doc, first, span_hashes(data, start, end, fold))


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k words from each word on, the words from which k words remain in the text)."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.doc[:n] == w.doc[k - 1 :])
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + w.hash[j : n + j]
    return mix(h)[at], at


def sequences(w: Words) -> np.ndarray:
    """A hash of each text's whole word sequence."""
    n = len(w.hash)
    base = 0xD6E8FEB86659FD93
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(w.hash * powers(base, n), out=prefix[1:])
    lo, hi = w.first[:-1], w.first[1:]
    return mix((prefix[hi] - prefix[lo]) * powers(pow(base, -1, 2**64), n + 1)[lo] ^ (hi - lo).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def shingle_sets(w: Words, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text, hashed; of fewer words, the whole sequence as one; of none, empty."""
    h, at = windows(w, k)
    cut = np.searchsorted(at, w.first)
    whole, n = sequences(w), w.count()
    return [np.unique(h[a:b]) if n[i] >= k else whole[i : i + 1] if n[i] else h[:0] for i, (a, b) in enumerate(itertools.pairwise(cut.tolist()))]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
