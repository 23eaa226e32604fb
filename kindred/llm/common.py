"""What the operators share: byte arrays of whole texts, word hashes, keyed streams, components.

Texts reach Python as Arrow batches.  ``chunks`` turns a batch into runs of whole documents whose
bytes lie in one numpy array, so that tokenising and hashing are vector operations whose memory is
bounded by ``CHUNK`` (or by one document, if that is longer).  Batches are bounded by ``BATCH``.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 18
BATCH = 4 << 20  # bytes of an Arrow batch, about
U64 = np.uint64
#: Byte classes: ASCII white space, and A-Z to a-z.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TABLE = np.random.default_rng(20260101).integers(0, 2**64, (32, 256), dtype=U64).ravel()
_ODD = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Unset, a run on one machine gets a temporary folder, removed at exit; a cluster gets an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="kindred-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(spark: SparkSession) -> None:
    """Arrow batches of about ``BATCH`` bytes; the session keeps that bound, unless it has one of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def mapped(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches bounded in bytes."""
    bounded(df.sparkSession)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(batches)
        released()

    return df.mapInArrow(lean, schema)


def released() -> None:
    """Gives free memory back, so that a worker that waits for its next task holds none."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def squeezed(raw: bytes) -> bytes:
    """Compressed; empty stays empty."""
    return zstandard.compress(raw, 1) if raw else b""


def opened(raw: bytes) -> bytes:
    return zstandard.decompress(raw) if raw else b""


def buckets_of(spark: SparkSession) -> int:
    """How many keys the packed shuffles use: some for each shuffle partition, so that they grow with it."""
    return max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one array, and its offsets; null is empty."""
    col = pc.fill_null(batch.column(name).cast(pa.large_string()), "")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offs


def chunks(batch: pa.RecordBatch, size: int = CHUNK) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets from 0) of runs of whole documents of about ``size`` bytes."""
    data, offs = texts_of(batch)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        j = min(j, n)
        yield slice(i, j), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words_in(data: np.ndarray, offs: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word; ``apart`` has the bytes between words, no word crosses documents."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~apart[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each word: a sum of table entries by place and byte, then mixed."""
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    byte = data[np.repeat(start, size) + place]
    got = _TABLE[((place & 31) << 8) | byte]
    if int(size.max()) > 32:
        far = place >= 32
        got[far] = mix(got[far] + (place[far] >> 5).astype(U64) * _ODD)
    return mix(np.add.reduceat(got, at) + size.astype(U64) * _ODD)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word hashes."""
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = mix(out * U64(0xD6E8FEB86659FD93) + h[i : len(h) - n + 1 + i])
    return out


def packed(key: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """The columns' rows by key, as bytes."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    if not len(k):
        return
    cuts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    columns = [c[order] for c in columns]
    for a, b in zip(cuts, np.r_[cuts[1:], len(k)], strict=True):
        yield int(k[a]), [c[a:b].tobytes() for c in columns]


def keyed(df: DataFrame, each: Callable[[list[dict]], Iterator[pa.RecordBatch]], schema: str, keys: tuple[str, ...] = ("bucket",), parts: int | None = None) -> DataFrame:
    """``each`` gets all rows of a key at once; a task holds one key's rows at a time.  ``parts``: the number of tasks."""
    keys = list(keys)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        now = None
        for batch in batches:
            for row in (r for i in range(0, batch.num_rows, 256) for r in batch.slice(i, 256).to_pylist()):
                k = tuple(row[c] for c in keys)
                if k != now and held:
                    yield from each(held)
                    held = []
                now = k
                held.append(row)
        if held:
            yield from each(held)

    return mapped((df.repartition(parts, *keys) if parts else df.repartition(*keys)).sortWithinPartitions(*keys), stream, schema)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component, by repeated hooking and jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        if not live.any():
            break
        a, b = a[live], b[live]
        lo, hi = np.minimum(ra[live], rb[live]), np.maximum(ra[live], rb[live])
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in an edge list; the component is its smallest id.

    Large-star and small-star steps (Kiveris et al. 2014) on DataFrames: each step is one grouped
    minimum (combined before the shuffle) and one join, and ends when no edge changes.
    """

    def held(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = checkpointed(df.distinct())
        return df, tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now, was = held(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    while was[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v")
        now, new = held(small)
        if new == was:
            break
        was = new
    tops = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(tops)
