"""Approximate nearest neighbours over shifted space-filling curves.

Vectors are projected to ``dims`` random directions, shifted and brought on a grid; the Hilbert index of
the cell, then bits of a hash of the id, order them.  For each of ``curves`` projections and shifts the
rows are dealt, in the order of that key, to blocks of equally many rows and range-partitioned by block
in Spark.  A query meets the blocks in a window around its own place and keeps its nearest of each block;
the windows of all curves merge, and what is left is reranked by the exact measure on the original vectors.

The index is fitted on the data: grid and blocks on a sample of in expectation at most ``fit_rows`` vectors,
the window on about ``probes`` of them, whose true neighbours among *all* vectors one pass finds: it is the
smallest one that holds the share ``recall`` of these neighbours on at least one curve.  So vectors with
structure get narrow windows and vectors without it wide ones, by one rule at every size.  Every vector is
indexed.  The windows compare vectors in half precision, streamed past the queries of a block, which are
what a task holds; ``k + SPARE`` of them go on from each block.

Equal vectors are one row of the index with the ``k + 1`` smallest of their ids, found by an aggregation
before any ordering, so copies neither fill a window nor a task; near copies share a cell, and the hash
deals them to as many blocks as they need.

Vectors that are null, empty, zero or hold a null or a non-finite component take no part; nor do rows
without an id, or vectors of another length than the query's.  A repeated id counts once for each
different vector.  An empty table gives an empty result.  Very long vectors have no other limit than a
batch in memory.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import U64, checkpointed, mapped, mix

SPARE = 4
SALT = 23  # bits of the id's hash below the curve's
RESULT = "query_id long, rank int, vec_id long, score double"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of grid cells (rows of unsigned coordinates), by Skilling's transform (2004)."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(up, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _matrix(column: pa.Array, of: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(of, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Curves:
    """Projections, shifts and block bounds of all curves, and the window in blocks to either side."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, curves: int, dims: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.bits = bits
        self.axes = [np.linalg.qr(rng.normal(size=(d, dims)))[0] for _ in range(curves)]
        self.shifts = rng.uniform(-0.5, 0.5, (curves, dims))
        self.centre = [(sample @ a).mean(0) for a in self.axes]
        self.spread = [np.maximum((sample @ a).std(0), 1e-9) for a in self.axes]
        self.order = [np.sort(k) for k in self.keys(sample, ids)]
        self.half, self.blocks = 0, 1
        self.cuts = [np.zeros(0, np.int64)] * curves

    def keys(self, x: np.ndarray, ids: np.ndarray) -> Iterator[np.ndarray]:
        """Each curve's keys of unit vectors."""
        salt = (mix(ids.astype(np.int64).view(U64)) >> U64(64 - SALT)).astype(np.int64)
        for a, s, m, w in zip(self.axes, self.shifts, self.centre, self.spread, strict=True):
            cells = np.clip(((x @ a - m) / w + s + 4) / 8 * (1 << self.bits), 0, (1 << self.bits) - 1).astype(np.int64)
            yield hilbert(cells, self.bits) << SALT | salt

    def apart(self, x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Least share of all rows that lies between each pair's keys on any curve."""
        best = np.ones(len(x))
        for order, p, q in zip(self.order, self.keys(x, i), self.keys(y, j), strict=True):
            best = np.minimum(best, abs(np.searchsorted(order, p) - np.searchsorted(order, q)) / len(order))
        return best

    def widen(self, share: float) -> None:
        """Blocks of a quarter of the window's side: this share of all rows to either side are four blocks beside a place's own."""
        n = len(self.order[0])
        self.blocks = max(1, min(n // 4, int(4 / max(share, 1 / n))))
        self.half = max(1, int(np.ceil(share * self.blocks)))
        at = np.arange(1, self.blocks) * n // self.blocks
        self.cuts = [order[at] for order in self.order]

    def places(self, x: np.ndarray, ids: np.ndarray) -> Iterator[np.ndarray]:
        for cut, key in zip(self.cuts, self.keys(x, ids), strict=True):
            yield np.searchsorted(cut, key, "right")

    def work(self) -> float:
        """Comparisons for each query and row of the index."""
        return len(self.axes) * min(1.0, (2 * self.half + 1) / self.blocks)


def neighbours(rows: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", curves: int = 48, dims: int = 8, bits: int = 5, recall: float = 0.94, fit_rows: int = 20_000, probes: int = 128, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score (cosine in double precision): ties go to the smaller id."""
    spark = rows.sparkSession
    index, asked = indexed(rows, queries, k, vec_id, embedding)
    sizes = [r.d for r in index.select(F.size("v").alias("d")).distinct().collect()]  # the vectors' lengths
    if not sizes:
        return spark.createDataFrame([], RESULT)
    found = None
    for d in sizes:
        part, ask = index.where(F.size("v") == d), asked.where(F.size("v") == d)
        one = _search(part, ask, fit(part, k, curves, min(dims, d), bits, recall, fit_rows, probes, seed), k)
        found = one if found is None else found.unionByName(one)
    near = Window.partitionBy("ask").orderBy(F.desc("about"), "rep")
    found = found.groupBy("ask", "rep").agg(F.max("about").alias("about")).withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + SPARE).select("ask", "rep")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    found = found.join(asked.select("ask", "query_id", F.col("v").alias("q")), "ask").join(index, "rep")
    found = found.select("query_id", F.explode("ids").alias("vec_id"), (dot("q", "v") / (F.sqrt(dot("q", "q")) * F.sqrt(dot("v", "v")))).alias("score")).where("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def indexed(rows: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """((rep, v, ids) of the different vectors, (ask, query_id, v) of the queries)."""
    vec = F.transform(F.col(embedding), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), vec.alias("v"), queries.alias("q")).where(fine)
    spec = Window.partitionBy("h", "v").orderBy("vec_id")
    rows = rows.dropDuplicates(["vec_id", "v"]).withColumn("h", F.xxhash64("v"))
    copies = rows.withColumn("r", F.row_number().over(spec)).where(F.col("r") <= k + 1).groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    index = copies.select(F.xxhash64("h", F.col("ids")[0]).alias("rep"), "v", "ids")
    return checkpointed(index), checkpointed(rows.where("q").select(F.xxhash64("vec_id", "h").alias("ask"), F.col("vec_id").alias("query_id"), "v"))


def fit(part: DataFrame, k: int, curves: int, dims: int, bits: int, recall: float, fit_rows: int, probes: int, seed: int) -> Curves:
    """Curves for the vectors of one length; see the module for the sample."""
    n = part.count()
    chance = F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(1 << 30))
    got = part.where(chance < F.lit(min(1.0, fit_rows / n) * (1 << 30))).select("rep", "v", chance.alias("u")).toPandas()  # about fit_rows rows
    if not len(got):
        got = part.limit(1).select("rep", "v", F.lit(0).alias("u")).toPandas()
    got = got.sort_values(["u", "rep"])
    ids, x = got["rep"].to_numpy(np.int64), _unit(np.stack(got["v"].to_numpy()).astype(np.float64))
    out = Curves(x, ids, curves, dims, bits, seed)
    probe, who = x[:probes], ids[:probes]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, names, vectors = np.full((len(probe), k), -2.0), np.zeros((len(probe), k), np.int64), np.zeros((len(probe), k, probe.shape[1]))
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                b = batch.slice(a, 4096)
                y, name = _unit(_matrix(b.column("v"), b.num_rows)), b.column("rep").to_numpy()
                s = probe @ y.T
                s[who[:, None] == name[None]] = -2
                m = min(k, s.shape[1])
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                both = np.concatenate([best, np.take_along_axis(s, top, 1)], 1)
                keep = np.argsort(-both, axis=1, kind="stable")[:, :k]
                best, names = np.take_along_axis(both, keep, 1), np.take_along_axis(np.concatenate([names, name[top]], 1), keep, 1)
                vectors = np.take_along_axis(np.concatenate([vectors, y[top]], 1), keep[:, :, None], 1)
        i, j = np.nonzero(best > -2)
        yield pa.RecordBatch.from_pydict({"probe": pa.array(i, pa.int32()), "score": pa.array(best[i, j]), "rep": pa.array(names[i, j]), "v": pa.array(list(vectors[i, j]), pa.list_(pa.float64()))})

    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "rep"))
    near = mapped(part.select("rep", "v"), scan, "probe int, score double, rep long, v array<double>").withColumn("r", rank).where(F.col("r") <= k).select("probe", "rep", "v").toPandas()  # k rows a probe
    share = 1.0
    if len(near):
        i = near["probe"].to_numpy()
        share = float(np.quantile(out.apart(probe[i], who[i], np.stack(near["v"].to_numpy()), near["rep"].to_numpy(np.int64)), recall))
    out.widen(share)
    return out


def _search(part: DataFrame, ask: DataFrame, fitted: Curves, k: int) -> DataFrame:
    """(ask, rep, about) of the nearest in each query's windows of all curves, by cosines of half-precision vectors."""
    sent = part.sparkSession.sparkContext.broadcast(fitted)  # bounded by the sample
    schema = "block int, side int, id long, v binary"

    def deal(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                b = batch.slice(a, 2048)
                x, ids = _unit(_matrix(b.column("v"), b.num_rows)), b.column("id").to_numpy()
                raw = pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())
                for i, place in enumerate(c.places(x, ids)):
                    reach = c.half if side == 0 else 0
                    for step in range(-reach, reach + 1):
                        ok = (place + step >= 0) & (place + step < c.blocks)
                        m = int(ok.sum())
                        if m:
                            mask = pa.array(ok)
                            yield pa.RecordBatch.from_pydict({"block": pa.array(i * c.blocks + place[ok] + step, pa.int32()), "side": pa.array(np.full(m, side), pa.int32()), "id": b.column("id").filter(mask), "v": raw.filter(mask)})

    index = mapped(part.select(F.col("rep").alias("id"), "v"), lambda b: deal(b, 1), schema)
    asks = mapped(ask.select(F.col("ask").alias("id"), "v"), lambda b: deal(b, 0), schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, best = None, [], None
        for batch in batches:  # sorted: a block's queries come before its rows of the index
            place = batch.column("block").to_numpy().astype(np.int64) * 2 + batch.column("side").to_numpy()
            cut = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else []
            for a, b in zip(cut, [*cut[1:], len(place)], strict=True):
                block, side = divmod(int(place[a]), 2)
                if block != now:
                    if best is not None:
                        yield best.rows()
                    now, held, best = block, [], None
                ids, x = batch.column("id").slice(a, b - a).to_numpy(), _halves(batch.column("v").slice(a, b - a))
                if side == 0:
                    held.append((ids, x))
                elif held:
                    if best is None:
                        best = _Best(held, k + SPARE)
                    best.add(ids, x)
        if best is not None:
            yield best.rows()

    both = index.unionByName(asks)
    return mapped(both.repartitionByRange("block").sortWithinPartitions("block", "side"), search, "ask long, rep long, about float")


def _halves(column: pa.Array) -> np.ndarray:
    """Rows of a binary column of half-precision vectors, in single precision."""
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(np.float16).reshape(len(column), -1).astype(np.float32)


class _Best:
    """The ``many`` nearest rows of each query of a block, while rows stream by."""

    def __init__(self, held: list[tuple[np.ndarray, np.ndarray]], many: int):
        self.asks, self.x = (np.concatenate(c) for c in zip(*held, strict=True))
        self.score, self.ids, self.many = np.full((len(self.x), many), -2, np.float32), np.zeros((len(self.x), many), np.int64), many

    def add(self, ids: np.ndarray, y: np.ndarray) -> None:
        for a in range(0, len(self.x), 512):
            for b in range(0, len(y), 2048):
                k = slice(a, a + 512)
                s = self.x[k] @ y[b : b + 2048].T
                m = min(self.many, s.shape[1])
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                score = np.concatenate([self.score[k], np.take_along_axis(s, top, 1)], 1)
                keep = np.argpartition(-score, self.many - 1, axis=1)[:, : self.many]
                self.ids[k] = np.take_along_axis(np.concatenate([self.ids[k], ids[b : b + 2048][top]], 1), keep, 1)
                self.score[k] = np.take_along_axis(score, keep, 1)

    def rows(self) -> pa.RecordBatch:
        i, j = np.nonzero(self.score > -2)
        return pa.RecordBatch.from_pydict({"ask": pa.array(self.asks[i]), "rep": pa.array(self.ids[i, j]), "about": pa.array(self.score[i, j], pa.float32())})
