"""Dense candidates: nearest pool vectors by inner product, exactly or over cells.

Exact search deals queries and pool to blocks and joins blocks of one country; a pair of blocks is a
task's work as a matrix product.  Cell search assigns pool vectors to centres fitted on a bounded
sample, and each query meets only the cells nearest to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALWAYS, MOST, HIGH = 3, 6, 0.93


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def kept(pairs: DataFrame, score: str = "cos_emb", digits: int = 5) -> DataFrame:
    """The three nearest, and up to six whose cosine is high."""
    pairs = pairs.withColumn(score, F.round(score, digits))
    rank = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc(score), "cand_id"))
    return pairs.withColumn("_r", rank).where((F.col("_r") <= ALWAYS) | ((F.col("_r") <= MOST) & (F.col(score) >= HIGH))).drop("_r")


def exact(queries: DataFrame, pool: DataFrame, block: int = 2048) -> DataFrame:
    """s1_id, cand_id, cos_emb over (entity_id, country, embedding); an equi-join on (country, pair of blocks)."""
    size = lambda df, name: df.groupBy("country").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    counts = size(queries, "nq").join(size(pool, "np"), "country")
    own = lambda n: F.pmod(F.xxhash64("entity_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side = lambda df, q, p, query: df.join(counts, "country").withColumns({"qb": q, "pb": p}).select("country", "qb", "pb", F.col("entity_id").alias("id"), "embedding", F.lit(query).alias("query"))
    rows = side(queries, own("nq"), every("np"), True).unionByName(side(pool, every("nq"), own("np"), False))
    return kept(_within(rows, ["country", "qb", "pb"]))


def _within(rows: DataFrame, keys: list[str]) -> DataFrame:
    def nearest(g: pd.DataFrame) -> pd.DataFrame:
        q, p = g[g["query"]], g[~g["query"]].sort_values("id")
        if q.empty or p.empty:
            return pd.DataFrame({"s1_id": pd.Series(dtype=str), "cand_id": pd.Series(dtype=str), "cos_emb": pd.Series(dtype=float)})
        x, y = (np.stack([np.asarray(v, np.float64) for v in s["embedding"]]) for s in (q, p))
        s = np.round(x @ y.T, 5)
        k = min(MOST, s.shape[1])
        cut = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
        i, j = np.nonzero(s >= cut)  # ties at the cut all go on to the exact ranking
        return pd.DataFrame({"s1_id": q["id"].to_numpy()[i], "cand_id": p["id"].to_numpy()[j], "cos_emb": s[i, j]})

    return rows.groupBy(*keys).applyInPandas(nearest, "s1_id string, cand_id string, cos_emb double").dropDuplicates(["s1_id", "cand_id"])


def cell_count(n: int) -> int:
    """Cells for a pool of n vectors: one for each 40, 64 to 2048."""
    return min(2048, max(64, n // 40))


def cells(queries: DataFrame, pool: DataFrame, count: int | None = None, probes: int | None = None, sample: int = 32, seed: int = 42) -> DataFrame:
    """As ``exact``, over the ``probes`` cells nearest to each query (12, and 64 at most, as the cells grow in number).

    Centres are fitted on about ``sample`` pool vectors for each cell, 65,536 at most.
    """
    n = pool.count()
    count = count or cell_count(n)
    probes = probes or min(64, max(12, count // 32))
    sample *= count
    part = pool.where(F.pmod(F.xxhash64(F.lit(seed), "entity_id"), F.lit(1 << 20)) < F.lit(min(1.0, sample / max(1, n)) * (1 << 20))).select("embedding").toPandas()
    if part.empty:
        return exact(queries, pool)
    x = np.stack([np.asarray(v, np.float64) for v in part["embedding"]])
    centres = x[np.random.default_rng(seed).permutation(len(x))[:count]].copy()
    for _ in range(10):  # Lloyd's iterations on the unit sphere
        near = np.concatenate([(part @ centres.T).argmax(1) for part in np.array_split(x, 1 + len(x) // 4096)])
        for c in range(len(centres)):
            if (near == c).any():
                m = x[near == c].mean(0)
                centres[c] = m / max(1e-12, np.linalg.norm(m))

    def assign(batches: Iterator[pd.DataFrame], many: int) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1024):
                some = b.iloc[at : at + 1024]
                s = np.stack([np.asarray(v, np.float64) for v in some["embedding"]]) @ centres.T
                near = np.argsort(-s, axis=1, kind="stable")[:, :many]
                out = some.loc[some.index.repeat(near.shape[1])].copy()
                out["cell"] = near.ravel().astype("int32")
                yield out

    schema = "id string, country string, embedding array<float>, query boolean, cell int"
    tag = lambda df, q: df.select(F.col("entity_id").alias("id"), "country", F.col("embedding").cast("array<float>").alias("embedding"), F.lit(q).alias("query"))
    q = tag(queries, True).mapInPandas(lambda b: assign(b, min(probes, len(centres))), schema)
    p = tag(pool, False).mapInPandas(lambda b: assign(b, 1), schema)
    return kept(_within(q.unionByName(p), ["country", "cell"]))


def encode(records: DataFrame, encoder, dims: int) -> DataFrame:
    """entity_id, embedding: ``encoder`` maps a list of texts to rows of floats; names go in as they are."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = np.asarray(encoder(b["text"].tolist()), np.float32).reshape(len(b), dims)
                yield pd.DataFrame({"entity_id": b["entity_id"], "embedding": list(v / np.maximum(1e-12, np.linalg.norm(v, axis=1, keepdims=True)))})

    text = F.concat(F.lit("query: "), F.trim("business_name"))
    return records.select("entity_id", text.alias("text")).mapInPandas(each, "entity_id string, embedding array<float>")


def merge(cands: DataFrame, dense: DataFrame) -> DataFrame:
    """Candidates with the dense channel's pairs and score; an earlier dense score is replaced."""
    from kindred.operators.candidates import union

    return union([cands.drop("cos_emb"), dense.select("s1_id", "cand_id", "cos_emb")])
