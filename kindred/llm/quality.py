"""Quality classifier from weak labels.

Heuristic labellers vote good, junk or nothing on each document.  Expectation-maximisation estimates
from all documents' votes how often each labeller errs on either class (the votes of all
documents are counted by pattern; there are at most 3^labellers patterns).  The posterior of a pattern
is the soft label that trains a linear scorer on hashed words, word shapes and repetitions.

Estimation covers every document.  The scorer is fitted on a sample: in expectation at most
``fit_rows`` documents, by a hash of doc_id.  Scoring is one pass without a shuffle.

Null texts and texts without a word score 0.  Rows without a doc_id are left out; repeated rows are
each scored.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import U64, chunks, mapped, mix, word_hashes, words_in

BITS = 16
SHORT = 24  # texts of fewer words count as this long, so that a few words say little
#: Byte classes of a word's shape: letters (all bytes from 128 on are), digits; the rest stand for themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[np.r_[65:91, 97:123, 128:256]] = ord("a")
SHAPE[48:58] = ord("0")
_USUAL = np.zeros(256, bool)  # signs of usual prose
_USUAL[[ord(c) for c in " .,;:!?'\"()-\n\r\t"]] = True
#: Labellers: name, junk above (or below, if the first bound is less), good on the other side of the second bound.
LABELLERS = (("signs", 0.05, 0.01), ("bare", 0.10, 0.02), ("letters", 0.72, 0.88), ("repeats", 0.20, 0.05), ("variety", 0.30, 0.45), ("short_words", 0.04, 0.12), ("word_length", 14.0, 10.0))


def measures(data: np.ndarray, offs: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of the labellers' measures for each document, and its number of words."""
    n = len(offs) - 1
    per = np.repeat(np.arange(n), np.diff(offs))
    count = lambda d, w=None: np.bincount(d, w, n).astype(float)
    words = np.maximum(count(doc), 1)
    shape = SHAPE[data]
    letter, digit = shape == ord("a"), shape == ord("0")
    dark = np.maximum(count(per, ~_USUAL[data]), 1)
    size = end - start
    inside = np.r_[0, np.cumsum(letter | digit)]
    bare = inside[end] == inside[start]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((h, doc))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    variety = count(doc[order], fresh) / np.sqrt(words * np.minimum(words, 400))  # long texts repeat words
    return np.stack([count(per, ~letter & ~digit & ~_USUAL[data]) / np.maximum(count(per), 1), count(doc, bare) / words, count(per, letter) / dark, count(doc, again) / words, variety, count(doc, size <= 3) / words, count(doc, size) / words], 1), count(doc).astype(np.int64)


def votes(m: np.ndarray, words: np.ndarray) -> np.ndarray:
    """0 nothing, 1 junk, 2 good; texts under 8 words get no votes but on signs."""
    out = np.zeros(m.shape, np.int64)
    for i, (name, junk, good) in enumerate(LABELLERS):
        x = m[:, i]
        bad, fine = (x > junk, x < good) if junk > good else (x < junk, x > good)
        out[:, i] = np.where(bad, 1, np.where(fine, 2, 0))
        if name != "signs":
            out[words < 8, i] = 0
    return out


def posteriors(pattern: np.ndarray, count: np.ndarray, rounds: int = 60, false_alarm: float = 0.002) -> np.ndarray:
    """P(good) of each vote pattern, by EM over the class and the error rates of votes given.

    Labellers look for different kinds of junk and the kinds rarely meet, so without more the classes
    might part one kind of junk from all else: a labeller's rate of junk votes on good documents is held
    at ``false_alarm`` or less, which is what its bounds were set for.
    """
    k = len(LABELLERS)
    v = pattern[:, None] // 3 ** np.arange(k) % 3
    share = ((v == 2).sum(1) - (v == 1).sum(1)) / k
    p = 1 / (1 + np.exp(-6 * share - 1))
    for _ in range(rounds):
        w = np.stack([count * (1 - p), count * p], 1)
        prior = (w.sum(0) + 1) / (w.sum() + 2)
        rate = np.stack([[(w * (v[:, [i]] == x)).sum(0) + 1 for x in (1, 2)] for i in range(k)])
        rate = rate / rate.sum(1, keepdims=True)
        rate[:, 0, 1] = np.minimum(rate[:, 0, 1], false_alarm)
        rate = np.concatenate([np.ones_like(rate[:, :1]), rate], 1)  # no vote says nothing
        log = np.log(prior) + sum(np.log(rate[i, v[:, i]]) for i in range(k))
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))
    return p


def parts(data: np.ndarray, offs: np.ndarray) -> tuple:
    """(hashed features of each word: its own, its shape's, repetition; document of each word; votes; words)."""
    start, end, doc = words_in(data, offs)
    h = word_hashes(data, start, end)
    m, n = measures(data, offs, start, end, doc, h)
    shape = SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[start] = True
    at = np.r_[0, np.cumsum(keep)]
    s = word_hashes(shape[keep], at[start], at[end]) if len(start) else h
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    low = U64((1 << BITS) - 1)
    f = np.stack([np.maximum((h >> U64(20)) & low, U64(3)), np.maximum((mix(s + U64(7)) >> U64(20)) & low, U64(3)), np.where(again, U64(1), U64(2))], 1).astype(np.int64)
    return f, doc, votes(m, n), n


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, f: np.ndarray, doc: np.ndarray, words: np.ndarray) -> np.ndarray:
        z = np.bincount(doc, self.weights[f].sum(1), len(words)) / np.maximum(words, SHORT) + self.bias
        z = z + self.weights[0] * np.maximum(SHORT - words, 0) / SHORT  # feature 0: how much of a short text is missing
        return np.where(words > 0, 1 / (1 + np.exp(-np.clip(z, -60, 60))), 0.0)


def train(docs: DataFrame, fit_rows: int = 5000, epochs: int = 30) -> Scorer:
    """Counts the votes of all documents, estimates, and fits the scorer."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            for _, data, offs in chunks(batch):
                start, end, doc = words_in(data, offs)
                m, n = measures(data, offs, start, end, doc, word_hashes(data, start, end))
                total += np.bincount(votes(m, n)[n > 0] @ 3 ** np.arange(len(LABELLERS)), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(at, pa.int32()), "n": pa.array(total[at])})

    got = mapped(rows, count, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas()  # at most 3^7 rows
    if not len(got):
        return Scorer(np.zeros(1 << BITS), 0.0)
    label = np.full(3 ** len(LABELLERS), 0.5)
    label[got["pattern"]] = posteriors(got["pattern"].to_numpy(np.int64), got["n"].to_numpy(float))
    share = min(1.0, fit_rows / max(1, int(got["n"].sum())))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offs in chunks(batch):
                f, doc, v, n = parts(data, offs)
                y = label[v @ 3 ** np.arange(len(LABELLERS))]
                cut = np.searchsorted(doc, np.arange(len(n) + 1))
                out = []
                for i in np.flatnonzero(n):
                    k, c = np.unique(np.r_[f[cut[i] : cut[i + 1]].ravel(), np.zeros(max(0, SHORT - n[i]), np.int64)], return_counts=True)
                    out.append((float(y[i]), k.astype(np.int32).tobytes(), (c / max(n[i], SHORT)).astype(np.float32).tobytes()))
                yield pa.RecordBatch.from_pydict({c: pa.array([x[j] for x in out], t) for j, (c, t) in enumerate((("y", pa.float64()), ("k", pa.binary()), ("x", pa.binary())))})

    part = rows.where(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 20)) < F.lit(share * (1 << 20)))
    data = mapped(part, sample, "y double, k binary, x binary").toPandas()  # about fit_rows sparse rows
    w, b = np.zeros(1 << BITS), 0.0
    if not len(data):
        return Scorer(w, b)
    k = np.concatenate([np.frombuffer(x, np.int32) for x in data["k"]]).astype(np.int64)
    x = np.concatenate([np.frombuffer(x, np.float32) for x in data["x"]]).astype(float)
    row = np.repeat(np.arange(len(data)), [len(v) // 4 for v in data["k"]])
    y = data["y"].to_numpy()
    weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))  # both classes weigh alike
    g2, gb = np.full(len(w), 1e-8), 1e-8
    for _ in range(epochs):  # AdaGrad on whole batches
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[k] * x, len(y)) + b, -60, 60)))
        e = (p - y) * weight
        g = np.bincount(k, e[row] * x, len(w)) + 1e-7 * w
        g2 += g * g
        gb += e.sum() ** 2
        w -= 0.5 * g / np.sqrt(g2) * (g != 0)
        b -= 0.5 * e.sum() / np.sqrt(gb)
    return Scorer(w, float(b))


def score(docs: DataFrame, scorer: Scorer, keep: float = 0.3) -> DataFrame:
    """doc_id, score (that it is good, 0 to 1), keep."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(scorer)  # 2^16 weights

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in chunks(batch):
                f, doc, _, n = parts(data, offs)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part.start : part.stop], pa.array(sent.value.score(f, doc, n))], ["doc_id", "score"])

    return mapped(rows, each, "doc_id long, score double").withColumn("keep", F.col("score") >= keep)


def kept(docs: DataFrame, scorer: Scorer, keep: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, with all their columns, in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in chunks(batch):
                f, doc, _, n = parts(data, offs)
                yield batch.slice(part.start, part.stop - part.start).filter(pa.array(sent.value.score(f, doc, n) >= keep))

    return mapped(docs.where("doc_id is not null"), each, docs.schema)
