"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding maps letters to lower case without accents, homoglyphs of other scripts and digit or sign
substitutions to the letters they stand for, and all else to single spaces.  Entries are whole folded
words, and beginnings of words; both learn their weights, log odds of the labels, from a sample of
labelled texts.  Matches inside an exception phrase don't count.  The sum of the matched weights, and
that sum divided by the text's length, enter a logistic score fitted on the same sample.

The sample has in expectation at most ``fit_rows`` labelled documents, by a hash of doc_id.  Of equal
folded texts with one label one stays, and of near copies with one label: those that agree in all
``HASHES`` minimum hashes of one of ``BANDS`` bands, over pairs of neighbouring words.  An entry needs ``least`` toxic documents,
or ``share`` of them if that is more, and the heaviest ``entries`` of them make the lexicon; a beginning also needs three different words in toxic documents
and half a unit more, as it reaches words that were never seen.  Scoring reads whole texts in one pass without a shuffle.

A very long text is folded and matched as a whole by one task, in time and memory in proportion to its
length.  Null and empty texts have no match and the score of one.  Without labels of both kinds the lexicon is
empty and every score is 0.  Rows without a doc_id are left out; repeated rows are each scored.  Other
columns are ignored.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import U64, checkpointed, chunks, gram_hashes, mapped, mix, word_hashes, words_in

# Characters that look like a Latin letter (Cyrillic, Greek), and substitutions within words.
LOOKS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
#: Phrases in which a usual entry is harmless.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "trash collection", "clown fish", "clown nose", "pathetic fallacy", "worthless check", "pond scum", "soap scum")
BANDS, HASHES = 3, 5
_memo: dict[object, object] = {}


def _fold_table() -> np.ndarray:
    """Each code point's folded character; 0 drops it (joiners and marks)."""
    if "fold" not in _memo:
        t = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c in DIGITS or c.lower() in LOOKS:
                t[i] = ord(DIGITS.get(c) or LOOKS[c.lower()])
            elif unicodedata.category(c) in ("Mn", "Cf", "Me"):
                t[i] = 0
            elif c.isalpha():
                base = unicodedata.normalize("NFKD", c.lower())[0]
                t[i] = ord(LOOKS.get(base, base)) if base.isalpha() else 32
            elif c.isdigit():
                t[i] = ord(DIGITS.get(str(unicodedata.digit(c, 2)), "z"))
        _memo["fold"] = t
    return _memo["fold"]


def fold(data: np.ndarray, offs: np.ndarray) -> Iterator[str]:
    """The documents' folded texts, each between two spaces."""
    cps = _fold_table()[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)]
    at = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offs]
    keep = cps != 0
    at, cps = np.r_[0, np.cumsum(keep)][at], cps[keep]
    keep = np.ones(len(cps), bool)
    keep[1:] = (cps[1:] != 32) | (cps[:-1] != 32)
    at = np.r_[0, np.cumsum(keep)][at]
    text = cps[keep].astype("<u4").tobytes().decode("utf-32-le")
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield f" {text[a:b].strip()} "


def fold_text(text: str | None) -> str:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return next(fold(raw, np.array([0, len(raw)])))


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, logistic: tuple[float, ...] | None = None):
        self.weights, self.exceptions, self.logistic = weights, exceptions, logistic

    def automaton(self):
        """Aho-Corasick over entries (which begin with a space, whole words also end with one) and exceptions."""
        key = (len(self.weights), hash(tuple(sorted(self.weights.items()))), self.exceptions)
        if key not in _memo:
            import ahocorasick

            a = ahocorasick.Automaton()
            for w, x in self.weights.items():
                a.add_word(w, (len(w), x))
            for phrase in self.exceptions:
                w = fold_text(phrase)
                a.add_word(w, (len(w), None))
            if len(a):
                a.make_automaton()
            _memo[key] = a
        return _memo[key]

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight): the heaviest entry at each word, outside exceptions."""
        a = self.automaton()
        if not len(a):
            return []
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, x) in a.iter(folded):
            start = end - n + 1
            if x is None:
                spared.append((start, end))
            elif start not in best or x > best[start][1]:
                best[start] = (end, x)
        if not spared:
            return [(s, e, x) for s, (e, x) in best.items()]
        spared.sort()
        starts, reach = [p for p, _ in spared], list(accumulate((q for _, q in spared), max))  # the furthest end of phrases that start so early
        return [(s, e, x) for s, (e, x) in best.items() if not (i := bisect_right(starts, s)) or reach[i - 1] < e]

    def features(self, folded: str) -> tuple[float, float, int]:
        """(log of the weight, log of the weight per 100 characters, matches)."""
        got = self.matches(folded)
        w = sum(x for _, _, x in got)
        return float(np.log1p(w)), float(np.log1p(100 * w / max(20, len(folded) - 2))), len(got)


def _entries(folded: str) -> set[str]:
    """What may become an entry: whole words, and beginnings of longer ones."""
    words = {w for w in folded.split() if len(w) >= 3}
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in (4, 5, 6, 7) if len(w) > n}


def _bands(folded: str) -> list[int]:
    """A key for each band: its minimum hashes over pairs of neighbouring words, or a hash of a shorter text."""
    data = np.frombuffer(folded.encode(), np.uint8)
    start, end, _ = words_in(data, np.array([0, len(data)]))
    h = word_hashes(data, start, end)
    h = gram_hashes(h, 2) if len(h) > 1 else h if len(h) else np.zeros(1, U64)
    least = np.array([mix(h ^ x).min() for x in mix(np.arange(1, BANDS * HASHES + 1, dtype=U64))], U64).reshape(BANDS, HASHES)
    key = least[:, 0]
    for i in range(1, HASHES):
        key = mix(key * U64(0xD6E8FEB86659FD93) + least[:, i])
    return key.view(np.int64).tolist()


def fit(docs: DataFrame, labels: DataFrame, train: Column, fit_rows: int = 12000, least: int = 3, share: float = 0.01, log_odds: float = 4.0, entries: int = 5000, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from ``labels`` (doc_id, toxic) of the rows where ``train`` holds."""
    spark = docs.sparkSession
    empty = Lexicon({}, exceptions)
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("y")).where(train)
    n = labels.count()
    if not n:
        return empty
    labels = labels.where(F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 20)) < F.lit(min(1.0, fit_rows / n) * (1 << 20))).groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null").join(F.broadcast(labels), "doc_id")  # at most about fit_rows ids

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in chunks(batch):
                got = list(fold(data, offs))
                keys = np.array([_bands(t) for t in got], np.int64).reshape(-1, BANDS)
                yield pa.RecordBatch.from_arrays([batch.column("y")[part.start : part.stop], pa.array(got), *map(pa.array, keys.T)], ["y", "folded", *bands])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("folded"), pa.array([sorted(_entries(t)) for t in batch.column("folded").to_pylist()], pa.list_(pa.string()))], ["y", "folded", "entries"])

    spread = spark.sparkContext.defaultParallelism
    bands = [f"b{i}" for i in range(BANDS)]
    sample = mapped(rows, texts, "y int, folded string, " + ", ".join(f"{b} long" for b in bands))
    for b in bands:  # equal texts agree in the first
        others = ["folded", *(x for x in bands if x != b)]
        sample = sample.groupBy("y", b).agg(F.min_by(F.struct(*others), F.struct(F.xxhash64("folded"), "folded")).alias("r")).select("y", b, "r.*")
    sample = checkpointed(mapped(sample.select("y", "folded").repartition(spread), words, "y int, folded string, entries array<string>"))  # at most about fit_rows rows
    many = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = many.get(1, 0), sum(v for k, v in many.items() if k != 1)
    if not pos or not neg:
        return empty
    def learned(part: DataFrame, pos: int, neg: int) -> Lexicon:
        counts = part.select("y", F.explode("entries").alias("e")).groupBy("e").agg(F.sum((F.col("y") == 1).cast("long")).alias("p"), F.sum((F.col("y") != 1).cast("long")).alias("q"))
        weight = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("q") + 0.5) / (neg + 1))
        words_of = part.where("y = 1").select(F.explode(F.filter("entries", lambda e: F.endswith(e, F.lit(" ")))).alias("e")).distinct()
        types = words_of.select(F.explode(F.transform(F.sequence(F.lit(5), F.lit(8)), lambda n: F.substr("e", F.lit(1), n))).alias("e")).groupBy("e").agg(F.count("*").alias("types"))
        counts = counts.where(F.col("p") >= max(least, round(share * pos))).withColumn("w", weight).join(types, "e", "left")
        whole = F.endswith("e", F.lit(" "))
        got = counts.where((F.col("w") >= log_odds) & (whole | ((F.col("w") >= log_odds + 0.5) & (F.col("types") >= 3)))).orderBy(F.desc("w"), F.desc("p"), "e").limit(entries).collect()
        return Lexicon({r.e: float(r.w) for r in got}, exceptions)

    # the score is fitted on one half with the entries of the other, so that entries' weights are not trusted too far
    half = F.pmod(F.xxhash64("folded"), F.lit(2))
    sizes = {(r.h, r.y): r.n for r in sample.groupBy(half.alias("h"), F.when(F.col("y") == 1, 1).otherwise(0).alias("y")).agg(F.count("*").alias("n")).collect()}
    lexicon, first = learned(sample, pos, neg), learned(sample.where(half == 0), sizes.get((0, 1), 0), sizes.get((0, 0), 0))

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [first.features(t)[:2] for t in batch.column("folded").to_pylist()]
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "a": pa.array([x for x, _ in f], pa.float64()), "b": pa.array([x for _, x in f], pa.float64())})

    fitted = mapped(sample.where(half == 1).select("y", "folded"), points, "y int, a double, b double").groupBy("y", "a", "b").agg(F.count("*").alias("n")).toPandas()  # at most about fit_rows rows
    x = np.c_[np.ones(len(fitted)), fitted["a"], fitted["b"]]
    y, n = (fitted["y"] == 1).to_numpy(float), fitted["n"].to_numpy(float)
    n = n / max(1.0, n.sum())
    beta = np.zeros(3)
    for _ in range(50):  # Newton steps of a penalised logistic regression
        p = 1 / (1 + np.exp(-(x @ beta)))
        ridge = np.diag([1e-6, 1e-4, 1e-4])
        beta += np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + ridge, x.T @ (n * (y - p)) - ridge @ beta)
    lexicon.logistic = tuple(map(float, beta))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, n_matches, spans (start, end in the folded text, weight)."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most `entries` entries

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = sent.value
        for batch in batches:
            for part, data, offs in chunks(batch):
                out = []
                for text in fold(data, offs):
                    got = lex.matches(text)
                    w = sum(x for _, _, x in got)
                    z = (1.0, np.log1p(w), np.log1p(100 * w / max(20, len(text) - 2)))
                    out.append((float(1 / (1 + np.exp(-np.dot(lex.logistic, z)))) if lex.logistic else 0.0, len(got), [{"start": s, "end": e, "weight": x} for s, e, x in got]))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part.start : part.stop], pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())])))], ["doc_id", "score", "n_matches", "spans"])

    return mapped(docs, each, "doc_id long, score double, n_matches int, spans array<struct<start:int,end:int,weight:double>>")
