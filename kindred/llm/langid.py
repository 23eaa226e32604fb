"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of order 4 over lower-case letters; a run of other characters is one space.
All languages share sorted arrays of n-gram hashes, with a column of log2 probabilities for each
language, already interpolated; a second set of arrays has the contexts' back-off weights for n-grams
that no language has seen.  A text goes to the language of the lowest cross-entropy per character.
The score is the posterior at a temperature fitted on short pieces of texts kept out of the counts,
halved for each standard deviation beyond ``slack`` that the entropy lies above the language's usual
one; under ``reject`` the text counts as rejected.

Counts are fitted on a sample: in expectation at most ``per_language`` documents of each language, by
a hash of doc_id, beside at most ``held`` kept out.  These are one share of every language's sample,
large or small, and one document at least; a language with a single document has no usual entropy.
The fewer there are, the more their deviation follows that of all languages.  Prediction reads whole
texts only, in one pass without a shuffle.

``und``: null texts and texts without a letter (score 0).  Rows without a doc_id are left out; each
repeated row gets its own result.  Without any labelled text all are ``und``.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import U64, chunks, mapped, mix

ORDER = 4
_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Each code point's letter in lower case (16 bits; letters beyond share one), or a space."""
    if not _tables:
        t = np.full(0x110000, 32, U64)
        for i in range(0x110000):
            if (c := chr(i)).isalpha():
                low = c.lower()
                t[i] = min(ord(low[0]), 0xFFFF)
        _tables.append(t)
    return _tables[0]


def symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single spaces of a chunk's documents, each after ORDER - 1 spaces, and the offsets of the documents."""
    cps = _letters()[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)]
    at = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offs]
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    keep = np.ones(len(cps), bool)
    keep[1:] = (cps[1:] != 32) | (cps[:-1] != 32)
    keep[at[:-1][at[:-1] < len(cps)]] = True
    cps, doc = cps[keep], doc[keep]
    out = np.full(len(cps) + (len(offs) - 1) * (ORDER - 1), 32, U64)
    out[np.arange(len(cps)) + (doc + 1) * (ORDER - 1)] = cps
    return out, np.r_[0, np.cumsum(np.bincount(doc, minlength=len(offs) - 1) + ORDER - 1)]


def codes(syms: np.ndarray) -> np.ndarray:
    """The last ORDER symbols up to each place from ORDER - 1 on, 16 bits each, the last lowest."""
    out = syms[: len(syms) - ORDER + 1].copy()
    for i in range(1, ORDER):
        out = (out << U64(16)) | syms[i : len(syms) - ORDER + 1 + i]
    return out


class SortedHashes:
    """Rows of floats by 64-bit hash: a sorted array, entered by the hash's leading bits."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        h = mix(keys)
        order = np.argsort(h)
        self.keys, self.rows = np.r_[h[order], U64(0)], np.r_[rows[order], np.zeros((1, rows.shape[1]), rows.dtype)]
        bits = max(1, int(len(keys)).bit_length() + 1)
        self.shift = U64(64 - bits)
        self.first = np.searchsorted(h[order], np.arange(1 << bits, dtype=U64) << self.shift).astype(np.int64)
        self.most = int(np.diff(np.r_[self.first, len(keys)]).max(initial=0))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, found)."""
        h = mix(keys)
        at = self.first[(h >> self.shift).astype(np.int64)]
        got = self.keys[at] == h
        left = np.flatnonzero(~got)
        for _ in range(1, self.most):
            if not len(left):
                break
            at[left] = np.minimum(at[left] + 1, len(self.keys) - 1)
            ok = self.keys[at[left]] == h[left]
            got[left[ok]] = True
            left = left[~ok & (self.keys[at[left]] < h[left])]
        got &= at < len(self.keys) - 1
        return at, got


class Model:
    """All languages' models; ``counts`` has (codes, counts) of each."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        per = [self._levels(*counts[x]) for x in self.langs]
        self.temperature, self.usual = 1.0, {x: (0.0, 1e9) for x in self.langs}
        vocab = max(len({int(c) for p in per for c in p[1]["code"]}), 1) + 1
        self.grams, self.contexts = [], []
        for k in range(1, ORDER + 1):
            union = np.unique(np.concatenate([p[k]["code"] for p in per]))
            prob = np.stack([self._prob(p, k, union, vocab) for p in per], 1)
            self.grams.append(SortedHashes(union ^ U64(k << 60), np.log2(prob).astype(np.float32)))
            ctx = np.unique(np.concatenate([p[k]["ctx"] for p in per]))
            self.contexts.append(SortedHashes(ctx ^ U64(k << 60), np.stack([np.log2(self._back(p, k, ctx)) for p in per], 1).astype(np.float32)))
        self.floor = np.float32(-math.log2(vocab))

    @staticmethod
    def _levels(code: np.ndarray, count: np.ndarray) -> dict[int, dict]:
        """Counts at the highest order, continuation counts below."""
        out = {}
        for k in range(ORDER, 0, -1):
            order = np.argsort(code)
            code, count = code[order], count[order].astype(float)
            n1, n2 = (count == 1).sum(), (count == 2).sum()
            d = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.1), 0.95)
            ctx, inv = np.unique(code >> U64(16), return_inverse=True)
            out[k] = {"code": code, "count": count, "d": d, "ctx": ctx, "total": np.bincount(inv, count), "types": np.bincount(inv)}
            code, count = np.unique(code & U64((1 << 16 * (k - 1)) - 1), return_counts=True)
        return out

    @staticmethod
    def _at(keys: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return np.where(keys[i] == x, values[i], 0)

    def _back(self, p: dict, k: int, ctx: np.ndarray) -> np.ndarray:
        m = p[k]
        total = self._at(m["ctx"], m["total"], ctx)
        return np.where(total > 0, m["d"] * self._at(m["ctx"], m["types"], ctx) / np.maximum(total, 1), 1.0)

    def _prob(self, p: dict, k: int, code: np.ndarray, vocab: int) -> np.ndarray:
        low = np.full(len(code), 1 / vocab) if k == 1 else self._prob(p, k - 1, code & U64((1 << 16 * (k - 1)) - 1), vocab)
        m = p[k]
        total = self._at(m["ctx"], m["total"], code >> U64(16))
        seen = np.maximum(self._at(m["code"], m["count"], code) - m["d"], 0)
        return np.where(total > 0, seen / np.maximum(total, 1), 0) + self._back(p, k, code >> U64(16)) * low

    def log2(self, code: np.ndarray) -> np.ndarray:
        """A row of log2 probabilities of the last symbol for each code."""
        at, got = self.grams[-1].find(code ^ U64(ORDER << 60))
        out = self.grams[-1].rows[at]
        left = np.flatnonzero(~got)
        out[left] = 0
        for k in range(ORDER, 0, -1):
            if not len(left):
                break
            c = code[left] & U64((1 << 16 * k) - 1) if k < 4 else code[left]
            at, got = self.grams[k - 1].find(c ^ U64(k << 60))
            out[left[got]] += self.grams[k - 1].rows[at[got]]
            left, c = left[~got], c[~got]
            at, got = self.contexts[k - 1].find((c >> U64(16)) ^ U64(k << 60))
            out[left[got]] += self.contexts[k - 1].rows[at[got]]
        out[left] += self.floor
        return out

    def sums(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log2 probabilities by document and language, and the numbers of letters."""
        syms, at = symbols(data, offs)
        if len(syms) < ORDER:
            return np.zeros((len(offs) - 1, len(self.langs))), np.zeros(len(offs) - 1, np.int64)
        row = self.log2(codes(syms)).astype(np.float64)
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))[ORDER - 1 :]
        own = np.arange(len(row)) + ORDER - 1 >= at[doc] + ORDER - 1
        total = np.stack([np.bincount(doc[own], row[own, i], len(offs) - 1) for i in range(len(self.langs))], 1)
        return total, np.bincount(doc, syms[ORDER - 1 :] != 32, len(offs) - 1).astype(np.int64)

    def posterior(self, total: np.ndarray, letters: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, score, cross-entropy)."""
        best = total.argmax(1)
        n = np.maximum(letters, 1)
        entropy = -total.max(1) / n
        z = (total - total.max(1, keepdims=True)) * (self.temperature * math.log(2)) / np.sqrt(n)[:, None]
        usual = np.array([self.usual[x] for x in self.langs])[best]
        over = np.clip((entropy - usual[:, 0]) / usual[:, 1] - slack, 0, 60)
        return best, 1 / np.exp(z).sum(1) * 0.5**over, entropy


def fit(docs: DataFrame, train: Column, per_language: int = 3000, held: int = 250) -> Model | None:
    """A model of the languages of the rows where ``train`` holds; see the module for the sample."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("u", F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20)) / (1 << 20))
    many = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("u").alias("low"), F.max("u").alias("high")).collect()
    if not many:
        return None
    share = {r.lang: min(1.0, (per_language + held) / r.n) for r in many}
    # the row of the least u is always counted; where all rows are in the sample, that of the greatest is always held
    start = {r.lang: max(r.low + 2**-21, min(share[r.lang] * per_language / (per_language + held), r.high if share[r.lang] == 1 else 1.0)) for r in many}
    share, start = (F.create_map(*(F.lit(x) for kv in d.items() for x in kv))[F.col("lang")] for d in (share, start))
    sample = rows.where((F.col("u") < share) | (F.col("u") < start)).select("lang", "text", (F.col("u") >= start).alias("held"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), object)
            for part, data, offs in chunks(batch):
                syms, at = symbols(data, offs)
                if len(syms) < ORDER:
                    continue
                code = codes(syms)
                doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))[ORDER - 1 :]
                ok = np.arange(len(code)) + ORDER - 1 >= at[doc] + ORDER - 1
                for x in set(lang[part]):
                    c, n = np.unique(code[ok & (lang[part] == x)[doc]], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([x] * len(c), pa.string()), "code": pa.array(c.view(np.int64)), "n": pa.array(n, pa.int64())})

    got = mapped(sample.where("not held"), count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    if not len(got):
        return None
    model = Model({x: (g["code"].to_numpy().view(U64), g["n"].to_numpy()) for x, g in got.groupby("lang")})
    pieces = sample.where("held").select("lang", F.substring("text", 1, 240).alias("text")).collect()  # about `held` for each language
    pieces = [(r.lang, r.text) for r in pieces if r.lang in model.langs and any(map(str.isalpha, r.text))]
    if pieces:
        def run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            raw = [t.encode() for t in texts]
            return model.sums(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])

        truth = np.array([model.langs.index(x) for x, _ in pieces])
        total, n = run([t for _, t in pieces])
        entropy = -total[np.arange(len(truth)), truth] / np.maximum(n, 1)
        many = np.bincount(truth, minlength=len(model.langs))
        mean = np.bincount(truth, entropy, len(model.langs)) / np.maximum(many, 1)
        apart = np.bincount(truth, (entropy - mean[truth]) ** 2, len(model.langs))
        every = apart.sum() / max(1, (many - 1).clip(0).sum())
        for i, x in enumerate(model.langs):
            if many[i]:
                model.usual[x] = (float(mean[i]), max(0.05, math.sqrt((apart[i] + 5 * every) / (many[i] + 5) * (1 + 1 / many[i]))))
        short = [(i, t[:m]) for m in (6, 12, 24, 48) for i, (_, t) in zip(truth, pieces, strict=True) if any(map(str.isalpha, t[:m]))]
        total, n = run([t for _, t in short])
        who = np.array([i for i, _ in short])

        def loss(temperature: float) -> float:
            z = (total - total.max(1, keepdims=True)) * (temperature * math.log(2)) / np.sqrt(np.maximum(n, 1))[:, None]
            return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(who)), who]).mean())

        model.temperature = min((0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0), key=loss)
    return model


def predict(docs: DataFrame, model: Model | None, slack: float = 6.0, reject: float = 0.3) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy (bits a letter, null for und), rejected."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.langs, "und"], object)
        for batch in batches:
            for part, data, offs in chunks(batch, 1 << 19):
                total, letters = m.sums(data, offs)
                best, score, entropy = m.posterior(total, letters, slack)
                none = letters == 0
                score = np.where(none, 0.0, score)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part.start : part.stop], pa.array(names[np.where(none, len(m.langs), best)], pa.string()), pa.array(score), pa.array(entropy, mask=none), pa.array(score < reject)], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return mapped(docs, each, schema)
