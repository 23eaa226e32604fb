"""Subword lattice likelihood: the probability of a text summed over all its segmentations.

A text is its words in order and one end.  A word, after a mark for its start, is a run of pieces of an
existing vocabulary (with single bytes for the rest), drawn independently; forward recursion in log
space over the lattice of pieces gives its probability over all segmentations.  A training word has
one arc more, over the whole word, with its discounted share of the training words; the discounts'
mass goes to the lattice of pieces.  The text's probability is the product over its words and the end,
so the model is a proper distribution over texts.  ``lattice_score`` leaves that arc out: the pieces of the
vocabulary alone weigh all segmentations.

The vocabulary and the order of its scores are given; expected counts over all segmentations (forward
and backward) of every different training word re-estimate the scores, ``rounds`` times.

1. Words are counted in packed blocks by hash (each different word once for each batch).
2. Words with at least 1/``common`` of all tokens, at most ``common`` by definition, are sent to every
   task with counts and likelihoods; a hot word is so never a shuffle key.
3. The rest travels as packed (document, word) blocks to the word's bucket, is scored there once for
   each different word, and returns as sums by document.

A very long word takes time and memory in proportion to its length; a very long text is a document's words
like any other.  Words are equal if their 64-bit hashes are.  Null texts are empty: one end.  Rows without a doc_id are
left out; rows that repeat a doc_id are scored together, with an end each.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import LOWER, U64, checkpointed, chunks, keyed, mapped, mix, packed, word_hashes, words_in

START = 32  # the byte that marks a word's start; no word has it
LN10 = float(np.log(10))


class Pieces:
    """A trie of pieces, and the log probability of each node's piece (-inf: none)."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        weight: dict[bytes, float] = {}
        for i in range(sp.get_piece_size()):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                raw = bytes([int(text[3:5], 16)])
            elif sp.is_control(i) or sp.is_unknown(i) or "▁" in text[1:] or any("A" <= c <= "Z" for c in text):
                continue
            else:
                raw = text.encode().replace("▁".encode(), bytes([START]))
            weight[raw] = weight.get(raw, 0) + 1 / (10 + max(0.0, -sp.get_score(i)))  # the given scores order pieces by rank
        for b in range(256):
            weight.setdefault(bytes([b]), 1e-4)
        nodes: list[dict[int, int]] = [{}, {}]  # 0: none, 1: the root
        ends: dict[int, float] = {}
        for raw, w in sorted(weight.items()):
            at = 1
            for b in raw:
                if b not in nodes[at]:
                    nodes[at][b] = len(nodes)
                    nodes.append({})
                at = nodes[at][b]
            ends[at] = w
        self.next = np.zeros((len(nodes), 256), np.int32 if len(nodes) > 65535 else np.uint16)
        for i, x in enumerate(nodes):
            for b, j in x.items():
                self.next[i, b] = j
        self.next = self.next.ravel()
        self.at = np.array(sorted(ends))
        self.count = len(nodes)
        self.initial = np.zeros(self.count, bool)  # nodes of pieces that start a word
        below = [nodes[1][START]]
        while below:
            i = below.pop()
            self.initial[i] = True
            below += nodes[i].values()
        self.words = (0, 0.0, 0.0)
        self.set(np.array([ends[i] for i in self.at]))

    def set(self, weights: np.ndarray) -> None:
        """Piece weights. With s the share of pieces that start words, a word's first piece has weight / s, and after
        each piece the word ends with probability s; so its probability is the product of its pieces' shares."""
        self.logp = np.full(self.count, -np.inf)
        self.logp[self.at] = np.log(weights / weights.sum())

    def learned(self, tokens: int, types: int, ends: int, discount: float = 0.6) -> None:
        """Numbers of training words, different ones, and texts."""
        self.words = (tokens, discount, types * discount / tokens if tokens else 1.0)
        self.more = float(np.log10((tokens + 0.5) / (tokens + ends + 1)))
        self.stop = float(np.log10((ends + 0.5) / (tokens + ends + 1)))

    def word_log10(self, lattice: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of one more word, from its ln probability over the pieces and its training count: with its own arc, and by the pieces alone."""
        tokens, discount, rest = self.words
        low = lattice / LN10 + np.log10(rest)
        with np.errstate(divide="ignore"):
            whole = np.log10(np.maximum(count - discount, 0) / max(tokens, 1))
        return self.more + np.logaddexp(low * LN10, whole * LN10) / LN10, self.more + lattice / LN10

    def arcs(self, w: np.ndarray, j: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(end, rows, nodes) of the pieces that start at byte j of the rows of a matrix of words."""
        rows, state = np.arange(len(w)), np.ones(len(w), np.int64)
        for i in range(j, w.shape[1]):
            state = self.next[(state << 8) | w[rows, i]].astype(np.int64)
            live = state > 0
            if not live.all():
                rows, state = rows[live], state[live]
                if not len(rows):
                    return
            piece = self.logp[state] > -np.inf
            if piece.any():
                yield i + 1, rows[piece], state[piece]

    def forward(self, w: np.ndarray) -> np.ndarray:
        a = np.full((w.shape[1] + 1, len(w)), -np.inf)
        a[0] = 0
        for j in range(w.shape[1]):
            for i, rows, node in self.arcs(w, j):
                a[i, rows] = np.logaddexp(a[i, rows], a[j, rows] + self.logp[node])
        return a

    def ln(self, w: np.ndarray) -> np.ndarray:
        """ln probability of each row of a matrix of words."""
        return np.array([self.alone(x)[0] for x in w]) if self._few(w) else self.forward(w)[-1]

    @staticmethod
    def _few(w: np.ndarray) -> bool:
        """Few long words go one by one, in time in proportion to their length."""
        return len(w) < 32 and w.shape[1] > 24

    def alone(self, w: np.ndarray, backward: bool = False) -> tuple[float, np.ndarray, np.ndarray]:
        """(ln probability, and if asked for the nodes of all arcs and their expected numbers) of one word of any length."""
        n = len(w)
        at, state, found = np.arange(n), np.ones(n, np.int64), []
        while len(at):  # the arcs of all starts, one byte longer each time
            i = at + len(found)
            at, state, i = at[i < n], state[i < n], i[i < n]
            state = self.next[(state << 8) | w[i]].astype(np.int64)
            live = state > 0
            at, state = at[live], state[live]
            found.append((at, state))
        start = np.concatenate([a[self.logp[s] > -np.inf] for a, s in found])
        node = np.concatenate([s[self.logp[s] > -np.inf] for _, s in found])
        end = np.concatenate([a[self.logp[s] > -np.inf] + d + 1 for d, (a, s) in enumerate(found)])
        forth = self._chain(n, start, end, self.logp[node])
        if not backward:
            return forth[n], node, np.zeros(0)
        back = self._chain(n, n - end, n - start, self.logp[node])
        return forth[n], node, np.exp(np.array(forth)[start] + self.logp[node] + np.array(back)[n - end] - forth[n])

    @staticmethod
    def _chain(n: int, start: np.ndarray, end: np.ndarray, logp: np.ndarray) -> list[float]:
        """ln of the sum over all chains of arcs from 0 to each place."""
        order = np.argsort(end, kind="stable")
        cut = np.searchsorted(end[order], np.arange(n + 2)).tolist()
        begin, p = start[order].tolist(), np.exp(logp[order]).tolist()
        out, value, shift = [0.0] * (n + 1), [0.0] * (n + 1), 0.0
        value[0], longest = 1.0, int((end - start).max(initial=1))
        for i in range(1, n + 1):
            x = 0.0
            for k in range(cut[i], cut[i + 1]):
                x += value[begin[k]] * p[k]
            if 0.0 < x < 1e-150:  # scaled up, with all places that are still in reach
                for j in range(max(0, i - longest), i):
                    value[j] *= 1e150
                x *= 1e150
                shift -= 150 * LN10
            value[i] = x
            out[i] = math.log(x) + shift if x > 0 else -math.inf
        return out

    def expected(self, w: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected numbers of the nodes' pieces in words that occur ``count`` times."""
        if self._few(w):
            out = np.zeros(self.count)
            for x, c in zip(w, count, strict=True):
                _, node, many = self.alone(x, True)
                out += np.bincount(node, many * c, self.count)
            return out
        a = self.forward(w)
        b = np.full(a.shape, -np.inf)
        b[-1] = 0
        out = np.zeros(self.count)
        for j in range(w.shape[1] - 1, -1, -1):
            for i, rows, node in self.arcs(w, j):
                x = self.logp[node] + b[i, rows]
                b[j, rows] = np.logaddexp(b[j, rows], x)
                out += np.bincount(node, np.exp(a[j, rows] + x - a[-1, rows]) * count[rows], self.count)
        return out


def by_length(size: np.ndarray, raw: np.ndarray, most: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which, matrix) of words of one length, each after the mark of a word's start."""
    at = np.cumsum(size) - size
    order = np.argsort(size, kind="stable")
    if not len(size):
        return
    cut = np.flatnonzero(np.r_[True, np.diff(size[order]) > 0])
    for a, b in zip(cut, [*cut[1:], len(size)], strict=True):
        n = int(size[order[a]])
        step = max(1, min(most, (1 << 22) // (n + 1)))
        for c in range(a, b, step):
            who = order[c : min(b, c + step)]
            w = np.full((len(who), n + 1), START, np.uint8)
            w[:, 1:] = raw[at[who][:, None] + np.arange(n)]
            yield who, w


def _distinct(h: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(hashes, counts, sizes, bytes, each word's index) of the different words."""
    names, first, inv = np.unique(h, return_index=True, return_inverse=True)
    size = (end - start)[first]
    cell = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return names, np.bincount(inv, count, len(names)).astype(np.int64), size.astype(np.int32), data[np.repeat(start[first], size) + cell], inv


def _word_bytes(size: np.ndarray, raw: np.ndarray, which: np.ndarray) -> np.ndarray:
    at = np.cumsum(size, dtype=np.int64) - size
    n = size[which]
    cell = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return raw[np.repeat(at[which], n) + cell]


def _dictionary(names: np.ndarray, count: np.ndarray, size: np.ndarray, raw: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """The words by bucket: (bucket, which, [hashes, counts, sizes, bytes])."""
    key = (names >> U64(40)) % U64(buckets)
    for k, (which,) in packed(key, [np.arange(len(names))]):
        who = np.frombuffer(which, np.int64)
        yield k, who, [names[who].tobytes(), count[who].tobytes(), size[who].tobytes(), _word_bytes(size, raw, who).tobytes()]


def _merged(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """The dictionaries of a bucket as one: (hashes, counts, sizes, bytes, index of each row's each word)."""
    h, n, size, raw = (np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in zip("hnsb", (U64, np.int64, np.int32, np.uint8), strict=True))
    names, first, inv = np.unique(h, return_index=True, return_inverse=True)
    return names, np.bincount(inv, n, len(names)).astype(np.int64), size[first], _word_bytes(size, raw, first), inv


def score(docs: DataFrame, train: Column, model_file: str | None = None, rounds: int = 3, common: int = 100_000) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, lattice_score (by the pieces alone); ``train`` marks the rows to learn from."""
    if model_file is None:
        import public_tokenizers

        model_file = public_tokenizers.path("piece_bpe_32k.model")
    spark = docs.sparkSession
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text", train.alias("train"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, ends, place = [], 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            names, n, size, raw, _ = _merged([dict(zip("hnsb", (x.tobytes() for x in g), strict=True)) for g in got])
            got.clear()
            rows = [(k, cols, 0) for k, _, cols in _dictionary(names, n, size, raw, buckets)] + [(place % buckets, [b""] * 4, ends)]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int32())} | {c: pa.array([r[1][i] for r in rows], pa.binary()) for i, c in enumerate("hnsb")} | {"ends": pa.array([r[2] for r in rows], pa.int64())})

        for batch in batches:
            learn = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            ends, place = ends + int(learn.sum()), place + batch.num_rows
            for part, data, offs in chunks(batch):
                data = LOWER[data]
                start, end, doc = words_in(data, offs)
                ok = learn[part][doc]
                start, end = start[ok], end[ok]
                got.append(_distinct(word_hashes(data, start, end), start, end, data)[:4])
            if sum(len(g[3]) for g in got) > 1 << 22:
                yield from out()
                ends = 0
        yield from out()

    def total(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        names, n, size, raw, _ = _merged(rows)
        yield pa.RecordBatch.from_pydict({c: pa.array([x.tobytes()], pa.binary()) for c, x in zip("hnsb", (names, n, size, raw), strict=True)} | {"ends": pa.array([sum(r["ends"] for r in rows)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64()), "types": pa.array([len(names)], pa.int64())})

    packed_words = "h binary, n binary, s binary, b binary, ends long"
    table = checkpointed(keyed(mapped(docs, count, "bucket int, " + packed_words), total, packed_words + ", tokens long, types long"))
    sums = table.agg(F.coalesce(F.sum("ends"), F.lit(0)).alias("ends"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first()
    n_all, n_ends = int(sums.tokens + sums.ends), int(sums.ends)
    norm = float(np.log10(n_all + 0.1 * (int(sums.types) + (n_ends > 0) + 1)))
    pieces = Pieces(model_file)

    for _ in range(rounds if sums.tokens else 0):
        sent = spark.sparkContext.broadcast(pieces)

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            out = np.zeros(sent.value.count)
            for batch in batches:
                for row in batch.to_pylist():
                    size, raw = (np.frombuffer(row[c], t) for c, t in zip("sb", (np.int32, np.uint8), strict=True))
                    for who, w in by_length(size, raw):  # each different word once, as each lends the lattice one discount
                        out += sent.value.expected(w, np.ones(len(who)))
            node = np.flatnonzero(out)
            yield pa.RecordBatch.from_pydict({"node": pa.array(node, pa.int32()), "n": pa.array(out[node])})

        got = mapped(table, expect, "node int, n double").groupBy("node").agg(F.sum("n").alias("n")).collect()  # at most a row for each piece
        weight = np.zeros(pieces.count)
        weight[[r.node for r in got]] = [r.n for r in got]
        pieces.set(weight[pieces.at] + 0.01)

    pieces.learned(int(sums.tokens), int(sums.types), n_ends)
    sent = spark.sparkContext.broadcast(pieces)
    least = max(1, -(-int(sums.tokens) // common))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, n, size, raw = (np.frombuffer(row[c], t) for c, t in zip("hnsb", (U64, np.int64, np.int32, np.uint8), strict=True))
                many = np.flatnonzero(n >= least)
                lm, sub = likelihoods(sent.value, size[many], _word_bytes(size, raw, many), n[many])
                yield pa.RecordBatch.from_pydict({"h": pa.array(h[many].view(np.int64)), "n": pa.array(n[many]), "lm": pa.array(lm), "sub": pa.array(sub)})

    top = mapped(table, frequent, "h long, n long, lm double, sub double").toPandas()  # at most `common` rows
    order = np.argsort(top["h"].to_numpy(np.int64).view(U64))
    known = spark.sparkContext.broadcast((top["h"].to_numpy(np.int64).view(U64)[order], *(top[c].to_numpy()[order] for c in ("n", "lm", "sub"))))
    end_base, end_lm = float(np.log10(n_ends + 0.1)), pieces.stop

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By bucket, sums over the documents' frequent words, and their rare words."""
        hot, hot_n, hot_lm, hot_sub = known.value
        hot_base = np.log10(hot_n + 0.1)
        every, rare = [], []

        def sums() -> Iterator[pa.RecordBatch]:
            own = [np.concatenate(x).astype(np.float64 if i > 2 else np.int64) for i, x in enumerate(zip(*every, strict=True))]
            every.clear()
            if own:
                yield _batch([(k, [b""] * 4, x, 0) for k, x in packed(mix(own[0].view(U64)) % U64(buckets), own)])

        for batch in batches:
            ids, learn = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            for part, data, offs in chunks(batch):
                data, m = LOWER[data], len(offs) - 1
                start, end, doc = words_in(data, offs)
                h = word_hashes(data, start, end)
                at = np.minimum(np.searchsorted(hot, h), max(len(hot) - 1, 0))
                is_hot = hot[at] == h if len(hot) else np.zeros(len(h), bool)
                d, w = doc[is_hot], at[is_hot]
                every.append([ids[part], np.bincount(doc, minlength=m) + 1, np.bincount(d, minlength=m) + (n_ends > 0), np.bincount(d, hot_base[w], m) + end_base, np.bincount(d, hot_lm[w], m) + end_lm, np.bincount(d, hot_sub[w], m) + end_lm])
                h, size = h[~is_hot], (end - start)[~is_hot]
                cell = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                doc = doc[~is_hot] + part.start
                rare.append((ids[doc], learn[doc], h, size, data[np.repeat(start[~is_hot], size) + cell]))
                if sum(len(x[4]) for x in rare) > 1 << 21:
                    yield others(rare)
            if sum(len(x[0]) for x in every) > 1 << 14:
                yield from sums()
        yield from sums()
        if rare:
            yield others(rare)

    def others(rare: list[tuple]) -> pa.RecordBatch:
        names_of, learn, h, size, data = (np.concatenate(x) for x in zip(*rare, strict=True))
        rare.clear()
        ids, doc = np.unique(names_of, return_inverse=True)
        start = np.cumsum(size) - size
        rows = []
        names, n, size, raw, inv = _distinct(h, start, start + size, data, learn.astype(float))
        pair, times = np.unique(doc.astype(np.int64) * (len(names) + 1) + inv, return_counts=True)
        p_doc, p_word = pair // (len(names) + 1), pair % (len(names) + 1)
        p_key = ((names >> U64(40)) % U64(buckets))[p_word]
        place, words = np.empty(len(names), np.int64), {}
        for k, who, cols in _dictionary(names, n, size, raw, buckets):
            place[who] = np.arange(len(who))
            words[k] = cols
        order = np.argsort(p_key, kind="stable")
        cut = np.searchsorted(p_key[order], np.arange(buckets + 1))
        for k, cols in words.items():
            who = order[cut[k] : cut[k + 1]]
            docs_, per = np.unique(p_doc[who], return_counts=True)  # who is in order of documents
            wide = np.uint16 if len(cols[0]) < 8 * 65536 else np.uint32
            rows.append((k, cols, [ids[docs_].tobytes(), per.astype(np.int32).tobytes(), place[p_word[who]].astype(wide).tobytes(), times[who].astype(np.int32).tobytes(), b"", b""], np.dtype(wide).itemsize))
        return _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int32()), "wide": pa.array([r[3] for r in rows], pa.int32())} | {c: pa.array([r[1][i] for r in rows], pa.binary()) for i, c in enumerate("hnsb")} | {c: pa.array([r[2][i] for r in rows], pa.binary()) for i, c in enumerate("vwxyzu")})

    def meet(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        own = [np.frombuffer(b"".join(r[c] for r in rows if not r["wide"]), np.float64 if i > 2 else np.int64) for i, c in enumerate("vwxyzu")]
        rows = [r for r in rows if r["wide"]]
        if rows:
            _, n, size, raw, inv = _merged(rows)
            lm, sub = likelihoods(sent.value, size, raw, n)
            base, seen = np.log10(n + 0.1), n > 0
            begin = np.cumsum([0] + [len(r["h"]) // 8 for r in rows])
            for r, at in zip(rows, begin, strict=False):
                word = inv[at + np.frombuffer(r["x"], np.uint16 if r["wide"] == 2 else np.uint32).astype(np.int64)]
                times = np.frombuffer(r["y"], np.int32)
                doc = np.repeat(np.arange(len(r["v"]) // 8), np.frombuffer(r["w"], np.int32))
                m = len(r["v"]) // 8
                more = [np.frombuffer(r["v"], np.int64), np.zeros(m, np.int64), np.bincount(doc, times * seen[word], m).astype(np.int64), np.bincount(doc, times * base[word], m), np.bincount(doc, times * lm[word], m), np.bincount(doc, times * sub[word], m)]
                own = [x if isinstance(x, list) else [x] for x in own]
                for x, y in zip(own, more, strict=True):
                    x.append(y)
            own = [np.concatenate(x) for x in own]
            ids, inv = np.unique(own[0], return_inverse=True)
            own = [ids] + [np.bincount(inv, x, len(ids)).astype(np.float64 if i > 1 else np.int64) for i, x in enumerate(own[1:])]
        yield pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in zip(("doc_id", "n_tokens", "n_known", "base", "lm", "sub"), own, strict=True)})

    parts = keyed(mapped(docs, emit, "bucket int, wide int, h binary, n binary, s binary, b binary, v binary, w binary, x binary, y binary, z binary, u binary"), meet, "doc_id long, n_tokens long, n_known long, base double, lm double, sub double")
    out = parts.groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "lm", "sub")))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * norm).alias("base_score"), F.col("lm").alias("score"), F.col("sub").alias("lattice_score"))


def likelihoods(pieces: Pieces, size: np.ndarray, raw: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probabilities of each word, given how often it occurs in training texts; see ``word_log10``."""
    out = np.zeros(len(size))
    for who, w in by_length(size, raw):
        out[who] = pieces.ln(w)
    return pieces.word_log10(out, count)
