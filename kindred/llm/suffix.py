"""Exact substring dedup: bytes inside a string of ``length`` bytes that also starts earlier are removed.

Suffixes are sorted blockwise with a sparse cover of sample positions, as in difference-cover
construction, but with the sample chosen by content so that it synchronises all occurrences:

* Every window of ``length`` bytes selects one k-byte string in it (the leftmost least hash), so
  equal windows select the same string at the same place.  The selected positions are the sample,
  about one in (length - k) / 2.  The windows that select one position are neighbours: a *span*.
* Suffix buckets are keyed by the hash of the selected string.  A bucket with one occurrence has no
  repeats; of the others, the spans' bytes go to the bucket, each different span once for each run
  of documents, with its first occurrence there (all later ones are repeats as a whole).
* Buckets are sorted one at a time.  Sorting their whole spans leaves the first of each different one;
  these are sorted one window place at a time.  A comparison reads ``PERIOD`` bytes and the rank of one
  cover-sample position, whose strings of length - PERIOD bytes were ranked before, once for the whole
  bucket; so ties longer than PERIOD cost one lookup, and memory is bounded by a bucket's samples.  As
  buckets are aligned at their selected string, one residue for each period covers all differences.

What is removed was compared byte by byte: the hash only decides which spans meet, so a hash that is
equal by chance removes nothing.

Repeats are judged on the input; the first occurrence (smallest doc_id, then start) stays.  Matches
never cross documents.  Null texts are empty.  Rows without a doc_id are left out; of rows that repeat
a doc_id the one with the smallest text counts.  Bytes that remain may cut a character in two: ``kept``
is binary.  A very long text is hashed in parts and cut as a whole by one task, in memory in proportion
to its length.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import _TABLE, U64, buckets_of, chunks, keyed, mapped, mix, opened, packed, squeezed

GRAM = 32
PERIOD = 32
_PLACE = 26  # bits of a place in a run of documents
_PART = 1 << 25
_A, _B = U64(0x9FB21C651E98DF25), U64(0xD6E8FEB86659FD93)


def _join(x: np.ndarray, w: int) -> np.ndarray:
    """Hashes of 2w bytes from those of w bytes."""
    y = x[w:]
    out = x[:-w] * _A
    out ^= out >> U64(29)
    out += y * _B
    out ^= out >> U64(32)
    return out


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours."""
    out, have = x, 1
    while have * 2 <= w:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[: len(out) - (w - have)], out[w - have :]) if w > have else out


def spans(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, first start, number of starts, place of the selected string after the first start, its hash)."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U64))
    if len(data) < length:
        return none
    if len(data) > _PART:  # one very long document, in parts; a part's last windows reach into the next
        got = [(p, spans(data[p : p + _PART // 2 + length - 1], np.array([0, min(_PART // 2 + length - 1, len(data) - p)]), length)) for p in range(0, len(data), _PART // 2)]
        return tuple(np.concatenate([x[i] + p * (i == 1) for p, x in got]) if i < 4 else np.concatenate([x[i] for _, x in got]) for i in range(5))
    h = _TABLE[:256][data]
    for w in (1, 2, 4, 8, 16):
        h = _join(h, w)
    if GRAM != 32:
        raise ValueError("the string hashes are made by doubling to 32")
    low = U64((1 << _PLACE) - 1)
    order = (mix(h) & ~low) | np.arange(len(h), dtype=U64)
    pick = (_least(order, length - GRAM + 1) & low).astype(np.int64)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(pick)]
    start = np.flatnonzero(np.arange(len(pick)) + length <= offs[doc + 1])
    if not len(start):
        return none
    pick, doc = pick[start], doc[start]
    first = np.flatnonzero(np.r_[True, (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1])])
    many = np.diff(np.r_[first, len(start)])
    s = start[first]
    return doc[first], s - offs[doc[first]], many, pick[first] - s, mix(h[pick[first]])


def _ranks(c: np.ndarray) -> np.ndarray:
    """Dense rank of each row of a byte matrix."""
    c = np.ascontiguousarray(np.pad(c, ((0, 0), (0, -c.shape[1] % 8))))
    words = c.view(">u8")
    order = np.lexsort(words.T[::-1])
    w = words[order]
    out = np.empty(len(c), np.int64)
    out[order] = np.cumsum(np.r_[False, (w[1:] != w[:-1]).any(1)])
    return out


def sort_bucket(cls: np.ndarray, text: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, int]]:
    """(rows, place): windows that repeat an earlier one.  Row i's windows start at lo[i]..hi[i] of text[i], at byte at[i] of doc[i] for place 0."""
    width = text.shape[1] - length
    cover = list(range(0, width + PERIOD, PERIOD))
    text = np.pad(text, ((0, 0), (0, PERIOD)))
    rank = {c: _ranks(text[:, c : c + length - PERIOD]) for c in cover}
    for place in range(width + 1):
        rows = np.flatnonzero((lo <= place) & (place <= hi))
        if len(rows) < 2:
            continue
        c = -(-place // PERIOD) * PERIOD
        rest = np.ascontiguousarray(np.concatenate([text[rows, place:c], text[rows, c + length - PERIOD : place + length]], 1)).view(">u8")
        keys = [at[rows] + place, doc[rows], *rest.T, rank[c][rows], cls[rows]]
        order = np.lexsort(keys)
        same = np.ones(len(rows) - 1, bool)
        for k in keys[2:]:
            k = k[order]
            same &= k[1:] == k[:-1]
        if same.any():
            yield rows[order][1:][same], place


def repeated_bytes(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, text and ``runs``: the sorted maximal runs [start, end) of bytes to remove, as little-endian 64-bit pairs."""
    if not GRAM + PERIOD + 4 <= length <= 132:  # a span's number of starts and places fit in a byte
        raise ValueError("length must lie in 68..132")
    count, left = buckets_of(docs.sparkSession), length - GRAM
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").groupBy("doc_id").agg(F.min("text").alias("text"))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                doc, s, many, key = (np.concatenate(c) for c in zip(*held, strict=True))
                got = [(k, [x[0], *map(squeezed, x[1:])]) for k, x in packed(key % U64(count), [key, doc, s.astype(np.int32), many.astype(np.uint8)])]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([k for k, _ in got], pa.int32())} | {c: pa.array([x[i] for _, x in got], pa.binary()) for i, c in enumerate("abcd")})
                held.clear()

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for part, data, offs in chunks(batch):
                doc, s, many, _, key = spans(data, offs, length)
                held.append((ids[part][doc], s, many, key))
            if sum(len(x[0]) for x in held) > 1 << 18:
                yield from out()
        yield from out()

    def repeated(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        """The spans whose selected string has another occurrence."""
        key, doc, s, many = (np.frombuffer(b"".join(r[c] if c == "a" else opened(r[c]) for r in rows), t) for c, t in zip("abcd", (U64, np.int64, np.int32, np.uint8), strict=True))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        keep = order[np.r_[same, False] | np.r_[False, same]]
        for a in range(0, len(keep), 1 << 16):
            k = keep[a : a + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc[k]), "s": pa.array(s[k]), "many": pa.array(many[k].astype(np.int32)), "key": pa.array(key[k].view(np.int64))})

    marks = keyed(mapped(docs, select, "bucket int, a binary, b binary, c binary, d binary"), repeated, "doc_id long, s int, many int, key long")
    marks = marks.groupBy("doc_id").agg(F.collect_list(F.struct("s", "many", "key")).alias("marks"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By bucket, spans that differ among some batches, and (without bytes) runs that repeat an earlier span of these."""
        held: list[list[np.ndarray]] = []
        for batch in batches:
            for part, data, offs in chunks(batch):
                sub = batch.slice(part.start, part.stop - part.start)
                lists = sub.column("marks")
                flat = lists.flatten()
                size = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, int)
                doc = np.repeat(np.arange(len(sub)), size)
                s, many, key = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("s", "many", "key"))
                if len(s):
                    ids = sub.column("doc_id").to_numpy(zero_copy_only=False)[doc]
                    for a in range(0, len(s), 1 << 14):  # some MB of spans at a time
                        k = slice(a, a + (1 << 14))
                        held.append(_contexts(data, offs[doc[k]] + s[k], ids[k], s[k], many[k], key[k], length))
                        if sum(len(x[0]) for x in held) > 1 << 15:
                            yield from emit(held)
        yield from emit(held)

    def emit(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        key, ids, s, lo, many, text = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order, fresh = _sorted(key, lo, many, text, ids, s)
        later = order[~fresh]
        keep = order[fresh]
        got = [(k, [*x[:5], squeezed(x[5])]) for k, x in packed(mix(key[keep].view(U64)) % U64(count), [x[keep] for x in (key, ids, s, lo, many, text)])]
        got += [(k, [*x, b"", b"", b""]) for k, x in packed(mix(ids[later].view(U64)) % U64(count), [ids[later], s[later], many[later]])]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([k for k, _ in got], pa.int32())} | {c: pa.array([x[i] for _, x in got], pa.binary()) for i, c in enumerate("abcdef")})

    def classes(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        known = [r for r in rows if not r["d"]]
        if known:
            yield _runs(*(np.frombuffer(b"".join(r[c] for r in known), t) for c, t in zip("abc", (np.int64, np.int32, np.uint8), strict=True)), length)
        rows = [r for r in rows if r["d"]]
        if not rows:
            return
        key, doc, s, lo, many = (np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in zip("abcde", (np.int64, np.int64, np.int32, np.uint8, np.uint8), strict=True))
        text = np.frombuffer(b"".join(opened(r["f"]) for r in rows), np.uint8).reshape(len(key), left + length)
        cut = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, key[cut][1:] != key[cut][:-1], True])
        i = 0
        while i < len(first) - 1:  # whole suffix buckets, some thousand rows at a time
            j = max(i + 1, int(np.searchsorted(first, first[i] + 8192, "right")) - 1)
            block = cut[first[i] : first[j]]
            i = j
            order, fresh = _sorted(key[block], lo[block], many[block], text[block], doc[block], s[block])
            later, block = block[order[~fresh]], block[order[fresh]]
            if len(later):
                yield _runs(doc[later], s[later], many[later], length)
            same = key[block][1:] == key[block][:-1]
            block = block[np.r_[same, False] | np.r_[False, same]]  # buckets of several different spans
            if not len(block):
                continue
            low, begin = lo[block].astype(np.int64), s[block].astype(np.int64)
            got = list(sort_bucket(key[block], text[block], low, low + many[block] - 1, doc[block], begin - low, length))
            if got:
                row = np.concatenate([r for r, _ in got])
                place = np.concatenate([np.full(len(r), p) for r, p in got])
                order = np.lexsort((place, row))
                row, place = row[order], place[order]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)])
                run = np.diff(np.r_[new, len(row)])
                yield _runs(doc[block][row[new]], (begin - low)[row[new]] + place[new], run, length)

    found = keyed(mapped(docs.join(marks, "doc_id"), contexts, "bucket int, a binary, b binary, c binary, d binary, e binary, f binary"), classes, "doc_id long, s int, e int")
    runs = found.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("runs"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_union([(r["s"], r["e"]) for r in x or []]) for x in batch.column("runs").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(got, pa.binary())], ["doc_id", "text", "runs"])

    return mapped(docs.join(runs, "doc_id", "left"), merge, "doc_id long, text string, runs binary")


def _contexts(data: np.ndarray, at: np.ndarray, ids: np.ndarray, s: np.ndarray, many: np.ndarray, key: np.ndarray, length: int) -> list[np.ndarray]:
    """Each span's bytes, aligned at its selected string, with what is known of it."""
    left = length - GRAM
    text = np.zeros((len(s), left + length), np.uint8)
    lo = left - _selected(data, at, many, length)  # the selected string's place is found again from the span itself, which fixes it
    size = many + length - 1
    cell = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(np.arange(len(s)), size), np.repeat(lo, size) + cell] = data[np.repeat(at, size) + cell]
    return [key, ids, s.astype(np.int32), lo.astype(np.uint8), many.astype(np.uint8), text]


def _sorted(key: np.ndarray, lo: np.ndarray, many: np.ndarray, text: np.ndarray, doc: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by bucket, bytes and place; whether each is the first of equal spans)."""
    words = np.ascontiguousarray(np.pad(text, ((0, 0), (0, -text.shape[1] % 8)))).view(">u8")
    order = np.lexsort([s, doc, many, lo, *words.T, key])
    same = np.ones(max(0, len(order) - 1), bool)
    for x in (key, lo, many, *words.T):
        x = x[order]
        same &= x[1:] == x[:-1]
    return order, np.r_[True, ~same][: len(order)]


def _runs(doc: np.ndarray, s: np.ndarray, many: np.ndarray, length: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(doc), "s": pa.array(s, pa.int32()), "e": pa.array(s.astype(np.int64) + many + length - 1, pa.int32())})


def _selected(data: np.ndarray, at: np.ndarray, many: np.ndarray, length: int) -> np.ndarray:
    """Where in each span its selected string starts."""
    out = np.empty(len(at), np.int64)
    for a in range(0, len(at), 4096):
        p = at[a : a + 4096]
        cell = np.minimum(p[:, None] + np.arange(length), len(data) - 1)
        h = _TABLE[:256][data[cell]]
        for w in (1, 2, 4, 8, 16):
            x = h[:, :-w] * _A
            x ^= x >> U64(29)
            x += h[:, w:] * _B
            x ^= x >> U64(32)
            h = x
        low = U64((1 << _PLACE) - 1)
        out[a : a + 4096] = ((mix(h) & ~low) | np.arange(h.shape[1], dtype=U64)).argmin(1)
    return out


def _union(runs: list[tuple[int, int]]) -> bytes:
    if not runs:
        return b""
    r = np.array(sorted(runs), np.int64)
    reach = np.maximum.accumulate(r[:, 1])
    first = np.flatnonzero(np.r_[True, r[1:, 0] > reach[:-1]])
    return np.stack([r[first, 0], np.r_[reach[first[1:] - 1], reach[-1]]], 1).astype("<i8").tobytes()


def removed(rows: DataFrame) -> DataFrame:
    """What ``repeated_bytes`` found, applied: doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in chunks(batch):
                out: list[tuple] = []
                runs = batch.column("runs")
                for i, (a, b) in enumerate(zip(offs[:-1], offs[1:], strict=True)):
                    r = np.frombuffer(runs[part.start + i].as_py() or b"", "<i8").reshape(-1, 2)
                    text = data[a:b].tobytes()
                    edge = [0, *r.ravel().tolist(), len(text)]
                    kept = b"".join(text[x:y] for x, y in zip(edge[::2], edge[1::2], strict=True)) if len(r) else text
                    out.append((len(text), len(text) - len(kept), len(r), kept, hashlib.sha256(kept).hexdigest()))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part.start : part.stop], *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return mapped(rows, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def kept_texts(rows: DataFrame) -> DataFrame:
    """doc_id and text of what ``repeated_bytes`` leaves; bytes that are no longer part of a character go."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.decode("utf-8", "ignore") for x in batch.column("kept").to_pylist()], pa.string())], ["doc_id", "text"])

    return mapped(removed(rows).select("doc_id", "kept"), cut, "doc_id long, text string")
