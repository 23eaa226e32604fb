"""Exact Jaccard join of documents on word n-grams, as a blocked sparse matrix product.

The incidence matrix has a row for each different set of n-grams and a column for each n-gram.

1. N-grams have a fixed order, rarest words first.  A row of s columns that links shares at least
   ceil(t * s) of them, so both rows of a link have a common column among their first
   s - ceil(t * s) + 1: rows that meet there, with sizes of one level, are candidates of each other.
   The order takes word frequencies from all documents (frequent words only, at most ``common`` of
   them by definition); any order gives the same links, this one keeps common passages from meeting.
2. Rows that meet are compared by sketch, the numbers of their n-grams in ``BINS`` hash bins: two sets differ
   in at least the sum of the bins' differences, so pairs beyond the bound of their sizes go without
   their sets being read.  Meetings of more than ``wide`` rows, found by a count, are not compared: their
   rows are candidates of each other, joined to the least of them, and none is gathered in one task.
   Candidates that hang together are compared once more, all with all, by sketches whose bins grow with
   the set, of about four n-grams each; a group's rows are dealt to blocks, and pairs of blocks to tasks.
3. Candidates that still hang together form a group.  A group's rows are dealt to blocks of ``block`` rows
   and ``BLOCK`` bytes;
   the product of the rows of a block, with a few pivots of the whole group, is a task, which accumulates
   the overlap counts and discards pairs below the bound of their sizes.  That links a group of near
   copies whole.  Where a group stays in parts, the rows outside its largest part are sent to all its
   blocks; pairs inside one part no longer matter.  A task returns a spanning forest of its links.
4. Components of all links give each document its component.

Hashes of n-grams and sets have 64 bits; equal hashes count as equal.  Groups are never expanded
into pairs of rows of a DataFrame; exact copies are one row of the matrix from the start.

A very long text is one row of the matrix, tokenised as a whole in memory in proportion to its length.
Null and empty texts and texts without words have no n-grams and link with nothing.  A text of fewer
words than n is one n-gram.  Rows without a doc_id are left out.  Rows that repeat a doc_id are
joined like others, and the component of an id that occurs twice is that of either; the result has
each row.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import LOWER, U64, buckets_of, checkpointed, chunks, components, gram_hashes, keyed, mapped, mix, packed, roots, word_hashes, words_in


BINS = 64
PIVOTS = 16
BLOCK, TASK = 4 << 20, 16 << 20  # bytes of sets of a block, and those that a task of the product reads, about


class Levels:
    """Bounds that follow from sizes, for a threshold num/den."""

    def __init__(self, num: int, den: int, step: float = 1.4):
        self.num, self.den = num, den
        self.top = [1]
        while self.top[-1] < 1 << 40:
            self.top.append(max(self.top[-1] + 1, int(self.top[-1] * step)))

    def of(self, size: int) -> list[int]:
        """Levels that a size takes part in: a pair is found at the level of its larger size."""
        first = int(np.searchsorted(self.top, size))
        out = [first]
        while (self.top[out[-1]] + 1) * self.num <= size * self.den:
            out.append(out[-1] + 1)
        return out

    def prefix(self, size: int) -> int:
        return size + self.num * -size // self.den + 1


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int, usual: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """For each document of a chunk the sorted different hashes of its word n-grams, and how usual each one's words are."""
    data = LOWER[data]
    start, end, doc = words_in(data, offs)
    h = word_hashes(data, start, end)
    at = np.searchsorted(doc, np.arange(len(offs)))
    if usual is not None:
        known, weight = usual
        i = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
        w = np.r_[0, np.cumsum(np.where(known[i] == h, weight[i], 0) if len(known) else np.zeros(len(h), np.int64))]
    for a, b in zip(at[:-1], at[1:], strict=True):
        m = b - a
        if not m:
            yield np.zeros(0, U64), np.zeros(0, np.int64)
            continue
        g = gram_hashes(h[a:b], n) if m >= n else mix(gram_hashes(h[a:b], m) + U64(m))
        if usual is None:
            g = np.sort(g)
            yield g[np.r_[True, g[1:] != g[:-1]]], None
        else:
            g, first = np.unique(g, return_index=True)
            yield g, (w[a + min(m, n) : b + 1] - w[a : b + 1 - min(m, n)])[first]


def usual_words(docs: DataFrame, common: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with at least about 1/common of all words, sorted, and their frequencies in sixteenths of bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            h, at = np.unique(np.concatenate([x for x, _ in held] or [np.zeros(0, U64)]), return_inverse=True)
            c = np.bincount(at, np.concatenate([x for _, x in held] or [np.zeros(0, np.int64)]), len(h)).astype(np.int64)
            held.clear()
            keep = c >= max(2, c.sum() / (2 * common))  # a word that is common in all is so in some part
            yield pa.RecordBatch.from_pydict({"h": pa.array(np.r_[h[keep].view(np.int64), np.int64(0)], pa.int64()), "n": pa.array(np.r_[c[keep], c[~keep].sum()], pa.int64())})

        for batch in batches:
            for _, data, offs in chunks(batch):
                data = LOWER[data]
                start, end, _ = words_in(data, offs)
                held.append(np.unique(word_hashes(data, start, end), return_counts=True))
            if sum(len(x) for x, _ in held) > 1 << 20:
                yield from out()
        yield from out()

    rows = checkpointed(mapped(docs, count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    total = rows.agg(F.sum("n").alias("n")).first().n or 0
    top = rows.where((F.col("h") != 0) & (F.col("n") >= max(2, total / common))).toPandas()  # at most `common` rows
    h, n = top["h"].to_numpy(np.int64).view(U64), top["n"].to_numpy(float)
    order = np.argsort(h)
    return h[order], np.round(16 * np.log2(1 + n[order] * common / max(total, 1))).astype(np.int64)


def bins_of(n: int) -> int:
    """Bins of the fine sketch of a set: about four n-grams in each."""
    return max(BINS, 1 << max(0, (n - 1).bit_length() - 2))


def sketched(g: np.ndarray, bins: int) -> np.ndarray:
    """Numbers of n-grams by the leading bits of their hashes."""
    return np.bincount((g >> U64(65 - bins.bit_length())).astype(np.int64), minlength=bins)


def as_bytes(counts: list[np.ndarray]) -> tuple[list[bytes], int]:
    """Sketches of a set as bytes, a byte a bin if all its numbers fit, else four; and 1 for the latter."""
    wide = any(c.max(initial=0) > 255 for c in counts)
    return [c.astype(np.uint32 if wide else np.uint8).tobytes() for c in counts], int(wide)


def from_bytes(raw: bytes, bins: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == bins else np.uint32)


def sketch_pairs(size: np.ndarray, sketches: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, sorted by size, whose sizes and sketches allow a link; a finer sketch is added up to a coarser one's bins."""
    left, right = [np.zeros(0, int)], [np.zeros(0, int)]
    last = np.searchsorted(size * num, size * den, "right")  # sizes within the threshold
    widths = np.array([len(s) for s in sketches])
    i = 0
    while i < len(size):
        end = int(np.searchsorted(widths, widths[i], "right"))
        bins = np.stack([s.reshape(widths[i], -1).sum(1, dtype=np.int32) for s in sketches[i : last[end - 1]]])
        for r in range(i, end):
            apart = np.abs(bins[r - i + 1 : last[r] - i] - bins[r - i]).sum(1)
            j = r + 1 + np.flatnonzero(apart * (den + num) <= (den - num) * (size[r + 1 : last[r]] + size[r]))
            left.append(np.full(len(j), r))
            right.append(j)
        i = end
    return np.concatenate(left), np.concatenate(right)


def _set_id(g: np.ndarray) -> int:
    return int(mix(np.array([np.add.reduce(mix(g ^ U64(0xA5A5A5A5))) + U64(len(g))], U64)).view(np.int64)[0])


def _candidates(docs: DataFrame, n: int, levels: Levels, common: int) -> DataFrame:
    """kind 0: (a: doc_id, b: its set, n: its size, s, f: its sketches); kind 1: (a: a meeting, b: a set in it)."""
    count = buckets_of(docs.sparkSession)
    usual = docs.sparkSession.sparkContext.broadcast(usual_words(docs, common))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs, nodes, rows, bins, fine = [], [], [], [], []

        def out() -> Iterator[pa.RecordBatch]:
            if rows:
                r = np.array(rows, np.int64)
                got = []
                for k, (which,) in packed(mix(r[:, 0].view(U64)) % U64(count), [np.arange(len(r))]):
                    who = np.frombuffer(which, np.int64)
                    got.append((0, k, [*(r[who, i].tobytes() for i in range(3)), b"".join(bins[i] for i in who), b"".join(fine[i] for i in who)]))
                if sigs:
                    s = np.concatenate(sigs)
                    who = np.repeat(np.array(nodes, np.int64), [len(x) for x in sigs])
                    got += [(1, k, [*x, b"", b"", b""]) for k, x in packed(s % U64(count), [s, who])]
                yield pa.RecordBatch.from_pydict({"kind": pa.array([x[0] for x in got], pa.int32()), "bucket": pa.array([x[1] for x in got], pa.int32())} | {c: pa.array([x[2][i] for x in got], pa.binary()) for i, c in enumerate("xyzsf")})
            rows.clear(), sigs.clear(), nodes.clear(), bins.clear(), fine.clear()
            if len(seen) > 1 << 16:
                seen.clear()

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for part, data, offs in chunks(batch):
                for doc, (g, w) in zip(ids[part], shingle_sets(data, offs, n, usual.value), strict=True):
                    (s, f), wide = as_bytes([sketched(g, BINS), sketched(g, bins_of(len(g))) if bins_of(len(g)) > BINS else np.zeros(0, int)])
                    bins.append(s)
                    fine.append(f)
                    if not len(g):
                        rows.append((doc, 0, 0))
                        continue
                    node = _set_id(g)
                    rows.append((doc, node, 2 * len(g) + wide))  # the last bit: bytes a bin
                    if node in seen:
                        continue
                    seen.add(node)
                    p = levels.prefix(len(g))
                    order = (w.astype(U64) << U64(48)) | (g >> U64(16))
                    g = g[order <= np.partition(order, p - 1)[p - 1]]
                    for level in levels.of(len(w)):
                        sigs.append(mix(g + U64(level)))
                        nodes.append(node)
                if sum(map(len, sigs)) > 1 << 19 or len(rows) > 1 << 14 or sum(map(len, fine)) > 8 << 20:
                    yield from out()
        yield from out()

    def cut(raw: bytes, sizes: np.ndarray) -> list[bytes]:
        return [raw[end - m : end] for m, end in zip(sizes.tolist(), np.cumsum(sizes).tolist(), strict=True)]

    def meet(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        plain = [r for r in rows if r["kind"] == 0]
        a, b, size = (np.frombuffer(b"".join(r[c] for r in plain), np.int64) for c in "xyz")
        size, each = size >> 1, np.where(size & 1, 4, 1)  # bytes a bin
        coarse = cut(b"".join(r["s"] for r in plain), each * BINS)
        fine = cut(b"".join(r["f"] for r in plain), each * np.array([m if m > BINS else 0 for m in map(bins_of, size.tolist())], np.int64))
        kind = np.zeros(len(a), np.int32)
        sig, node = np.frombuffer(b"".join(r["x"] for r in rows if r["kind"]), U64), np.frombuffer(b"".join(r["y"] for r in rows if r["kind"]), np.int64)
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[fresh], node[fresh]
        new = np.ones(len(sig) + 1, bool)
        new[1:-1] = sig[1:] != sig[:-1]
        inside = ~(new[:-1] & new[1:])
        new, node = new[:-1][inside], node[inside]
        if len(node):  # a meeting is named by who is there, so that the same sets meet once
            first = np.flatnonzero(new)
            size1 = np.diff(np.r_[first, len(node)])
            name = mix(np.add.reduceat(mix(node.view(U64)), first) + size1.astype(U64)).view(np.int64)
            once = np.unique(name, return_index=True)[1]
            keep = np.zeros(len(first), bool)
            keep[once] = True
            who = np.repeat(keep, size1)
            a, b = np.r_[a, np.repeat(name, size1)[who]], np.r_[b, node[who]]
            more = len(a) - len(kind)
            kind, size, coarse, fine = np.r_[kind, np.ones(more, np.int32)], np.r_[size, np.zeros(more, np.int64)], coarse + [None] * more, fine + [None] * more
        yield pa.RecordBatch.from_pydict({"kind": pa.array(kind), "a": pa.array(a), "b": pa.array(b), "n": pa.array(size), "s": pa.array(coarse, pa.binary()), "f": pa.array(fine, pa.binary())})

    return keyed(mapped(docs, emit, "kind int, bucket int, x binary, y binary, z binary, s binary, f binary"), meet, "kind int, a long, b long, n long, s binary, f binary")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of all pairs: the product of the incidence matrix with its transpose."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    col = np.concatenate(sets)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    first = np.flatnonzero(np.r_[True, col[1:] != col[:-1]])
    size = np.diff(np.r_[first, len(col)])
    out = np.zeros((m, m), np.float32)
    for f in np.unique(size[(size > 1) & (size <= 12)]):  # rare columns: their few pairs, one by one
        who = row[first[size == f][:, None] + np.arange(f)]
        for i in range(f):
            for j in range(f):
                np.add.at(out, (who[:, i], who[:, j]), 1)
    wide = np.flatnonzero(size > 12)
    for k in range(0, len(wide), 2048):  # frequent columns: dense strips
        strip = wide[k : k + 2048]
        x = np.zeros((m, len(strip)), np.float32)
        at = np.repeat(np.arange(len(strip)), size[strip])
        x[row[np.repeat(first[strip], size[strip]) + np.arange(len(at)) - np.repeat(np.cumsum(size[strip]) - size[strip], size[strip])], at] = 1
        out += x @ x.T
    return out


def _linked(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """A spanning forest of the links (places in ``ids``), as pairs of ids."""
    root = roots(len(ids), a, b)
    far = np.flatnonzero(root != np.arange(len(ids)))
    return pa.RecordBatch.from_pydict({"a": pa.array(ids[root[far]], pa.int64()), "b": pa.array(ids[far], pa.int64())})


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, block: int = 1024, common: int = 100_000, wide: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id: components of links with num*|union| <= den*|intersection|, exactly."""
    levels = Levels(num, den)
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    base = checkpointed(_candidates(docs, n, levels, common))
    rows = base.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("node"), F.col("n").alias("n_shingles"))
    rep = base.where("kind = 0 and n > 0").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("rep"), F.first("n").alias("n"), F.first("s").alias("s"), F.first("f").alias("f"))

    def near(held: list[dict]) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda r: (r["n"], r["node"]))
        ids, size = np.array([r["node"] for r in held], np.int64), np.array([r["n"] for r in held], np.int64)
        yield _linked(ids, *sketch_pairs(size, [from_bytes(r["f"], bins_of(r["n"])) if r.get("f") else from_bytes(r["s"], BINS) for r in held], num, den))

    meetings = base.where("kind = 1").select(F.col("a").alias("meeting"), F.col("b").alias("node")).distinct()
    sizes = checkpointed(meetings.groupBy("meeting").agg(F.count("*").alias("many"), F.min("node").alias("least")).where(F.col("many") > wide))
    all_of = meetings.join(sizes, "meeting").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    few = meetings.join(sizes, "meeting", "left_anti").join(rep.select("node", "n", "s"), "node").select("meeting", "node", "n", "s")
    groups = components(all_of.unionByName(keyed(few, near, "a long, b long", ("meeting",))))
    # the same test on finer sketches, between all rows of a group, takes apart what only coarse ones held together
    groups = groups.select(F.col("id").alias("node"), F.col("component").alias("blob")).join(rep, "node")
    many = F.ceil(F.greatest(F.count("*") / block, F.sum("n") / BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("k")).cast("int")
    pairs = groups.join(groups.groupBy("blob").agg(many.alias("k")), "blob").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumns({"i": F.least(own, "j"), "j": F.greatest(own, "j")})
    groups = components(keyed(pairs.select("blob", "i", "j", "node", "n", "s", "f"), near, "a long, b long", ("blob", "i", "j")))
    groups = groups.select(F.col("id").alias("node"), F.col("component").alias("blob")).join(rep.select("node", "rep", "n"), "node")
    many = F.ceil(F.greatest(F.count("*") / block, F.sum("n") * 8 / BLOCK)).cast("int")  # blocks of few rows and few bytes
    blocks = groups.groupBy("blob").agg(many.alias("k"))
    own = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("k")).cast("int")
    groups = checkpointed(groups.join(blocks, "blob").select(F.col("rep").alias("doc_id"), "blob", "n", "k").withColumn("own", own))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in chunks(batch):
                got = [g.tobytes() for g, _ in shingle_sets(data, offs, n)]
                yield pa.RecordBatch.from_arrays([batch.column(c)[part.start : part.stop] for c in names] + [pa.array(got, pa.binary())], [*names, "g"])

    def product(held: list[dict]) -> Iterator[pa.RecordBatch]:
        """All pairs of the rows at home, and of these with the guests."""
        held.sort(key=lambda r: r["guest"])
        ids = np.array([r["doc_id"] for r in held], np.int64)
        home = int(sum(not r["guest"] for r in held))
        g = [np.frombuffer(r["g"], U64) for r in held]
        size = np.array([len(x) for x in g])
        both = overlaps(g)
        found = [(np.zeros(0, int), np.zeros(0, int))]
        for i in range(0, home, 128):  # strips, so that the bounds need little memory
            strip = both[i : min(i + 128, home)].astype(np.int64)
            a, b = np.nonzero(den * strip >= num * (size[i : i + len(strip), None] + size[None, :] - strip))
            found.append((a[a + i < b] + i, b[a + i < b]))
        yield _linked(ids, np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))

    names = ["doc_id", "seats"]

    def products(seats: DataFrame) -> DataFrame:
        """Links found where rows sit together; ``seats``: doc_id, n, seats (array of blob, i, j, guest)."""
        sized = checkpointed(seats)
        most = sized.agg(F.sum(F.col("n") * 8 * F.size("seats"))).first()[0] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), most // TASK)  # a task's rows stay small at any size
        seat = "struct<blob:bigint,i:int,j:int,guest:boolean>"
        dealt = mapped(docs.join(sized.drop("n"), "doc_id"), sets, f"doc_id long, seats array<{seat}>, g binary")
        dealt = dealt.select("doc_id", "g", F.explode("seats").alias("s")).select("s.*", "doc_id", "g")
        return keyed(dealt, product, "a long, b long", ("blob", "i", "j"), parts)

    # a group's rows meet those of their own block and a few pivots, which link the blocks of a group of near copies
    first = Window.partitionBy("blob").orderBy("doc_id")
    pivots = groups.where("k > 1").withColumn("r", F.row_number().over(first)).where(F.col("r") <= PIVOTS).select("doc_id", F.lit(True).alias("pivot"))
    seat = lambda i, j, guest: F.struct("blob", i.cast("int").alias("i"), j.cast("int").alias("j"), guest.alias("guest"))
    every = F.sequence(F.lit(0), F.col("k") - 1)
    at_home = F.array(seat(F.col("own"), F.lit(0), F.lit(False)))
    abroad = F.transform(F.filter(every, lambda j: j != F.col("own")), lambda j: seat(j, F.lit(0), F.lit(True)))
    placed = groups.join(pivots, "doc_id", "left").select("doc_id", "n", F.when(F.col("pivot"), F.concat(at_home, abroad)).otherwise(at_home).alias("seats"))
    links = products(placed)
    # where that leaves a group in parts, the rows outside its largest part meet all its blocks; inside a part no pair matters any more
    now = components(links)
    large = groups.where("k > 1").join(now.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    large = checkpointed(large)
    part = large.groupBy("blob", "component").agg(F.count("*").alias("m")).groupBy("blob").agg(F.max_by("component", F.struct("m", "component")).alias("main"))
    large = large.join(part, "blob").withColumn("out", F.col("component") != F.col("main"))
    left = large.where("out").groupBy("blob").agg(many.alias("h"))
    large = large.join(left, "blob")
    if not large.isEmpty():
        hosts = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda j: seat(F.col("own"), j, F.lit(False)))
        table = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("h"))
        guests = F.transform(every, lambda i: seat(i, table, i != F.col("own")))  # in its own block it is at home, and meets its table's other guests
        more = products(large.select("doc_id", "n", F.when(F.col("out"), F.concat(F.filter(hosts, lambda s: s.j != table), guests)).otherwise(hosts).alias("seats")))
        now = components(now.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    rep = rep.select("node", "rep").join(now.withColumnRenamed("id", "rep"), "rep", "left").select("node", F.coalesce("component", "rep").alias("component_id"))
    full = rows.where("n_shingles > 0").join(rep, "node").select("doc_id", "n_shingles", "component_id")
    return full.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
