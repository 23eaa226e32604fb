"""Each operator against a brute-force version on small texts, with nulls, empty and repeated rows, and empty tables."""

import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import common, decontam, hilbert, jaccard, langid, lattice, packing, quality, suffix, toxicity, warc

SCHEMA = "doc_id long, text string, words int, bucket string"  # the last two clash with names used inside


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def make(seed=0, n=60):
    """Texts with copies, near copies, shared passages, odd bytes."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randrange(2, 8))) for _ in range(300)]
    passage = " ".join(rng.choices(vocab, k=40))
    texts = [None, "", " \n\t ", "x", "A b", "ß" * 300, "z" * 700, passage, passage + " tail", "0123456789" * 60]
    for _ in range(n):
        words = rng.choices(vocab, k=rng.randrange(3, 120))
        if rng.random() < 0.3:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        texts.append(" ".join(words))
        if rng.random() < 0.4:
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(" ".join(words).title() if rng.random() < 0.3 else " ".join(words))
    return [(7 * i, t, 1, "b") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make() + [(None, "left out", 1, "b")], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    more = [(100001, "it's 3.5 <|endoftext|> “x”  \x1c\x85 日本語 ½", 1, "b"), (100002, " ".join(["word"] * 5000), 1, "b")]
    rows = make() + more
    got = packing.pack(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {}
    for r in got:
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0
        by.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        pieces = sorted(by[i], key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in pieces]).tolist() == ids
        assert [p.start for p in pieces] == np.cumsum([0] + [p.length for p in pieces[:-1]]).tolist() and all(p.doc_tokens == len(ids) for p in pieces)
    assert len({r.sequence_id for r in got}) == len(got)
    assert packing.pack(empty(spark)).count() == 0
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for t in (" " * 10**6 + "x", "a" * 10**6, "\n" * 10**6, "1" * 10**6, " \n\t" * 10**5, "日" * 10**5, "!" * 511 + " " * 255 + "x", "x" * 512, " " * 256):
        assert encode(t) == tok.encode(t, add_special_tokens=False).ids
    assert packing.pieces(2048 * 2 + 5, 2048) == [2048, 2048, 4, 1]
    with pytest.raises(ValueError):
        packing.pack(docs, longest=100)


def brute_repeats(rows, n):
    seen, out = set(), {}
    for i, t in sorted((i, t or "") for i, t, *_ in rows):
        raw = t.encode()
        mark = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - n + 1):
            w = raw[p : p + n]
            if w in seen:
                mark[p : p + n] = True
            seen.add(w)
        kept = bytes(np.frombuffer(raw, np.uint8)[~mark[:-1]])
        out[i] = (len(raw), int(mark.sum()), int((np.diff(np.r_[False, mark].astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length", [68, 100])
def test_suffix(spark, docs, length):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.removed(suffix.repeated_bytes(docs, length)).collect()}
    assert got == brute_repeats(make(), length)
    if length == 100:
        assert suffix.removed(suffix.repeated_bytes(empty(spark))).count() == 0
        twice = spark.createDataFrame([(1, "b" * 200, 1, "b"), (1, "a" * 150, 1, "b")], SCHEMA)
        assert [r.n_bytes for r in suffix.removed(suffix.repeated_bytes(twice)).collect()] == [150]
        texts = {r.doc_id: r.text for r in suffix.kept_texts(suffix.repeated_bytes(docs)).collect()}
        assert texts[0] == "" and all(isinstance(t, str) for t in texts.values())


def test_suffix_parts_of_long_documents(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    data[3000:3400] = data[100:500]
    offs = np.array([0, len(data)])
    whole = suffix.spans(data, offs, 100)
    monkeypatch.setattr(suffix, "_PART", 1000)
    parts = suffix.spans(data, offs, 100)
    cover = lambda x: sorted((s + k, s + p - (s + k)) for s, m, p in zip(x[1], x[2], x[3], strict=True) for k in range(m))
    assert cover(whole) == cover(parts)


def brute_links(rows, n, num, den):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n,num,den,block", [(3, 90, 100, 384), (5, 8, 10, 384), (5, 8, 10, 2), (1, 1, 2, 3)])
def test_jaccard(spark, docs, n, num, den, block):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, n, num, den, block).collect()}
    assert got == brute_links(make(), n, num, den)


def test_jaccard_edges(spark):
    assert jaccard.jaccard_components(empty(spark)).count() == 0
    twice = spark.createDataFrame([(5, "a b c d e f", 1, "b"), (5, "a b c d e f", 1, "b"), (9, "a b c d e f", 1, "b")], SCHEMA)
    assert sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(twice).collect()) == [(5, 5), (5, 5), (9, 5)]
    levels = jaccard.Levels(8, 10)
    for a in range(1, 200):
        assert levels.prefix(a) == a - math.ceil(0.8 * a - 1e-9) + 1
        for b in range(a, int(a / 0.8 + 1e-9) + 1):
            assert levels.of(b)[0] in levels.of(a)


def test_overlaps():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(50)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert np.array_equal(jaccard.overlaps(sets), want)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = list(range(200))
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {i: root[i] for i in {x for e in edges if e[0] != e[1] for x in e}}


BENCH = "item_id long, text string, doc_id long"


def brute_windows(rows, bench, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    out = {}
    for i, t, *_ in rows:
        w, hit, items = words(t), set(), set()
        for item, b, _ in bench:
            b = words(b)
            m = min(n, len(b))
            have = {tuple(b[j : j + m]) for j in range(len(b) - m + 1)} if m else set()
            for s in range(len(w) - m + 1):
                if m and tuple(w[s : s + m]) in have:
                    hit |= set(range(s, s + m))
                    items.add(str(item))
        out[i] = (len(w), len(hit), len(items), sorted(items))
    return out


@pytest.mark.parametrize("small", [200_000, 0])
def test_decontamination(spark, docs, small):
    rows = make()
    long = [t for _, t, *_ in rows if t and len(t.split()) > 30]
    bench = [(1, " ".join(long[0].split()[5:25]).upper(), 1), (12, long[3], 1), (3, None, 1), (4, "", 1), (5, " ".join(long[2].split()[:6]), 1), (6, long[5].split()[0], 1), (7, "nothing of this kind is anywhere in them at all", 1), (12, long[3], 1)]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r["items"]) for r in decontam.decontaminate(docs, spark.createDataFrame(bench, BENCH), small=small).collect()}
    assert got == brute_windows(rows, bench)
    if small:
        none = decontam.decontaminate(docs, spark.createDataFrame([], BENCH)).collect()
        assert len(none) == len(rows) and not any(r.contaminated for r in none)
        assert decontam.decontaminate(empty(spark), spark.createDataFrame(bench, BENCH)).count() == 0


def test_lattice(spark, docs):
    rows = make()
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) != 0
    got = {r.doc_id: r for r in lattice.score(docs, learn).collect()}
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")) + [None] for i, t, *_ in rows}
    count = {}
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            for x in w:
                count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    assert set(got) == set(tokens)
    for i, w in tokens.items():
        assert got[i].n_tokens == len(w) and got[i].n_known == sum(x in count for x in w) and got[i].train_tokens == n
        assert got[i].base_score == pytest.approx(sum(math.log10((count.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert got[i].score < 0 and got[i].lattice_score < 0
    assert lattice.score(empty(spark), learn).count() == 0
    none = {r.doc_id: r for r in lattice.score(docs, F.lit(False)).collect()}
    assert all(r.train_tokens == 0 and math.isfinite(r.score) for r in none.values())


def test_lattice_scores_add_up(spark):
    """Without rounds of estimation, whole scores from the forward recursion of each word, its own arc and the ends."""
    import public_tokenizers

    texts = {1: "the cat sat on the mat", 2: "the dog", 3: "a cat " + "xyz" * 30, 4: None, 5: "The cat"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in lattice.score(df, F.col("doc_id") < 4, rounds=0).collect()}
    p = lattice.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    words = {i: lower(t or "").split() for i, t in texts.items()}
    count = {}
    for i in (1, 2, 3):
        for w in words[i]:
            count[w] = count.get(w, 0) + 1
    n, v, ends = sum(count.values()), len(count), 3
    for i, ws in words.items():
        mixed = alone = math.log10((ends + 0.5) / (n + ends + 1))
        for w in ws:
            sub = math.exp(p.forward(np.frombuffer(b" " + w.encode(), np.uint8)[None])[-1][0])
            go = math.log10((n + 0.5) / (n + ends + 1))
            mixed += go + math.log10(sub * 0.6 * v / n + max(count.get(w, 0) - 0.6, 0) / n)
            alone += go + math.log10(sub)
        assert got[i].score == pytest.approx(mixed) and got[i].lattice_score == pytest.approx(alone)


def test_long_words_alone():
    import public_tokenizers

    p = lattice.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(3)
    w = np.full((40, 61), 32, np.uint8)
    w[:, 1:] = rng.integers(97, 123, (40, 60))
    assert np.allclose(p.forward(w)[-1], [p.alone(x)[0] for x in w])
    assert np.allclose(p.expected(w, np.arange(40)), p.expected(w[:20], np.arange(20)) + p.expected(w[20:], np.arange(20, 40)))
    assert math.isfinite(p.alone(np.r_[32, rng.integers(97, 123, 100_000)].astype(np.uint8))[0])


def test_sketches_bound_differences():
    """Pairs that link are never apart by sketch, whatever the sizes."""
    rng = np.random.default_rng(5)
    for n in (1, 60, 300, 3000):
        g = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        h = np.unique(np.r_[g[: len(g) - len(g) // 10], rng.integers(0, 2**64, len(g) // 20, dtype=np.uint64)])
        rows = sorted((g, h), key=len)
        left, right = jaccard.sketch_pairs(np.array([len(r) for r in rows]), [jaccard.sketched(r, jaccard.bins_of(len(r))) for r in rows], 8, 10)
        assert (left.tolist(), right.tolist()) == ([0], [1])


def test_jaccard_groups_of_several_blocks(spark):
    """Meetings that are not compared, blocks of a few rows, pivots, and rows outside a group's largest part."""
    rng = random.Random(12)
    base = ["w%d" % i for i in range(60)]
    rows = []
    for i in range(150):
        words = base[:]
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words), 1, "b"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute_links(rows, 2, 8, 10)
    for wide in (5, 1024):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, 2, 8, 10, block=7, wide=wide).collect()}
        assert got == want
    assert 1 < len({c for _, c in want.values()}) < 150


def test_toxicity_exceptions_in_long_texts():
    lex = toxicity.Lexicon({" trash ": 5.0, " scum ": 5.0}, ("trash can", "pond scum"))
    got = lex.matches(toxicity.fold_text("trash can " * 50_000 + "trash scum pond scum"))
    assert len(got) == 2


def test_lattice_is_a_distribution():
    """The forward recursion equals the sum over all segmentations, and words' probabilities add up to at most 1."""
    import public_tokenizers

    p = lattice.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    strings, stack = {}, [(1, b"")]
    nxt = p.next.reshape(-1, 256)
    while stack:
        node, s = stack.pop()
        if p.logp[node] > -np.inf:
            strings[s] = math.exp(p.logp[node])
        if len(s) < 6:
            stack += [(int(nxt[node, b]), s + bytes([b])) for b in np.flatnonzero(nxt[node])]

    def brute(s):
        return sum(strings[s[:k]] * (brute(s[k:]) if k < len(s) else 1.0) for k in range(1, len(s) + 1) if s[:k] in strings)

    for w in (b"the", b"oneng", b"zq", "é".encode()):
        m = np.frombuffer(b" " + w, np.uint8)[None]
        assert p.forward(m)[-1][0] == pytest.approx(math.log(brute(b" " + w)))
        assert p.expected(m, np.ones(1)).sum() >= 1


def test_language(spark):
    rng = random.Random(4)
    parts = {"aa": ["ba", "la", "mi", "no"], "bb": ["sch", "ung", "ein", "tz"]}
    text = lambda x, n: " ".join("".join(rng.choices(parts[x], k=rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, text("aa" if i % 2 else "bb", rng.randrange(5, 60)), "aa" if i % 2 else "bb") for i in range(300)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 -", None), (1003, "日本語" * 50, None), (1004, text("aa", 4), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2
    model = langid.fit(docs, fold, per_language=100, held=20)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[i].lang_pred == x for i, _, x in rows[:300]]) > 0.98
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].rejected and got[1004].lang_pred == "aa"
    assert langid.fit(docs.where("false"), fold) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs.where("false"), model).count() == 0
    # each context's probabilities, all symbols and one unseen, add up to one
    level = model.grams[0]
    assert np.exp2(level.rows[:-1].astype(float)).sum(0) == pytest.approx(1, abs=0.1)


def test_quality(spark):
    rng = random.Random(5)
    good = lambda: " ".join("".join(rng.choices("abcdefghij", k=rng.choice((2, 3, 5, 7)))) for _ in range(rng.randrange(40, 120))) + "."
    bad = [lambda: " ".join(w + "&&&" for w in good().split()), lambda: " | ".join(good().split()), lambda: " ".join(w for w in good().split()[:9] for _ in range(12))]
    rows = [(i, bad[i % 3]() if i % 6 == 0 else good()) for i in range(600)] + [(9000, None), (9001, ""), (9002, "a short one")]
    rows = [(i, (bad[(i // 6) % 3]() if i % 6 == 0 and i < 600 else t), 1, "b") for i, t in rows]
    docs = spark.createDataFrame(rows, SCHEMA)
    scorer = quality.train(docs)
    got = {r.doc_id: r for r in quality.score(docs, scorer).collect()}
    assert np.mean([got[i].keep == (i % 6 != 0) for i in range(600)]) > 0.99
    assert got[9000].score == got[9001].score == 0 and 0 <= got[9002].score <= 1
    kept = quality.kept(docs, scorer)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.keep}
    assert quality.score(empty(spark), quality.train(empty(spark))).count() == 0


def test_toxicity(spark):
    rng = random.Random(6)
    clean = lambda n: ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 8))) for _ in range(n)]
    rows, labels = [], []
    for i in range(400):
        w = clean(rng.randrange(10, 80))
        if i % 4 == 0:
            for x in rng.choices(["scum", "moron", "trash"], k=4):
                w.insert(rng.randrange(len(w)), x)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, "ѕсum and m0r0n " + " ".join(clean(10))), (901, "the trash can by the trash bin " + " ".join(clean(10))), (902, None), (903, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(5000, 1), (None, 1)], "doc_id long, toxic int")
    lex = toxicity.fit(docs, labels, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    got = {r.doc_id: r for r in toxicity.score(docs, lex).collect()}
    assert all((got[i].score >= 0.7) == (i % 4 == 0) for i in range(400))
    assert got[900].score >= 0.7 and got[901].n_matches == 0 and got[901].score < 0.5
    assert got[902].score == got[903].score < 0.5
    assert toxicity.fold_text("Ｓtüpíd  W0RTHLE$$!") == " stupid worthless "
    none = toxicity.fit(docs, labels.where("false"), F.lit(True))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), lex).count() == 0


VEC = "vec_id long, embedding array<float>, block int"


def test_neighbours(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[100:160] = x[50]  # copies
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(500, None, 0), (550, [0.0] * 8, 0), (600, [1.0, None] * 4, 0), (650, [float("nan")] * 8, 0), (700, [], 0), (None, [1.0] * 8, 0), (750, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, VEC)
    got = {}
    for r in hilbert.neighbours(df, F.col("vec_id") % 50 == 0, recall=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    d = x.astype(float)
    s = d @ d.T / np.linalg.norm(d, axis=1)[:, None] / np.linalg.norm(d, axis=1)[None]
    assert set(got) == set(range(0, 400, 50))
    for q, found in got.items():
        found.sort()
        others = np.array([i for i in range(400) if i != q])
        want = others[np.lexsort((others, -np.round(s[q, others], 12)))[:5]]
        assert np.allclose([c for *_, c in found], s[q, [i for _, i, _ in found]]) and [r for r, *_ in found] == [1, 2, 3, 4, 5]
        assert len({i for _, i, _ in found} & set(want.tolist())) >= 4
    again = spark.createDataFrame(rows + rows, VEC)  # repeated rows count once
    assert hilbert.neighbours(again, F.col("vec_id") % 50 == 0).count() == 40
    assert hilbert.neighbours(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("groups", [0, 60])
def test_recall_of_windows(spark, groups):
    """The default window against brute force, on vectors without structure and in clusters."""
    rng = np.random.default_rng(groups)
    x = rng.normal(size=(4000, 24)) if not groups else rng.normal(size=(groups, 24))[rng.integers(0, groups, 4000)] + 0.3 * rng.normal(size=(4000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in hilbert.neighbours(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append(r.score)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q, scores in got.items():
        s = np.delete(u @ u[q], q)
        hit += (np.array(scores) >= np.sort(s)[-5] - 1e-9).sum()
    assert len(got) == 80 and hit >= 0.9 * 400
    index, _ = hilbert.indexed(df, F.col("vec_id") % 50 == 0)
    assert hilbert.fit(index, 5, 48, 8, 5, 0.94, 20_000, 128, 7).work() < (0.2 if groups else 0.9)


def test_hilbert_curve():
    bits, dims = 3, 2
    cells = np.array([(i, j) for i in range(8) for j in range(8)])
    order = cells[np.argsort(hilbert.hilbert(cells, bits))]
    assert sorted(hilbert.hilbert(cells, bits).tolist()) == list(range(64))
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all() and dims == 2


PAGE = "page_id long, url string, html string, content string"


def test_warc(spark, tmp_path):
    html = '<html><head><title>T\n x</title><style>a{}</style></head><body><!-- c --><p>One &amp; two&nbsp;<b>three</b></p><a href="/x">link</a><script>1</script></body></html>'
    pages = spark.createDataFrame([(1, "http://a/1", html, "c"), (2, None, None, "c"), (3, "http://a/3", "", "c"), (None, "x", "y", "c"), (4, "http://a/4", "plain 日本", "c")], PAGE)
    got = {(r.page_id, r.record_type): r for r in warc.derive(warc.responses(pages), "page_id").collect()}
    assert set(got) == {(i, k) for i in (1, 2, 3, 4) for k in ("metadata", "conversion")}
    text, meta = got[1, "conversion"], got[1, "metadata"]
    assert text.content == "One & two three\nlink"
    assert "outlink: /x\r\n" in meta.content and "title: T x\r\n" in meta.content and "source-status: 200" in meta.content
    assert text.refers_to == meta.refers_to and text.record_id != meta.record_id and text.refers_to_target_uri == "http://a/1"
    assert text.source_payload_digest == "sha1:" + hashlib.sha1(html.encode()).hexdigest()
    assert text.block_digest == "sha1:" + hashlib.sha1(text.content.encode()).hexdigest() and text.content_length == len(text.content.encode())
    assert got[2, "conversion"].content == "" and "HTTP/1.1 200 OK" in got[2, "conversion"].source_headers
    warc.write_warc(warc.derive(warc.responses(pages)), str(tmp_path / "w"))
    back = [x for f in (tmp_path / "w").glob("part-*.gz") for x in warc.parse(f.read_bytes())]
    assert sorted((h["warc-type"], h["warc-record-id"], b) for h, b in back) == sorted((r.record_type, r.record_id, r.content.encode()) for r in got.values())
    assert all(h["warc-refers-to"] and h["warc-source-headers"].startswith("HTTP/1.1 200") for h, _ in back)
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>hi\r\n\r\nWARC/1.1</p>"
    raw = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Target-URI: http://b\r\nWARC-Date: d\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(gzip.compress(raw) + gzip.compress(raw))
    rows = warc.read_warc(spark, str(tmp_path / "in")).collect()
    assert len(rows) == 2 and rows[0].payload == "<p>hi\r\n\r\nWARC/1.1</p>" and rows[0].http_headers == "HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    assert warc.derive(warc.responses(pages.where("false"))).count() == 0


def test_warc_references(spark):
    """Every reference of the HTML standard, and odd ones, against the standard library's parser of whole pages."""
    from html.entities import html5
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.text, self.links = "", []

        def handle_data(self, data):
            self.text += data

        def handle_starttag(self, tag, attrs):
            self.links += [v for k, v in attrs if tag == "a" and k == "href"]

    body = " ".join(f"a&{n} b" for n in sorted(html5)) + " &#65;&#x1F600;&#0;&#xD800;&#00000000066; &unknown; &amp;copy; & &# 5&6 &notit"
    links = """<a href="/x?a=1&amp;b=2">p</a><a class=k href='/y"z'>q</a><A HREF=/bare>r</A><a data-href="/no">s</a>"""
    pages = spark.createDataFrame([(1, "u", f"<body>{body} {links}</body>", "c"), (2, "u", f"<p>&#{'9' * 6000};&#x{'f' * 6000};{'&copy;' * 300_000}</p>", "c"), (2, "u", "<p>&reg;", "c"), (2, "u", "<p>&reg;", "c")], PAGE)
    got = {}
    for r in warc.derive(warc.responses(pages), "page_id").collect():
        got.setdefault((r.page_id, r.record_type), []).append(r.content)
    parser = Text()
    parser.feed(f"{body} {links}")
    parser.close()
    flat = lambda t: re.sub(r"[ \t\r\n\f\u00a0]+", " ", t).strip()
    want = flat(parser.text)
    assert flat(got[1, "conversion"][0]).replace(" ", "") == want.replace(" ", "")
    assert "&copy;" in want and "A😀��B &unknown; &copy; & &# 5&6 ¬it" in got[1, "conversion"][0]
    assert re.findall(r"outlink: (.*)\r\n", got[1, "metadata"][0]) == [x for x in parser.links] == ["/x?a=1&b=2", '/y"z', "/bare"]
    assert sorted(got[2, "conversion"]) == ["®", "®", "��" + "©" * 300_000]


def test_chunks_and_words():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": pa.array([None, "", "ab  c", "d", "é f" * 100, "g "])})
    out = []
    for part, data, offs in common.chunks(batch, 10):
        start, end, doc = common.words_in(data, offs)
        out += [(part.start + int(d), bytes(data[s:e]).decode()) for s, e, d in zip(start, end, doc, strict=True)]
    want = [(i, w) for i, t in enumerate(batch.column("text").to_pylist()) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert out == want


def test_sketches_take_a_byte_a_bin(spark):
    """Sketches are stored in a byte a bin, whatever doesn't fit in four, and come back as they were."""
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(300))), (2, "a b c"), (3, "")], "doc_id long, text string")
    rows = {r.a: r for r in jaccard._candidates(df, 2, jaccard.Levels(8, 10), 1000).where("kind = 0").collect()}
    assert {k: (r.n, len(r.s), len(r.f)) for k, r in rows.items()} == {1: (299, jaccard.BINS, 128), 2: (2, jaccard.BINS, 0), 3: (0, jaccard.BINS, 0)}
    assert sum(rows[1].f) == sum(rows[1].s) == 299
    for most in (255, 256):
        (raw, _), wide = jaccard.as_bytes([np.array([0, most, 3]), np.zeros(0, int)])
        assert wide == (most > 255) and len(raw) == (12 if wide else 3) and jaccard.from_bytes(raw, 3).tolist() == [0, most, 3]
