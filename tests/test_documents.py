"""Documents as records: the whole text counts, against brute force."""

import math
import random
from collections import Counter

import pytest

from kindred.plans import catalogue, views
from kindred.sources import records as R


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents that share an opening of more than 200 characters; what tells them apart comes after it."""
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(400)]
    opening = " ".join(rng.choices(vocab, k=40))
    rows = []
    for i in range(120):
        rows.append((i, opening + " " + " ".join(rng.choices(vocab[40:], k=rng.randrange(20, 60))), "en", f"src{i % 6}"))
    for i in range(0, 24, 2):  # copies on the other side
        rows.append((200 + i, rows[i * 3][1], "en", "src5" if i * 3 % 6 < 3 else "src0"))
    d = str(tmp_path_factory.mktemp("documents"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    side = lambda i, s: ("S1-" if s in ("src0", "src1", "src2") else "S2-" if i % 2 == 0 else "S3-") + str(i)
    return d, {side(i, s): t for i, t, _, s in rows}


def brute_cosines(texts, most, top):
    one, pool = ({i: Counter(t.split()) for i, t in texts.items() if i.startswith("S1-") == first} for first in (True, False))
    df = Counter(w for c in pool.values() for w in c)
    idf = {w: math.log((1 + len(pool)) / (1 + n)) + 1 for w, n in df.items() if 2 <= n <= most * len(pool)}

    def unit(c):
        w = {x: (1 + math.log(n)) * idf[x] for x, n in c.items() if x in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {x: v / norm for x, v in w.items()}

    p, out = {i: unit(c) for i, c in pool.items()}, {}
    for q, c in one.items():
        a = unit(c)
        got = sorted((-round(sum(v * b.get(x, 0) for x, v in a.items()), 6), i) for i, b in p.items())
        out |= {(q, i): -v for v, i in got[:top] if -v > 0.05}
    return out


def test_whole_texts_are_names(spark, folder):
    d, texts = folder
    assert {r.entity_id: r.business_name for r in R.documents_as_records(spark, d).collect()} == texts


def test_truth_is_equal_texts(spark, folder):
    d, texts = folder
    want = {(a, b) for a, s in texts.items() for b, t in texts.items() if a.startswith("S1-") and not b.startswith("S1-") and s == t}
    true, ids = views.truth(spark, d)
    assert {tuple(r) for r in true.collect()} == want and want
    assert ids.count() == sum(i.startswith("S1-") for i in texts)


def test_blocking_sees_whole_texts(spark, folder):
    d, texts = folder
    want = brute_cosines(texts, views.MOST, 15)
    got = {(r.s1_id, r.cand_id): r.cos_all for r in catalogue.QUERIES["blk_all_topk"](spark, d).collect()}
    assert len(want) > 100 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
