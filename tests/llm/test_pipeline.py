"""The pipeline's stages against brute force, each on the input it got."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import brute_links, brute_repeats, brute_windows

import corpus_pipeline
from kindred.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefghiklm", k=rng.choice((2, 3, 3, 5, 7, 8)))) for _ in range(3000)]
    passage = " ".join(rng.choices(vocab, k=70))
    bench = [" ".join(rng.choices(vocab, k=25)) for _ in range(5)]
    rows = []
    for i in range(260):
        words = rng.choices(vocab, k=rng.randrange(60, 160))
        if i % 13 == 0:
            words = [w for w in words[:12] for _ in range(10)]
        elif i % 11 == 0:
            words[20:20] = passage.split()
        elif i % 17 == 0:
            words[10:10] = bench[i % 5].split()[3:18]
        rows.append((i, " ".join(words), "en", "s", 0))
        if i % 7 == 0:
            words[rng.randrange(len(words))] = "zz"
            rows.append((1000 + i, " ".join(words), "en", "s", 0))
    rows += [(5000, None, None, None, None), (5001, "", "en", "s", 0), (None, "no id", "en", "s", 0)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        out = spark.createDataFrame(out.collect(), out.schema)
        got[name] = (docs, out)
        docs = out
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    before, after = map(texts, got["quality_filter"])
    junk = {i for i in before if i is None or i in (5000, 5001) or i % 1000 % 13 == 0}
    assert set(after) == set(before) - junk
    before, after = map(texts, got["near_duplicates"])
    links = brute_links([(i, t) for i, t in before.items()], 5, 8, 10)
    assert set(after) == {i for i, (_, c) in links.items() if c == i} and len(after) < len(before)
    before, after = map(texts, got["repeated_passages"])
    want = brute_repeats([(i, t) for i, t in before.items()], 100)
    assert set(before) == set(after) and sum(w[1] for w in want.values()) > 1000
    assert all(len(after[i].encode()) == n - cut for i, (n, cut, *_) in want.items())
    assert all(r.n_chars == len(r.text) for r in got["repeated_passages"][1].collect())
    before, after = map(texts, got["benchmark_passages"])
    bench = [(r.item_id, r.text, 0) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hit = {i for i, w in brute_windows([(i, t) for i, t in before.items()], bench).items() if w[1]}
    assert hit and set(after) == set(before) - hit
    docs, out = got["packing"]
    assert {r.doc_id for r in out.select("doc_id").collect()} == set(texts(docs))


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 100 and out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).where("n <> d").count() == 0


def test_queries_have_the_contracts_columns(spark):
    want = {
        "op2_": ["doc_id", "held_out", "lang_pred", "score"], "op3_": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], "op5_": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op6_": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], "op7_": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], "op8_": ["doc_id", "held_out", "score", "predicted"],
        "op9_": ["doc_id", "n_shingles", "component_id"], "op10_": ["query_id", "rank", "vec_id", "score"],
    }
    for name, f in queries.QUERIES.items():
        for start, columns in want.items():
            if name.startswith(start):
                assert f(spark, "/root/testdata/sf0.001").columns[: len(columns)] == columns
