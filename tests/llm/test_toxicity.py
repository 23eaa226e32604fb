"""Texts that differ stay in the fitting sample, copies don't."""

import random
import zlib

from pyspark.sql import functions as F

from kindred.llm import toxicity


def test_sample_keeps_different_texts(spark):
    rng = random.Random(15)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randrange(4, 9))) for _ in range(3000)]
    first = min(("".join(rng.choices("klmnopqrst", k=8)) for _ in range(20000)), key=lambda w: zlib.crc32(w.encode()))
    hot = first + " " + " ".join(rng.choices(vocab, k=6))  # all documents share it, and its first word has a small checksum
    copies = "copied " + " ".join(rng.choices(vocab, k=200))
    rows, labels = [], []
    for i in range(240):
        toxic = i % 2
        w = rng.choices(vocab, k=30) + (["scum", "moron"] if toxic else [])
        rng.shuffle(w)
        rows.append((i, hot + " " + " ".join(w)))
        labels.append((i, toxic))
    near = [copies.split() for _ in range(30)]  # toxic labels, equal or one word changed
    for i, w in enumerate(near):
        if i % 2:
            w[i] = vocab[i]
        rows.append((500 + i, " ".join(w)))
        labels.append((500 + i, 1))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lex = toxicity.fit(docs, marks, F.lit(True), share=0.05)
    assert {" scum ", " moron "} <= set(lex.weights) and " copied " not in lex.weights
    got = {r.doc_id: r for r in toxicity.score(docs, lex).collect()}
    assert all((got[i].n_matches > 0) == bool(i % 2) for i in range(240))
