"""Held-out rows of languages of a few hundred documents."""

import random

from pyspark.sql import functions as F

from kindred.llm import langid


def test_small_languages_are_calibrated(spark):
    rng = random.Random(14)
    parts = {"aa": ["ba", "la", "mi", "no"], "bb": ["sch", "ung", "ein", "tz"]}
    text = lambda x, n: " ".join("".join(rng.choices(parts[x], k=rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, text("aa" if i % 3 else "bb", rng.randrange(20, 80)), "aa" if i % 3 else "bb") for i in range(600)]
    rows += [(700, text("aa", 9), "one"), (701, "qu" * 30, "two"), (702, "qu qu" * 9, "two")]
    odd = [(1000 + i, " ".join("".join(rng.choices("qxzwvkjy", k=6)) for _ in range(40)), None) for i in range(9)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.col("doc_id") < 1000)
    assert set(model.langs) == {"aa", "bb", "one", "two"}  # each has counts
    assert all(0 < model.usual[x][1] < 10 for x in ("aa", "bb", "two")) and model.usual["one"] == (0.0, 1e9)
    model = langid.fit(docs, F.col("doc_id") < 600)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == x and not got[i].rejected for i, _, x in rows[:600])
    assert all(got[i].rejected for i, *_ in odd)
