"""A short item beside a long one that holds it."""

from kindred.llm import decontam


def test_short_item_beside_a_long_one(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    short = [(k, " ".join(long[k : k + 5])) for k in range(len(long) - 4)]  # some are kept marks of the long one
    bench = spark.createDataFrame([*short, (99, " ".join(long))], "item_id long, text string")
    rows = [(10 * k + n, t + " other" * (n - 5)) for k, t in short for n in range(5, 10)]
    docs = spark.createDataFrame([*rows, (900, "x " + " ".join(long)), (901, "x y")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.decontaminate(docs, bench).collect()}
    want = {10 * k + n: (n, 5, [str(k)]) for k, _ in short for n in range(5, 10)}
    assert got == want | {900: (21, 20, sorted(str(i) for i in [*range(len(short)), 99])), 901: (2, 0, [])}
