"""Golden rows and properties of the linkage engine."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions import similarity as S
from kindred.functions.text import normalise, squash, transliterate
from kindred.operators import candidates, check, consistency, decide, dense, features, metrics, tokenmap
from kindred.sources import records as R

NAMES = [
    ("Acme Bolts Pvt. Ltd.", "acme bolts pvt ltd", "acme bolts", "acmebolts", 0),
    ("Smith & Sons Intl Corp", "smith and sons international corp", "smith sons international", "smithsonsinternational", 0),
    ("sjdcement.com", "sjdcement", "sjdcement", "sjdcement", 1),
    ("www.Foo-Bar.co.in", "foobar", "foobar", "foobar", 1),
    ("foo bar.com", "foobar", "foobar", "foobar", 1),
    ("The Co", "the co", "the co", "theco", 0),
    ("007 Store", "7 store", "7 store", "7store", 0),
    ("St. John Svc", "street john service", "street john service", "streetjohnservice", 0),
    ("", "", "", "", 0),
    ("Café Société", "cafe societe", "cafe societe", "cafesociete", 0),
]
ADDRESSES = [
    ("No. 0012, MG Rd, Bengaluru 560001", "no 12 mg road bengaluru 560001", "mg bengaluru", "12 560001", "12", 0),
    ("Flat 4B, 221 Baker St, London", "flat 4b 221 baker street london", "baker london", "221", "221", 0),
    ("A-12 Park", "a 12 park", "park", "12", "", 0),
    ("#45, 2nd Floor", "45 2nd floor", "", "45", "45", 0),
    ("12 bis R de Lyon, 69007 Lyon", "12 bis rue de lyon 69007 lyon", "bis lyon lyon", "12 69007", "12", 0),
    ("n° 5 rue X", "5 rue x", "", "5", "5", 0),
    ("Nos 5, Hill", "nos 5 hill", "nos hill", "5", "", 0),
    ("   ", "", "", "", "", 1),
]


def test_names(spark):
    df = spark.createDataFrame([(str(i), n[0], "", "x") for i, n in enumerate(NAMES)], R.SCHEMA)
    got = {r.entity_id: (r.name_norm, r.name_core, r.name_nospace, r.is_domain) for r in normalise(df).collect()}
    assert got == {str(i): n[1:] for i, n in enumerate(NAMES)}


def test_addresses(spark):
    df = spark.createDataFrame([(str(i), "", a[0], "x") for i, a in enumerate(ADDRESSES)], R.SCHEMA)
    got = {r.entity_id: (r.addr_norm, r.addr_words, r.addr_nums, r.house_num, r.addr_empty) for r in normalise(df).collect()}
    assert got == {str(i): a[1:] for i, a in enumerate(ADDRESSES)}


def test_indic(spark):
    assert squash("praaivett") == "praivet"
    assert transliterate("abc") == "abc" and transliterate("राम").isascii()
    df = spark.createDataFrame([("S2-1", "राम 12", "", "x")], R.SCHEMA)
    row = normalise(df, indic=True).first()
    assert row.name_nonlatin == 1 and row.name_norm.endswith("12") and len(row.name_norm) > 3


def naive_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=90), st.text("abc ", max_size=90))
def test_lcs_of_strings(a, b):
    assert S._lcs(a, b) == naive_lcs(a, b)


def test_ratio(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choices("abcd ", k=rng.randrange(0, 75))), "".join(rng.choices("abcd ", k=rng.randrange(0, 75)))) for _ in range(150)] + [("", ""), ("", "a"), ("x" * 70, "x" * 69)]
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", S.ratio(F.col("a"), F.col("b")).alias("r")).collect():
        n = len(r.a) + len(r.b)
        assert r.r == pytest.approx(100.0 if not n else 200 * naive_lcs(r.a, r.b) / n)


def test_pair_similarities():
    assert S.jaro_winkler_pair("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert S.jaro_winkler_pair("", "") == 1 and S.jaro_winkler_pair("a", "") == 0
    assert S.token_set("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100 and S.token_set("", "a") == 0
    assert S.token_set("a b", "c d") == S.indel("a b", "c d") and S.indel("", "") == 100
    assert S.partial("abc", "xxabcxx") == 100 and S.partial("", "a") == 0


def pairs_of(spark, rows):
    return spark.createDataFrame(rows, "s1_id string, cand_id string, prob double")


def test_decisions(spark):
    p = pairs_of(spark, [("S1-1", "x", 0.9), ("S1-2", "x", 0.8), ("S1-2", "y", 0.6), ("S1-3", "z", 0.1)])
    assert {(r.s1_id, r.cand_id) for r in decide.one_to_one(p).collect()} == {("S1-1", "x"), ("S1-2", "y"), ("S1-3", "z")}
    assert {r.cand_id for r in decide.threshold(p, 0.66, 0.58).collect()} == {"x", "y"}
    assert {r.cand_id for r in decide.threshold(p, 0.66).collect()} == {"x"}
    q = pairs_of(spark, [("S1-1", "a", 0.9), ("S1-1", "b", 0.6), ("S1-2", "c", 0.1)])
    assert {r.cand_id for r in decide.expected_f(q).collect()} == {"a", "b"}


def test_metrics(spark):
    pred = spark.createDataFrame([("e", "a"), ("e", "b"), ("e", "c")], "s1_id string, cand_id string")
    true = spark.createDataFrame([("e", "a"), ("e", "c")], "s1_id string, cand_id string")
    ids = spark.createDataFrame([("e",)], "s1_id string")
    assert metrics.report(pred, true, ids).first().macro_f05 == pytest.approx(0.714286, abs=1e-6)
    none = true.limit(0)
    assert metrics.report(none, none, ids).first().macro_f05 == 1
    assert metrics.report(none, true, ids).first().macro_f05 == 0


def test_second_pass(spark):
    p = spark.createDataFrame([("A", "c1", 0.95), ("A", "c2", 0.92), ("A", "c3", 0.2)], "s1_id string, cand_id string, p double")
    pool = spark.createDataFrame([("c1", "acme bolts", "12"), ("c2", "acme", "12"), ("c3", "acme nuts", "")], "entity_id string, name_core string, house_num string")
    ctx = {r.cand_id: r for r in consistency.probabilities(p, consistency.top2(p)).collect()}
    assert [(ctx[c].p_rank, ctx[c].p_max_other, ctx[c].n_conf_others) for c in ("c1", "c2", "c3")] == [(1, 0.92, 1), (2, 0.95, 1), (3, 0.95, 2)]
    prof = {r.cand_id: (r.prof_name_cov, r.prof_name_n) for r in consistency.profile(p, pool, "name_core", "name").collect()}
    assert prof == {"c1": (0.5, 2), "c2": (1.0, 1), "c3": (0.5, 2)}
    house = {r.cand_id: (r.prof_house_support, r.conf_house_agree) for r in consistency.houses(p, pool).collect()}
    assert house == {"c1": (1, 1.0), "c2": (1, 1.0), "c3": (0, 0.0)}


def test_house_features(spark):
    base = dict(addr_nums1="12 560001", addr_nums2="12 560002", house_num1="12", house_num2="112")
    df = spark.createDataFrame([tuple(base.values())], list(base))
    r = df.select(*(c.alias(k) for k, c in features.house_features().items())).first()
    assert (r.house_lev, r.house_one_edit, r.house_prefix, r.house_neq, r.house_eq, r.nums_near) == (1, 1, 1, 1, 0, 1)


def test_single_candidate_context(spark):
    df = spark.createDataFrame([("A", "c", 50.0, 50.0, 0.5, 1)], "s1_id string, cand_id string, name_tsr double, addr_tsr double, cos_all double, house_eq int")
    r = features.context(df).first()
    assert (r.best0_gap, r.margin0, r.rank0, r.n_cands) == (1.0, 0.0, 1, 1)


def test_tokenmap(spark):
    df = spark.createDataFrame([("pune mh",)], "a string")
    assert df.select(tokenmap.mapped(F.col("a"), {"mh": "maharashtra"})).first()[0] == "pune maharashtra"
    rows = spark.createDataFrame([("a road new york", "a road ny")] * 3 + [("b maharashtra", "b mh")] * 3, "a string, b string")
    assert tokenmap.resolved(tokenmap.mine(rows, least=2)) == {"ny": "new york", "mh": "maharashtra"}


def test_blocking_small_pools(spark):
    one = normalise(spark.createDataFrame([("S1-1", "red bolt", "", "x"), ("S1-2", "lone", "", "y")], R.SCHEMA))
    pool = normalise(spark.createDataFrame([("S2-1", "red bolt", "", "x"), ("S2-2", "red nut", "", "x")], R.SCHEMA))
    assert candidates.block(one, pool).count() == 0  # too small a pool for any term to count
    got = candidates.topk(one, pool, candidates.channels(1.0)["name"]).collect()
    assert {(r.s1_id, r.cand_id) for r in got} == {("S1-1", "S2-1"), ("S1-1", "S2-2")}


def test_dense_cells_recall(spark):
    from kindred.plans import views

    one, pool = views.vectors(spark, "/root/testdata/sf0.01")
    exact = {(r.s1_id, r.cand_id) for r in dense.exact(one, pool).collect()}
    assert exact == {(r.s1_id, r.cand_id) for r in dense.cells(one, pool, count=16, probes=16).collect()}
    near = {(r.s1_id, r.cand_id) for r in dense.cells(one, pool, count=16, probes=12).collect()}
    assert len(exact & near) >= 0.8 * len(exact)


def test_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA "quoted" \\ name\t\tus\n')
    row = R.read_source(spark, str(tmp_path / "a.tsv")).first()
    assert row.business_name == 'A "quoted" \\ name' and row.business_address == ""
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-2\nS1-2\t\n")
    pairs, ids = R.read_ground_truth(spark, str(tmp_path / "t.tsv"))
    assert pairs.count() == 2 and ids.count() == 2
    lists = spark.createDataFrame([("S1-1", ["S2-1", "S2-1", "S1-9"])], "s1_id string, ids array<string>")
    R.write_id_lists(R.id_lists(ids, lists, "matched_entity_ids"), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\n"
    assert check.header(spark, str(tmp_path / "out"), "matched_entity_ids") == []
    assert check.header(spark, str(tmp_path / "none"), "x")
    assert check.rows(spark, str(tmp_path / "out")).count() == 2


def test_entry_without_subpackage():
    import __spark_entry__

    assert {"flagship_link", "blk_all_topk"} <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_blocks_of_candidates(spark, monkeypatch):
    """Many small blocks, equal rows and repeated ids: the same best rows as from all pairs, and no pair is shuffled."""
    import math
    from collections import Counter

    rng = random.Random(3)
    words = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(60)]
    one = [(f"S1-{i}", rng.choice(texts), "", rng.choice("xy")) for i in range(40)] + [("S1-90", "wa wb", "", "x"), ("S1-90", "wb wc wc", "", "x")]
    pool = [(f"S2-{i}", rng.choice(texts), "", rng.choice("xy")) for i in range(150)] + [("S3-90", "wa wb", "", "x"), ("S3-90", "wb", "", "x")]
    channel = candidates.Channel("name", F.col("name_core"), 3, 0.6)

    def counted(rows):
        out = {}
        for i, t, _, c in rows:
            out.setdefault((i, c), Counter()).update(t.split())
        return out

    q, p, n = counted(one), counted(pool), Counter(c for *_, c in pool)
    df = Counter((c, t) for (_, c), ts in p.items() for t in ts)
    idf = {k: math.log((1 + n[k[0]]) / (1 + m)) + 1 for k, m in df.items() if 2 <= m <= 0.6 * n[k[0]]}

    def unit(key, ts):
        w = {t: (1 + math.log(m)) * idf[key[1], t] for t, m in ts.items() if (key[1], t) in idf}
        return {t: x / math.sqrt(sum(y * y for y in w.values())) for t, x in w.items()}

    a, b = ({k: unit(k, ts) for k, ts in side.items()} for side in (q, p))
    want = set()
    for (i, c), x in a.items():
        got = [(-round(sum(w * y.get(t, 0) for t, w in x.items()), 6), j) for (j, d), y in b.items() if c == d]
        want |= {(i, j, -s) for s, j in sorted(g for g in got if g[0] < -0.05)[:3]}
    monkeypatch.setattr(candidates, "POOL", (60, 9), raising=False)
    monkeypatch.setattr(candidates, "QUERIES", (30, 4), raising=False)
    sides = [normalise(spark.createDataFrame(x, R.SCHEMA)) for x in (one, pool)]
    top = candidates.topk(*sides, channel)
    assert {tuple(r) for r in top.collect()} == want
    assert "Join" not in top._jdf.queryExecution().optimizedPlan().toString()  # a finished result, not pairs yet to be shuffled


def test_truth_and_aligned_pairs_carry_little(spark):
    """Truth joins digests of texts; pairs to align have equal numbers of tokens before their texts are joined."""
    from kindred.plans import catalogue, views

    true, _ = views.truth(spark, "/root/testdata/sf0.001")
    assert "sha2(" in true._jdf.queryExecution().optimizedPlan().toString()
    rows = catalogue._text_pairs(spark, "/root/testdata/sf0.001", 0.06).collect()
    assert rows and all(len(r.a.split()) == len(r.b.split()) for r in rows)


def test_blocks_are_not_shuffled_for_each_other(spark, monkeypatch):
    """Many blocks shuffle little more than one block: the disk doesn't grow with pairs of blocks."""
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("bcdfgh") + rng.choice("aeiou") + rng.choice("klmnpr") for _ in range(60))
    one, pool = (normalise(spark.createDataFrame([(f"S{s}-{i}", text(), "", "x") for i in range(400)], R.SCHEMA)) for s in (1, 2))
    channel = candidates.Channel("name", F.col("name_core"), 3, 0.9)
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    at, start = [], written()
    for most in (1 << 20, 25):
        monkeypatch.setattr(candidates, "POOL", (1 << 30, most))
        monkeypatch.setattr(candidates, "QUERIES", (1 << 30, most))
        at.append((candidates.topk(one, pool, channel).collect(), written() - start))
        start = written()
    (few, single), (same, many) = at
    assert {tuple(r) for r in few} == {tuple(r) for r in same} and len(few) == 1200
    assert many < 2 * single, (single, many)


def test_equal_pairs_are_compared_once():
    import pyarrow as pa

    seen = []

    def f(a, b):
        seen.append((a, b))
        return float(len(a) - len(b))

    x, y = ["abc", "ab", "abc", None, "l" * 300] * 3, ["b", "b", "b", "x", "m" * 20] * 3
    assert S.of_pairs(f, pa.array(x), pa.array(y)).to_pylist() == [2.0, 1.0, 2.0, -1.0, 280.0] * 3
    assert sorted(set(seen)) == sorted(seen[:3] + [("l" * 300, "m" * 20)]) and len(seen) == 6  # long texts are not kept


def test_steps_of_candidates_leave_no_shuffle_files(spark):
    """Only the last of the many shuffles may still be there."""
    import time

    def shuffles():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = (found.apply(i).getName() for i in range(found.size()))
        return {int(n.split("_")[1]) for n in names if n.startswith("shuffle_")}

    sides = [normalise(spark.createDataFrame([(f"S{s}-{i}", f"red w{i % 7} w{i % 5}", "", "x") for i in range(30)], R.SCHEMA)) for s in (1, 2)]
    old = shuffles()
    top = candidates.topk(*sides, candidates.Channel("name", F.col("name_core"), 3, 0.9))
    end = time.time() + 10
    while len(left := shuffles() - old) > 3 and time.time() < end:
        time.sleep(0.2)
    assert len(left) <= 3 and top.count() == 90


def test_columns_go_once_to_a_bucket(spark, monkeypatch):
    """Pairs get both records' columns as by plain joins, also of candidates that the pool lacks; ids that repeat are joined pair by pair."""
    monkeypatch.setattr(features, "BUCKET", 3, raising=False)
    records = lambda s, n: [(f"S{s}-{i}", f"name {s} {i}", f"{i} road", "xy"[i % 2]) for i in range(n)]
    one, pool = records(1, 6), records(2, 20)
    pairs = [(f"S1-{i}", f"S2-{j}", i / 10) for i in range(6) for j in range(i % 2, 20, 2) if i != 4] + [("S1-4", "S2-99", 0.5)]
    cands = spark.createDataFrame(pairs, "s1_id string, cand_id string, cos_addr double")
    for more in ([], [("S2-3", "other", "", "x")]):
        a, b = (normalise(spark.createDataFrame(x, R.SCHEMA)) for x in (one, pool + more))
        got = features.joined(cands, a, b, ("name_core", "house_num"))
        left, right = ({} for _ in range(2))
        for side, rows in ((left, a), (right, b)):
            for r in rows.collect():
                side.setdefault(r.entity_id, []).append(r)
        want = {(i, j, s, x.country, x.name_core, x.house_num, y and y.name_core, y and y.house_num) for i, j, s in pairs for x in left[i] for y in right.get(j, [None])}
        rows = [(r.s1_id, r.cand_id, r.cos_addr, r.country, r.name_core1, r.house_num1, r.name_core2, r.house_num2) for r in got.collect()]
        assert len(rows) == len(want) and set(rows) == want and "addr_norm1" not in got.columns and got.first().cos_all == 0.0
        assert ("MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()) and ("Join LeftOuter, (cand_id" in got._jdf.queryExecution().optimizedPlan().toString()) == bool(more)


@pytest.mark.parametrize("name", ["ctx_competition", "cand_top2", "ctx_rank_margin", "decide_expected_f", "decide_threshold"])
def test_queries_on_candidates_start_from_one_list(spark, name):
    """Of what the candidates need on the way, nothing is on the disk when the rest of the query begins."""
    from pathlib import Path

    from kindred.operators.settle import settled
    from kindred.plans import catalogue

    settled(spark.range(1))
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    old = set(folder.glob("rdd-*"))
    df = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(set(folder.glob("rdd-*")) - old) == 1
    assert df.count() > 0


def test_channels_unite_without_a_shuffle_of_pairs(spark):
    """An entity's lists meet as texts; its pairs are made where they meet."""
    sides = [normalise(spark.createDataFrame([(f"S{s}-{i}", f"red w{i % 7} w{i % 5}", f"{i % 3} road", "x") for i in range(30)], R.SCHEMA)) for s in (1, 2)]
    table = {k: c for k, c in candidates.channels(0.9, 0.9).items() if k != "namechar"}
    out = candidates.block(*sides, table)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    rows = {(r.s1_id, r.cand_id): r for r in out.collect()}
    for name, c in table.items():
        want = {(r.s1_id, r.cand_id): r[f"cos_{name}"] for r in candidates.topk(*sides, c).collect()}
        assert want and {k: r[f"cos_{name}"] for k, r in rows.items() if r[f"cos_{name}"] > 0} == want
