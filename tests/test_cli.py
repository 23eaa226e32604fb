"""Every stage of the command line, on records made up here, and the folds of the models."""

import random
import zlib

import pytest

from kindred import cli
from kindred.operators import dense, learn

HEADER = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


def encoder(texts):
    """A stand-in for a sentence encoder: counts of hashed character trigrams."""
    out = []
    for t in texts:
        v = [0.0] * 32
        for i in range(len(t) - 2):
            v[zlib.crc32(t[i : i + 3].encode()) % 32] += 1
        out.append(v)
    return out


def records(folder, split, n, seed):
    """Three sources of n entities, an eighth of the pool as domains, and their truth."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(4, 9)))
    sources, truth = {1: [], 2: [], 3: []}, []
    for i in range(n):
        name, street, country = [word() for _ in range(3)], f"{rng.randrange(1, 90)} {word()} Road, {word()}", "US" if i % 2 else "India"
        sources[1].append((f"S1-{i}", " ".join(name).title() + " Ltd", street, country))
        found = []
        for s in (2, 3):
            if rng.random() < 0.8:
                odd = rng.random() < 0.2
                sources[s].append((f"S{s}-{i}", "".join(name[:2]) + ".com" if odd else " ".join(name) + " Limited", "" if odd else street.replace("Road", "Rd"), country))
                found.append(f"S{s}-{i}")
        truth.append((f"S1-{i}", ",".join(found)))
    for s, rows in sources.items():
        (folder / f"{split}_source{s}.tsv").write_text(HEADER + "".join("\t".join(r) + "\n" for r in rows))
    (folder / f"{split}_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join("\t".join(r) + "\n" for r in truth))
    return dict(truth)


def test_stages(spark, tmp_path, capsys):
    data = tmp_path / "data"
    data.mkdir()
    records(data, "train", 300, 1)
    truth = records(data, "test", 200, 2)
    run = lambda stage, *more: cli.main([stage, "--work", str(tmp_path / "work"), "--data", str(data), *more])
    small = ("--n-train", "160", "--n-val", "60", "--rounds", "3", "--leaf", "2")
    for split in ("train", "test"):
        run("prepare", "--split", split)
    run("equiv")
    run("block-eval", "--n", "20")
    for split in ("train", "test"):
        run("block", "--split", split)
        run("embed-encode", "--split", split, "--encoder", "tests.test_cli:encoder", "--dims", "32")
        run("embed-block", "--split", split)
        run("merge-emb", "--split", split)
        run("featurize", "--split", split)
    run("train", *small)
    run("train2", *small)
    run("evaluate")
    run("predict2", "--split", "test")
    work = tmp_path / "work"
    lines = next((work / "matching_results").glob("part-*")).read_text().splitlines()[1:]
    got = dict(line.split("\t") for line in lines)
    assert set(got) == set(truth)
    right = {(i, x) for i, ids in truth.items() for x in ids.split(",") if x}
    found = {(i, x) for i, ids in got.items() for x in ids.split(",") if x}
    assert len(right & found) >= 0.6 * len(right) and len(right & found) >= 0.8 * len(found)
    oof = spark.read.parquet(str(work / "train_oof"))
    assert {r.fold for r in oof.select("fold").distinct().collect()} == {0, 1, None}
    assert run("validate", "--split", "test", "--check-ids") == 0
    bad = tmp_path / "bad.tsv"
    bad.write_text("source1_entity_id\tmatched_entity_ids\nS1-0\tS2-0,S2-0\nno tab\n")
    assert run("validate", "--split", "test", "--matching", str(bad)) == 1
    said = capsys.readouterr().out
    assert all(x in said for x in ("malformed_row", "duplicate_id", "missing_s1", "top features", "PASS", "FAIL"))
    bad.write_text("source1_entity_id,matched_entity_ids\n")
    assert run("validate", "--split", "test", "--matching", str(bad)) == 1


def test_cross_fit(spark):
    rng = random.Random(3)
    rows = [(f"S1-{i}", f"S2-{i}-{k}", float(k), rng.random(), int(k == 0)) for i in range(40) for k in range(3)]
    rows = spark.createDataFrame(rows, "s1_id string, cand_id string, x double, y double, label int")
    ids = rows.select("s1_id").distinct().where("s1_id < 'S1-3'")
    full = learn.fit(rows, ["x", "y"], rounds=2, depth=2, leaf=1)
    got = learn.cross_fit(rows, ["x", "y"], ids, full, rounds=2, depth=2, leaf=1)
    assert got.count() == rows.count() and {"fold", "p"} <= set(got.columns)
    known = {r.s1_id for r in ids.collect()}
    assert all((r.fold is None) == (r.s1_id not in known) for r in got.collect())
    assert all((r.p > 0.5) == (r.label == 1) for r in got.collect())
    assert learn.importances(full, ["x", "y"])[0][0] == "x"


@pytest.mark.parametrize("n, want", [(0, 64), (2_000, 64), (10_000, 250), (10_300_000, 2048)])
def test_cell_count(n, want):
    assert dense.cell_count(n) == want
