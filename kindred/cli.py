"""Stages on the command line: ``python -m kindred.cli STAGE --work DIR``.

Each stage reads the tables of the ones before from the work folder and skips what is already
complete; tables are Parquet on any file system that Spark knows.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.text import normalise
from kindred.operators import candidates, check, consistency, decide, dense, features, learn, metrics, tokenmap
from kindred.sources import records as R


class Work:
    def __init__(self, spark: SparkSession, folder: str, data: str):
        self.spark, self.folder, self.data = spark, folder.rstrip("/"), data

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def done(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        if not self.done(name):
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.read(name)

    def sides(self, split: str) -> tuple[DataFrame, DataFrame]:
        return self.read(f"{split}_s1"), self.read(f"{split}_pool")

    def truth(self) -> tuple[DataFrame, DataFrame]:
        return R.read_ground_truth(self.spark, f"{self.data}/train_ground_truth.tsv")

    def probabilities(self, split: str, model: str) -> DataFrame:
        return learn.predict(learn.PipelineModel.load(f"{self.folder}/{model}"), self.read(f"{split}_feats")).select("s1_id", "cand_id", "p")


def names(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ("s1_id", "cand_id", "label", "p_")]


def prepare(w: Work, a: argparse.Namespace) -> None:
    for name, df in zip(("s1", "pool"), R.read_split(w.spark, w.data, a.split), strict=True):
        w.write(f"{a.split}_{name}_plain", normalise(df, indic=True))


def equiv(w: Work, a: argparse.Namespace) -> None:
    """Mines from the plain tables, so a second run finds the same rules."""
    pairs, _ = w.truth()
    maps = tokenmap.learn(w.read("train_s1_plain"), w.read("train_pool_plain"), pairs)
    rows = [(k, y, x) for k, t in maps.items() for y, x in t.items()]
    w.write("equiv", w.spark.createDataFrame(rows, "kind string, token string, replacement string"))
    for split in ("train", "test"):
        for name in ("s1", "pool"):
            if w.done(f"{split}_{name}_plain"):
                w.write(f"{split}_{name}", tokenmap.apply(w.read(f"{split}_{name}_plain"), maps))


def block(w: Work, a: argparse.Namespace) -> None:
    one, pool = w.sides(a.split)
    if a.n:
        one = learn.sample(one, a.n)
    w.write(f"{a.split}_cands", candidates.block(one, pool))


def block_eval(w: Work, a: argparse.Namespace) -> None:
    one, pool = w.sides("train")
    if a.country:
        one, pool = (x.where(F.col("country") == a.country) for x in (one, pool))
    one = learn.sample(one, a.n or 20_000)
    pairs, _ = w.truth()
    candidates.recall(candidates.block(one, pool), pairs, one.select(F.col("entity_id").alias("s1_id"))).show(truncate=False)


def embed_encode(w: Work, a: argparse.Namespace) -> None:
    """Vectors of all reference records, and of the pool's domains, names in other scripts and empty addresses.

    ``--encoder module:function`` names a function that maps a list of texts to rows of ``--dims`` floats.
    """
    module, _, name = (a.encoder or "").partition(":")
    if not name:
        raise SystemExit("embed-encode needs --encoder module:function")
    encoder = getattr(importlib.import_module(module), name)
    one, pool = w.sides(a.split)
    rows = one.select(*R.COLUMNS).unionByName(pool.where("is_domain = 1 or name_nonlatin = 1 or addr_empty = 1").select(*R.COLUMNS))
    if a.n:
        rows = learn.sample(rows, a.n)
    w.write(f"{a.split}_vectors", rows.select("entity_id", "country").join(dense.encode(rows, encoder, a.dims), "entity_id"))


def embed_block(w: Work, a: argparse.Namespace) -> None:
    """The dense pairs of a table of vectors (entity_id, country, embedding) in <split>_vectors."""
    one, pool = R.sides(w.read(f"{a.split}_vectors"))
    w.write(f"{a.split}_cands_emb", dense.cells(one, pool))


def merge_emb(w: Work, a: argparse.Namespace) -> None:
    embed_block(w, a)
    w.write(f"{a.split}_cands_merged", dense.merge(w.read(f"{a.split}_cands"), w.read(f"{a.split}_cands_emb")))


def featurize(w: Work, a: argparse.Namespace) -> None:
    one, pool = w.sides(a.split)
    cands = w.read(f"{a.split}_cands_merged" if w.done(f"{a.split}_cands_merged") else f"{a.split}_cands")
    w.write(f"{a.split}_feats", features.build(cands, one, pool, w.truth()[0] if a.split == "train" else None))


def _parts(w: Work, a: argparse.Namespace) -> DataFrame:
    """s1_id, part (train, valid or null) of all entities with features."""
    ids = w.read("train_feats").select(F.col("s1_id").alias("entity_id")).distinct()
    return learn.split(ids, a.n_train, a.n_val).withColumnRenamed("entity_id", "s1_id")


def _report(model: learn.PipelineModel, features: list[str]) -> None:
    print("top features:", [(k, round(v, 4)) for k, v in learn.importances(model, features)])


def train(w: Work, a: argparse.Namespace) -> None:
    parts = _parts(w, a).where("part is not null")
    rows = w.read("train_feats").join(parts, "s1_id").withColumn("_valid", F.col("part") == "valid")
    features = names(w.read("train_feats"))
    model = learn.fit(rows, features, rounds=a.rounds, depth=8, valid="_valid", leaf=a.leaf)
    _report(model, features)
    model.write().overwrite().save(f"{w.folder}/model")
    held = learn.predict(model, rows.where("_valid"), "prob").select("s1_id", "cand_id", "prob")
    _tune(w, "rule", held, parts.where("part = 'valid'").select("s1_id"))


def _tune(w: Work, name: str, pairs: DataFrame, ids: DataFrame) -> None:
    true = w.truth()[0].join(ids, "s1_id", "left_semi")
    rule, score = decide.tune(w.write(f"{name}_pairs", pairs), true, ids)
    w.write(name, w.spark.createDataFrame([(str(k), str(v)) for k, v in rule.items()] + [("macro_f05", str(score))], "key string, value string"))


def _rule(w: Work, name: str) -> dict:
    got = {r.key: r.value for r in w.read(name).collect()}
    return {k: v if k == "rule" else float(v) for k, v in got.items() if k != "macro_f05"}


def _second(w: Work, split: str, p: DataFrame) -> DataFrame:
    _, pool = w.sides(split)
    pruned = consistency.prune(p)
    more = consistency.build(pruned, pool, consistency.top2(p))
    return w.read(f"{split}_feats").join(more, ["s1_id", "cand_id"])


def train2(w: Work, a: argparse.Namespace) -> None:
    """The second model learns from the first fold's entities, stops and is tuned on the held-out ones.

    Probabilities of training entities come from the other fold's model, all others from the first pass's.
    ``--parts`` keeps that many sixteenths of the entities, for a quick run.
    """
    rows, parts = w.read("train_feats"), _parts(w, a)
    if a.parts:
        rows = rows.where(F.conv(F.substring(learn.digest("s1_id", 45), 32, 1), 16, 10).cast("int") < a.parts)
    full = learn.PipelineModel.load(f"{w.folder}/model")
    p = learn.cross_fit(rows, names(rows), parts.where("part = 'train'"), full, rounds=a.rounds, depth=8, leaf=a.leaf)
    p = w.write("train_oof", p.select("s1_id", "cand_id", "p", "fold"))
    table = w.write("train_feats2", _second(w, "train", p.drop("fold")))
    valid = parts.where("part = 'valid'").select("s1_id")
    known = p.groupBy("s1_id").agg(F.max("fold").alias("_own")).join(valid.withColumn("_valid", F.lit(True)), "s1_id", "left").fillna(False, ["_valid"])
    used = table.join(known.where("_own = 0 or _valid"), "s1_id")
    model = learn.fit(used, names(table), rounds=a.rounds, depth=8, valid="_valid", leaf=a.leaf)
    _report(model, names(table))
    model.write().overwrite().save(f"{w.folder}/model2")
    held = learn.predict(model, used.where("_valid").drop("p_"), "prob").select("s1_id", "cand_id", "prob")
    _tune(w, "rule2", held, valid.join(rows.select("s1_id").distinct(), "s1_id", "left_semi"))


def _outputs(w: Work, a: argparse.Namespace, pairs: DataFrame, rule: dict, cands: DataFrame) -> None:
    one, pool = w.sides(a.split)
    ids = one.select(F.col("entity_id").alias("s1_id"))
    chosen = decide.lists(decide.apply(pairs, rule))
    listed = decide.lists(cands)
    R.write_id_lists(R.id_lists(ids, chosen, "matched_entity_ids"), f"{w.folder}/matching_results")
    R.write_id_lists(R.id_lists(ids, listed, "candidate_entity_ids"), f"{w.folder}/candidate_pairs")
    text = lambda df: df.select("s1_id", F.array_join("ids", ",").alias("ids"))
    check.findings(ids.join(text(chosen), "s1_id", "left").fillna("", ["ids"]), ids, pool.select(F.col("entity_id").alias("id")), text(listed)).show(truncate=False)


def predict(w: Work, a: argparse.Namespace) -> None:
    pairs = w.probabilities(a.split, "model").withColumnRenamed("p", "prob")
    _outputs(w, a, pairs, _rule(w, "rule"), pairs)


def predict2(w: Work, a: argparse.Namespace) -> None:
    table = w.write(f"{a.split}_feats2", _second(w, a.split, w.probabilities(a.split, "model")))
    pairs = learn.predict(learn.PipelineModel.load(f"{w.folder}/model2"), table, "prob").select("s1_id", "cand_id", "prob")
    _outputs(w, a, pairs, _rule(w, "rule2"), pairs)


def evaluate(w: Work, a: argparse.Namespace) -> None:
    pairs, ids = w.truth()
    metrics.report(decide.apply(w.read("rule_pairs"), _rule(w, "rule")), pairs, w.read("rule_pairs").select("s1_id").distinct()).show()


def validate(w: Work, a: argparse.Namespace) -> int:
    """Findings of ``--matching`` and ``--candidate`` against the split's records under ``--data``; 1 if any is an error."""
    spark, errors = w.spark, []
    required = R.read_ids(spark, f"{w.data}/{a.split}_source1.tsv").withColumnRenamed("id", "s1_id")
    known = None
    if a.check_ids:
        known = R.read_ids(spark, f"{w.data}/{a.split}_source2.tsv").unionByName(R.read_ids(spark, f"{w.data}/{a.split}_source3.tsv"))
    files = [(a.matching or f"{w.folder}/matching_results", "matched_entity_ids"), (a.candidate or f"{w.folder}/candidate_pairs", "candidate_entity_ids")]
    read = {}
    for path, second in files:
        wrong = check.header(spark, path, second)
        if second == "candidate_entity_ids" and wrong and wrong[0].startswith("missing file"):
            print(f"warning: {path}: {wrong[0]}")
            continue
        errors += [f"{path}: {x}" for x in wrong]
        if not wrong:
            read[second] = (path, check.rows(spark, path))
    for second, (path, rows) in read.items():
        listed = read.get("candidate_entity_ids", (None, None))[1] if second == "matched_entity_ids" else None
        for r in check.findings(rows, required, known, listed).collect():  # a row for each rule
            line = f"{path}: {r.rule}: {r.n}, such as {r.examples}"
            if r.level == "error":
                errors.append(line)
            else:
                print("warning:", line)
    for line in errors:
        print("error:", line)
    print("FAIL" if errors else "PASS")
    return int(bool(errors))


STAGES = {f.__name__.replace("_", "-"): f for f in (prepare, equiv, block, block_eval, embed_encode, embed_block, merge_emb, featurize, train, train2, predict, predict2, evaluate, validate)}


def main(argv: list[str] | None = None) -> int:
    """The exit code: 1 if ``validate`` finds errors."""
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("stage", choices=STAGES)
    p.add_argument("--work", required=True)
    p.add_argument("--data", default=".")
    p.add_argument("--split", default="train")
    p.add_argument("--country")
    p.add_argument("--n", type=int, default=0)
    p.add_argument("--n-train", type=int, default=700_000)
    p.add_argument("--n-val", type=int, default=100_000)
    p.add_argument("--rounds", type=int, default=100)
    p.add_argument("--parts", type=int, default=0)
    p.add_argument("--leaf", type=int, default=100)
    p.add_argument("--encoder")
    p.add_argument("--dims", type=int, default=384)
    p.add_argument("--matching")
    p.add_argument("--candidate")
    p.add_argument("--check-ids", action="store_true")
    a = p.parse_args(argv)
    return STAGES[a.stage](Work(SparkSession.builder.appName(f"kindred {a.stage}").getOrCreate(), a.work, a.data), a) or 0


if __name__ == "__main__":
    sys.exit(main())
