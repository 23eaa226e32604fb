"""Rules of the output files, as DataFrames of findings.

A finding has level (error or warning), rule, n and up to five examples in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def header(spark: SparkSession, path: str, second: str) -> list[str]:
    """What is wrong with a file as a whole: missing, empty, commas for tabs, or another header."""
    try:
        first = spark.read.text(path).limit(1).collect()
    except Exception as e:  # noqa: BLE001  whatever the file system says, the file can't be read
        return [f"missing file: {type(e).__name__}"]
    if not first:
        return ["empty file"]
    got, want = first[0].value, f"source1_entity_id\t{second}"
    if got == want:
        return []
    return ["comma separated"] if "," in got and "\t" not in got else [f"header {got!r}"]


def rows(spark: SparkSession, path: str) -> DataFrame:
    """s1_id, ids (text), malformed, of a file's lines below the header; blank lines don't count."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith("value", F.lit("source1_entity_id")))
    parts = F.split("value", "\t", 2)
    return lines.select(parts[0].alias("s1_id"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("ids"), (F.size(parts) < 2).alias("malformed"))


def findings(out: DataFrame, required: DataFrame, known: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """Findings of an output (s1_id, ids as comma-joined text) against the required (s1_id), known ids (id) and candidates (s1_id, ids)."""
    malformed = F.col("malformed") if "malformed" in out.columns else F.lit(False)
    out = out.withColumn("_bad", malformed)
    good = out.where(~F.col("_bad"))
    items = lambda df: df.select("s1_id", F.explode(F.array_remove(F.split("ids", ","), "")).alias("id"))
    flat = items(good)
    rule = lambda level, name, df, c: df.select(F.lit(level).alias("level"), F.lit(name).alias("rule"), F.col(c).alias("x"))
    found = [
        rule("error", "malformed_row", out.where("_bad"), "s1_id"),
        rule("error", "duplicate_s1_row", good.groupBy("s1_id").count().where("count > 1"), "s1_id"),
        rule("error", "duplicate_id", flat.groupBy("s1_id", "id").count().where("count > 1"), "id"),
        rule("error", "self_match", flat.where(F.startswith("id", F.lit("S1-"))), "id"),
        rule("error", "wrong_prefix", flat.where(~F.col("id").rlike("^S[123]-")), "id"),
        rule("error", "missing_s1", required.select("s1_id").distinct().join(good, "s1_id", "left_anti"), "s1_id"),
        rule("error", "unexpected_s1", good.select("s1_id").distinct().join(required, "s1_id", "left_anti"), "s1_id"),
    ]
    if known is not None:
        found.append(rule("error", "unknown_id", flat.where(F.col("id").rlike("^S[23]-")).join(known, "id", "left_anti"), "id"))
    if candidates is not None:
        found.append(rule("warning", "match_outside_candidates", flat.join(items(candidates), ["s1_id", "id"], "left_anti"), "id"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    # at most five examples: the smallest of each rule, ranked before they are gathered
    from pyspark.sql import Window

    ranked = every.groupBy("level", "rule", "x").agg(F.count("*").alias("m")).withColumn("r", F.row_number().over(Window.partitionBy("level", "rule").orderBy("x")))
    return ranked.groupBy("level", "rule").agg(F.sum("m").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.col("x")))), ",").alias("examples"))
