"""Stand-in relations over the test tables that the catalogue's queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.text import normalise
from kindred.operators import candidates
from kindred.sources import records as R

MOST = 0.1  # small tables lose most words at the default share


def documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return R.sides(normalise(R.documents_as_records(spark, d)))


def parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return R.sides(normalise(R.parts_as_records(spark, d)))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """s1_id, cand_id, prob: cosines of all words as a fixed scorer."""
    one, pool = documents(spark, d)
    return candidates.topk(one, pool, candidates.channels(MOST)["all"]).withColumnRenamed("cos_all", "prob")


def truth(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """((s1_id, cand_id) with one text, (s1_id) of all reference documents)."""
    one, pool = R.sides(R.documents_as_records(spark, d))
    text = F.sha2("business_name", 256).alias("text")  # texts are not shuffled
    same = one.select(F.col("entity_id").alias("s1_id"), text, "country").join(pool.select(F.col("entity_id").alias("cand_id"), text, "country"), ["text", "country"])
    return same.select("s1_id", "cand_id"), one.select(F.col("entity_id").alias("s1_id"))


def part_pairs(spark: SparkSession, d: str, *only: str) -> DataFrame:
    """Pairs of parts of one type, name and brand-like key, with both records' columns, or those in ``only``."""
    from kindred.operators import features

    one, pool = parts(spark, d)
    top = candidates.topk(one, pool, candidates.channels(0.5)["addr"])
    return features.joined(top, one, pool, only or None)


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = R.table(spark, d, "embeddings").select(F.concat(F.when(F.col("vec_id") % 5 == 0, "S1-").otherwise("S2-"), F.col("vec_id").cast("string")).alias("entity_id"), F.col("label").cast("string").alias("country"), "embedding")
    return R.sides(rows)
