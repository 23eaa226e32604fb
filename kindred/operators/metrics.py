"""Macro F of beta 1/2 over entities, and pair counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f_beta(n_pred: Column, n_true: Column, tp: Column, beta: float = 0.5) -> Column:
    b2 = beta * beta
    p, r = tp / F.nullif(n_pred, F.lit(0)), tp / F.nullif(n_true, F.lit(0))
    return F.when((n_pred == 0) & (n_true == 0), 1.0).when(tp == 0, 0.0).otherwise((1 + b2) * p * r / (b2 * p + r))


def entities(pred: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    """s1_id, n_pred, n_true, tp for every entity of ``ids``; a missing prediction is an empty list."""
    both = pred.select("s1_id", "cand_id").distinct().withColumn("p", F.lit(1)).join(truth.select("s1_id", "cand_id").withColumn("t", F.lit(1)), ["s1_id", "cand_id"], "full")
    per = both.groupBy("s1_id").agg(F.count("p").alias("n_pred"), F.count("t").alias("n_true"), F.count(F.col("p") + F.col("t")).alias("tp"))
    return ids.select("s1_id").join(per, "s1_id", "left").fillna(0)


def report(pred: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: macro_f05, n, pair_precision, pair_recall, singleton_acc."""
    rows = entities(pred, truth, ids).withColumn("f", f_beta(F.col("n_pred"), F.col("n_true"), F.col("tp")))
    over = lambda a, b: F.round(a / F.greatest(F.lit(1), b), 6)
    single = F.col("n_true") == 0
    return rows.agg(
        over(F.coalesce(F.sum("f"), F.lit(0.0)), F.count("*")).alias("macro_f05"), F.count("*").alias("n"), over(F.coalesce(F.sum("tp"), F.lit(0)), F.coalesce(F.sum("n_pred"), F.lit(0))).alias("pair_precision"),
        over(F.coalesce(F.sum("tp"), F.lit(0)), F.coalesce(F.sum("n_true"), F.lit(0))).alias("pair_recall"), over(F.count_if(single & (F.col("n_pred") == 0)), F.count_if(single)).alias("singleton_acc"),
    )
