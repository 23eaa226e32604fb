"""Second pass: pruning, competition among probabilities, and leave-one-out profiles of an entity's sure matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.text import split_tokens

LEAST, SURE, CLIP = 0.005, 0.9, 1e-6


def prune(pairs: DataFrame, least: float = LEAST, top: int = 1) -> DataFrame:
    """Pairs with p of at least ``least``, and each entity's ``top`` best."""
    rank = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("p"), "cand_id"))
    return pairs.withColumn("_r", rank).where((F.col("p") >= least) | (F.col("_r") <= top)).drop("_r")


def top2(pairs: DataFrame) -> DataFrame:
    """cand_id, max1, max2 over all pairs; 0 if there is no second."""
    rank = F.row_number().over(Window.partitionBy("cand_id").orderBy(F.desc("p"), "s1_id"))
    best = pairs.withColumn("_r", rank).where(F.col("_r") <= 2)
    return best.groupBy("cand_id").agg(F.max(F.when(F.col("_r") == 1, F.col("p"))).alias("max1"), F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("p"))), F.lit(0.0)).alias("max2"))


def probabilities(pairs: DataFrame, tops: DataFrame, digits: int = 6) -> DataFrame:
    """Pairs with logit, rank, others' probabilities of the same entity, and the candidate's best other entity."""
    s1 = Window.partitionBy("s1_id")
    order = s1.orderBy(F.desc("p"), "cand_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sure = (F.col("p") >= SURE).cast("int")
    clip = F.least(F.greatest("p", F.lit(CLIP)), F.lit(1 - CLIP))
    second = F.coalesce(F.nth_value("p", 2).over(whole), F.lit(0.0))
    out = pairs.withColumns({
        "p_logit": F.round(F.log(clip / (1 - clip)), digits), "p_rank": F.row_number().over(order), "p_sum_others": F.round(F.sum("p").over(s1) - F.col("p"), digits),
        "p_max_other": F.when(F.col("p") == F.max("p").over(s1), second).otherwise(F.max("p").over(s1)), "n_conf_others": F.sum(sure).over(s1) - sure,
    })
    out = out.join(tops, "cand_id", "left")
    other = F.when(F.col("p") >= F.col("max1"), F.col("max2")).otherwise(F.col("max1"))
    return out.withColumn("cand_p_max_other_s1", other).withColumn("cand_p_gap", F.round(F.col("p") - other, digits)).drop("max1", "max2")


def profile(pairs: DataFrame, pool: DataFrame, column: str, name: str, digits: int = 6) -> DataFrame:
    """s1_id, cand_id, prof_<name>_cov, prof_<name>_n: share and number of a candidate's tokens that another sure match has."""
    tokens = pool.select(F.col("entity_id").alias("cand_id"), F.explode(F.array_distinct(split_tokens(F.col(column)))).alias("t"))
    sure = (F.col("p") >= SURE).cast("int")
    rows = pairs.select("s1_id", "cand_id", sure.alias("c")).join(tokens, "cand_id")
    rows = rows.withColumn("others", F.sum("c").over(Window.partitionBy("s1_id", "t")) - F.col("c"))
    got = rows.groupBy("s1_id", "cand_id").agg(F.round(F.avg((F.col("others") >= 1).cast("double")), digits).alias("cov"), F.count("*").alias("n"))
    out = pairs.select("s1_id", "cand_id").join(got, ["s1_id", "cand_id"], "left")
    return out.select("s1_id", "cand_id", F.coalesce("cov", F.lit(0.0)).alias(f"prof_{name}_cov"), F.coalesce("n", F.lit(0)).alias(f"prof_{name}_n"))


def houses(pairs: DataFrame, pool: DataFrame, digits: int = 6) -> DataFrame:
    """s1_id, cand_id, prof_house_support, conf_house_agree: other sure matches with the same house number, and their share."""
    rows = pairs.select("s1_id", "cand_id", (F.col("p") >= SURE).cast("int").alias("c")).join(pool.select(F.col("entity_id").alias("cand_id"), "house_num"), "cand_id", "left")
    has = F.coalesce(F.col("house_num") != "", F.lit(False))
    own = F.when(has, F.col("c")).otherwise(0)
    same = F.when(has, F.sum(own).over(Window.partitionBy("s1_id", "house_num")) - own).otherwise(0)
    every = F.sum(own).over(Window.partitionBy("s1_id")) - own
    return rows.select("s1_id", "cand_id", same.alias("prof_house_support"), F.round(same / F.greatest(F.lit(1), every), digits).alias("conf_house_agree"))


def build(pairs: DataFrame, pool: DataFrame, tops: DataFrame) -> DataFrame:
    """The fifteen features of the second pass, of pruned pairs (s1_id, cand_id, p)."""
    keys = ["s1_id", "cand_id"]
    out = probabilities(pairs, tops)
    for column, name in (("name_core", "name"), ("addr_words", "addr"), ("addr_nums", "nums")):
        got = profile(pairs, pool, column, name)
        out = out.join(got.drop("prof_nums_n"), keys)
    return out.join(houses(pairs, pool), keys)
