"""Decisions on scored pairs (s1_id, cand_id, prob). Ties go to the smaller id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALES = (0.8, 1.0, 1.25, 1.5, 2.0)


def one_to_one(pairs: DataFrame, *by: str) -> DataFrame:
    """Each candidate's best entity."""
    order = Window.partitionBy(*by, "cand_id").orderBy(F.desc("prob"), "s1_id")
    return pairs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1).drop("_r")


def threshold(pairs: DataFrame, t: float, top: float | None = None, exclusive: bool = True) -> DataFrame:
    """Pairs of at least ``t``; with ``top``, an entity's best pairs of at least that too."""
    out = one_to_one(pairs) if exclusive else pairs
    keep: Column = F.col("prob") >= t
    if top is not None:
        out = out.withColumn("_best", F.max("prob").over(Window.partitionBy("s1_id")))
        keep = keep | ((F.col("prob") == F.col("_best")) & (F.col("prob") >= top))
    return out.where(keep).select("s1_id", "cand_id", "prob")


def expected_f(pairs: DataFrame, scale: float = 1.0, least: float = 0.05, digits: int = 6) -> DataFrame:
    """For each entity the candidates whose number has the highest expected F of beta 1/2, if that beats none."""
    rows = one_to_one(pairs).where(F.col("prob") >= least).withColumn("p", F.pow("prob", F.lit(scale)) if scale != 1.0 else F.col("prob"))
    order = Window.partitionBy("s1_id").orderBy(F.desc("prob"), "cand_id")
    run, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("s1_id")
    rows = rows.withColumns({"k": F.row_number().over(order), "_cum": F.sum("p").over(run), "_tot": F.sum("p").over(whole)})
    one = F.exp(F.sum(F.when(F.col("p") < 1, F.log(1 - F.col("p")))).over(whole))
    rows = rows.withColumn("_none", F.round(F.when(F.max("p").over(whole) >= 1, 0.0).otherwise(one), digits))
    rows = rows.withColumn("_ef", F.round(1.25 * F.col("_cum") / (0.25 * F.col("k") + F.col("_tot")), digits))
    rows = rows.withColumn("_top", F.max("_ef").over(whole))
    rows = rows.withColumn("_star", F.min(F.when((F.col("_ef") == F.col("_top")) & (F.col("_top") > F.col("_none")), F.col("k"))).over(whole))
    return rows.where(F.col("k") <= F.col("_star")).select("s1_id", "cand_id", "prob", "k")


def apply(pairs: DataFrame, rule: dict) -> DataFrame:
    if rule["rule"] == "expected_f":
        return expected_f(pairs, rule.get("scale", 1.0)).drop("k")
    return threshold(pairs, rule["threshold"], rule.get("top_threshold"))


def lists(pairs: DataFrame, score: str = "prob") -> DataFrame:
    """s1_id, ids: candidates by falling score."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("a"), F.col("cand_id").alias("b"))))
    return pairs.groupBy("s1_id").agg(rows.alias("r")).select("s1_id", F.transform("r", lambda x: x.b).alias("ids"))


def grid(pairs: DataFrame, truth: DataFrame, ids: DataFrame, cuts: list[float], tops: list[float | None] = [None]) -> DataFrame:  # noqa: B006
    """threshold, top_threshold, macro_f05 of every rule of a grid, in one pass over the pairs."""
    spark = pairs.sparkSession
    rules = [(float(t), None if u is None else float(u)) for t in cuts for u in tops]
    table = F.broadcast(spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "rule int, t double, u double"))  # a row for each rule
    rows = one_to_one(pairs).withColumn("_best", F.max("prob").over(Window.partitionBy("s1_id")))
    rows = rows.join(truth.withColumn("_true", F.lit(1)), ["s1_id", "cand_id"], "left")
    keep = (F.col("prob") >= F.col("t")) | ((F.col("prob") == F.col("_best")) & (F.col("prob") >= F.col("u")))
    hits = rows.join(table, F.coalesce(keep, F.col("prob") >= F.col("t"))).groupBy("rule", "s1_id").agg(F.count("*").alias("n_pred"), F.count("_true").alias("tp"))
    size = ids.join(truth.groupBy("s1_id").agg(F.count("*").alias("n_true")), "s1_id", "left").fillna(0, ["n_true"])
    from kindred.operators.metrics import f_beta

    got = hits.join(size, "s1_id").withColumn("f", f_beta(F.col("n_pred"), F.col("n_true"), F.col("tp")))
    # an entity without a prediction scores 1 if it has no match, else 0
    empty = size.agg(F.count("*").alias("n"), F.count_if(F.col("n_true") == 0).alias("single"))
    per = got.groupBy("rule").agg(F.sum("f").alias("f"), F.count_if(F.col("n_true") == 0).alias("lost"))
    total = table.join(empty).join(per, "rule", "left").fillna(0, ["f", "lost"])
    return total.select(F.col("t").alias("threshold"), F.col("u").alias("top_threshold"), F.round((F.col("f") + F.col("single") - F.col("lost")) / F.greatest(F.lit(1), F.col("n")), 6).alias("macro_f05"))


def tune(pairs: DataFrame, truth: DataFrame, ids: DataFrame) -> tuple[dict, float]:
    """(rule, macro_f05): thresholds from .30 below .96 by .02; then top thresholds from .10 by .04; then expected F. The first best wins."""
    from kindred.operators.metrics import report

    steps = lambda a, b, s: [round(a + i * s, 10) for i in range(max(0, -int(-(b - a) / s // 1)))]
    best = max(grid(pairs, truth, ids, steps(0.30, 0.96, 0.02)).collect(), key=lambda r: (r.macro_f05, -r.threshold))
    rule, score = {"rule": "threshold", "threshold": best.threshold}, best.macro_f05
    tops = steps(0.10, best.threshold, 0.04)
    if tops:
        more = max(grid(pairs, truth, ids, [best.threshold], tops).collect(), key=lambda r: (r.macro_f05, -r.top_threshold))
        if more.macro_f05 > score:
            rule, score = rule | {"top_threshold": more.top_threshold}, more.macro_f05
    for scale in SCALES:
        f = report(expected_f(pairs, scale), truth, ids).first().macro_f05
        if f > score:
            rule, score = {"rule": "expected_f", "scale": scale}, f
    return rule, score
