"""Splits, boosted trees, and out-of-fold scores.

Sampling orders ids by a digest, so a sample is the same on every run and cluster.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def digest(column: str = "entity_id", seed: int = 42):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")))


def sample(ids: DataFrame, n: int, column: str = "entity_id", seed: int = 42) -> DataFrame:
    """n rows, all if there are fewer."""
    return ids.withColumn("_d", digest(column, seed)).orderBy("_d").limit(n).drop("_d")


def split(ids: DataFrame, n_train: int, n_valid: int, column: str = "entity_id", seed: int = 42) -> DataFrame:
    """ids with ``part``: the first min(n_valid, a quarter) by digest are valid, the next n_train train, the rest null.

    Ranks come from a sorted limit, so no task sorts more ids than are used.
    """
    n = ids.count()
    v = min(n_valid, n // 4)
    top = sample(ids.select(column), v + n_train, column, seed).withColumn("_r", F.row_number().over(Window.orderBy(digest(column, seed))))
    return ids.join(top, column, "left").withColumn("part", F.when(F.col("_r") <= v, "valid").when(F.col("_r").isNotNull(), "train")).drop("_r")


def fold(column: str = "s1_id", seed: int = 43):
    """0 or 1 for each id, by the last digit of a digest."""
    return F.when(F.substring(digest(column, seed), 32, 1).isin(*"01234567"), 0).otherwise(1)


def fit(rows: DataFrame, features: list[str], rounds: int = 60, depth: int = 5, valid: str | None = None, seed: int = 42, leaf: int = 100) -> PipelineModel:
    """Boosted trees on ``label``; ``valid`` names a boolean column of rows that stop the rounds; ``leaf`` is the least number of rows in a leaf."""
    gbt = GBTClassifier(labelCol="label", featuresCol="_x", maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=leaf, seed=seed)
    if valid:
        gbt = gbt.setValidationIndicatorCol(valid)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep"), gbt]).fit(rows)


def predict(model: PipelineModel, rows: DataFrame, name: str = "p") -> DataFrame:
    return model.transform(rows).withColumn(name, vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def out_of_fold(rows: DataFrame, features: list[str], key: str = "s1_id", **kw) -> DataFrame:
    """Each fold scored by the model of the other."""
    rows = rows.withColumn("_fold", fold(key))
    models = {f: fit(rows.where(F.col("_fold") == 1 - f), features, **kw) for f in (0, 1)}
    parts = [predict(models[f], rows.where(F.col("_fold") == f)) for f in (0, 1)]
    return parts[0].unionByName(parts[1]).withColumnRenamed("_fold", "fold")


def cross_fit(rows: DataFrame, features: list[str], train_ids: DataFrame, full: PipelineModel, key: str = "s1_id", **kw) -> DataFrame:
    """rows with ``fold`` and ``p``: ids of ``train_ids`` get the probability of the other fold's model, all other ids (fold null) that of ``full``."""
    known = train_ids.select(key, F.lit(True).alias("_known")).distinct()
    rows = rows.join(known, key, "left").withColumn("_fold", F.when(F.col("_known"), fold(key))).drop("_known")
    inside = rows.where(F.col("_fold").isNotNull())
    scored = [predict(fit(inside.where(F.col("_fold") != f), features, **kw), inside.where(F.col("_fold") == f)) for f in (0, 1)]
    rest = predict(full, rows.where(F.col("_fold").isNull()))
    return scored[0].unionByName(scored[1]).unionByName(rest).withColumnRenamed("_fold", "fold")


def importances(model: PipelineModel, features: list[str], top: int = 15) -> list[tuple[str, float]]:
    got = zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True)
    return sorted(got, key=lambda x: -x[1])[:top]
