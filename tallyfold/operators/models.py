"""Fraud models: a random forest and boosted trees over the assembled features, trained and scored by Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.detect import ensemble

FOREST, BOOSTED = "RANDOM_FOREST", "GRADIENT_BOOSTED"
LOADERS = {FOREST: RandomForestClassificationModel, BOOSTED: GBTClassificationModel}
LEAST_ROWS = 10
SEED = 42


def _names(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c.startswith("f_")]


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=_names(rows), outputCol="features").transform(rows)


def training_summary(rows: DataFrame) -> DataFrame:
    """One row: n_rows, n_fraud, n_legit of assembled rows (id, label, f_…)."""
    fraud = F.col("label") == 1
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(fraud).alias("n_fraud"), F.count_if(~fraud).alias("n_legit"))


def train(rows: DataFrame, trees: int = 50, depth: int = 5, rounds: int = 100) -> dict:
    """Models by name. rows: assembled (id, label, f_…). Fewer than ten rows, or a single class, is an error."""
    n = training_summary(rows).first()
    if n.n_rows < LEAST_ROWS or not n.n_fraud or not n.n_legit:
        raise ValueError(f"training needs {LEAST_ROWS} rows of both classes; there are {n.n_rows}, {n.n_fraud} of them fraud")
    vectors = _vectors(rows).select("label", "features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=SEED)
    return {FOREST: forest.fit(vectors), BOOSTED: GBTClassifier(maxIter=rounds, maxDepth=depth, seed=SEED).fit(vectors)}


def score(rows: DataFrame, models: dict) -> DataFrame:
    """id, risk_score, model_name: the larger probability of fraud, or that of the only model there is."""
    out = _vectors(rows).select("id", "features")
    for name, column in ((FOREST, "rf_score"), (BOOSTED, "gbt_score")):
        if name in models:
            out = models[name].transform(out).withColumn(column, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        else:
            out = out.withColumn(column, F.lit(None).cast("double"))
    return ensemble(out.select("id", "rf_score", "gbt_score"))


def importances(models: dict, names: list[str], session) -> DataFrame:
    """model_name, feature, importance (each model's sum to 1), rank. As many rows as models and features."""
    rows = []
    for model, fitted in models.items():
        weights = fitted.featureImportances.toArray()
        total = float(weights.sum()) or 1.0
        order = sorted(range(len(names)), key=lambda k: (-weights[k], names[k]))
        rows += [(model, names[k].removeprefix("f_"), float(weights[k]) / total, r + 1) for r, k in enumerate(order)]
    return session.createDataFrame(rows, "model_name string, feature string, importance double, rank int")


def save(models: dict, folder: str) -> None:
    for name, model in models.items():
        model.write().overwrite().save(f"{folder}/{name}")


def load(folder: str, names: tuple[str, ...] = (FOREST, BOOSTED)) -> dict:
    return {name: LOADERS[name].load(f"{folder}/{name}") for name in names}
