"""Classifier of finding types over the features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators.features import FEATURES

MIN_ROWS = 50


@dataclass
class TypeClassifier:
    model: PipelineModel
    samples_trained: int
    accuracy: float
    classes: list[str]


def fit_classifier(features: DataFrame, label: str = "label", *, trees: int = 100, depth: int = 10,
                   seed: int = 42) -> TypeClassifier:
    """Random forest on four fifths of the rows; accuracy on the rest."""
    rows = features.select(*FEATURES, F.col(label).cast("string").alias("label")).filter("label is not null")
    n = rows.count()
    if n < MIN_ROWS:
        raise ValueError(f"at least {MIN_ROWS} rows are needed, got {n}")
    indexer = StringIndexer(inputCol="label", outputCol="_label", stringOrderType="alphabetAsc").fit(rows)
    train, test = rows.randomSplit([0.8, 0.2], seed=seed)
    stages = [
        VectorAssembler(inputCols=FEATURES, outputCol="_features"),
        RandomForestClassifier(labelCol="_label", featuresCol="_features", predictionCol="_class",
                               probabilityCol="_probability", rawPredictionCol="_votes",
                               numTrees=trees, maxDepth=depth, seed=seed),
        IndexToString(inputCol="_class", outputCol="predicted_type", labels=indexer.labels),
    ]
    model = Pipeline(stages=stages).fit(indexer.transform(train))
    judged = model.transform(indexer.transform(test))
    accuracy = MulticlassClassificationEvaluator(
        labelCol="_label", predictionCol="_class", metricName="accuracy").evaluate(judged)
    return TypeClassifier(model, n, accuracy, list(indexer.labels))


def predict_type(features: DataFrame, classifier: TypeClassifier | PipelineModel) -> DataFrame:
    """Adds ``predicted_type``; only rows flagged ``is_anomaly`` get one, if that column exists."""
    model = classifier.model if isinstance(classifier, TypeClassifier) else classifier
    out = model.transform(features).drop("_features", "_votes", "_probability", "_class")
    if "is_anomaly" in features.columns:
        out = out.withColumn("predicted_type", F.when(F.col("is_anomaly"), F.col("predicted_type")))
    return out


def class_probabilities(features: DataFrame, classifier: TypeClassifier) -> DataFrame:
    out = classifier.model.transform(features)
    return out.withColumn("probabilities", vector_to_array("_probability")).drop(
        "_features", "_votes", "_probability", "_class")


def save_classifier(classifier: TypeClassifier, path: str) -> None:
    classifier.model.write().overwrite().save(path)


def load_classifier(path: str) -> PipelineModel:
    return PipelineModel.load(path)
