"""Distributed classifiers and scoring."""

import json
from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.columns import logistic, positive_probability, require_columns, safe_ratio
from riskframe.operators import network, trees
from riskframe.operators.features import slot_names

# Fixed training settings.
COMMON = {"featuresCol": "features", "labelCol": "label"}
LOGREG = {"maxIter": 20, "tol": 1e-4, "regParam": 0.1, "elasticNetParam": 0.0, "fitIntercept": True}
FOREST = {"numTrees": 20, "maxDepth": 5, "subsamplingRate": 0.5, "featureSubsetStrategy": "auto", "seed": 42}
BOOSTED = {"maxIter": 30, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.5, "seed": 42}
PERCEPTRON = {"maxIter": 20, "seed": 42, "blockSize": 256}
HIDDEN = (256, 128)
BATCH = 2048


def _fit(estimator, train: DataFrame, weighted: bool) -> PipelineModel:
    require_columns(train, ["features", "label"])
    if weighted:
        require_columns(train, ["weight"])
        estimator = estimator.setWeightCol("weight")
    return Pipeline(stages=[estimator]).fit(train)


def train_logreg(train: DataFrame, weighted: bool = True, **settings) -> PipelineModel:
    return _fit(LogisticRegression(**{**COMMON, **LOGREG, **settings}), train, weighted)


def train_forest(train: DataFrame, weighted: bool = True, **settings) -> PipelineModel:
    return _fit(RandomForestClassifier(**{**COMMON, **FOREST, **settings}), train, weighted)


def train_gbt(train: DataFrame, weighted: bool = True, **settings) -> PipelineModel:
    return _fit(GBTClassifier(**{**COMMON, **BOOSTED, **settings}), train, weighted)


def train_mlp(train: DataFrame, width: int, hidden: tuple[int, ...] = HIDDEN, **settings) -> PipelineModel:
    """Sigmoid network with two outputs; it takes no weights, so oversample beforehand.

    The L-BFGS steps are those of Spark's fit, taken by matrix products (``operators/network.py``).
    """
    perceptron = MultilayerPerceptronClassifier(layers=[width, *hidden, 2], **{**COMMON, **PERCEPTRON, **settings})
    if perceptron.getSolver() != "l-bfgs":
        return _fit(perceptron, train, False)
    return network.fit_as_spark(perceptron, require_columns(train, ["features", "label"]))


TRAINERS: dict[str, Callable[..., PipelineModel]] = {
    "logreg": train_logreg,
    "rf": train_forest,
    "gbt": train_gbt,
}


def score_column(df: DataFrame, model: PipelineModel | None = None) -> Column:
    """P(class 1): from ``probability``, else from the raw prediction as the kind of ``model`` defines it.

    A logistic model's raw value is its margin, a forest's are votes to be
    normalised, a boosted model's is half the margin; without ``model`` a raw
    prediction has no meaning and is refused.
    """
    if "probability" in df.columns:
        return positive_probability(F.col("probability"))
    if "rawPrediction" not in df.columns:
        raise ValueError(f"neither probability nor rawPrediction in {df.columns}")
    last, raw = None if model is None else model.stages[-1], vector_to_array("rawPrediction")
    if isinstance(last, LogisticRegressionModel):
        return logistic(raw[1])
    if isinstance(last, RandomForestClassificationModel):
        return safe_ratio(raw[1], raw[0] + raw[1])
    if isinstance(last, GBTClassificationModel):
        return logistic(F.lit(2.0) * raw[1])
    raise ValueError("a raw prediction needs the logistic, forest or boosted model that made it")


def score_model(model: PipelineModel, df: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, label, score) of a table under a model."""
    predicted = model.transform(require_columns(df, ["label"]))
    return predicted.select(*keep, F.col("label").cast("int").alias("label"), score_column(predicted, model).alias("score"))


def mlp_layers(model: PipelineModel) -> list[tuple[np.ndarray, np.ndarray]]:
    """(matrix out x in, bias) per layer of a fitted network."""
    network = model.stages[-1]
    sizes, flat, layers = network.getLayers(), network.weights.toArray(), []
    at = 0
    for n_in, n_out in zip(sizes, sizes[1:]):
        matrix = flat[at : at + n_in * n_out].reshape((n_out, n_in), order="F")
        at += n_in * n_out
        layers.append((matrix, flat[at : at + n_out]))
        at += n_out
    return layers


# A batch scorer gives P(class 1) of a matrix with one dense row each, inside a task.
BatchScorer = Callable[[np.ndarray], np.ndarray]


def _network_scorer(layers: list[tuple[np.ndarray, np.ndarray]]) -> BatchScorer:
    def score(rows: np.ndarray) -> np.ndarray:
        out = rows
        for i, (matrix, bias) in enumerate(layers):
            out = out @ matrix.T + bias
            if i < len(layers) - 1:
                out = 1.0 / (1.0 + np.exp(-out))
        shifted = np.exp(out - out.max(axis=1, keepdims=True))
        return shifted[:, 1] / shifted.sum(axis=1)

    return score


class LinearScorer:
    """The logistic of a weighted sum of the slots."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(rows @ self.weights + self.intercept)))


def batch_scorer(model: PipelineModel) -> BatchScorer | None:
    """The score of a one-stage model as a function of matrices; None for a kind of model that is not known."""
    last = model.stages[-1]
    if len(model.stages) > 1:
        return None
    if isinstance(last, LogisticRegressionModel) and last.numClasses == 2:
        return LinearScorer(last.coefficients.toArray(), float(last.intercept))
    if isinstance(last, MultilayerPerceptronClassificationModel):
        return _network_scorer(mlp_layers(model))
    if trees.is_ensemble(model) and last.numClasses == 2:
        return trees.BatchTrees(trees.ensemble(model), last.numFeatures)
    return None


def score_batched(model: PipelineModel, values: Column, batch: int = BATCH) -> Column:
    """P(class 1) of a fitted network by matrix products over batches of dense rows."""
    layers = mlp_layers(model)
    udf = predict_batch_udf(
        lambda: _network_scorer(layers), return_type=T.DoubleType(), batch_size=batch,
        input_tensor_shapes=[[layers[0][0].shape[1]]],
    )
    return udf(values)


def importance_table(models: dict[str, PipelineModel], vectors: DataFrame) -> DataFrame:
    """(model, slot, name, value): coefficients of linear models, importances of tree models."""
    names = slot_names(vectors)
    rows = []
    for code, model in models.items():
        last = model.stages[-1]
        values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
        rows += [(code, i, names[i] if i < len(names) else f"f{i}", float(v)) for i, v in enumerate(values.toArray())]
    return vectors.sparkSession.createDataFrame(rows, "model string, slot int, name string, value double")


def top_slots(model: PipelineModel, vectors: DataFrame) -> dict:
    """The slots that matter most to a fitted model: ten coefficients, or twenty importances, largest first."""
    last, names = model.stages[-1], slot_names(vectors)
    linear = hasattr(last, "coefficients")
    values = (last.coefficients if linear else last.featureImportances).toArray()
    order = np.argsort(-np.abs(values), kind="stable")[: 10 if linear else 20]
    ranked = [{"feature": names[i] if i < len(names) else f"f{i}", "value": float(values[i])} for i in order]
    return {"top_coefficients" if linear else "top_importances": ranked}


def linear_parameters(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """One JSON document with the coefficients and the intercept of a logistic model."""
    last = model.stages[-1]
    document = json.dumps({"coefficients": last.coefficients.toArray().tolist(), "intercept": float(last.intercept)})
    return spark.createDataFrame([(document,)], "document string")
