"""Encoded and scaled feature vectors."""

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERIC = ["step", "amount", "oldbalanceOrg", "newbalanceOrg", "oldbalanceDest", "newbalanceDest"]
CATEGORICAL = ["type", "merchant"]


def fit_features(
    train: DataFrame, categorical: Sequence[str] = CATEGORICAL, numeric: Sequence[str] = NUMERIC
) -> PipelineModel:
    """Frequency-indexed one-hot categories followed by numerics in units of their sample std."""
    indexed = [f"{c}_idx" for c in categorical]
    onehot = [f"{c}_ohe" for c in categorical]
    return Pipeline(
        stages=[
            StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=onehot, handleInvalid="keep"),
            VectorAssembler(inputCols=list(numeric), outputCol="num_vec"),
            StandardScaler(inputCol="num_vec", outputCol="num_scaled"),
            VectorAssembler(inputCols=[*onehot, "num_scaled"], outputCol="features"),
        ]
    ).fit(train)


def slot_names(df: DataFrame, column: str = "features") -> list[str]:
    """Readable names of the vector slots, ``f{i}`` where the column carries none."""
    attrs = df.schema[column].metadata.get("ml_attr", {})
    width = attrs.get("num_attrs", 0)
    names = {a["idx"]: a.get("name", f"f{a['idx']}") for group in attrs.get("attrs", {}).values() for a in group}
    width = max(width, max(names, default=-1) + 1)
    return [names.get(i, f"f{i}") for i in range(width)]


def slot_expressions(model: PipelineModel) -> list[str]:
    """The SQL of every slot that :func:`fit_features` makes, over the raw columns.

    Categories of a fitted feature pipeline are few: they are the slots of a dense vector.
    """
    indexer, _, assembler, scaler, _ = model.stages
    slots = []
    for column, labels in zip(indexer.getInputCols(), indexer.labelsArray):
        known = ["'" + str(label).replace("\\", "\\\\").replace("'", "\\'") + "'" for label in labels]
        slots += [f"CAST({column} <=> {label} AS DOUBLE)" for label in known]
        unknown = f"{column} NOT IN ({', '.join(known)})" if known else "true"
        slots.append(f"CAST({column} IS NULL OR {unknown} AS DOUBLE)")
    for column, std in zip(assembler.getInputCols(), scaler.std):
        slots.append(f"{column} * {1.0 / float(std) if std else 0.0!r}D")
    return slots


def zscore(df: DataFrame, columns: Sequence[str], train: DataFrame) -> DataFrame:
    """(x - mean) / (population std + 1e-6) with the statistics of ``train``."""
    stats = train.agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_mean") for c in columns],
            *[F.stddev_pop(c).alias(f"{c}_std") for c in columns],
        ).alias("s")
    ).scalar()
    return df.withColumns(
        {c: (F.col(c) - stats.getField(f"{c}_mean")) / (stats.getField(f"{c}_std") + F.lit(1e-6)) for c in columns}
    )
