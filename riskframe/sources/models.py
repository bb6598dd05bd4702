"""Saving and loading fitted models under their known folder names."""

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

# The folder names a model may have been saved under.
FOLDERS = {
    "logreg": ["logreg", "lr", "baseline_logreg"],
    "rf": ["rf", "random_forest", "randomForest"],
    "gbt": ["gbt", "gbtc", "gradient_boosted_trees"],
}


class AmbiguousModel(ValueError):
    """Two folders claim to hold the same model."""


def save_model(model: PipelineModel, models_dir: str, code: str) -> str:
    path = f"{models_dir.rstrip('/')}/{code}"
    model.write().overwrite().save(path)
    return path


def saved_models(spark: SparkSession, models_dir: str) -> set[str]:
    """Names of the folders below ``models_dir`` that hold a saved pipeline, from two listings."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(models_dir)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    saved = fs.globStatus(hadoop.Path(root, "*/metadata")) or []
    return {status.getPath().getParent().getName() for status in saved}


def resolve_model(spark: SparkSession, models_dir: str, code: str) -> str:
    """The folder that holds the saved pipeline of a model code, under whichever of its names."""
    saved = saved_models(spark, models_dir)
    candidates = saved & {code, *FOLDERS.get(code, [])}
    if not candidates:
        raise FileNotFoundError(f"no model {code} in {models_dir}, which holds {sorted(saved)}")
    if len(candidates) > 1:
        raise AmbiguousModel(f"model {code} is in {models_dir} as {sorted(candidates)}; keep one")
    return f"{models_dir.rstrip('/')}/{candidates.pop()}"


def load_model(spark: SparkSession, models_dir: str, code: str) -> PipelineModel:
    return PipelineModel.load(resolve_model(spark, models_dir, code))
