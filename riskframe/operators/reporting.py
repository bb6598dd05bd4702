"""Comparison tables and metric documents per model and segment."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Display names of the model codes, and the columns of a comparison.
MODEL_NAMES = {
    "LOGREG": "Logistic Regression",
    "RF": "Random Forest",
    "GBT": "Gradient Boosted Trees",
    "CNN": "Convolutional Neural Network",
    "LSTM": "Long Short-Term Memory",
    "MLP": "Multi-Layer Perceptron",
    "TRANSFORMER": "Transformer",
}
SPARK_MODELS = ["logreg", "rf", "gbt"]
COMPARISON = ["threshold", "accuracy", "precision", "recall", "f1", "pr_auc", "roc_auc"]


def with_display_name(df: DataFrame, model: str = "model") -> DataFrame:
    """Add ``display_name``; an unknown code is its own name."""
    names = df.sparkSession.createDataFrame(list(MODEL_NAMES.items()), "name_code string, name string")
    joined = df.join(F.broadcast(names), F.col(model) == F.col("name_code"), "left")
    return joined.select(*df.columns, F.coalesce("name", model).alias("display_name"))


def missing_models(present: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Expected model codes without a row in ``present``."""
    wanted = present.sparkSession.createDataFrame([(m,) for m in expected], "model string")
    return wanted.join(present.select("model").distinct(), "model", "left_anti")


def metric_documents(evaluated: DataFrame, segments: Sequence[str] = (), more: Sequence[str] = ()) -> DataFrame:
    """One JSON document per segment, an object keyed by model name; ``more`` names further columns to report.

    A document holds one entry per model of its segment, so it stays small.
    """
    matrix = F.array(F.array("tn", "fp"), F.array("fn", "tp"))
    names = ["accuracy", "precision", "recall", "f1", "auc_pr", "auc_roc"]
    entry = F.struct(F.struct(*names).alias("metrics"), matrix.alias("confusion_matrix"), *more)
    models = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("model"), entry.alias("report")))))
    return evaluated.groupBy(*segments).agg(F.to_json(models).alias("document"))


def _numbers(fields: Column) -> Column:
    """The JSON numbers and truth values of an object, keys in lower case.

    Of keys that are equal in lower case the last in code point order wins, so a key
    already in lower case beats its other spellings.
    """
    kept = F.map_filter(fields, lambda _, v: F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"))
    as_double = F.transform_values(
        kept,
        lambda _, v: F.coalesce(
            F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "boolean").cast("double")
        ),
    )
    entries = F.array_sort(F.map_entries(as_double))
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: F.lower(x["key"]) == F.lower(e["key"])),
    )
    return F.map_from_entries(F.transform(last, lambda e: F.struct(F.lower(e["key"]), e["value"])))


def normalise_documents(documents: DataFrame, segments: Sequence[str] = (), column: str = "document") -> DataFrame:
    """(segments, model, metric, value) of every numeric field of a report.

    A field inside ``metrics`` overrides an equally named top-level field.  Text,
    lists, nulls and other nested objects are left out, as are entries that are not
    objects.
    """
    inside = "map<string,variant>"
    models = F.explode(F.try_variant_get(F.try_parse_json(column), "$", inside)).alias("model", "body")
    fields = (
        documents.select(*segments, models)
        .withColumn("outer", _numbers(F.try_variant_get("body", "$", inside)))
        .withColumn("inner", _numbers(F.try_variant_get("body", "$.metrics", inside)))
    )
    none = F.create_map().cast("map<string,double>")
    inner = F.coalesce("inner", none)
    outer = F.map_filter("outer", lambda k, _: ~F.map_contains_key(inner, k))
    return fields.select(*segments, "model", F.explode(F.map_concat(outer, inner)).alias("metric", "value"))


def report_kind(column: str = "document") -> Column:
    """What a report holds: a threshold ``sweep``, one ``network``, or any number of ``models``."""
    body = F.try_parse_json(column)
    sweep = F.try_variant_get(body, "$.sweep", "array<variant>").isNotNull()
    network = F.try_variant_get(body, "$.test_metrics_t0_50", "map<string,variant>").isNotNull()
    models = F.try_variant_get(body, "$", "map<string,variant>").isNotNull()
    return F.when(sweep, "sweep").when(network, "network").when(models, "models")


def all_reports(documents: DataFrame) -> DataFrame:
    """(name, kind, model, threshold, metric, value) of reports of all kinds, from (name, document).

    A model's metrics stand at threshold 0.50; a network's best threshold is its metric
    ``best_threshold``; a sweep gives one row per threshold and metric.  A network or a
    sweep that does not name its model is called by the last part of its own name.  A
    text that is no JSON object gives no rows.
    """
    kinds = documents.select("name", "document", report_kind().alias("kind"))
    inside = "map<string,variant>"
    columns = ["name", "kind", "model", "threshold", "metric", "value"]

    def long(rows: DataFrame, fields: Column, threshold: Column) -> DataFrame:
        found = rows.withColumn("threshold", threshold).withColumn("fields", _numbers(fields))
        return found.select("name", "kind", "model", "threshold", F.explode("fields").alias("metric", "value"))

    models = normalise_documents(kinds.where("kind = 'models'"), ["name", "kind"])
    models = models.withColumn("threshold", F.lit(0.5)).select(columns)

    body = F.try_parse_json("document")
    own = F.element_at(F.split(F.regexp_replace("name", r"(_metrics)?\.json$", ""), "_"), -1)
    named = F.coalesce(F.try_variant_get(body, "$.model", "string"), own).alias("model")
    networks = kinds.where("kind = 'network'").select("name", "kind", named, body.alias("body"))
    at_half = F.try_variant_get("body", "$.test_metrics_t0_50", inside)
    best = F.try_variant_get("body", "$.best_f1.threshold", "double")
    networks = long(networks, at_half, F.lit(0.5)).unionByName(
        networks.where(best.isNotNull()).select(
            "name", "kind", "model", F.lit(0.5).alias("threshold"), F.lit("best_threshold").alias("metric"), best.alias("value")
        )
    )
    steps = F.explode(F.try_variant_get(body, "$.sweep", "array<variant>")).alias("step")
    sweeps = kinds.where("kind = 'sweep'").select("name", "kind", named, steps)
    at = F.try_variant_get("step", "$.threshold", "double")
    fields = F.map_filter(F.try_variant_get("step", "$", inside), lambda k, _: k != "threshold")
    return models.unionByName(networks).unionByName(long(sweeps, fields, at))


def compared_reports(reports: DataFrame) -> DataFrame:
    """The comparison table of :func:`all_reports`: a row per distributed model and per network.

    The threshold of a network's row is that of its best F1, its metrics are those at 0.50.
    """
    wanted = ["accuracy", "precision", "recall", "f1", "auc_pr", "auc_roc", "best_threshold"]
    rows = reports.where(
        ((F.col("kind") == "models") & F.col("model").isin(SPARK_MODELS)) | (F.col("kind") == "network")
    )
    wide = rows.groupBy("name", "kind", "model").pivot("metric", wanted).agg(F.first("value"))
    best = F.when(F.col("best_threshold").isNotNull(), F.format_string("%.2f", "best_threshold"))
    network = F.col("kind") == "network"
    return wide.select(
        F.upper("model").alias("model"),
        F.when(network, best).otherwise(F.lit("0.50")).alias("threshold"),
        "accuracy", "precision", "recall", "f1",
        F.col("auc_pr").alias("pr_auc"),
        F.col("auc_roc").alias("roc_auc"),
        F.when(network, "DL").otherwise("SPARK").alias("source"),
    )


def wide_metrics(
    long: DataFrame, keys: Sequence[str] = ("model",), metrics: Sequence[str] | None = None
) -> DataFrame:
    """One row per model with the metrics as sorted columns, null where absent.

    Every metric that occurs gets a column, found in one pass over the long table;
    naming ``metrics`` spares that pass and keeps only those.
    """
    pivoted = long.groupBy(*keys).pivot("metric", sorted(metrics) if metrics is not None else None)
    return pivoted.agg(F.first("value"))


def spark_rows(evaluated: DataFrame, segments: Sequence[str] = (), models: Sequence[str] = SPARK_MODELS) -> DataFrame:
    """Comparison rows of the distributed models at the default threshold."""
    return evaluated.where(F.col("model").isin(list(models))).select(
        *segments,
        F.upper("model").alias("model"),
        F.lit("0.50").alias("threshold"),
        "accuracy", "precision", "recall", "f1",
        F.col("auc_pr").alias("pr_auc"),
        F.col("auc_roc").alias("roc_auc"),
        F.lit("SPARK").alias("source"),
    )


def deep_rows(evaluated: DataFrame, best: DataFrame, segments: Sequence[str] = ()) -> DataFrame:
    """Comparison rows of the neural models: metrics at 0.50 next to the best-F1 threshold.

    ``threshold`` keeps the reported best-F1 value; ``metrics_threshold`` says which
    threshold the metrics belong to.
    """
    keys = [*segments, "model"]
    # A struct key: a null segment inside one still equals itself in a join.
    best = best.select(F.struct(*keys).alias("unit"), F.col("threshold").alias("best_threshold"))
    shown = F.when(F.col("best_threshold").isNotNull(), F.format_string("%.2f", F.col("best_threshold")))
    return evaluated.withColumn("unit", F.struct(*keys)).join(best, "unit", "left").select(
        *segments,
        F.upper("model").alias("model"),
        shown.alias("threshold"),
        F.lit("0.50").alias("metrics_threshold"),
        "accuracy", "precision", "recall", "f1",
        F.col("auc_pr").alias("pr_auc"),
        F.col("auc_roc").alias("roc_auc"),
        F.lit("DL").alias("source"),
    )


def overview(spark_part: DataFrame, deep_part: DataFrame) -> DataFrame:
    """Both kinds of rows in one table; columns one side lacks are null."""
    return spark_part.unionByName(deep_part, allowMissingColumns=True)
