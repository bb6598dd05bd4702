"""The batch jobs from raw transactions to reports, each one call."""

import json
import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.columns import with_label
from riskframe.operators import encoding, evaluation, features, network, reporting, sampling, training, trees
from riskframe.operators import explain as attribution
from riskframe.operators import sequences as seq
from riskframe.session import shared_folder
from riskframe.sources import files
from riskframe.sources.models import load_model, save_model
from riskframe.sources.transactions import TRANSACTION_SCHEMA

SPLIT_COLUMNS = ("tx_id", "features", "label", "weight")


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Raw transactions as parquet or CSV, the columns in any order.

    ``tx_id`` is the integer id of a row.  A row of an extract without one is named by
    a hash of all its values, so its draws and its place in a sequence depend on the
    row alone, however the files are cut or read; rows equal in every column share an
    id and are interchangeable.
    """
    types = {"tx_id": T.LongType(), **{f.name: f.dataType for f in TRANSACTION_SCHEMA}}
    if files.has_parquet(spark, path):
        rows = files.scan_parquet(spark, path)
    else:
        header = spark.read.option("header", True).csv(path).columns  # reads the first line
        schema = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
        rows = files.scan_csv(spark, path, schema)
    if "tx_id" in rows.columns:
        return rows
    # null markers keep a null apart from an absent neighbour; sorted names make the column order irrelevant
    values = [part for c in sorted(rows.columns) for part in (F.col(c), F.col(c).isNull())]
    return rows.withColumn("tx_id", F.xxhash64(*values).bitwiseAND(F.lit((1 << 63) - 1)))


def prepare(spark: SparkSession, source: str, out_dir: str) -> None:
    """Encoded train, valid and test splits, and the class counts of the train split, from raw transactions."""
    clean = with_label(read_transactions(spark, source).dropna(subset=["type", "amount", "isFraud"]))
    split = sampling.three_way_split(clean, "tx_id")
    train = split.where(F.col("split") == "train")
    encoded = features.fit_features(train).transform(split)
    files.write_splits(encoding.with_class_weight(encoded, train=train), f"{out_dir}/splits", SPLIT_COLUMNS)
    # the same rows that the weights come from
    meta = encoding.preprocess_meta(train, features.NUMERIC, features.CATEGORICAL)
    files.write_documents(meta.select(F.to_json(F.struct("*")).alias("document")), f"{out_dir}/meta")


MODELS = (*training.TRAINERS, "mlp")
CLASS_WEIGHTS = ("none", "balanced")


def train(
    spark: SparkSession, data_dir: str, models_dir: str, codes: Sequence[str] = MODELS, fraction: float = 1.0,
    report_path: str | None = None, weighted: bool = True, network_weights: str = "none",
) -> DataFrame:
    """Fit and save the named models on a reproducible share of the train split.

    Returns, and writes as one JSON document where ``report_path`` is given, the
    metrics of each on the validation split with the share and the weighting used.
    With ``network_weights`` "balanced" the network learns from all rows, positives
    weighed by the class counts, else from rows in which the minority is oversampled.
    """
    if network_weights not in CLASS_WEIGHTS:
        raise ValueError(f"{network_weights} is none of {', '.join(CLASS_WEIGHTS)}")
    rows = sampling.bernoulli_sample(files.read_split(spark, f"{data_dir}/splits", "train"), "tx_id", fraction)
    parts = []
    for code in codes:
        if code == "mlp":
            # the metadata of the encoded column knows its width; an empty split has no row to ask
            width = len(features.slot_names(rows))
            if not width or rows.isEmpty():
                raise ValueError(f"no rows with encoded features in the train split of {data_dir}")
            if network_weights == "balanced":
                pos_weight = encoding.floored_class_weight(rows).first()["pos_weight"]  # one row
                weight = F.when(F.col("label") == 1, F.lit(pos_weight)).otherwise(F.lit(1.0))
                model, _ = network.train_weighted_network(rows.withColumn("weight", weight), training.HIDDEN)
            else:
                model = training.train_mlp(sampling.oversample_minority(rows, "tx_id", 0.1), width)
        else:
            model = training.TRAINERS[code](rows, weighted=weighted)
        save_model(model, models_dir, code)
        scores = written_scores(spark, data_dir, models_dir, code, "valid")
        parts.append(evaluation.evaluate_models(scores, ["model"]))
    table = reduce(DataFrame.unionByName, parts).withColumns(
        {"train_frac": F.lit(float(fraction)), "used_weight": F.when(F.col("model") == "mlp", network_weights == "balanced").otherwise(weighted)}
    )
    if report_path is not None:
        files.write_documents(reporting.metric_documents(table, more=["train_frac", "used_weight"]), report_path)
    return table


def scored_split(spark: SparkSession, data_dir: str, models_dir: str, code: str, split: str = "test") -> DataFrame:
    """(tx_id, label, score) of a saved model on a split."""
    rows = files.read_split(spark, f"{data_dir}/splits", split)
    return training.score_model(load_model(spark, models_dir, code), rows, "tx_id")


def written_scores(spark: SparkSession, data_dir: str, models_dir: str, code: str, split: str) -> DataFrame:
    """(model, tx_id, label, score), scored once into the shared folder and read from there."""
    scores = scored_split(spark, data_dir, models_dir, code, split).withColumn("model", F.lit(code))
    path = shared_folder(spark)
    scores.write.parquet(path)
    return spark.read.schema(scores.schema).parquet(path)


def evaluate(spark: SparkSession, data_dir: str, models_dir: str, report_path: str, split: str = "test") -> DataFrame:
    """Metrics of every saved model; also written as one JSON document keyed by model.

    The document also names the largest coefficients or importances of each model
    that has them, the neural model's metrics at 0.30 and its best threshold, and
    under ``missing_models`` the expected models that are not there.
    """
    present, extras, parts = [], {}, []
    for code in MODELS:
        try:
            model = load_model(spark, models_dir, code)
        except FileNotFoundError:
            continue
        present.append(code)
        scores = written_scores(spark, data_dir, models_dir, code, split)
        parts.append(scores)
        if code == "mlp":
            at = evaluation.threshold_sweep(scores, [0.3]).first().asDict()
            best = evaluation.best_threshold(evaluation.threshold_sweep(scores, evaluation.GRID_19)).first()
            extras[code] = {"metrics_030": at, "best_f1": best.asDict()}
        else:
            rows = files.read_split(spark, f"{data_dir}/splits", split)
            extras[code] = training.top_slots(model, rows)
    if not present:
        raise FileNotFoundError(f"no model in {models_dir}")
    missing = sorted(set(MODELS) - set(present))
    table = evaluation.evaluate_models(reduce(DataFrame.unionByName, parts), ["model"])
    report = json.loads(reporting.metric_documents(table).first()["document"])  # one entry per model
    report = {code: {**entry, **extras.get(code, {})} for code, entry in report.items()}
    if missing:
        warnings.warn(f"models missing in {models_dir}: {', '.join(missing)}", stacklevel=2)
        report["missing_models"] = missing
    files.write_documents(spark.createDataFrame([(json.dumps(report),)], "document string"), report_path)
    return table


def sweep(
    spark: SparkSession, data_dir: str, models_dir: str, code: str, report_path: str,
    grid: Sequence[float] = evaluation.GRID_19, split: str = "test",
) -> DataFrame:
    """Threshold sweep of a saved model; also written as one JSON document."""
    scores = written_scores(spark, data_dir, models_dir, code, split)
    table = evaluation.threshold_sweep(scores, grid)
    matrix = F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix")
    row = F.struct("threshold", "precision", "recall", "f1", matrix)
    document = table.agg(F.sort_array(F.collect_list(row)).alias("sweep")).select(
        F.to_json(
            F.struct(F.lit(code).alias("model"), evaluation.pr_auc(scores).scalar().alias("pr_auc"), "sweep")
        ).alias("document")
    )
    files.write_documents(document, report_path)
    return table


def sweep_scores(
    spark: SparkSession, scores: str, name: str, state_path: str, report_path: str | None = None,
    grid: Sequence[float] = evaluation.GRID_51,
) -> DataFrame:
    """Threshold sweep over exported score files: ``scores`` is added as ``name`` to those in ``state_path``.

    The state is made where it is not yet; files added before are not read again.
    Returns the sweep over all files, also written as one JSON document.
    """
    if files.exists(spark, f"{state_path}/grid"):
        state = evaluation.SweepState(spark, state_path)
    else:
        state = evaluation.SweepState.create(spark, state_path, grid)
    state.add(name, files.read_scores(spark, scores))
    table = state.sweep()
    if report_path is not None:
        rows = F.sort_array(F.collect_list(F.struct("threshold", "precision", "recall", "f1")))
        document = table.agg(rows.alias("sweep")).select(F.to_json(F.struct(F.lit(name).alias("model"), "sweep")).alias("document"))
        files.write_documents(document, report_path)
    return table


def compare(spark: SparkSession, reports: str, out_path: str) -> DataFrame:
    """The comparison table of all written reports that match a pattern, also written as CSV."""
    table = reporting.compared_reports(reporting.all_reports(files.read_reports(spark, reports)))
    table = reporting.with_display_name(table)
    table.write.mode("overwrite").option("header", True).csv(out_path)
    return table


def sequences(spark: SparkSession, source: str, out_path: str, seq_len: int = 20) -> None:
    """Fixed-length account sequences from raw transactions."""
    seq.build_sequences(read_transactions(spark, source), seq_len).write.mode("overwrite").parquet(out_path)


def export(
    spark: SparkSession, data_dir: str, models_dir: str, code: str, out_dir: str, split: str = "test",
    sample_rows: int = 10_000,
) -> None:
    """Scores as CSV, a dense feature sample, and the parameters of a linear model."""
    rows = files.read_split(spark, f"{data_dir}/splits", split)
    model = load_model(spark, models_dir, code)
    files.export_scores(training.score_model(model, rows), f"{out_dir}/scores")
    files.export_feature_sample(rows, "tx_id", sample_rows, f"{out_dir}/sample")
    if hasattr(model.stages[-1], "coefficients"):
        files.write_documents(training.linear_parameters(spark, model), f"{out_dir}/parameters")


METHODS = ("kernel", "permutation", "tree", "linear", "surrogate")


def explain(
    spark: SparkSession, data_dir: str, models_dir: str, code: str, out_path: str, split: str = "valid",
    n_rows: int | None = None, background_n: int = 100, n_masks: int = 100, method: str = "kernel",
) -> DataFrame:
    """Attributions of a split, written as a table; returns the ranking of the slots.

    All rows are explained unless ``n_rows`` asks for a sample.  ``kernel`` and
    ``permutation`` take any model, ``n_masks`` masks or ``background_n`` pairs of orders
    against ``background_n`` rows of the train split; ``tree`` is exact for forests and
    boosted trees against the whole train split, ``linear`` for a logistic margin.  All
    four write (tx_id, slot, phi).  ``surrogate`` writes (tx_id, rank, feature, weight).
    """
    if method not in METHODS:
        raise ValueError(f"{method} is none of {', '.join(METHODS)}")
    model = load_model(spark, models_dir, code)
    last = model.stages[-1]
    width = last.numFeatures

    def dense(part: str, n: int | None, purpose: str) -> DataFrame:
        rows = files.read_split(spark, f"{data_dir}/splits", part)
        rows = rows if n is None else sampling.fixed_size_sample(rows, "tx_id", n, purpose)
        return rows.select("tx_id", vector_to_array("features").alias("x"))

    rows = dense(split, n_rows, "foreground")
    if method == "tree":
        found = trees.shap_tree(rows, "tx_id", trees.ensemble(model), dense("train", None, ""), width)
    elif method == "linear":
        if not hasattr(last, "coefficients"):
            raise ValueError(f"{code} has no linear margin")
        found = attribution.shap_linear(rows, F.lit([float(w) for w in last.coefficients.toArray()]))
    elif method == "surrogate":
        found = attribution.lime_local(rows, "tx_id", dense("train", None, ""), attribution.model_scorer(model))
    else:
        estimate = attribution.shap_kernel if method == "kernel" else attribution.shap_permutation
        background = dense("train", background_n, "background")
        effort = n_masks if method == "kernel" else background_n
        found = estimate(rows, "tx_id", background, width, attribution.model_scorer(model), effort)
    found.write.mode("overwrite").parquet(out_path)
    written = spark.read.parquet(out_path)
    if method == "surrogate":
        strength = F.round(F.avg(F.abs("weight")), 9).alias("mean_abs")
        return written.groupBy("feature").agg(strength).orderBy(F.desc("mean_abs"), "feature").limit(20)
    return attribution.shap_summary(written)
