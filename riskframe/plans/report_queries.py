"""Comparison reports over every model and segment, and their documents."""

from pyspark.sql import functions as F

from riskframe.operators import evaluation as ev
from riskframe.operators import reporting as rp
from riskframe.plans.evaluation_queries import evaluated_sql, rounded
from riskframe.plans.registry import query
from riskframe.plans.sql import counts_at, ratios
from riskframe.session import shared_folder
from riskframe.sources.files import read_documents, read_reports, write_documents
from riskframe.sources.transactions import scored_models

SEGMENTS = ["merchant", "type"]
METRICS = ["accuracy", "auc_pr", "auc_roc", "f1", "precision", "recall"]
_CODE_SQL = "CASE model WHEN 'rule' THEN 'logreg' WHEN 'noise' THEN 'rf' ELSE 'mlp' END"


def coded(spark, sf_dir):
    """The three score columns under published model codes: two distributed models, one neural."""
    code = F.when(F.col("model") == "rule", "logreg").when(F.col("model") == "noise", "rf").otherwise("mlp")
    return scored_models(spark, sf_dir).withColumn("model", code)


def evaluated(spark, sf_dir, segments=SEGMENTS):
    return ev.evaluate_models(coded(spark, sf_dir), ["model", *segments])


def report_sql(body, by="merchant, type"):
    return evaluated_sql(
        f"model, {by}", f", coded AS (SELECT * REPLACE ({_CODE_SQL} AS model) FROM evaluated) {body}"
    )


def _metric_union(columns):
    return " UNION ALL ".join(
        f"SELECT {columns}, '{m}' AS metric, round({m}, 9) AS value FROM coded WHERE {m} IS NOT NULL" for m in METRICS
    )


@query("json_report_sink", report_sql(
    "SELECT model, merchant, tp, fp, tn, fn, " + ", ".join(f"round({m}, 9) AS {m}" for m in METRICS) + " FROM coded",
    "merchant",
))
def json_report_sink(spark, sf_dir):
    """One document per merchant, written, read back and flattened."""
    path = shared_folder(spark)
    documents = rp.metric_documents(evaluated(spark, sf_dir, ["merchant"]), ["merchant"])
    write_documents(documents, path, ["merchant"])
    metrics = ", ".join(f"{m}: double" for m in METRICS)
    shape = f"map<string, struct<metrics: struct<{metrics}>, confusion_matrix: array<array<bigint>>>>"
    parsed = read_documents(spark, path, segments=["merchant"]).select("merchant", F.from_json("document", shape).alias("d"))
    flat = parsed.select("merchant", F.explode("d").alias("model", "r"))
    cell = F.col("r.confusion_matrix")
    return flat.select(
        "model", "merchant",
        cell[1][1].alias("tp"), cell[0][1].alias("fp"), cell[0][0].alias("tn"), cell[1][0].alias("fn"),
        *[F.round(f"r.metrics.{m}", 9).alias(m) for m in METRICS],
    )


@query("json_report_scan", report_sql(_metric_union("merchant, model"), "merchant"))
def json_report_scan(spark, sf_dir):
    """Documents read by folder, keyed by model, as one row per numeric field."""
    path = shared_folder(spark)
    write_documents(rp.metric_documents(evaluated(spark, sf_dir, ["merchant"]), ["merchant"]), path, ["merchant"])
    long = rp.normalise_documents(read_documents(spark, path, segments=["merchant"]), ["merchant"])
    return rounded(long, "value")


_SHAPES_SQL = (
    """, one AS (SELECT * FROM coded)
SELECT 'spark_test_metrics.json' AS name, 'models' AS kind, model, 0.5e0 AS threshold, metric, value FROM ("""
    + " UNION ALL ".join(f"SELECT model, '{m}' AS metric, round({m}, 9) AS value FROM one WHERE {m} IS NOT NULL" for m in METRICS)
    + """)
UNION ALL SELECT 'dl_mlp_metrics.json', 'network', model, 0.5e0, metric, value FROM ("""
    + " UNION ALL ".join(f"SELECT model, '{m}' AS metric, round({m}, 9) AS value FROM one WHERE {m} IS NOT NULL" for m in METRICS)
    + """) WHERE model = 'mlp'
UNION ALL SELECT 'dl_mlp_metrics.json', 'network', 'mlp', 0.5e0, 'best_threshold', threshold FROM (
  SELECT threshold FROM rates WHERE model = 'mlp' ORDER BY f1 DESC, threshold LIMIT 1)
UNION ALL SELECT 'threshold_sweep_rf.json', 'sweep', 'rf', threshold, metric, round(value, 9) FROM (
  SELECT threshold, 'precision' AS metric, precision AS value FROM rates WHERE model = 'rf'
  UNION ALL SELECT threshold, 'recall', recall FROM rates WHERE model = 'rf'
  UNION ALL SELECT threshold, 'f1', f1 FROM rates WHERE model = 'rf')"""
)


def shapes_sql():
    grid = ", ".join(f"({t}e0)" for t in ev.GRID_19)
    return evaluated_sql(
        "model",
        f""", coded AS (SELECT * REPLACE ({_CODE_SQL} AS model) FROM evaluated), grid(threshold) AS (VALUES {grid}),
hits AS (SELECT {_CODE_SQL} AS model, threshold, {counts_at('threshold')} FROM scored_models, grid GROUP BY ALL),
rates AS (SELECT model, threshold, {ratios()} FROM hits)"""
        + _SHAPES_SQL,
    )


def written_reports(spark, sf_dir, folder):
    """Three reports of different shapes: the evaluation of all models, a network's own, a sweep."""
    scores = coded(spark, sf_dir)
    table = ev.evaluate_models(scores, ["model"])
    write_documents(rp.metric_documents(table), f"{folder}/spark_test_metrics.json")
    best = ev.best_threshold(ev.threshold_sweep(scores.where("model = 'mlp'"), ev.GRID_19))
    at_half = table.where("model = 'mlp'").select("model", F.struct(*METRICS).alias("test_metrics_t0_50"))
    report = at_half.join(best.select(F.struct("threshold", "f1").alias("best_f1")))  # one row each
    write_documents(report.select(F.to_json(F.struct("*")).alias("document")), f"{folder}/dl_mlp_metrics.json")
    steps = ev.threshold_sweep(scores.where("model = 'rf'"), ev.GRID_19)
    steps = steps.agg(F.sort_array(F.collect_list(F.struct("threshold", "precision", "recall", "f1"))).alias("sweep"))
    sweep = steps.select(F.to_json(F.struct(F.lit("rf").alias("model"), "sweep")).alias("document"))
    write_documents(sweep, f"{folder}/threshold_sweep_rf.json")
    write_documents(sweep, f"{folder}/notes.txt")  # found by pattern: this one is not


@query("report_shapes", shapes_sql())
def report_shapes(spark, sf_dir):
    """Reports of three shapes found by pattern and named by their file, in one long table."""
    folder = shared_folder(spark)
    written_reports(spark, sf_dir, folder)
    return rounded(rp.all_reports(read_reports(spark, f"{folder}/*.json")), "value")


@query("normalise_metrics", report_sql(_metric_union("merchant, type, upper(model) AS model")))
def normalise_metrics(spark, sf_dir):
    documents = rp.metric_documents(evaluated(spark, sf_dir), SEGMENTS)
    return rounded(rp.normalise_documents(documents, SEGMENTS).withColumn("model", F.upper("model")), "value")


@query("wide_metric_table", report_sql(
    "SELECT merchant, type, model, " + ", ".join(f"round({m}, 9) AS {m}" for m in METRICS) + " FROM coded"
))
def wide_metric_table(spark, sf_dir):
    documents = rp.metric_documents(evaluated(spark, sf_dir), SEGMENTS)
    wide = rp.wide_metrics(rp.normalise_documents(documents, SEGMENTS), [*SEGMENTS, "model"])
    return rounded(wide, *METRICS)


_COMPARED = (
    "round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall, "
    "round(f1, 9) AS f1, round(auc_pr, 9) AS pr_auc, round(auc_roc, 9) AS roc_auc"
)
_RATED = ["accuracy", "precision", "recall", "f1", "pr_auc", "roc_auc"]

_SPARK_ROWS = f"""
SELECT merchant, type, upper(model) AS model, '0.50' AS threshold, {_COMPARED}, 'SPARK' AS source
FROM coded WHERE model IN ('logreg', 'rf', 'gbt')"""

_GRID = ", ".join(f"({t}e0)" for t in ev.GRID_19)
_BEST_VIEWS = f"""
, grid(threshold) AS (VALUES {_GRID}),
deep_counts AS (SELECT merchant, type, threshold, {counts_at('threshold')} FROM scored_models, grid
                WHERE model = 'amount' GROUP BY merchant, type, threshold),
deep_f1 AS (SELECT merchant, type, threshold, {ratios(15)} FROM deep_counts),
deep_best AS (SELECT merchant, type, threshold AS best FROM deep_f1
              QUALIFY row_number() OVER (PARTITION BY merchant, type ORDER BY f1 DESC, threshold) = 1)"""

_DEEP_ROWS = f"""
SELECT merchant, type, upper(model) AS model, printf('%.2f', best) AS threshold, '0.50' AS metrics_threshold,
       {_COMPARED}, 'DL' AS source
FROM coded JOIN deep_best USING (merchant, type) WHERE model = 'mlp'"""


def both_parts(spark, sf_dir):
    """(rows of the distributed models, rows of the neural one) from one evaluation."""
    keys = ["model", *SEGMENTS]
    scores = coded(spark, sf_dir)
    metrics = ev.evaluate_models(scores, keys)
    neural = F.col("model") == "mlp"
    best = ev.best_threshold(ev.threshold_sweep(scores.where(neural), ev.GRID_19, keys), keys)
    return rp.spark_rows(metrics, SEGMENTS), rp.deep_rows(metrics.where(neural), best, SEGMENTS)


@query("comparison_spark_rows", report_sql(_SPARK_ROWS))
def comparison_spark_rows(spark, sf_dir):
    return rounded(rp.spark_rows(evaluated(spark, sf_dir), SEGMENTS), *_RATED)


@query("comparison_dl_rows", report_sql(_BEST_VIEWS + _DEEP_ROWS))
def comparison_dl_rows(spark, sf_dir):
    return rounded(both_parts(spark, sf_dir)[1], *_RATED)


_UNION = f"""
, both_parts AS (
  SELECT merchant, type, model, threshold, NULL AS metrics_threshold, accuracy, precision, recall, f1, pr_auc,
         roc_auc, source FROM ({_SPARK_ROWS})
  UNION ALL
  SELECT merchant, type, model, threshold, metrics_threshold, accuracy, precision, recall, f1, pr_auc,
         roc_auc, source FROM ({_DEEP_ROWS}))"""


@query("overview_union", report_sql(_BEST_VIEWS + _UNION + " SELECT * FROM both_parts"))
def overview_union(spark, sf_dir):
    return rounded(rp.overview(*both_parts(spark, sf_dir)), *_RATED)


_NAMES = ", ".join(f"('{k}', '{v}')" for k, v in rp.MODEL_NAMES.items())


@query(
    "comparison_overview",
    report_sql(
        _BEST_VIEWS
        + _UNION
        + f", names(code, name) AS (VALUES {_NAMES}) SELECT both_parts.*, coalesce(name, model) AS display_name "
        "FROM both_parts LEFT JOIN names ON code = model"
    ),
)
def comparison_overview(spark, sf_dir):
    table = rp.overview(*both_parts(spark, sf_dir))
    return rounded(rp.with_display_name(table), *_RATED)


@query(
    "final_comparison",
    report_sql(
        _BEST_VIEWS
        + _UNION
        + " SELECT merchant, type, model, threshold, accuracy, precision, recall, f1, pr_auc, roc_auc FROM both_parts"
    ),
)
def final_comparison(spark, sf_dir):
    table = rp.overview(*both_parts(spark, sf_dir))
    return rounded(table.select(*SEGMENTS, "model", *rp.COMPARISON), *_RATED)
