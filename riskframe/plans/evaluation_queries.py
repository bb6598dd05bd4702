"""Model evaluation over whole score tables."""

from pyspark.sql import functions as F

from riskframe.operators import evaluation as ev
from riskframe.operators.ranking import score_curve
from riskframe.plans.registry import query
from riskframe.plans.sql import AP, PR, ROC, counts_at, curve_views, models_sql, ratios, scored_sql
from riskframe.session import shared_folder
from riskframe.sources import files
from riskframe.sources.transactions import scored, scored_models


def rounded(df, *columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _values(grid):
    return ", ".join(f"({t}e0)" for t in grid)


def _sweep_sql(grid):
    return f"""
, grid(threshold) AS (VALUES {_values(grid)}),
counts AS (SELECT threshold, {counts_at('threshold')} FROM scored, grid GROUP BY threshold)
SELECT threshold, tp, fp, tn, fn, {ratios()} FROM counts"""


@query("threshold_sweep_19", scored_sql(_sweep_sql(ev.GRID_19)))
def threshold_sweep_19(spark, sf_dir):
    return rounded(ev.threshold_sweep(scored(spark, sf_dir), ev.GRID_19), *ev.RATIOS)


@query("threshold_sweep_51", scored_sql(_sweep_sql(ev.GRID_51)))
def threshold_sweep_51(spark, sf_dir):
    return rounded(ev.threshold_sweep(scored(spark, sf_dir), ev.GRID_51), *ev.RATIOS)


@query("sweep_state", scored_sql(_sweep_sql(ev.GRID_51)))
def sweep_state(spark, sf_dir):
    """Three exported score files added one after the other, one of them twice."""
    folder, rows = shared_folder(spark), scored(spark, sf_dir)
    state = ev.SweepState.create(spark, f"{folder}/state", ev.GRID_51)
    for part in (0, 1, 2, 1):
        files.export_scores(rows.where(F.pmod("tx_id", F.lit(3)) == part), f"{folder}/scores_{part}")
        state.add(f"scores_{part}", files.read_scores(spark, f"{folder}/scores_{part}"))
    return rounded(state.sweep(), *ev.RATIOS)


@query(
    "threshold_cross",
    models_sql(
        f"""
, grid(threshold) AS (VALUES {_values(ev.GRID_19)}),
counts AS (SELECT model, threshold, {counts_at('threshold')} FROM scored_models, grid GROUP BY model, threshold)
SELECT model, threshold, tp, fp, tn, fn, {ratios()} FROM counts"""
    ),
)
def threshold_cross(spark, sf_dir):
    return rounded(ev.threshold_sweep(scored_models(spark, sf_dir), ev.GRID_19, by=["model"]), *ev.RATIOS)


@query(
    "best_threshold",
    scored_sql(
        f"""
, grid(threshold) AS (VALUES {_values(ev.GRID_19)}),
counts AS (SELECT threshold, {counts_at('threshold')} FROM scored, grid GROUP BY threshold)
SELECT * FROM (SELECT threshold, tp, fp, tn, fn, {ratios()} FROM counts) ORDER BY f1 DESC, threshold LIMIT 1"""
    ),
)
def best_threshold(spark, sf_dir):
    return rounded(ev.best_threshold(ev.threshold_sweep(scored(spark, sf_dir), ev.GRID_19)), *ev.RATIOS)


@query(
    "confusion_matrix",
    scored_sql(f"SELECT 0.5e0 AS threshold, {counts_at('0.5e0')}, CAST(count(*) AS BIGINT) AS total FROM scored"),
)
def confusion_matrix(spark, sf_dir):
    counts = ev.confusion(scored(spark, sf_dir), 0.5)
    total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return counts.select(F.lit(0.5).alias("threshold"), "tp", "fp", "tn", "fn", total.alias("total"))


@query(
    "classification_metrics",
    scored_sql(f", counts AS (SELECT {counts_at('0.5e0')} FROM scored) SELECT tp, fp, tn, fn, {ratios()} FROM counts"),
)
def classification_metrics(spark, sf_dir):
    return rounded(ev.classification_metrics(scored(spark, sf_dir)), *ev.RATIOS)


@query(
    "two_threshold_report",
    scored_sql(
        f"""
, grid(threshold) AS (VALUES (0.5e0), (0.3e0)),
counts AS (SELECT threshold, {counts_at('threshold')} FROM scored, grid GROUP BY threshold)
SELECT threshold, tp, fp, tn, fn, {ratios()} FROM counts"""
    ),
)
def two_threshold_report(spark, sf_dir):
    return rounded(ev.threshold_sweep(scored(spark, sf_dir), [0.3, 0.5]), *ev.RATIOS)


@query("roc_auc", scored_sql(f", {curve_views('scored')} SELECT round({ROC}, 9) AS roc_auc FROM points"))
def roc_auc(spark, sf_dir):
    return rounded(ev.roc_auc(scored(spark, sf_dir)), "roc_auc")


@query("pr_auc_trapezoid", scored_sql(f", {curve_views('scored')} SELECT round({PR}, 9) AS pr_auc FROM points"))
def pr_auc_trapezoid(spark, sf_dir):
    return rounded(ev.pr_auc(scored(spark, sf_dir)), "pr_auc")


@query(
    "average_precision",
    scored_sql(f", {curve_views('scored')} SELECT round({AP}, 9) AS average_precision FROM points"),
)
def average_precision(spark, sf_dir):
    return rounded(ev.average_precision(scored(spark, sf_dir)), "average_precision")


@query(
    "score_prefix_sums",
    models_sql(
        f""", {curve_views('scored_models', 'model')}
SELECT model, score, CAST(pos AS BIGINT) AS pos, CAST(n AS BIGINT) AS n, CAST(tp AS BIGINT) AS tp,
       CAST(pp - tp AS BIGINT) AS fp, CAST(positives AS BIGINT) AS positives, CAST(total AS BIGINT) AS total
FROM curve"""
    ),
)
def score_prefix_sums(spark, sf_dir):
    curve = score_curve(scored_models(spark, sf_dir), ("model",))
    return curve.select(
        "model", "score", "pos", "n", "tp", (F.col("pp") - F.col("tp")).alias("fp"), "positives", "total"
    )


@query(
    "pr_curve",
    models_sql(
        f"""
, grid(threshold) AS (VALUES {_values(ev.GRID_51)}),
counts AS (SELECT model, threshold, {counts_at('threshold')} FROM scored_models, grid GROUP BY model, threshold)
SELECT model, threshold, recall, precision FROM (SELECT model, threshold, {ratios()} FROM counts)"""
    ),
)
def pr_curve(spark, sf_dir):
    sweep = ev.threshold_sweep(scored_models(spark, sf_dir), ev.GRID_51, by=["model"])
    return rounded(sweep.select("model", "threshold", "recall", "precision"), "recall", "precision")


@query(
    "confusion_long",
    models_sql(
        f"""
, counts AS (SELECT model, {counts_at('0.5e0')} FROM scored_models GROUP BY model)
SELECT model, '1' AS "True", '1' AS "Pred", 'TP' AS "Cell", tp AS "Count" FROM counts
UNION ALL SELECT model, '1', '0', 'FN', fn FROM counts
UNION ALL SELECT model, '0', '1', 'FP', fp FROM counts
UNION ALL SELECT model, '0', '0', 'TN', tn FROM counts"""
    ),
)
def confusion_long(spark, sf_dir):
    return ev.confusion_long(ev.confusion(scored_models(spark, sf_dir), 0.5, ["model"]), ["model"])


def evaluated_sql(by: str, body: str) -> str:
    """``body`` over the view ``evaluated``: every model metric per ``by``."""
    on = " AND ".join(f"c.{b.strip()} IS NOT DISTINCT FROM a.{b.strip()}" for b in by.split(","))
    return models_sql(
        f""", {curve_views('scored_models', by)},
counts AS (SELECT {by}, {counts_at('0.5e0')} FROM scored_models GROUP BY {by}),
areas AS (SELECT {by}, {PR} AS auc_pr, {ROC} AS auc_roc FROM points GROUP BY {by}),
evaluated AS (
  SELECT c.*, {ratios(12)}, a.auc_pr, a.auc_roc FROM counts c JOIN areas a ON {on})
{body}"""
    )


@query(
    "eval_many_models",
    evaluated_sql(
        "model, merchant, type",
        "SELECT model, merchant, type, tp, fp, tn, fn, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, "
        "round(recall, 9) AS recall, round(f1, 9) AS f1, round(auc_pr, 9) AS auc_pr, round(auc_roc, 9) AS auc_roc "
        "FROM evaluated",
    ),
)
def eval_many_models(spark, sf_dir):
    table = ev.evaluate_models(scored_models(spark, sf_dir), ["model", "merchant", "type"])
    return rounded(table, *ev.RATIOS, "auc_pr", "auc_roc")
