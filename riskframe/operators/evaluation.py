"""Confusion counts, threshold sweeps and curve areas, each in one pass over the scores."""

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.columns import safe_ratio
from riskframe.operators.ranking import known_score, score_curve

GRID_19 = [round(0.05 * i, 2) for i in range(1, 20)]
GRID_51 = [round(0.02 * i, 2) for i in range(51)]
RATIOS = ["accuracy", "precision", "recall", "f1"]


def confusion(
    scored: DataFrame, threshold: float = 0.5, by: Sequence[str] = (), label: str = "label", score: str = "score"
) -> DataFrame:
    """tp, fp, tn, fn at an inclusive threshold; a missing score counts as 0."""
    hit, positive, negative = known_score(score) >= F.lit(threshold), F.col(label) == 1, F.col(label) == 0
    return scored.groupBy(*by).agg(
        F.count_if(hit & positive).alias("tp"),
        F.count_if(hit & negative).alias("fp"),
        F.count_if(~hit & negative).alias("tn"),
        F.count_if(~hit & positive).alias("fn"),
    )


def with_ratios(counts: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall and F1; 0.0 on an empty denominator."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rated = counts.withColumns(
        {
            "accuracy": safe_ratio(tp + tn, tp + fp + tn + fn),
            "precision": safe_ratio(tp, tp + fp),
            "recall": safe_ratio(tp, tp + fn),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", safe_ratio(F.lit(2.0) * p * r, p + r))


def classification_metrics(scored: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    return with_ratios(confusion(scored, threshold, by))


def step_counts(
    scored: DataFrame, grid: Sequence[float], by: Sequence[str] = (), label: str = "label", score: str = "score"
) -> DataFrame:
    """(by, reached, pos, neg): rows per number of grid thresholds that their score passes.

    At most ``len(grid) + 1`` rows per group.  Counts of several tables add up to the
    counts of all their rows.
    """
    grid = sorted(grid)
    values = known_score(score)
    splits = Bucketizer(
        splits=[float("-inf"), *grid, float("inf")], inputCol="value", outputCol="reached", handleInvalid="keep"
    )
    reached = F.least(F.col("reached").cast("int"), F.lit(len(grid)))  # NaN ranks above every number
    return (
        splits.transform(scored.select(*by, F.col(label).alias("label"), values.alias("value")))
        .groupBy(*by, reached.alias("reached"))
        .agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    )


def sweep_of_steps(steps: DataFrame, grid: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and ratios at every grid threshold from :func:`step_counts` of any number of tables."""
    grid = sorted(grid)
    if not by:  # an empty input still answers every threshold
        nothing = steps.sparkSession.range(1).selectExpr("0 AS reached", "0L AS pos", "0L AS neg")
        steps = steps.select("reached", "pos", "neg").unionByName(nothing)
    thresholds = F.posexplode(F.lit(grid)).alias("level", "threshold")
    passed = F.col("reached") > F.col("level")

    def total(column: str, condition: Column) -> Column:
        return F.sum(F.when(condition, F.col(column)).otherwise(F.lit(0)))

    counts = (
        steps.select(*by, "reached", "pos", "neg", thresholds)
        .groupBy(*by, "threshold")
        .agg(
            total("pos", passed).alias("tp"),
            total("neg", passed).alias("fp"),
            total("neg", ~passed).alias("tn"),
            total("pos", ~passed).alias("fn"),
        )
    )
    return with_ratios(counts).select(*by, "threshold", "tp", "fp", "tn", "fn", *RATIOS)


def threshold_sweep(
    scored: DataFrame, grid: Sequence[float], by: Sequence[str] = (), label: str = "label", score: str = "score"
) -> DataFrame:
    """Confusion counts and ratios at every grid threshold from one scan.

    Rows are counted per number of thresholds that their score passes; from these few
    counts every threshold is answered.
    """
    return sweep_of_steps(step_counts(scored, grid, by, label, score), grid, by)


class SweepState:
    """The step counts of every score file that was added to a sweep, kept in a folder.

    A new file is counted alone and its counts are put beside the others', so none of
    them is read again; adding a file once more replaces its own counts.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, spark: SparkSession, path: str, grid: Sequence[float] = GRID_51) -> "SweepState":
        rows = spark.createDataFrame([(float(t),) for t in sorted(grid)], "threshold double")
        rows.coalesce(1).write.parquet(f"{path}/grid")
        return cls(spark, path)

    def grid(self) -> list[float]:
        return sorted(r["threshold"] for r in self.spark.read.parquet(f"{self.path}/grid").collect())

    def add(self, source: str, scored: DataFrame, label: str = "label", score: str = "score") -> None:
        """Counts of a table (label, score) under the name ``source``."""
        counts = step_counts(scored, self.grid(), (), label, score).withColumn("source", F.lit(source))
        # a file without rows still has its folder, which empties what it had before
        nothing = self.spark.range(1).selectExpr("0 AS reached", "0L AS pos", "0L AS neg")
        counts = counts.unionByName(nothing.withColumn("source", F.lit(source)))
        writer = counts.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("source").parquet(f"{self.path}/steps")

    def steps(self) -> DataFrame:
        """(source, reached, pos, neg) of all files."""
        schema = "reached int, pos long, neg long, source string"
        return self.spark.read.schema(schema).parquet(f"{self.path}/steps")

    def sweep(self) -> DataFrame:
        """The sweep over the rows of all files."""
        return sweep_of_steps(self.steps(), self.grid())

    def sweep_by_source(self) -> DataFrame:
        return sweep_of_steps(self.steps(), self.grid(), ["source"])


def best_threshold(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sweep row of the highest F1; the lowest threshold wins a tie."""
    values = [c for c in sweep.columns if c not in by]
    best = F.max_by(F.struct(*values), F.struct("f1", -F.col("threshold")))
    return sweep.groupBy(*by).agg(best.alias("best")).select(*by, "best.*")


def curve_points(scored: DataFrame, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """ROC and precision-recall coordinates of every distinct score and of the score above it."""
    curve = score_curve(scored, tuple(by), buckets)
    negatives = F.col("total") - F.col("positives")
    tp0, pp0 = F.col("tp") - F.col("pos"), F.col("pp") - F.col("n")
    precision = safe_ratio(F.col("tp"), F.col("pp"))
    return curve.withColumns(
        {
            "recall": safe_ratio(F.col("tp"), F.col("positives")),
            "recall0": safe_ratio(tp0, F.col("positives")),
            "fpr": safe_ratio(F.col("pp") - F.col("tp"), negatives),
            "fpr0": safe_ratio(pp0 - tp0, negatives),
            "precision": precision,
            "precision0": F.when(pp0 == 0, precision).otherwise(safe_ratio(tp0, pp0)),
        }
    )


def _roc_area() -> Column:
    both = (F.max("positives") > 0) & (F.max("positives") < F.max("total"))
    strip = (F.col("fpr") - F.col("fpr0")) * (F.col("recall") + F.col("recall0")) / F.lit(2.0)
    return F.when(both, F.sum(strip))


def _pr_area() -> Column:
    strip = (F.col("recall") - F.col("recall0")) * (F.col("precision") + F.col("precision0")) / F.lit(2.0)
    return F.coalesce(F.sum(strip), F.lit(0.0))


def _step_area() -> Column:
    return F.coalesce(F.sum((F.col("recall") - F.col("recall0")) * F.col("precision")), F.lit(0.0))


def curve_areas(scored: DataFrame, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """roc_auc (null where one class is absent), pr_auc (trapezoid) and average_precision (steps)."""
    return (
        curve_points(scored, by, buckets)
        .groupBy(*by)
        .agg(_roc_area().alias("roc_auc"), _pr_area().alias("pr_auc"), _step_area().alias("average_precision"))
    )


def roc_auc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return curve_areas(scored, by).select(*by, "roc_auc")


def pr_auc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return curve_areas(scored, by).select(*by, "pr_auc")


def average_precision(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return curve_areas(scored, by).select(*by, "average_precision")


def evaluate_models(scored: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Confusion counts, ratios and areas of every model (and segment) from one curve."""
    hit = F.col("score") >= F.lit(threshold)
    neg = F.col("n") - F.col("pos")

    def total(condition: Column, value: Column) -> Column:
        return F.sum(F.when(condition, value).otherwise(F.lit(0)))

    counts = (
        curve_points(scored, by)
        .groupBy(*by)
        .agg(
            total(hit, F.col("pos")).alias("tp"),
            total(hit, neg).alias("fp"),
            total(~hit, neg).alias("tn"),
            total(~hit, F.col("pos")).alias("fn"),
            _roc_area().alias("auc_roc"),
            _pr_area().alias("auc_pr"),
        )
    )
    return with_ratios(counts).select(*by, "tp", "fp", "tn", "fn", *RATIOS, "auc_pr", "auc_roc")


def confusion_long(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Four labelled cells per confusion row."""
    cells = [("1", "1", "TP", "tp"), ("1", "0", "FN", "fn"), ("0", "1", "FP", "fp"), ("0", "0", "TN", "tn")]
    rows = F.array(
        *[
            F.struct(
                F.lit(true).alias("True"), F.lit(pred).alias("Pred"), F.lit(cell).alias("Cell"), F.col(c).alias("Count")
            )
            for true, pred, cell, c in cells
        ]
    )
    return counts.select(*by, F.inline(rows))
