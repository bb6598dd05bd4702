import math

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskframe.functions.columns import positive_probability
from riskframe.operators import evaluation as ev
from riskframe.operators.ranking import score_curve
from riskframe.sources.transactions import scored

# Published confusion matrices (tn, fp, fn, tp) and the ratios reported with them.
PUBLISHED = [
    ((876903, 600600, 10798, 12322), (0.592571, 0.020104, 0.532958, 0.038746)),
    ((1149406, 328097, 16305, 6815), (0.770494, 0.020349, 0.294766, 0.038069)),
    ((1145294, 332209, 16791, 6329), (0.767430, 0.018695, 0.273746, 0.035000)),
    ((874503, 600291, 10826, 12285), (0.592019, 0.020055, 0.531565, 0.038651)),
    ((1433, 0, 31, 0), (0.978825, 0.0, 0.0, 0.0)),
    ((31875, 17326, 451, 348), (0.644460, 0.019690, 0.435544, 0.037677)),
    ((0, 49201, 0, 799), (0.015980, 0.015980, 1.0, 0.031457)),
]


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "label int, score double")


@pytest.mark.parametrize("counts, ratios", PUBLISHED)
def test_published_ratios(spark, counts, ratios):
    table = spark.createDataFrame([counts], "tn long, fp long, fn long, tp long")
    row = ev.with_ratios(table).first()
    assert [round(row[c], 6) for c in ev.RATIOS] == pytest.approx(ratios, abs=1.1e-6)


EXAMPLE = [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8), (1, 0.1)]


@pytest.mark.parametrize("buckets", [2, 3, 64, None])
def test_areas_by_hand(spark, buckets):
    row = ev.curve_areas(frame(spark, EXAMPLE), buckets=buckets).first()
    assert row["roc_auc"] == pytest.approx(0.58333333333)
    assert row["pr_auc"] == pytest.approx(0.73888888888)
    assert row["average_precision"] == pytest.approx(0.75555555555)


def test_areas_match_the_library_evaluator(spark, sf_dir):
    scores = scored(spark, sf_dir).withColumn("raw", array_to_vector(F.array(-F.col("score"), F.col("score"))))
    row = ev.curve_areas(scores).first()
    for metric, column in [("areaUnderROC", "roc_auc"), ("areaUnderPR", "pr_auc")]:
        judge = BinaryClassificationEvaluator(
            metricName=metric, labelCol="label", rawPredictionCol="raw", numBins=0
        )
        assert row[column] == pytest.approx(judge.evaluate(scores), abs=1e-12)


@pytest.mark.parametrize("parts", [1, 7])
def test_areas_do_not_depend_on_partitions(spark, sf_dir, parts):
    scores = scored(spark, sf_dir)
    a, b = ev.curve_areas(scores).first(), ev.curve_areas(scores.repartition(parts)).first()
    assert a.asDict() == pytest.approx(b.asDict(), abs=1e-12)


def test_one_class_and_empty(spark):
    only_negative = ev.curve_areas(frame(spark, [(0, 0.2), (0, 0.3)])).first()
    assert only_negative["roc_auc"] is None and only_negative["pr_auc"] == 0.0
    only_positive = ev.curve_areas(frame(spark, [(1, 0.2), (1, 0.3)])).first()
    assert only_positive["roc_auc"] is None and only_positive["average_precision"] == 1.0
    empty = frame(spark, [])
    assert ev.curve_areas(empty).first()["roc_auc"] is None
    assert ev.confusion(empty).first().asDict() == {"tp": 0, "fp": 0, "tn": 0, "fn": 0}
    assert ev.threshold_sweep(empty, ev.GRID_19).count() == 19


def test_all_scores_tied(spark):
    row = ev.curve_areas(frame(spark, [(1, 0.5), (0, 0.5), (0, 0.5), (1, 0.5)])).first()
    assert row["roc_auc"] == 0.5 and row["pr_auc"] == 0.5


def test_one_score_holding_most_rows(spark):
    rows = [(i % 3 == 0, 0.25) for i in range(600)] + [(i % 2, i / 400) for i in range(400)]
    scores = frame(spark, [(int(a), float(b)) for a, b in rows])
    curve = sorted(score_curve(scores, buckets=16).collect(), key=lambda r: -r["score"])
    tp = pp = 0
    for r in curve:
        same = [a for a, b in rows if b == r["score"]]
        tp, pp = tp + sum(same), pp + len(same)
        assert (r["tp"], r["pp"], r["n"]) == (tp, pp, len(same))
    assert len(curve) == len({b for _, b in rows})


def test_scores_outside_the_unit_interval(spark):
    scores = frame(spark, [(1, 1e300), (0, -1e300), (1, 5.0), (0, 4.0), (1, -2.0)])
    assert ev.curve_areas(scores, buckets=4).first()["roc_auc"] == pytest.approx(5 / 6)


def test_sweep_counts_scores_on_a_threshold(spark):
    scores = frame(spark, [(1, t) for t in ev.GRID_19] + [(0, 0.0), (0, 1.0)])
    for row in ev.threshold_sweep(scores, ev.GRID_19).collect():
        assert row["tp"] == sum(t >= row["threshold"] for t in ev.GRID_19)
        assert row["fp"] == 1
        assert row["tp"] + row["fp"] + row["tn"] + row["fn"] == 21


def test_recall_falls_with_the_threshold(spark, sf_dir):
    rows = sorted(ev.threshold_sweep(scored(spark, sf_dir), ev.GRID_51).collect(), key=lambda r: r["threshold"])
    assert all(a["recall"] >= b["recall"] for a, b in zip(rows, rows[1:]))


def test_sweep_equals_separate_confusions(spark, sf_dir):
    scores = scored(spark, sf_dir)
    sweep = {r["threshold"]: r for r in ev.threshold_sweep(scores, [0.2, 0.45, 0.9]).collect()}
    for t, row in sweep.items():
        one = ev.classification_metrics(scores, t).first()
        assert all(row[c] == one[c] for c in one.asDict())


def test_lowest_threshold_wins_a_tie(spark):
    sweep = ev.threshold_sweep(frame(spark, [(1, 0.9), (0, 0.1)]), ev.GRID_19)
    best = ev.best_threshold(sweep).first()
    assert best["threshold"] == 0.15 and best["f1"] == 1.0


def test_nan_and_null_scores(spark):
    scores = frame(spark, [(1, math.nan), (0, None), (1, 0.7), (0, 0.2)])
    row = ev.threshold_sweep(scores, [0.5]).first()
    assert (row["tp"], row["fp"], row["tn"], row["fn"]) == (2, 0, 2, 0)


def test_null_probability_counts_as_zero(spark):
    vectors = frame(spark, [(1, 0.7), (0, None)]).select(
        F.when(F.col("score").isNotNull(), array_to_vector(F.array(F.lit(0.3), F.col("score")))).alias("p")
    )
    assert {r[0] for r in vectors.select(positive_probability(F.col("p"))).collect()} == {0.7, 0.0}
