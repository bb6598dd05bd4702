"""Category tables, account layouts, sweep states and folders of reports."""

import json
import random

import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from riskframe.operators import categories, evaluation, reporting, sequences
from riskframe.plans import jobs
from riskframe.sources import files
from riskframe.sources.transactions import activity, transactions


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_are_those_of_the_indexer(spark):
    rng = random.Random(1)
    names = [f"n{rng.randrange(60)}" for _ in range(900)] + ["é", "Z", "z", "", "a b"]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string").repartition(7)
    model = StringIndexer(inputCol="name", outputCol="i", handleInvalid="keep").fit(df)
    expected = {label: i for i, label in enumerate(model.labels)}
    found = categories.frequency_numbers(df, "name").collect()
    assert {r["value"]: r["idx"] for r in found} == expected


def test_index_is_kept_as_a_table(spark, tmp_path):
    train = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), (None, "y")], "m string, t string")
    path = str(tmp_path / "index")
    categories.CategoryIndex.fit(train, ["m", "t"], path)
    index = categories.CategoryIndex.load(spark, path)
    rows = spark.createDataFrame([(1, "b", "x", 2.0), (2, "a", "new", 0.0), (3, None, "y", None)], "id int, m string, t string, v double")
    got = {r["id"]: (r["m_idx"], r["t_idx"]) for r in index.transform(rows).collect()}
    assert got == {1: (1.0, 1.0), 2: (0.0, 2.0), 3: (2.0, 0.0)}
    sparse = {r["id"]: (r["slots"], r["values"]) for r in index.sparse_slots(rows, ["v"]).collect()}
    # m has slots 0..2, t slots 3..5, v slot 6
    assert sparse == {1: ([1, 4, 6], [1.0, 1.0, 2.0]), 2: ([0, 5], [1.0, 1.0]), 3: ([2, 3], [1.0, 1.0])}
    empty = categories.CategoryIndex.fit(train.where("false"), ["m"], str(tmp_path / "none"))
    assert [r["m_idx"] for r in empty.transform(rows).collect()] == [0.0] * 3


def test_a_long_dictionary_stays_distributed(spark, tmp_path):
    """300,000 names: the plan joins two tables by value, and the fit collects nothing."""
    many = spark.range(600_000).select(F.concat(F.lit("m"), (F.col("id") % 300_000).cast("string")).alias("m"), "id")
    index = categories.CategoryIndex.fit(many, ["m"], str(tmp_path / "many"))
    coded = index.transform(many)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan_of(coded) or "ShuffledHashJoin" in plan_of(coded)
        n, low, high, wrong = coded.agg(
            F.countDistinct("m_idx"), F.min("m_idx"), F.max("m_idx"), F.count_if(F.col("m_idx").isNull())
        ).first()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert (n, low, high, wrong) == (300_000, 0.0, 299_999.0, 0)


@pytest.mark.parametrize("hot_rows", [20, 10**9])
def test_layout_gives_the_same_sequences(spark, sf_dir, tmp_path, hot_rows):
    tx, survey = transactions(spark, sf_dir), activity(spark, sf_dir)
    name = f"accounts_{hot_rows}"
    layout = sequences.AccountLayout.write(tx, name, str(tmp_path / name), 5, hot_rows=hot_rows, survey=survey)
    try:
        ordinary, hot = layout.ranked(spark)
        assert (hot.count() > 0) == (hot_rows == 20) and ordinary.count() + hot.count() == tx.count()
        assert "Exchange" not in plan_of(ordinary)  # nothing below the window but a sorted bucket
        got = layout.sequences(spark, 5)
        expected = sequences.build_sequences(tx, 5, survey=survey)
        assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0
        assert expected.count() > 0
    finally:
        layout.drop(spark)


def test_only_one_split_is_read(spark, sf_dir, tmp_path):
    path = str(tmp_path / "splits")
    rows = activity(spark, sf_dir).withColumn("split", F.when(F.col("tx_id") % 2 == 0, "train").otherwise("test"))
    files.write_splits(rows, path, ("tx_id", "type"))
    one = files.read_split(spark, path, "train")
    assert "PartitionFilters: [isnotnull(split" in plan_of(one)
    assert len(one.inputFiles()) > 0 and one.where("tx_id % 2 = 1").count() == 0


def test_adding_a_file_equals_a_sweep_over_all(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), rng.choice([None, 0.0, 0.02, 0.5, 1.0, rng.random()]), i % 4) for i in range(800)]
    df = spark.createDataFrame(rows, "label int, score double, part int")
    state = evaluation.SweepState.create(spark, str(tmp_path / "state"), evaluation.GRID_51)
    for part in range(4):
        state.add(f"f{part}", df.where(f"part = {part}"))
        so_far = evaluation.threshold_sweep(df.where(f"part <= {part}"), evaluation.GRID_51)
        assert sorted(map(tuple, state.sweep().collect())) == sorted(map(tuple, so_far.collect()))
    state.add("f2", df.where("part = 2"))  # once more: the same
    state.add("empty", df.where("false"))
    whole = sorted(map(tuple, evaluation.threshold_sweep(df, evaluation.GRID_51).collect()))
    assert sorted(map(tuple, state.sweep().collect())) == whole
    state.add("f3", df.where("false"))  # replaced by nothing
    rest = sorted(map(tuple, evaluation.threshold_sweep(df.where("part < 3"), evaluation.GRID_51).collect()))
    assert sorted(map(tuple, evaluation.SweepState(spark, str(tmp_path / "state")).sweep().collect())) == rest
    by_source = state.sweep_by_source().where("source = 'f0'").drop("source")
    own = evaluation.threshold_sweep(df.where("part = 0"), evaluation.GRID_51)
    assert sorted(map(tuple, by_source.collect())) == sorted(map(tuple, own.collect()))


def reports(folder):
    folder.mkdir()
    shapes = {
        "spark_test_metrics.json": {
            "logreg": {"metrics": {"accuracy": 0.9, "AUC_PR": 0.5, "note": "x"}, "confusion_matrix": [[1, 2], [3, 4]]},
            "rf": {"accuracy": 0.7, "metrics": None},
            "other": {"f1": 0.1},
            "missing_models": ["gbt"],
        },
        "dl_lstm_metrics.json": {"model": "lstm", "test_metrics_t0_50": {"f1": 0.25, "recall": 1}, "best_f1": {"threshold": 0.35}},
        "dl_cnn_metrics.json": {"test_metrics_t0_50": {"f1": 0.75}},
        "threshold_sweep_rf.json": {"model": "rf", "pr_auc": 0.3, "sweep": [{"threshold": 0.05, "f1": 0.2}, {"threshold": 0.1, "f1": 0.4}]},
        "list.json": [1, 2],
    }
    for name, body in shapes.items():
        (folder / name).write_text(json.dumps(body, indent=2))
    (folder / "broken.json").write_text("{not json")
    (folder / "ignored.txt").write_text("{}")


def test_reports_of_all_shapes(spark, tmp_path):
    reports(tmp_path / "r")
    found = reporting.all_reports(files.read_reports(spark, str(tmp_path / "r" / "*.json"))).collect()
    got = {(r["name"], r["kind"], r["model"], r["threshold"], r["metric"]): r["value"] for r in found}
    s, n, t = "spark_test_metrics.json", "dl_lstm_metrics.json", "threshold_sweep_rf.json"
    assert got == {
        (s, "models", "logreg", 0.5, "accuracy"): 0.9,
        (s, "models", "logreg", 0.5, "auc_pr"): 0.5,
        (s, "models", "rf", 0.5, "accuracy"): 0.7,
        (s, "models", "other", 0.5, "f1"): 0.1,
        (n, "network", "lstm", 0.5, "f1"): 0.25,
        (n, "network", "lstm", 0.5, "recall"): 1.0,
        (n, "network", "lstm", 0.5, "best_threshold"): 0.35,
        ("dl_cnn_metrics.json", "network", "cnn", 0.5, "f1"): 0.75,
        (t, "sweep", "rf", 0.05, "f1"): 0.2,
        (t, "sweep", "rf", 0.1, "f1"): 0.4,
    }
    table = jobs.compare(spark, str(tmp_path / "r" / "*.json"), str(tmp_path / "out")).collect()
    rows = {r["model"]: r for r in table}
    assert set(rows) == {"LOGREG", "RF", "LSTM", "CNN"}
    assert (rows["LSTM"]["threshold"], rows["LSTM"]["f1"], rows["LSTM"]["source"]) == ("0.35", 0.25, "DL")
    assert (rows["LOGREG"]["threshold"], rows["LOGREG"]["pr_auc"], rows["LOGREG"]["display_name"]) == ("0.50", 0.5, "Logistic Regression")
    assert rows["CNN"]["threshold"] is None
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 4


def test_sweep_of_score_files(spark, tmp_path):
    rows = [(i % 2, i / 40) for i in range(40)]
    for part in (0, 1):
        own = [r for i, r in enumerate(rows) if i % 4 // 2 == part]
        (tmp_path / f"scores_{part}.csv").write_text("label,score\n" + "\n".join(f"{a},{b}" for a, b in own))
    for part in (0, 1):
        table = jobs.sweep_scores(spark, str(tmp_path / f"scores_{part}.csv"), f"m{part}", str(tmp_path / "state"), str(tmp_path / "doc"))
    whole = evaluation.threshold_sweep(spark.createDataFrame(rows, "label int, score double"), evaluation.GRID_51)
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, whole.collect()))
    document = json.loads(spark.read.text(str(tmp_path / "doc")).first()[0])
    assert len(document["sweep"]) == 51 and document["model"] == "m1"
