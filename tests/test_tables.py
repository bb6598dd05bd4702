import json

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskframe.functions import columns as c
from riskframe.operators import encoding, evaluation, features, reporting, sampling
from riskframe.plans import jobs
from riskframe.sources import files
from riskframe.sources.transactions import TRANSACTION_SCHEMA, scored, transactions

REPORT = {
    "logreg": {
        "metrics": {"Accuracy": 0.59, "f1": 0.0387, "auc": None, "lr_coeff_top": [["f4", -0.26]]},
        "confusion_matrix": [[876903, 600600], [10798, 12322]],
        "train_frac": 0.01,
        "f1": 0.5,
        "used_weight": True,
        "note": "0.7",
    },
    "broken": 3,
}


def test_report_fields(spark, tmp_path):
    (tmp_path / "report.json").write_text(json.dumps(REPORT, indent=2))
    documents = files.read_documents(spark, str(tmp_path), whole_files=True)
    got = {(r["model"], r["metric"]): r["value"] for r in reporting.normalise_documents(documents).collect()}
    assert got == {
        ("logreg", "accuracy"): 0.59, ("logreg", "f1"): 0.0387, ("logreg", "train_frac"): 0.01,
        ("logreg", "used_weight"): 1.0,
    }
    assert documents.first()["source_file"].endswith("report.json")


def test_documents_round_trip(spark, sf_dir, tmp_path):
    table = evaluation.evaluate_models(scored(spark, sf_dir).withColumn("model", F.lit("rule")), ["model"])
    files.write_documents(reporting.metric_documents(table), str(tmp_path / "d"))
    document = json.loads(files.read_documents(spark, str(tmp_path / "d")).first()["document"])
    row = table.first()
    assert document["rule"]["confusion_matrix"] == [[row["tn"], row["fp"]], [row["fn"], row["tp"]]]
    assert document["rule"]["metrics"]["auc_roc"] == row["auc_roc"]


def test_label_aliases_are_case_sensitive(spark):
    df = spark.createDataFrame([(1,)], "Fraud int")
    assert c.with_label(df).first()["label"] == 1
    with pytest.raises(ValueError, match="no label"):
        c.with_label(spark.createDataFrame([(1,)], "FRAUD int"))
    with pytest.raises(ValueError, match="missing columns"):
        c.require_columns(df, ["label"])


def test_sparse_and_dense_vectors_agree(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 7.0, 0.0, 0.0)], ", ".join(f"{n} double" for n in "abcdeg"))
    sparse = VectorAssembler(inputCols=df.columns, outputCol="v").transform(df)
    assert "SparseVector" in type(sparse.first()["v"]).__name__
    dense = df.select(array_to_vector(F.array(*df.columns)).alias("v"))
    assert sparse.select(vector_to_array("v")).first()[0] == dense.select(vector_to_array("v")).first()[0]


def test_weight_is_not_a_feature(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1, 9.0)], "a double, b double, label int, weight double")
    assert c.flat_feature_columns(df) == ["a", "b"]


def test_dictionaries_of_any_size_are_numbered_in_order(spark):
    df = spark.range(300).select(F.concat(F.lit("k"), F.format_string("%03d", "id")).alias("type"))
    assert encoding.dictionary(df, "type").count() == 300
    encoded = encoding.dict_encode(df, "type", "idx")
    assert all(int(r["type"][1:]) == r["idx"] for r in encoded.collect())
    assert encoding.dict_encode(df, "type", "idx", start=1).agg(F.min("idx")).first()[0] == 1


def test_class_weight_without_one_class(spark):
    none = spark.createDataFrame([(0,), (0,)], "label int")
    assert {r["weight"] for r in encoding.with_class_weight(none).collect()} == {1.0}
    assert encoding.floored_class_weight(none).first()["pos_weight"] == 2.0


def test_feature_layout(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    vectors = features.fit_features(tx).transform(tx)
    names = features.slot_names(vectors)
    assert len(names) == 21 and names[15:] == [f"num_scaled_{i}" for i in range(6)]
    unknown = tx.limit(1).withColumn("type", F.lit("NEW")).withColumn("merchant", F.lit("NEW"))
    row = features.fit_features(tx).transform(unknown).select(vector_to_array("features").alias("x")).first()["x"]
    assert row[5] == 1.0 and row[14] == 1.0 and sum(row[:15]) == 2.0


def test_scans(spark, sf_dir, tmp_path):
    raw = transactions(spark, sf_dir).select(*TRANSACTION_SCHEMA.fieldNames())
    raw.write.parquet(str(tmp_path / "deep" / "p"))
    raw.write.option("header", True).csv(str(tmp_path / "c"))
    total = raw.agg(F.sum("amount")).first()[0]
    for scan in (
        files.scan_any(spark, str(tmp_path / "deep")  + "/p"),
        files.scan_any(spark, str(tmp_path / "c"), TRANSACTION_SCHEMA),
        files.scan_csv(spark, str(tmp_path / "c")),
        files.scan_parquet(spark, str(tmp_path / "deep"), glob="*.parquet", recursive=True),
    ):
        assert scan.agg(F.sum("amount")).first()[0] == pytest.approx(total)
    with pytest.raises(FileNotFoundError):
        files.scan_any(spark, str(tmp_path / "absent"))


def test_split_reads_one_folder(spark, sf_dir, tmp_path):
    split = sampling.three_way_split(transactions(spark, sf_dir), "tx_id")
    files.write_splits(split, str(tmp_path / "s"), ["tx_id"])
    train = files.read_split(spark, str(tmp_path / "s"), "train")
    assert train.count() == split.where("split = 'train'").count()
    assert "PartitionFilters: [isnotnull(split" in train._jdf.queryExecution().toString()


def test_extract_without_ids(spark, sf_dir, tmp_path):
    """Twelve columns, in another order, several files: ids are unique and splits repeat."""
    source = str(tmp_path / "raw.csv")
    raw = transactions(spark, sf_dir).select(*reversed(TRANSACTION_SCHEMA.fieldNames()))
    raw.repartition(3).write.option("header", True).csv(source)
    rows = jobs.read_transactions(spark, source)
    assert rows.select("tx_id").distinct().count() == 1000 and dict(rows.dtypes)["amount"] == "double"
    assert rows.agg(F.sum("amount")).first()[0] == pytest.approx(raw.agg(F.sum("amount")).first()[0])
    def splits():
        fresh = jobs.read_transactions(spark, source)
        return sorted(map(tuple, sampling.three_way_split(fresh, "tx_id").select("tx_id", "split").collect()))

    first = splits()
    for key, values in (("spark.sql.files.maxPartitionBytes", ("128m", "20k")), ("spark.sql.files.minPartitionNum", ("4", "16"))):
        for value in values:  # however the files are cut, every row keeps its id and its split
            spark.conf.set(key, value)
            assert splits() == first
        spark.conf.unset(key)
    jobs.sequences(spark, source, str(tmp_path / "seq"), 20)
    assert spark.read.parquet(str(tmp_path / "seq")).count() == 44


def test_jobs_from_csv_to_report(spark, sf_dir, tmp_path):
    source, data, models = (str(tmp_path / n) for n in ("tx.csv", "data", "models"))
    transactions(spark, sf_dir).select("tx_id", *TRANSACTION_SCHEMA.fieldNames()).write.option("header", True).csv(source)
    jobs.prepare(spark, source, data)
    meta = json.loads(files.read_documents(spark, f"{data}/meta").first()["document"])
    n_train = files.read_split(spark, f"{data}/splits", "train").count()
    assert meta["pos"] + meta["neg"] == n_train and meta["num_cols"] == features.NUMERIC
    trained = jobs.train(spark, data, models, ["logreg", "mlp"], report_path=str(tmp_path / "trained"))
    assert {r["model"]: r["used_weight"] for r in trained.collect()} == {"logreg": True, "mlp": False}
    document = json.loads(files.read_documents(spark, str(tmp_path / "trained")).first()["document"])
    assert document["logreg"]["train_frac"] == 1.0 and "metrics" in document["mlp"]
    with pytest.warns(UserWarning, match="gbt, rf"):
        report = jobs.evaluate(spark, data, models, str(tmp_path / "report"))
    assert sorted(r["model"] for r in report.collect()) == ["logreg", "mlp"]
    document = json.loads(files.read_documents(spark, str(tmp_path / "report")).first()["document"])
    assert document["missing_models"] == ["gbt", "rf"] and len(document["logreg"]["top_coefficients"]) == 10
    assert document["mlp"]["metrics_030"]["threshold"] == 0.3 and 0 <= document["mlp"]["best_f1"]["threshold"] < 1
    sweep = jobs.sweep(spark, data, models, "logreg", str(tmp_path / "sweep"))
    assert sweep.count() == 19
    document = json.loads(files.read_documents(spark, str(tmp_path / "sweep")).first()["document"])
    assert len(document["sweep"]) == 19 and document["model"] == "logreg"
    jobs.sequences(spark, source, str(tmp_path / "seq"), 20)
    assert spark.read.parquet(str(tmp_path / "seq")).count() == 44
    jobs.export(spark, data, models, "logreg", str(tmp_path / "out"), sample_rows=50)
    scores = files.scan_csv(spark, str(tmp_path / "out" / "scores"), "label int, score double")
    assert scores.count() == sum(report.first()[cell] for cell in ("tp", "fp", "tn", "fn"))
    assert files.scan_parquet(spark, str(tmp_path / "out" / "sample")).count() == 50
    parameters = json.loads(files.read_documents(spark, str(tmp_path / "out" / "parameters")).first()["document"])
    assert len(parameters["coefficients"]) == 21
    top = jobs.explain(spark, data, models, "logreg", str(tmp_path / "phi"), background_n=2)
    assert top.count() == 20
