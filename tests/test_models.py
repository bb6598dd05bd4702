from inspect import signature

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe.functions.columns import linear_margin, logistic
from riskframe.operators import explain, sampling, training
from riskframe.plans import jobs
from riskframe.plans import model_queries as mq
from riskframe.sources.models import AmbiguousModel, load_model, resolve_model, save_model


@pytest.fixture(scope="module")
def data(spark, sf_dir):
    return mq.vectors(spark, sf_dir)


@pytest.fixture(scope="module")
def logreg(data):
    return training.train_logreg(mq.part(data, "train"))


@pytest.fixture(scope="module")
def gbt(data):
    return training.train_gbt(mq.part(data, "train"), maxIter=5)


def test_linear_score_is_the_model(data, logreg):
    last = logreg.stages[-1]
    w = F.array(*[F.lit(float(v)) for v in last.coefficients.toArray()])
    test = mq.part(data, "test")
    rows = logreg.transform(test).select(
        vector_to_array("probability")[1].alias("a"),
        logistic(linear_margin(vector_to_array("features"), w, last.intercept)).alias("b"),
    )
    assert rows.where(F.abs(F.col("a") - F.col("b")) > 1e-9).count() == 0


@pytest.mark.parametrize("kind", ["logreg", "gbt", "rf"])
def test_score_from_the_raw_prediction_of_each_kind(data, logreg, gbt, kind):
    model = {"logreg": logreg, "gbt": gbt}.get(kind) or training.train_forest(mq.part(data, "train"), numTrees=4)
    out = model.transform(mq.part(data, "test"))
    a = out.select("tx_id", training.score_column(out).alias("a"))
    raw = out.drop("probability")
    b = raw.select("tx_id", training.score_column(raw, model).alias("b"))
    assert a.join(b, "tx_id").where(F.abs(F.col("a") - F.col("b")) > 1e-9).count() == 0
    with pytest.raises(ValueError, match="needs the"):
        training.score_column(raw)
    with pytest.raises(ValueError, match="neither"):
        training.score_column(raw.drop("rawPrediction"), model)


def test_batched_scores_vary(data):
    """The comparison with transform runs with the SQL twins; here, that the scores are not constant."""
    model = mq.fitted_mlp(data, (8,))
    rows = mq.part(data, "test").select(training.score_batched(model, vector_to_array("features")).alias("p"))
    low, high = rows.agg(F.min("p"), F.max("p")).first()
    assert 0.0 < low < high < 1.0


def test_model_round_trip_under_an_alias(spark, data, logreg, tmp_path):
    save_model(logreg, str(tmp_path), "lr")
    assert resolve_model(spark, str(tmp_path), "logreg").endswith("/lr")
    again = load_model(spark, str(tmp_path), "logreg")
    assert again.stages[-1].coefficients == logreg.stages[-1].coefficients
    with pytest.raises(FileNotFoundError, match="no model gbt"):
        resolve_model(spark, str(tmp_path), "gbt")
    (tmp_path / "gbtc").mkdir()  # an empty folder is no saved model
    with pytest.raises(FileNotFoundError, match="no model gbt"):
        resolve_model(spark, str(tmp_path), "gbt")
    save_model(logreg, str(tmp_path), "logreg")
    with pytest.raises(AmbiguousModel, match="keep one"):
        resolve_model(spark, str(tmp_path), "logreg")


def samples(data, n, m):
    rows = mq.dense(sampling.fixed_size_sample(mq.part(data, "test"), "tx_id", n))
    background = mq.dense(sampling.fixed_size_sample(mq.part(data, "train"), "tx_id", m, "background"))
    return rows, background


def sums(phi):
    return {r["tx_id"]: r["s"] for r in phi.groupBy("tx_id").agg(F.sum("phi").alias("s")).collect()}


def expected_sums(rows, background, scorer):
    base = scorer(background).agg(F.avg("p")).first()[0]
    return {r["tx_id"]: r["p"] - base for r in scorer(rows).collect()}


def test_attributions_add_up(data, gbt):
    rows, background = samples(data, 12, 2)
    scorer = explain.model_scorer(gbt)
    expected = expected_sums(rows, background, scorer)
    kernel = explain.shap_kernel(rows, "tx_id", background, mq.WIDTH, scorer, 60)
    assert sums(kernel) == pytest.approx(expected, abs=1e-9)
    walks = explain.shap_permutation(rows, "tx_id", background, mq.WIDTH, scorer, 2)
    assert sums(walks) == pytest.approx(expected, abs=1e-9)


def test_estimates_equal_the_exact_linear_values(data):
    """On a linear score both estimators give w * (x - mean of the background)."""
    rows, background = samples(data, 9, 4)
    w = [0.1 * ((i * 7) % 5 - 2) for i in range(mq.WIDTH)]

    def margin(df):
        return df.withColumn("p", linear_margin(F.col("x"), F.array(*[F.lit(v) for v in w])))

    mean = np.mean([r["x"] for r in background.collect()], axis=0)
    exact = {(r["tx_id"], i): w[i] * (r["x"][i] - mean[i]) for r in rows.collect() for i in range(mq.WIDTH)}
    for phi in (
        explain.shap_kernel(rows, "tx_id", background, mq.WIDTH, margin, 100),
        explain.shap_permutation(rows, "tx_id", background, mq.WIDTH, margin, 4),
    ):
        assert {(r["tx_id"], r["slot"]): r["phi"] for r in phi.collect()} == pytest.approx(exact, abs=1e-9)


@pytest.mark.parametrize("width, n", [(3, 6), (5, 30), (21, 100), (64, 200)])
def test_kernel_masks(width, n):
    masks, weights = explain.kernel_masks(width, n)
    assert len(masks) <= n and len(masks) == len(weights)
    assert weights.sum() == pytest.approx(1.0)
    assert 0 < masks.sum(axis=1).min() and masks.sum(axis=1).max() < width


def test_local_surrogate_finds_the_moving_slot(spark):
    train = spark.range(400).select("id", F.array(*[((F.col("id") * m) % 97 / 97.0) for m in (13, 29, 53)]).alias("x"))

    def scorer(df):
        return df.withColumn("p", F.when(F.col("x")[1] > 0.5, F.lit(1.0)).otherwise(F.lit(0.0)))

    rows = explain.lime_local(train.where("id < 3"), "id", train, scorer, n_samples=500, n_features=2).collect()
    assert len(rows) == 6
    for r in rows:
        if r["rank"] == 1:
            assert r["feature"] == "f1" and abs(r["weight"]) > 0.1


def test_importances_have_readable_names(spark, data, logreg):
    rows = training.importance_table({"logreg": logreg}, data).collect()
    assert [r["slot"] for r in rows] == list(range(21)) and rows[0]["name"].startswith("type_ohe_")


def test_nan_attributions_count_as_zero(spark):
    values = spark.createDataFrame([(0, float("nan")), (0, -2.0), (1, 0.5), (1, 0.5)], "slot int, value double")
    assert [tuple(r) for r in explain.mean_abs_by_feature(values).collect()] == [("f0", 1.0), ("f1", 0.5)]
    by_class = spark.createDataFrame([(0, 0, 5.0), (1, 0, 1.0)], "class int, slot int, phi double")
    assert explain.shap_summary(by_class).first()["mean_abs"] == 1.0


def test_registered_surrogates_use_all_neighbours(spark, sf_dir, monkeypatch):
    asked, lime_local = [], explain.lime_local
    default = signature(lime_local).parameters["n_samples"].default

    def spy(*args, **more):
        asked.append(more.get("n_samples", default))
        return lime_local(*args, **more)

    monkeypatch.setattr(explain, "lime_local", spy)
    mq.lime_local(spark, sf_dir)
    assert asked == [5000]


def test_surrogates_of_two_seeds_agree(data, logreg):
    """With all neighbours the strongest slot hardly depends on the draws."""
    rows = mq.dense(mq.part(data, "test")).limit(60)
    train, scorer = mq.dense(mq.part(data, "train")), explain.model_scorer(logreg)
    top = [
        {r["tx_id"]: r["feature"] for r in explain.lime_local(rows, "tx_id", train, scorer, seed=s).where("rank = 1").collect()}
        for s in (1, 2)
    ]
    assert len(top[0]) == 60 and np.mean([top[1][i] == f for i, f in top[0].items()]) > 0.75


def test_registered_attributions_use_a_large_background(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(mq, "adding_up", lambda phi, rows, background, scorer: seen.append(background.count()))
    mq.shap_kernel(spark, sf_dir)
    mq.shap_permutation(spark, sf_dir)
    assert seen == [100, 100]
    assert signature(jobs.explain).parameters["background_n"].default == 100
