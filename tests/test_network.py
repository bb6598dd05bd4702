import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskframe.operators import network, training
from riskframe.sources.models import load_model, save_model

SIZES = [4, 6, 3, 2]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 4))
    y = (x[:, 0] + x[:, 1] ** 2 > 1.2).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, x array<double>, label double")
    return df.select("id", "x", "label", array_to_vector("x").alias("features")).repartition(5, "id")


def prepared(df, weight):
    return df.select("x", F.col("label").cast("int").alias("label"), weight.cast("double").alias("weight"))


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    x, y, w = rng.standard_normal((30, 4)), rng.integers(0, 2, 30), rng.random(30) * 3
    flat = network.starting_parameters(SIZES) + 0.1 * rng.standard_normal(network.n_parameters(SIZES))
    loss, gradient = network.loss_and_gradient(flat, SIZES, x, y, w)
    for i in rng.integers(0, len(flat), 25):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, down = (network.loss_and_gradient(flat + s, SIZES, x, y, w)[0] for s in (step, -step))
        assert gradient[i] == pytest.approx((up - down) / 2e-6, rel=1e-5, abs=1e-6)


def test_sums_over_tasks_are_those_of_one_matrix(spark, rows):
    objective = network.distributed_objective(prepared(rows, F.col("id") % 3 + 1), SIZES)
    flat = network.starting_parameters(SIZES, 5)
    loss, gradient = objective(flat)
    local = rows.collect()
    x, y = np.array([r["x"] for r in local]), np.array([int(r["label"]) for r in local])
    w = np.array([r["id"] % 3 + 1.0 for r in local])
    expected = network.loss_and_gradient(flat, SIZES, x, y, w)
    assert loss == pytest.approx(expected[0] / w.sum(), abs=1e-12)
    assert gradient == pytest.approx(expected[1] / w.sum(), abs=1e-12)
    again = objective(flat)
    assert again[0] == loss and (again[1] == gradient).all()


def scores(model, rows):
    return {r["id"]: r["p"] for r in model.transform(rows).select("id", vector_to_array("probability")[1].alias("p")).collect()}


def test_weight_one_is_no_weight_and_two_is_the_row_twice(rows):
    def fit(df, weight="weight"):
        return network.train_weighted_network(df, (6, 3), weight, max_iter=8)

    plain, losses = fit(rows, None)
    assert all(b < a for a, b in zip(losses, losses[1:])) and len(losses) > 4
    ones, _ = fit(rows.withColumn("weight", F.lit(1)))
    assert scores(ones, rows) == scores(plain, rows)
    double = F.col("id") % 4 == 0
    heavy, heavy_losses = fit(rows.withColumn("weight", F.when(double, 2.0).otherwise(1.0)))
    twice, twice_losses = fit(rows.withColumn("weight", F.lit(1.0)).unionByName(rows.where(double).withColumn("weight", F.lit(1.0))))
    assert heavy_losses == pytest.approx(twice_losses, rel=1e-6)
    assert scores(heavy, rows) == pytest.approx(scores(twice, rows), abs=1e-5)
    assert scores(heavy, rows) != pytest.approx(scores(plain, rows), abs=1e-3)
    nothing = rows.withColumn("weight", F.when(double, 0.0).otherwise(1.0))
    assert scores(fit(nothing)[0], rows) == pytest.approx(scores(fit(rows.where(~double), None)[0], rows), abs=1e-5)


def test_the_fit_is_one_of_sparks_models(spark, rows, tmp_path):
    model, losses = network.train_weighted_network(rows, (6, 3), None, max_iter=5)
    sizes = list(model.stages[-1].getLayers())
    assert sizes == SIZES
    local = rows.collect()
    x, y = np.array([r["x"] for r in local]), np.array([int(r["label"]) for r in local])
    flat = model.stages[-1].weights.toArray()
    assert network.loss_and_gradient(flat, sizes, x, y, np.ones(len(y)))[0] / len(y) == pytest.approx(losses[-1], abs=1e-9)
    p = training.batch_scorer(model)(x)
    assert [scores(model, rows)[r["id"]] for r in local] == pytest.approx(list(p), abs=1e-12)
    save_model(model, str(tmp_path), "mlp")
    assert scores(load_model(spark, str(tmp_path), "mlp"), rows) == scores(model, rows)


def test_it_learns_as_well_as_sparks_fit(rows):
    own, losses = network.train_weighted_network(rows, (6, 3), None, max_iter=40)
    other = training.train_mlp(rows, 4, (6, 3), maxIter=40)
    local = rows.collect()
    x, y = np.array([r["x"] for r in local]), np.array([int(r["label"]) for r in local])
    theirs = network.loss_and_gradient(other.stages[-1].weights.toArray(), SIZES, x, y, np.ones(len(y)))[0] / len(y)
    assert losses[-1] < max(0.25, 1.5 * theirs)


def test_no_rows(rows):
    with pytest.raises(ValueError, match="no rows"):
        network.train_weighted_network(rows.where("false"), (3,), None)
    with pytest.raises(ValueError, match="no rows"):
        network.train_weighted_network(rows.withColumn("weight", F.lit(0.0)), (3,))


def test_sparks_fit_whatever_the_partitions(rows):
    """Rows in blocks of 10, 256 and 134 give the fit that Spark makes of all rows in one block."""
    few = F.col("id") < 10
    uneven = rows.where(few).coalesce(1).unionByName(rows.where(~few).coalesce(1))
    own = training.train_mlp(uneven, 4, (6, 3)).stages[-1]
    spark_fit = MultilayerPerceptronClassifier(layers=SIZES, maxIter=20, seed=42, blockSize=400).fit(rows.coalesce(1))
    assert own.weights.toArray() == pytest.approx(spark_fit.weights.toArray(), abs=1e-7)
    settings = ["solver", "maxIter", "tol", "seed", "stepSize"]
    assert [own.getOrDefault(s) for s in settings] == [spark_fit.getOrDefault(s) for s in settings]


def test_blocks_are_the_rows(rows):
    """Packed rows, some of them several times in a row, have the loss and the gradient of the plain ones."""
    again = rows.select("id", "x", "label", F.explode(F.sequence(F.lit(0), F.col("id") % 3))).coalesce(2)
    plain = prepared(again, F.lit(1.0))
    blocks = plain.select("x", "label").mapInArrow(network._packed(4, 2), "block binary")
    flat = network.starting_parameters(SIZES, 5)
    expected = network.distributed_objective(plain, SIZES)(flat)
    for tasks in (None, 2):
        loss, gradient = network.distributed_objective(blocks, SIZES, tasks)(flat)
        assert loss == pytest.approx(expected[0], abs=1e-12)
        assert gradient == pytest.approx(expected[1], abs=1e-12)


def test_rows_that_cannot_be_learnt_from_are_refused(rows):
    third = F.col("id") == 3
    bad = [
        rows.withColumn("label", F.when(~third, F.col("label"))),
        rows.withColumn("label", F.when(third, 2.0).otherwise(F.col("label"))),
        rows.withColumn("features", array_to_vector(F.transform("x", lambda v: F.when(third, float("nan")).otherwise(v)))),
        rows.withColumn("features", array_to_vector(F.when(third, F.array(F.lit(1.0))).otherwise(F.col("x")))),
    ]
    for df, message in zip(bad, ["labels", "labels", "features", "features"]):
        with pytest.raises(Exception, match=f"{message} must be"):
            training.train_mlp(df, 4, (3,), maxIter=1)
