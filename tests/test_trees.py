from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskframe.operators import explain, features, training, trees
from riskframe.plans import model_queries as mq

WIDTH = 10


@pytest.fixture(scope="module")
def rows(spark):
    """Ten slots: numbers, and categories of two, three and five values."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((900, WIDTH)).round(2)
    for slot, arity in ((2, 2), (5, 3), (8, 5)):
        x[:, slot] = rng.integers(0, arity, len(x))
    y = ((x[:, 0] * x[:, 1] > 0.1) ^ (x[:, 5] == 1) | (x[:, 8] > 2) & (x[:, 2] == 0)).astype(float)
    data = [(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "id long, x array<double>, label double")
    df = df.withColumn("raw", array_to_vector("x"))
    indexer = VectorIndexer(inputCol="raw", outputCol="features", maxCategories=5).fit(df)  # marks the category slots
    return indexer.transform(df).select("id", "x", "label", "features")


@pytest.fixture(scope="module", params=["gbt", "rf", "deep"])
def model(request, rows):
    fit = {
        "gbt": GBTClassifier(featuresCol="features", maxIter=6, maxDepth=5, seed=1),
        "rf": RandomForestClassifier(featuresCol="features", numTrees=5, maxDepth=4, seed=1),
        "deep": GBTClassifier(featuresCol="features", maxIter=2, maxDepth=9, seed=1),  # slots come again on a way
    }[request.param]
    return Pipeline(stages=[fit]).fit(rows)


def odd_values():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((50, WIDTH)), np.full((1, WIDTH), 0.5), np.full((1, WIDTH), 7.0)])
    x[:20, [2, 5, 8]] = rng.integers(0, 6, (20, 3))
    x[3, 0] = np.nan
    return x


def test_column_and_batch_scores_are_the_model(spark, rows, model):
    nodes = trees.ensemble(model)
    odd = spark.createDataFrame([(-1 - i, v.tolist(), 0.0) for i, v in enumerate(odd_values())], "id long, x array<double>, label double")
    known = rows.select("id", "x", "label").unionByName(odd.where("id not in (-4)" if model.stages[-1].uid.startswith("Random") else "true"))
    own = model.transform(known.withColumn("features", array_to_vector("x")))
    score = trees.score_column(nodes, trees.array_slots(WIDTH)).alias("compiled")
    scored = own.select("x", vector_to_array("probability")[1].alias("p"), score)
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
    found = scored.collect()
    assert max(abs(r["p"] - r["compiled"]) for r in found) < 1e-12
    bits = trees.scored(own, nodes, trees.array_slots(WIDTH), "x", "id").select("id", F.col("score").alias("bits"))
    bits = {r["id"]: r["bits"] for r in bits.collect()}
    assert max(abs(bits[r["id"]] - r["p"]) for r in own.select("id", vector_to_array("probability")[1].alias("p")).collect()) < 1e-12
    batch = training.batch_scorer(model)(np.array([r["x"] for r in found]))
    assert np.abs(batch - [r["p"] for r in found]).max() < 1e-12


def test_one_project_over_raw_columns(spark, sf_dir):
    """The plan of a compiled score holds a scan and projections: no vector and no transformer."""
    split = mq.split_transactions(spark, sf_dir).withColumn("label", F.col("isFraud"))
    encoder = features.fit_features(mq.train_part(split))
    vectors = encoder.transform(split)
    slots = features.slot_expressions(encoder)
    flat = vectors.select(vector_to_array("features").alias("x"), F.array(*map(F.expr, slots)).alias("s"))
    assert flat.where("x != s").count() == 0 and flat.count() > 0
    model = training.train_gbt(mq.part(mq.vectors(spark, sf_dir), "train"), maxIter=3)
    scored = trees.scored(split, trees.ensemble(model), slots, "tx_id")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan and "Exchange" not in plan.replace("BroadcastExchange", "")


def reached_value(nodes, counts, known, at=0):
    """A tree's value with the ``known`` slots fixed and all other sides averaged, by recursion."""
    node = nodes[at]
    if node.is_leaf:
        return node.value

    def n(i):
        return counts.get(i, 0) if nodes[i].is_leaf else n(nodes[i].left) + n(nodes[i].right)

    sides = [reached_value(nodes, counts, known, s) for s in (node.left, node.right)]
    if node.slot in known:
        v = known[node.slot]
        if node.values or not node.values_left:
            left = (v in node.values) == node.values_left
        else:
            left = v <= node.threshold
        return sides[0] if left else sides[1]
    shares = [n(node.left), n(node.right)]
    if not sum(shares):
        shares = [nodes[node.left].n, nodes[node.right].n]
    return float(np.dot(sides, shares) / sum(shares))


def all_subsets(model, counts, x):
    """Shapley values by their definition."""
    def value(slots):
        known = {i: x[i] for i in slots}
        return sum(w * reached_value(t, c, known) for t, w, c in zip(model.trees, model.weights, counts))

    values = {s: value(s) for k in range(WIDTH + 1) for s in combinations(range(WIDTH), k)}
    phi = np.zeros(WIDTH)
    for i in range(WIDTH):
        others = [j for j in range(WIDTH) if j != i]
        for k in range(WIDTH):
            chance = factorial(k) * factorial(WIDTH - 1 - k) / factorial(WIDTH)
            for s in combinations(others, k):
                phi[i] += chance * (values[tuple(sorted((*s, i)))] - values[s])
    return phi


@pytest.mark.parametrize("background", ["all", "few"])
def test_equal_to_enumerating_all_subsets(rows, model, background):
    nodes = trees.ensemble(model)
    others = rows if background == "all" else rows.where("id < 7")  # leaves that no background row reaches
    counts = trees.leaf_counts(nodes, others, WIDTH)
    explained = rows.where("id between 100 and 104")
    phi = trees.shap_tree(explained, "id", nodes, others, WIDTH)
    by_row = {}
    for r in phi.collect():
        by_row.setdefault(r["id"], np.zeros(WIDTH))[r["slot"]] = r["phi"]
    for r in explained.collect():
        assert by_row[r["id"]] == pytest.approx(all_subsets(nodes, counts, r["x"]), abs=1e-9)


def test_sums_are_margins_less_the_background_mean(rows, model):
    nodes = trees.ensemble(model)
    others = rows.where("id % 3 = 0")
    margin = trees.margin_column(nodes, trees.array_slots(WIDTH)).alias("m")
    base = np.mean([r["m"] for r in others.select(margin).collect()])
    expected = {r["id"]: r["m"] - base for r in rows.select("id", margin).collect()}
    phi = trees.shap_tree(rows, "id", nodes, others, WIDTH)
    got = {r["id"]: r["s"] for r in phi.groupBy("id").agg(F.sum("phi").alias("s")).collect()}
    assert got == pytest.approx(expected, abs=1e-9)
    assert trees.shap_tree(rows.where("false"), "id", nodes, others, WIDTH).count() == 0


def test_what_is_no_ensemble_is_refused(rows):
    plain = training.train_logreg(rows, weighted=False)
    with pytest.raises(ValueError, match="no forest"):
        trees.node_table(plain)


def table_scorer(model):
    """The scorer without its batch form."""
    full = explain.model_scorer(model)
    return lambda df: full(df)


@pytest.mark.parametrize("method", ["kernel", "permutation"])
def test_mixes_by_change_are_all_mixes(rows, model, method):
    """Scores of distinct mixes only give the values that scoring every mix gives."""
    explained, background = rows.where("id < 12").select("id", "x"), rows.where("id between 200 and 205").select("x")

    def of(scorer):
        if method == "kernel":
            phi = explain.shap_kernel(explained, "id", background, WIDTH, scorer, 40)
        else:
            phi = explain.shap_permutation(explained, "id", background, WIDTH, scorer, 8)
        return {(r["id"], r["slot"]): r["phi"] for r in phi.collect()}

    fast, slow = of(explain.model_scorer(model)), of(table_scorer(model))
    assert len(fast) == 12 * WIDTH and fast == pytest.approx(slow, abs=1e-9)


def test_at_most_half_the_mixes_are_scored(spark, sf_dir):
    data = mq.vectors(spark, sf_dir)
    train, test = mq.dense(mq.part(data, "train")), mq.dense(mq.part(data, "test"))
    background = np.array([r["x"] for r in train.orderBy("tx_id").limit(100).collect()])
    own = np.array([r["x"] for r in test.orderBy("tx_id").limit(60).collect()])
    weights = np.random.default_rng(1).standard_normal(mq.WIDTH)

    def score(x):
        return 1 / (1 + np.exp(-(x @ weights) ** 2))

    masks, _ = explain.kernel_masks(mq.WIDTH, 2 * mq.WIDTH)
    walks = np.concatenate([np.argsort(o)[None, :] < np.arange(mq.WIDTH + 1)[:, None] for _, o in explain.sampled_orders(mq.WIDTH, 100)])
    of_walks = np.repeat([k for k, _ in explain.sampled_orders(mq.WIDTH, 100)], mq.WIDTH + 1)
    for of, bits in ((np.tile(np.arange(100), len(masks)), np.repeat(masks, 100, axis=0)), (of_walks, walks)):
        mixes = explain.Mixes(background, of, bits, score)
        for x in own:
            p = score(x[None, :])[0]
            expected = score(np.where(bits.astype(bool), x, background[of]))
            assert np.abs(mixes.of_row(x, p) - expected).max() < 1e-12
        assert mixes.scored < 0.5 * len(of) * len(own)


def grown(rng, width, depth, at=0):
    """Nodes of a random tree over numbers and, in every third slot, categories."""
    nodes = []

    def grow(depth):
        at = len(nodes)
        nodes.append(None)
        if not depth or rng.random() < 0.1:
            nodes[at] = trees.Node(-1, -1, -1, 0.0, (), True, rng.standard_normal(), 1)
            return at
        slot = int(rng.integers(width))
        values = tuple(map(float, rng.choice(4, 2, replace=False))) if slot % 3 == 0 else ()
        left, right = grow(depth - 1), grow(depth - 1)
        nodes[at] = trees.Node(left, right, slot, round(rng.random() * 3, 1), values, bool(rng.integers(2)) or not values, 0.0, 1)
        return at

    grow(depth)
    return tuple(nodes)


@pytest.mark.parametrize("width", [5, 70])
@pytest.mark.parametrize("kind", ["linear", "boosted", "forest", "leaves"])
def test_rows_are_attributed_in_blocks(width, kind, monkeypatch):
    """Products over blocks of rows give what scoring every mix gives, and do not ask the scorer row by row."""
    rng = np.random.default_rng(width)
    background, x = (rng.integers(0, 4, (n, width)).astype(float) for n in (9, 300))
    x[3, 1], x[4, 2], x[:, 3], background[2, 4] = np.inf, -np.inf, background[0, 3], 2.5
    if kind == "linear":
        score = training.LinearScorer(rng.standard_normal(width), 0.3)
    else:
        grow = [grown(rng, width, 0 if kind == "leaves" else 5) for _ in range(12)]
        score = trees.BatchTrees(trees.Ensemble(tuple(grow), (0.1,) * 12, kind == "boosted"), width)
        x[5, 0] = np.nan
    masks, _ = explain.kernel_masks(width, 60)
    masks = np.repeat(np.concatenate([masks, np.zeros((1, width)), np.ones((1, width))]), 9, axis=0)
    of, gains = np.tile(np.arange(9), len(masks) // 9), rng.standard_normal((len(masks), width))
    expected = np.array([score(np.where(masks == 1, own, background[of])) @ gains for own in x])
    for kept in (64 << 20, 0):
        monkeypatch.setattr(explain.TreeMixes, "KEPT", kept)
        mixes, asked = explain.mixes_of(background, of, masks, gains, score), []
        monkeypatch.setattr(type(score), "__call__", lambda self, x, f=type(score).__call__: asked.append(len(x)) or f(self, x))
        assert mixes.of_rows(x) == pytest.approx(expected, abs=1e-9)
        assert mixes.of_rows(x[:0]).shape == (0, width) and len(asked) <= 8
        monkeypatch.undo()


def test_surrogate_sums_are_those_of_a_design_matrix():
    rng = np.random.default_rng(9)
    drawn, scores = rng.integers(0, 4, (800, 6)).astype(np.int8), rng.random(800)
    fits = explain.Surrogates(drawn, scores, 0.75 * 6**0.5, 3)

    def ridge(z, y, w, alpha):
        zc, yc = z - np.average(z, axis=0, weights=w), y - np.average(y, weights=w)
        return np.linalg.solve(zc.T @ (w[:, None] * zc) + alpha * np.eye(z.shape[1]), zc.T @ (w * yc))

    for own_bin, p in [(rng.integers(0, 4, 6).astype(np.int8), rng.random()) for _ in range(30)]:
        z, y = np.vstack([np.ones(6), drawn == own_bin]), np.append(p, scores)
        w = np.sqrt(np.exp(-((1.0 - z) ** 2).sum(axis=1) / (0.75 * 6**0.5) ** 2))
        first = ridge(z, y, w, 0.01)
        chosen = np.argsort(-np.abs(first), kind="stable")[:3]
        weight = ridge(z[:, chosen], y, w, 1.0)
        order = np.argsort(-np.abs(weight), kind="stable")
        slots, got = fits.weights(own_bin, p)
        assert slots.tolist() == chosen[order].tolist() and got == pytest.approx(weight[order], abs=1e-9)
