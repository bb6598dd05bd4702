"""Training, scoring and explanation over whole tables."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskframe.functions.columns import linear_margin, logistic
from riskframe.functions.keyed import residue_sql
from riskframe.operators import encoding, evaluation, explain, features, network, sampling, training, trees
from riskframe.plans.evaluation_queries import rounded
from riskframe.plans.feature_queries import TRAIN_SQL, split_transactions, train_part
from riskframe.plans.registry import query
from riskframe.plans.sequence_queries import GAP_SQL, class_gap
from riskframe.plans.sql import tx_sql
from riskframe.session import shared_folder
from riskframe.sources import files
from riskframe.sources.models import load_model, save_model
from riskframe.sources.transactions import table

WIDTH = 21
BACKGROUND = 100  # rows that stand for the train split in an attribution


# What this application has written for a data folder: (application, folder, name) to path.
_ONCE: dict[tuple[str, str, str], str] = {}


def once(spark, sf_dir, name, write):
    """The path of what ``write(path)`` left in the shared folder, made once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _ONCE or not files.exists(spark, _ONCE[key]):
        path = shared_folder(spark)
        write(path)
        _ONCE[key] = path
    return _ONCE[key]


def vectors(spark, sf_dir):
    """(tx_id, features, label, weight, split) written once, then read as often as fits and explanations need.

    Everything is fitted on the train split.  The written table spares every pass of
    a fit the joins and the encoding, survives lost executors and lets one split be
    read without the others.
    """

    def write(path):
        split = split_transactions(spark, sf_dir).withColumn("label", F.col("isFraud"))
        encoded = features.fit_features(train_part(split)).transform(split)
        weighted = encoding.with_class_weight(encoded, train=train_part(split))
        files.write_splits(weighted.hint("rebalance"), path, ("tx_id", "features", "label", "weight"))

    return spark.read.parquet(once(spark, sf_dir, "vectors", write))


def part(df, split):
    return df.where(F.col("split") == split).drop("split")


def validated(code, model, valid):
    """Rows and positives of the validation split by the matrix at 0.50, and how far a second route is off.

    The second route is a sweep over the same scores, whose counts come from another aggregation.
    """
    scores = training.score_model(model, valid)
    cells = ["tp", "fp", "tn", "fn"]
    once = evaluation.classification_metrics(scores)
    again = evaluation.threshold_sweep(scores, [0.5]).select(*[F.col(c).alias(f"{c}_again") for c in cells])
    off = sum((F.abs(F.col(c) - F.col(f"{c}_again")) for c in cells), F.lit(0))
    both = once.join(again)  # one row each
    return both.select(
        F.lit(code).alias("model"),
        (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n_rows"),
        (F.col("tp") + F.col("fn")).alias("positives"),
        off.cast("long").alias("off"),
        F.col("accuracy").between(0.5, 1.0).alias("better_than_chance"),
    )


def _valid_sql(code):
    return tx_sql(
        TRAIN_SQL
        + f" SELECT '{code}' AS model, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(isFraud) AS BIGINT) AS positives,"
        " CAST(0 AS BIGINT) AS off, true AS better_than_chance FROM split_tx WHERE split = 'valid'"
    )


def fitted_mlp(data, hidden=training.HIDDEN):
    train = sampling.oversample_minority(part(data, "train"), "tx_id", 0.1)
    return training.train_mlp(train, WIDTH, hidden)


FITS = {
    "logreg": lambda data: training.train_logreg(part(data, "train")),
    "rf": lambda data: training.train_forest(part(data, "train")),
    "gbt": lambda data: training.train_gbt(part(data, "train")),
    "mlp": fitted_mlp,
}


def trained(spark, sf_dir, code):
    """A model fitted now, and saved for the queries that score and explain with it."""
    model = FITS[code](vectors(spark, sf_dir))
    folder = shared_folder(spark)
    save_model(model, folder, code)
    _ONCE[spark.sparkContext.applicationId, sf_dir, f"model {code}"] = folder
    return model


def stored(spark, sf_dir, code):
    """The model that was fitted on a data folder, loaded; fitted and saved where it is not yet."""
    folder = once(
        spark, sf_dir, f"model {code}", lambda path: save_model(FITS[code](vectors(spark, sf_dir)), path, code)
    )
    return load_model(spark, folder, code)


@query("train_logreg", _valid_sql("logreg"))
def train_logreg(spark, sf_dir):
    return validated("logreg", trained(spark, sf_dir, "logreg"), part(vectors(spark, sf_dir), "valid"))


@query("train_random_forest", _valid_sql("rf"))
def train_random_forest(spark, sf_dir):
    return validated("rf", trained(spark, sf_dir, "rf"), part(vectors(spark, sf_dir), "valid"))


@query("train_gbt", _valid_sql("gbt"))
def train_gbt(spark, sf_dir):
    return validated("gbt", trained(spark, sf_dir, "gbt"), part(vectors(spark, sf_dir), "valid"))


@query("train_mlp", _valid_sql("mlp"))
def train_mlp(spark, sf_dir):
    return validated("mlp", trained(spark, sf_dir, "mlp"), part(vectors(spark, sf_dir), "valid"))


@query(
    "train_mlp_weighted",
    tx_sql(
        TRAIN_SQL
        + " SELECT 'mlp_weighted' AS model, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(isFraud) AS BIGINT) AS positives,"
        " CAST(0 AS BIGINT) AS off, true AS loss_fell FROM split_tx WHERE split = 'valid'"
    ),
)
def train_mlp_weighted(spark, sf_dir):
    """The network under class weights: a positive row counts as often as the classes differ in size, at least once."""
    data = vectors(spark, sf_dir)
    pos_weight = encoding.floored_class_weight(part(data, "train")).first()["pos_weight"]  # one row
    weight = F.when(F.col("label") == 1, F.lit(pos_weight)).otherwise(F.lit(1.0))
    train = part(data, "train").withColumn("weight", weight)
    model, losses = network.train_weighted_network(train, training.HIDDEN)
    fell = all(b < a for a, b in zip(losses, losses[1:])) and len(losses) > 1
    found = validated("mlp_weighted", model, part(data, "valid"))
    return found.drop("better_than_chance").withColumn("loss_fell", F.lit(fell))


_TEST_ROWS = tx_sql(
    TRAIN_SQL + " SELECT tx_id, isFraud AS label, 0e0 AS difference FROM split_tx WHERE split = 'test'"
)


@query("score_model", _TEST_ROWS)
def score_model(spark, sf_dir):
    """Scores of the test split against the logistic of the exported coefficients."""
    data = vectors(spark, sf_dir)
    model = stored(spark, sf_dir, "logreg")
    last = model.stages[-1]
    weights = F.lit([float(w) for w in last.coefficients.toArray()])
    test = part(data, "test")
    own = logistic(linear_margin(vector_to_array("features"), weights, last.intercept))
    scores = training.score_model(model, test.withColumn("own", own), "tx_id", "own")
    return scores.select("tx_id", "label", F.round(F.abs(F.col("score") - F.col("own")), 9).alias("difference"))


@query("model_store", _TEST_ROWS)
def model_store(spark, sf_dir):
    """Scores of the loaded model differ from the scores before saving by nothing."""
    data = vectors(spark, sf_dir)
    folder = shared_folder(spark)
    model = training.train_forest(part(data, "train"))
    save_model(model, folder, "random_forest")
    loaded = load_model(spark, folder, "rf")
    test = part(data, "test")
    first = model.transform(test).select("tx_id", "label", "features", F.col("probability").alias("first"))
    after = loaded.transform(first)
    difference = F.abs(vector_to_array("probability")[1] - vector_to_array("first")[1])
    return after.select("tx_id", "label", difference.alias("difference"))


@query("score_batched", _TEST_ROWS)
def score_batched(spark, sf_dir):
    """Batch scores differ from the model's own transform by nothing at nine digits."""
    data = vectors(spark, sf_dir)
    model = stored(spark, sf_dir, "mlp")
    own = model.transform(part(data, "test"))
    batched = own.withColumn("score", training.score_batched(model, vector_to_array("features")))
    difference = F.abs(F.col("score") - vector_to_array("probability")[1])
    return batched.select("tx_id", "label", F.round(difference, 9).alias("difference"))


# A weight per slot (the class gap of the embeddings) makes a linear model the SQL twin can hold.
_LINEAR = GAP_SQL + ", j AS (SELECT e.vec_id, e.label, e.i, e.value AS x, g.value AS w FROM e JOIN g USING (i))"


def embedded(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def gap_weights(spark, sf_dir):
    return explain.as_array(class_gap(spark, sf_dir), "value")


@query(
    "score_linear",
    _LINEAR + " SELECT vec_id, label, round(1e0 / (1e0 + exp(-(sum(x * w) + 0.1e0))), 9) AS score FROM j GROUP BY vec_id, label",
)
def score_linear(spark, sf_dir):
    rows = embedded(spark, sf_dir).withColumn("w", gap_weights(spark, sf_dir))
    margin = linear_margin(F.col("x"), F.col("w"), 0.1)
    return rows.select("vec_id", "label", F.round(logistic(margin), 9).alias("score"))


_PHI = _LINEAR + (
    ", m AS (SELECT i, avg(value) AS mean FROM e GROUP BY i)"
    ", phis AS (SELECT vec_id, label, i, w * (x - mean) AS phi FROM j JOIN m USING (i))"
)


@query("shap_linear", _PHI + " SELECT vec_id, label, CAST(i AS INTEGER) AS slot, round(phi, 9) AS phi FROM phis")
def shap_linear(spark, sf_dir):
    return rounded(explain.shap_linear(embedded(spark, sf_dir), gap_weights(spark, sf_dir)), "phi")


@query(
    "shap_summary",
    _PHI
    + ", s AS (SELECT i, round(avg(abs(phi)), 9) AS mean_abs FROM phis GROUP BY i)"
    + " SELECT 'f' || CAST(i AS VARCHAR) AS feature, mean_abs FROM s ORDER BY mean_abs DESC, i LIMIT 20",
)
def shap_summary(spark, sf_dir):
    """Both class slices exist; the positive one is ranked."""
    phi = explain.shap_linear(embedded(spark, sf_dir), gap_weights(spark, sf_dir))
    by_class = phi.select(
        "vec_id", "slot", F.inline(F.array(
            F.struct(F.lit(0).alias("class"), (-F.col("phi")).alias("phi")),
            F.struct(F.lit(1).alias("class"), F.col("phi").alias("phi")),
        ))
    )
    return explain.shap_summary(by_class, 20)


_MASKS = [[1 if (i + 1) * (m + 1) % 3 else 0 for i in range(64)] for m in range(20)]


@query(
    "background_cross",
    _LINEAR
    + """, others AS (SELECT vec_id FROM embeddings ORDER BY {draw}, vec_id LIMIT 50),
b AS (SELECT i, avg(value) AS mean FROM e JOIN others USING (vec_id) GROUP BY i),
masks AS (SELECT unnest(range(20)) AS mask)
SELECT vec_id, CAST(mask AS INTEGER) AS mask,
  round(sum(w * CASE WHEN (i + 1) * (mask + 1) % 3 <> 0 THEN x ELSE mean END), 6) AS value
FROM j JOIN b USING (i), masks GROUP BY vec_id, mask""".replace("{draw}", residue_sql("vec_id", "background")),
)
def background_cross(spark, sf_dir):
    """Coalition values of a linear margin: whole table x 20 masks x 50 sampled background rows."""
    rows = embedded(spark, sf_dir)
    weights = gap_weights(spark, sf_dir)

    def margin(df):
        return df.withColumn("w", weights).withColumn("p", linear_margin(F.col("x"), F.col("w"))).drop("w")

    background = sampling.fixed_size_sample(rows, "vec_id", 50, "background")
    values = explain.coalition_values(rows.select("vec_id", "x"), "vec_id", background, _MASKS, margin)
    return rounded(values, "value", digits=6)


def dense(df):
    return df.select("tx_id", vector_to_array("features").alias("x"))


_EXPLAINED = tx_sql(
    TRAIN_SQL
    + f" SELECT tx_id, CAST({WIDTH} AS BIGINT) AS slots, 0e0 AS difference FROM split_tx WHERE split = 'test'"
)


def adding_up(phi, rows, background, scorer):
    """Per explained row: how many slots it has, and how far their sum is from f(x) minus the base value."""
    base = scorer(background).agg(F.avg("p").alias("b")).scalar()
    whole = scorer(rows).select("tx_id", (F.col("p") - base).alias("expected"))
    sums = phi.groupBy("tx_id").agg(F.count("phi").alias("slots"), F.sum("phi").alias("total"))
    difference = F.round(F.abs(F.col("total") - F.col("expected")), 6)
    return sums.join(whole, "tx_id").select("tx_id", "slots", difference.alias("difference"))


@query("shap_kernel", _EXPLAINED)
def shap_kernel(spark, sf_dir):
    """Every test row under boosted trees: 100 masks, 100 background rows."""
    data = vectors(spark, sf_dir)
    scorer = explain.model_scorer(stored(spark, sf_dir, "gbt"))
    rows = dense(part(data, "test"))
    background = dense(sampling.fixed_size_sample(part(data, "train"), "tx_id", BACKGROUND, "background"))
    phi = explain.shap_kernel(rows, "tx_id", background, WIDTH, scorer, n_masks=100)
    return adding_up(phi, rows, background, scorer)


@query("shap_tree", _EXPLAINED)
def shap_tree(spark, sf_dir):
    """Every test row under boosted trees, exactly, against the whole train split.

    The sums are compared with the model's own margins less their mean over the train split.
    """
    data = vectors(spark, sf_dir)
    model = stored(spark, sf_dir, "gbt")
    rows, background = part(data, "test"), part(data, "train")
    phi = trees.shap_tree(dense(rows), "tx_id", trees.ensemble(model), dense(background), WIDTH)

    def margins(df):
        return model.transform(df).select("tx_id", vector_to_array("rawPrediction")[1].alias("margin"))

    base = margins(background).agg(F.avg("margin")).scalar()
    sums = phi.groupBy("tx_id").agg(F.count("phi").alias("slots"), F.sum("phi").alias("total"))
    difference = F.round(F.abs(F.col("total") - (F.col("margin") - base)), 9)
    return sums.join(margins(rows), "tx_id").select("tx_id", "slots", difference.alias("difference"))


@query("tree_columns", _TEST_ROWS)
def tree_columns(spark, sf_dir):
    """Scores of a boosted model as one expression over the raw columns, against the model's own transform."""
    split = split_transactions(spark, sf_dir).withColumn("label", F.col("isFraud"))
    encoder = features.fit_features(train_part(split))
    data = vectors(spark, sf_dir)
    model = stored(spark, sf_dir, "gbt")
    test = split.where(F.col("split") == "test")
    test = trees.scored(test, trees.ensemble(model), features.slot_expressions(encoder), "tx_id", "label")
    own = training.score_model(model, part(data, "test"), "tx_id").select("tx_id", F.col("score").alias("own"))
    difference = F.round(F.abs(F.col("score") - F.col("own")), 12)
    return test.join(own, "tx_id").select("tx_id", "label", difference.alias("difference"))


@query("shap_permutation", _EXPLAINED)
def shap_permutation(spark, sf_dir):
    """Every test row under the logistic model: for each of 100 background rows one order and its reverse."""
    data = vectors(spark, sf_dir)
    scorer = explain.model_scorer(stored(spark, sf_dir, "logreg"))
    rows = dense(part(data, "test"))
    background = dense(sampling.fixed_size_sample(part(data, "train"), "tx_id", BACKGROUND, "background"))
    phi = explain.shap_permutation(rows, "tx_id", background, WIDTH, scorer, pairs=BACKGROUND)
    return adding_up(phi, rows, background, scorer)


@query(
    "lime_local",
    tx_sql(
        TRAIN_SQL
        + " SELECT tx_id, CAST(rank AS INTEGER) AS rank, true AS ordered"
        " FROM split_tx, (SELECT unnest(range(1, 11)) AS rank) WHERE split = 'test'"
    ),
)
def lime_local(spark, sf_dir):
    """Every test row against 5000 neighbours, bins of the whole train split."""
    data = vectors(spark, sf_dir)
    scorer = explain.model_scorer(stored(spark, sf_dir, "logreg"))
    found = explain.lime_local(dense(part(data, "test")), "tx_id", dense(part(data, "train")), scorer)
    above = F.lag(F.abs("weight")).over(Window.partitionBy("tx_id").orderBy("rank"))
    return found.select("tx_id", "rank", F.coalesce(above >= F.abs("weight"), F.lit(True)).alias("ordered"))


def _ranked_sql(column):
    return (
        f"SELECT '{column}' AS column_name, {column} AS value, row_number() OVER (ORDER BY count(*) DESC, {column}) - 1 "
        f"AS i FROM split_tx WHERE split = 'train' GROUP BY {column}"
    )


@query(
    "importance_table",
    tx_sql(
        TRAIN_SQL
        + f""", category AS (SELECT *, 0 AS first FROM ({_ranked_sql('type')})
  UNION ALL SELECT *, 6 AS first FROM ({_ranked_sql('merchant')})),
slots AS (SELECT CAST(first + i AS INTEGER) AS slot, column_name || '_ohe_' || value AS name FROM category),
models(model, total) AS (VALUES ('logreg', CAST(NULL AS DOUBLE)), ('rf', 1e0), ('gbt', 1e0))
SELECT model, slot, name, total FROM slots, models"""
    ),
)
def importance_table(spark, sf_dir):
    """Names of the category slots by frequency, and the sum of the importances of each tree model."""
    data = vectors(spark, sf_dir)
    models = {code: stored(spark, sf_dir, code) for code in training.TRAINERS}
    table = training.importance_table(models, data)
    sums = table.groupBy("model").agg(F.round(F.sum("value"), 6).alias("sum"))
    total = F.when(F.col("model") != "logreg", F.col("sum"))
    named = table.where(F.col("name").contains("_ohe_") & ~F.col("name").endswith("__unknown"))
    return named.join(sums, "model").select("model", "slot", "name", total.alias("total"))
