"""Projections, filters and scalar rules over whole tables."""

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskframe.functions import columns as c
from riskframe.operators import encoding
from riskframe.operators.reporting import MODEL_NAMES, with_display_name
from riskframe.plans.registry import query
from riskframe.plans.sql import models_sql, ratio, scored_sql, tx_sql
from riskframe.sources.transactions import activity, scored, scored_models, table, transactions

RAW_COLUMNS = ["nameOrig", "step", "type", "amount", "oldbalanceOrg", "newbalanceOrg", "isFraud"]


def with_gaps(tx):
    """Transactions with nulls in the three columns the cleaning step looks at."""
    return tx.withColumns(
        {
            "type": F.when(F.col("type") != "CASH_IN", F.col("type")),
            "amount": F.when(F.col("amount") >= F.lit(50.0), F.col("amount")),
            "isFraud": F.when(F.col("merchant") != "atm", F.col("isFraud")),
        }
    )


@query(
    "drop_null_rows",
    tx_sql(
        """
, gaps AS (SELECT tx_id, nullif(type, 'CASH_IN') AS type, CASE WHEN amount >= 50e0 THEN amount END AS amount,
                  CASE WHEN merchant <> 'atm' THEN isFraud END AS isFraud FROM tx)
SELECT * FROM gaps WHERE type IS NOT NULL AND amount IS NOT NULL AND isFraud IS NOT NULL"""
    ),
)
def drop_null_rows(spark, sf_dir):
    gaps = with_gaps(transactions(spark, sf_dir)).select("tx_id", "type", "amount", "isFraud")
    return gaps.dropna(subset=["type", "amount", "isFraud"])


@query("label_cast", tx_sql("SELECT tx_id, isFraud, isFraud AS label FROM tx"))
def label_cast(spark, sf_dir):
    return transactions(spark, sf_dir).select("tx_id", "isFraud", F.col("isFraud").cast("int").alias("label"))


@query("label_alias_resolve", tx_sql("SELECT tx_id, isFraud = 1 AS \"Class\", isFraud AS label FROM tx"))
def label_alias_resolve(spark, sf_dir):
    named = transactions(spark, sf_dir).select("tx_id", (F.col("isFraud") == 1).alias("Class"))
    return c.with_label(named)


@query(
    "require_columns",
    tx_sql(
        """
SELECT 'amount' AS column_name, true AS present, CAST(count(amount) AS BIGINT) AS non_null FROM tx
UNION ALL SELECT 'features', false, CAST(0 AS BIGINT)
UNION ALL SELECT 'isFraud', true, CAST(count(isFraud) AS BIGINT) FROM tx
UNION ALL SELECT 'label', false, CAST(0 AS BIGINT)"""
    ),
)
def require_columns(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    wanted = ["amount", "features", "isFraud", "label"]
    filled = tx.agg(*[F.count(w).alias(w) if w in tx.columns else F.lit(0).cast("long").alias(w) for w in wanted])
    rows = [
        F.struct(F.lit(w).alias("column_name"), F.lit(w in tx.columns).alias("present"), F.col(w).alias("non_null"))
        for w in wanted
    ]
    return filled.select(F.inline(F.array(*rows)))


@query("project_columns", tx_sql(f"SELECT {', '.join(RAW_COLUMNS)} FROM tx"))
def project_columns(spark, sf_dir):
    return c.require_columns(transactions(spark, sf_dir), RAW_COLUMNS).select(*RAW_COLUMNS)


@query(
    "label_filter_count",
    tx_sql(
        "SELECT CAST(count(*) FILTER (WHERE isFraud = 1) AS BIGINT) AS pos, "
        "CAST(count(*) FILTER (WHERE isFraud = 0) AS BIGINT) AS neg FROM tx"
    ),
)
def label_filter_count(spark, sf_dir):
    return transactions(spark, sf_dir).agg(
        F.count_if(F.col("isFraud") == 1).alias("pos"), F.count_if(F.col("isFraud") == 0).alias("neg")
    )


@query(
    "prob_extract",
    scored_sql("SELECT tx_id, CASE WHEN score < 0.2e0 THEN 0e0 ELSE score END AS p1 FROM scored"),
)
def prob_extract(spark, sf_dir):
    pair = array_to_vector(F.array(F.lit(1.0) - F.col("score"), F.col("score")))
    vectors = scored(spark, sf_dir).select("tx_id", F.when(F.col("score") >= F.lit(0.2), pair).alias("probability"))
    return vectors.select("tx_id", c.positive_probability(F.col("probability")).alias("p1"))


@query(
    "raw_to_prob",
    scored_sql("SELECT tx_id, round(1e0 / (1e0 + exp(-(4e0 * score - 2e0))), 9) AS score FROM scored"),
)
def raw_to_prob(spark, sf_dir):
    margin = F.lit(4.0) * F.col("score") - F.lit(2.0)
    raw = scored(spark, sf_dir).select("tx_id", array_to_vector(F.array(-margin, margin)).alias("rawPrediction"))
    return raw.select("tx_id", F.round(c.logistic(vector_to_array("rawPrediction")[1]), 9).alias("score"))


@query("binarise", scored_sql("SELECT tx_id, label, CAST(score >= 0.3e0 AS INTEGER) AS yhat FROM scored"))
def binarise(spark, sf_dir):
    return scored(spark, sf_dir).select("tx_id", "label", c.binarise(F.col("score"), 0.3).alias("yhat"))


_WEIGHT = "greatest(sum(CASE WHEN isFraud = 0 THEN 1 ELSE 0 END), 1)"
_POSITIVES = "greatest(sum(CASE WHEN isFraud = 1 THEN 1 ELSE 0 END), 1)"


@query(
    "class_weight_column",
    tx_sql(
        f"""
, w AS (SELECT {ratio(_WEIGHT, _POSITIVES)} AS pos_weight FROM tx)
SELECT tx_id, isFraud AS label, CASE WHEN isFraud = 1 THEN pos_weight ELSE 1e0 END AS weight FROM tx, w"""
    ),
)
def class_weight_column(spark, sf_dir):
    labelled = transactions(spark, sf_dir).select("tx_id", F.col("isFraud").alias("label"))
    return encoding.with_class_weight(labelled)


@query("stats_broadcast", tx_sql(
    """
, s AS (SELECT avg(amount) AS mean_amount, CAST(count(*) AS BIGINT) AS n FROM tx)
SELECT tx_id, round(amount / mean_amount, 6) AS amount_share, n FROM tx, s"""
))
def stats_broadcast(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    stats = tx.agg(F.struct(F.avg("amount").alias("mean_amount"), F.count(F.lit(1)).alias("n")).alias("s")).scalar()
    return tx.select(
        "tx_id",
        F.round(F.col("amount") / stats.getField("mean_amount"), 6).alias("amount_share"),
        stats.getField("n").alias("n"),
    )


@query(
    "class_weight_floored",
    tx_sql(
        f"""
, c AS (SELECT CAST(count(*) FILTER (WHERE isFraud = 1) AS BIGINT) AS pos,
               CAST(count(*) FILTER (WHERE isFraud = 0) AS BIGINT) AS neg FROM tx)
SELECT pos, neg, greatest(1e0, {ratio('neg', 'greatest(pos, 1)')}) AS pos_weight FROM c"""
    ),
)
def class_weight_floored(spark, sf_dir):
    return encoding.floored_class_weight(transactions(spark, sf_dir), "isFraud")


@query(
    "safe_ratio",
    tx_sql(f"SELECT tx_id, round({ratio('amount', 'newbalanceOrg')}, 9) AS share FROM tx"),
)
def safe_ratio(spark, sf_dir):
    share = c.safe_ratio(F.col("amount"), F.col("newbalanceOrg"))
    return transactions(spark, sf_dir).select("tx_id", F.round(share, 9).alias("share"))


@query(
    "balance_rules",
    tx_sql(
        "SELECT tx_id, amount, oldbalanceOrg, newbalanceOrg, oldbalanceDest, "
        "round(oldbalanceDest + amount, 2) AS newbalanceDest FROM tx"
    ),
)
def balance_rules(spark, sf_dir):
    return transactions(spark, sf_dir).select(
        "tx_id", "amount", "oldbalanceOrg", "newbalanceOrg", "oldbalanceDest",
        F.round("newbalanceDest", 2).alias("newbalanceDest"),
    )


@query(
    "amount_boost",
    tx_sql(
        """
SELECT tx_id, type, round(amount * (1e0 + CASE WHEN type = 'TRANSFER' THEN 1.75e0
  WHEN type = 'CASH_OUT' THEN 1.5e0 ELSE 0e0 END * 0.3e0), 2) AS boosted FROM tx"""
    ),
)
def amount_boost(spark, sf_dir):
    boosted = c.boosted_amount(F.col("type"), F.col("amount"))
    return activity(spark, sf_dir).select("tx_id", "type", boosted.alias("boosted"))


@query("risk_rules", tx_sql("SELECT tx_id, type, amount, newbalanceOrg, risk, isFraud FROM tx"))
def risk_rules(spark, sf_dir):
    return transactions(spark, sf_dir).select("tx_id", "type", "amount", "newbalanceOrg", "risk", "isFraud")


@query(
    "flag_rule",
    tx_sql("SELECT tx_id, amount * 100e0 AS amount, CAST(amount * 100e0 > 200000e0 AS INTEGER) AS isFlaggedFraud FROM tx"),
)
def flag_rule(spark, sf_dir):
    cents = activity(spark, sf_dir).select("tx_id", (F.col("amount") * F.lit(100.0)).alias("amount"))
    return cents.withColumn("isFlaggedFraud", (F.col("amount") > F.lit(200000.0)).cast("int"))


@query(
    "weighted_category",
    tx_sql(
        """
, n AS (SELECT type, merchant, CAST(count(*) AS DOUBLE) AS n FROM tx GROUP BY type, merchant),
shares AS (SELECT type, merchant, n / sum(n) OVER () AS weight FROM n)
SELECT tx_id, type, merchant, round(weight, 9) AS weight FROM tx JOIN shares USING (type, merchant)"""
    ),
)
def weighted_category(spark, sf_dir):
    """Each row's category pair with the weight it has in the table."""
    tx = activity(spark, sf_dir).select("tx_id", "type", "merchant")
    pairs = tx.groupBy("type", "merchant").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = tx.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    shares = pairs.select("type", "merchant", F.round(F.col("n") / total, 9).alias("weight"))
    return tx.join(shares, ["type", "merchant"]).select("tx_id", "type", "merchant", "weight")


@query("account_ids", tx_sql("SELECT tx_id, nameOrig, nameDest FROM tx"))
def account_ids(spark, sf_dir):
    return activity(spark, sf_dir).select("tx_id", "nameOrig", "nameDest")


_NAME_VALUES = ", ".join(f"('{code}', '{name}')" for code, name in MODEL_NAMES.items())


@query(
    "name_lookup",
    models_sql(
        f"""
, coded AS (SELECT tx_id, CASE model WHEN 'rule' THEN 'LOGREG' WHEN 'noise' THEN 'RF' ELSE 'AMOUNT' END AS model
            FROM scored_models),
names(code, name) AS (VALUES {_NAME_VALUES})
SELECT tx_id, model, coalesce(name, model) AS display_name FROM coded LEFT JOIN names ON code = model"""
    ),
)
def name_lookup(spark, sf_dir):
    code = F.when(F.col("model") == "rule", "LOGREG").when(F.col("model") == "noise", "RF").otherwise("AMOUNT")
    return with_display_name(scored_models(spark, sf_dir).select("tx_id", code.alias("model")))


@query(
    "vector_densify",
    tx_sql(
        """
, slots AS (SELECT unnest(range(8)) AS i)
SELECT tx_id, CAST(i AS INTEGER) AS slot, CASE WHEN tx_id % 8 = i THEN amount ELSE 0e0 END AS value FROM tx, slots"""
    ),
)
def vector_densify(spark, sf_dir):
    """Sparse vectors, and every third row dense, give the same arrays."""
    tx = activity(spark, sf_dir).select(
        "tx_id",
        *[F.when(F.col("tx_id") % 8 == i, F.col("amount")).otherwise(F.lit(0.0)).alias(f"m{i}") for i in range(8)],
    )
    names = [f"m{i}" for i in range(8)]
    sparse = VectorAssembler(inputCols=names, outputCol="sparse").transform(tx)
    vector = F.when(F.col("tx_id") % 3 == 0, array_to_vector(F.array(*names))).otherwise(F.col("sparse"))
    return sparse.select("tx_id", vector.alias("features")).select(
        "tx_id", F.posexplode(vector_to_array("features")).alias("slot", "value")
    )


@query(
    "flat_features",
    tx_sql(
        """
SELECT tx_id, CAST(0 AS INTEGER) AS slot, amount AS value FROM tx
UNION ALL SELECT tx_id, 1, oldbalanceOrg FROM tx
UNION ALL SELECT tx_id, 2, CAST(step AS DOUBLE) FROM tx"""
    ),
)
def flat_features(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    flat = tx.select("amount", "oldbalanceOrg", "step", F.col("isFraud").alias("label"), F.lit(1.0).alias("weight"))
    names = c.flat_feature_columns(flat)
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(tx.select("tx_id", *names))
    return assembled.select("tx_id", F.posexplode(vector_to_array("features")).alias("slot", "value"))


@query(
    "feature_names",
    """
WITH e AS (SELECT vec_id, unnest(embedding) AS value, unnest(range(len(embedding))) AS i FROM embeddings)
SELECT vec_id, 'f' || CAST(i AS VARCHAR) AS feature, CAST(value AS DOUBLE) AS value FROM e""",
)
def feature_names(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return vectors.select("vec_id", F.posexplode("x").alias("slot", "value")).select(
        "vec_id", c.slot_name(F.col("slot")).alias("feature"), "value"
    )
