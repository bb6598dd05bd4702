"""The transaction views every query starts from."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.columns import MERCHANTS, clip, risk

TRANSACTION_SCHEMA = T.StructType(
    [
        T.StructField("step", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("nameOrig", T.StringType()),
        T.StructField("oldbalanceOrg", T.DoubleType()),
        T.StructField("newbalanceOrg", T.DoubleType()),
        T.StructField("nameDest", T.StringType()),
        T.StructField("oldbalanceDest", T.DoubleType()),
        T.StructField("newbalanceDest", T.DoubleType()),
        T.StructField("merchant", T.StringType()),
        T.StructField("isFraud", T.IntegerType()),
        T.StructField("isFlaggedFraud", T.IntegerType()),
    ]
)

# Event types and the transaction types they stand for.
EVENT_TO_TYPE = {
    "purchase": "PAYMENT",
    "click": "CASH_OUT",
    "view": "TRANSFER",
    "error": "CASH_IN",
    "signup": "DEBIT",
}

# Declared so that opening a table reads no file footers.
TABLE_SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def _small_uniform(multiplier: int, offset: int) -> str:
    """The fixture draw ((id * multiplier + offset) % 10007) / 10007."""
    return f"CAST((pmod(tx_id, 10007) * {multiplier} + {offset}) % 10007 AS DOUBLE) / 10007D"


_TYPE = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in EVENT_TO_TYPE.items()) + " END"
_MERCHANT = "element_at(array(" + ", ".join(f"'{m}'" for m in MERCHANTS) + "), CAST(pmod(event_id, 8) AS INT) + 1)"


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transaction columns that come from the events alone; no join."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS tx_id",
        "CAST(date_diff(CAST(ts AS DATE), DATE'2024-01-01') * 24 + hour(ts) + 1 AS INT) AS step",
        f"{_TYPE} AS type",
        "round(value * 8, 2) AS amount",
        "concat('C', CAST(user_id AS STRING)) AS nameOrig",
        "concat('M', CAST(event_id % 10 + 1 AS STRING)) AS nameDest",
        f"{_MERCHANT} AS merchant",
        "user_id",
        "event_id % 10 + 1 AS payee",
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per event, with the account and merchant balances joined in."""
    payers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    payees = table(spark, sf_dir, "supplier").where("s_suppkey BETWEEN 1 AND 10").select("s_suppkey", "s_acctbal")
    return (
        activity(spark, sf_dir)
        .join(payees, F.expr("payee = s_suppkey"), "left")
        .join(payers, F.expr("user_id = c_custkey"), "left")
        .selectExpr(
            "tx_id", "step", "type", "amount", "nameOrig", "nameDest", "merchant",
            f"{clip('coalesce(c_acctbal, 0D)', 0, 10000)} AS oldbalanceOrg",
            f"{clip('coalesce(s_acctbal, 0D)', 0, 20000)} AS oldbalanceDest",
        )
        .selectExpr(
            "tx_id", "step", "type", "amount", "nameOrig", "oldbalanceOrg",
            "greatest(oldbalanceOrg - amount, 0D) AS newbalanceOrg",
            "nameDest", "oldbalanceDest", "oldbalanceDest + amount AS newbalanceDest", "merchant",
        )
        .selectExpr(
            "*",
            f"{risk('type', 'amount', 'newbalanceOrg')} AS risk",
            f"{_small_uniform(7919, 17)} AS u1",
            f"{_small_uniform(104729, 7)} AS u2",
        )
        .selectExpr("*", "CAST(u1 < risk AS INT) AS isFraud", "CAST(amount > 200000D AS INT) AS isFlaggedFraud")
    )


_RULE_SCORE = "least(1D, 10D * risk + 0.5D * u2)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tx_id, label, score) of the rule model."""
    return transactions(spark, sf_dir).selectExpr("tx_id", "isFraud AS label", f"{_RULE_SCORE} AS score")


def scored_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three score columns of one scan in long form: (model, tx_id, merchant, type, label, score)."""
    by_model = (
        f"inline(array(struct('rule' AS model, {_RULE_SCORE} AS score), struct('noise' AS model, u2 AS score), "
        "struct('amount' AS model, least(1D, amount / 4000D) AS score)))"
    )
    long = transactions(spark, sf_dir).selectExpr(by_model, "tx_id", "merchant", "type", "isFraud AS label")
    return long.select("model", "tx_id", "merchant", "type", "label", "score")
