"""Account sequences, category codes, aggregates and limits."""

from pyspark.sql import functions as F

from riskframe.functions import columns as c
from riskframe.functions.keyed import residue, residue_sql
from riskframe.operators import encoding, explain, reporting, sequences
from riskframe.operators.features import CATEGORICAL, NUMERIC
from riskframe.plans.registry import query
from riskframe.plans.sql import models_sql, ratio, seq_sql, tx_sql
from riskframe.session import shared_folder
from riskframe.sources.transactions import activity, scored_models, table, transactions

SEQ_LEN = 20
VALUE_SEQS = [f"{v}_seq" for v in sequences.VALUE_COLUMNS]


def seq(spark, sf_dir):
    return sequences.build_sequences(
        transactions(spark, sf_dir), SEQ_LEN, survey=activity(spark, sf_dir)
    )


def elements(df, *arrays):
    """One row per position of equally long arrays."""
    zipped = F.posexplode(F.arrays_zip(*[F.col(a) for a in arrays])).alias("pos", "e")
    keys = [k for k in df.columns if k not in arrays]
    return df.select(*keys, zipped).select(*keys, "pos", *[F.col(f"e.{a}").alias(a) for a in arrays])


@query(
    "dict_encode",
    tx_sql(
        """
, codes AS (SELECT type AS known, row_number() OVER (ORDER BY type) - 1 AS code
            FROM (SELECT DISTINCT type FROM tx WHERE type <> 'CASH_IN'))
SELECT tx_id, type, CAST(coalesce(code, 0) AS INTEGER) AS type_idx FROM tx LEFT JOIN codes ON known = type"""
    ),
)
def dict_encode(spark, sf_dir):
    """Codes from the table without CASH_IN, so that one value is unknown when applied."""
    tx = activity(spark, sf_dir).select("tx_id", "type")
    return encoding.dict_encode(tx, "type", "type_idx", source=tx.where(F.col("type") != "CASH_IN"))


@query(
    "txn_rank",
    tx_sql(
        "SELECT tx_id, nameOrig, step, row_number() OVER (PARTITION BY nameOrig ORDER BY step, tx_id) AS rn FROM tx"
    ),
)
def txn_rank(spark, sf_dir):
    return sequences.txn_rank(activity(spark, sf_dir).select("tx_id", "nameOrig", "step"))


@query("count_window_id", seq_sql("SELECT tx_id, nameOrig, rn, win_id FROM wins"))
def count_window_id(spark, sf_dir):
    ranked = sequences.txn_rank(activity(spark, sf_dir).select("tx_id", "nameOrig", "step"))
    return sequences.with_window_id(ranked, SEQ_LEN).select("tx_id", "nameOrig", "rn", "win_id")


@query(
    "build_sequences",
    seq_sql(
        "SELECT nameOrig, win_id, pos, type_idx AS type_seq, amount AS amount_seq, "
        "oldbalanceOrg AS oldbalanceOrg_seq, newbalanceOrg AS newbalanceOrg_seq, label FROM seq_rows"
    ),
)
def build_sequences(spark, sf_dir):
    return elements(seq(spark, sf_dir), "type_seq", *VALUE_SEQS)


def layout(spark, sf_dir):
    """The account layout of a data folder, under a name of its own."""
    path = shared_folder(spark)
    name = f"accounts_{path.rsplit('/', 1)[-1]}"
    return sequences.AccountLayout.write(
        transactions(spark, sf_dir), name, path, 16, hot_rows=LAYOUT_HOT_ROWS, survey=activity(spark, sf_dir)
    )


LAYOUT_HOT_ROWS = 2_000  # so that both tables of the layout hold rows wherever an account is that large


@query("account_layout", seq_sql("SELECT tx_id, nameOrig, rn, win_id FROM wins"))
def account_layout(spark, sf_dir):
    """Ranks read from the bucketed layout."""
    ordinary, hot = layout(spark, sf_dir).ranked(spark)
    ranked = ordinary.select("tx_id", "nameOrig", "rn").unionByName(hot.select("tx_id", "nameOrig", "rn"))
    return sequences.with_window_id(ranked, SEQ_LEN).select("tx_id", "nameOrig", "rn", "win_id")


@query(
    "layout_sequences",
    seq_sql(
        "SELECT nameOrig, win_id, pos, type_idx AS type_seq, amount AS amount_seq, "
        "oldbalanceOrg AS oldbalanceOrg_seq, newbalanceOrg AS newbalanceOrg_seq, label FROM seq_rows"
    ),
)
def layout_sequences(spark, sf_dir):
    """Sequences read from the bucketed layout."""
    return elements(layout(spark, sf_dir).sequences(spark, SEQ_LEN), "type_seq", *VALUE_SEQS)


@query("n_types", seq_sql("SELECT max(type_idx) + 1 AS n_types FROM seq_rows"))
def n_types(spark, sf_dir):
    return sequences.n_types(seq(spark, sf_dir))


_SEQ_COLUMNS = ["amount", "oldbalanceOrg", "newbalanceOrg"]


@query(
    "zscore_sequences",
    seq_sql(
        ", s AS (SELECT "
        + ", ".join(f"avg({v}) AS {v}_m, stddev_pop({v}) AS {v}_s" for v in _SEQ_COLUMNS)
        + " FROM seq_rows) SELECT nameOrig, win_id, pos, label, "
        + ", ".join(f"round(({v} - {v}_m) / ({v}_s + 1e-6), 6) AS {v}_seq" for v in _SEQ_COLUMNS)
        + " FROM seq_rows, s"
    ),
)
def zscore_sequences(spark, sf_dir):
    scaled = sequences.zscore_sequences(seq(spark, sf_dir).drop("type_seq"), VALUE_SEQS)
    return elements(scaled, *VALUE_SEQS).withColumns({v: F.round(v, 6) for v in VALUE_SEQS})


@query(
    "sequence_flatten",
    seq_sql(
        """
, parts AS (
  SELECT nameOrig, win_id, 0 AS part, pos, CAST(type_idx AS DOUBLE) AS value FROM seq_rows
  UNION ALL SELECT nameOrig, win_id, 1, pos, amount FROM seq_rows
  UNION ALL SELECT nameOrig, win_id, 2, pos, oldbalanceOrg FROM seq_rows
  UNION ALL SELECT nameOrig, win_id, 3, pos, newbalanceOrg FROM seq_rows)
SELECT nameOrig, win_id, CAST(part AS INTEGER) AS part, pos, CAST(part * 20 + pos AS INTEGER) AS slot, value FROM parts"""
    ),
)
def sequence_flatten(spark, sf_dir):
    """The flat row and its four parts; both give the same values."""
    names = ["type_seq", *VALUE_SEQS]
    flat = seq(spark, sf_dir).select("nameOrig", "win_id", c.sequence_row([F.col(n) for n in names]).alias("row"))
    parts = F.array(*c.sequence_parts(F.col("row"), len(names), SEQ_LEN))
    cut = flat.select("nameOrig", "win_id", F.posexplode(parts).alias("part", "values"))
    return cut.select("nameOrig", "win_id", "part", F.posexplode("values").alias("pos", "value")).select(
        "nameOrig", "win_id", "part", "pos", (F.col("part") * SEQ_LEN + F.col("pos")).alias("slot"), "value"
    )


@query("array_tail", seq_sql("SELECT nameOrig, win_id, pos - 15 AS pos, amount AS amount_tail FROM seq_rows WHERE pos >= 15"))
def array_tail(spark, sf_dir):
    tails = seq(spark, sf_dir).select("nameOrig", "win_id", c.array_tail(F.col("amount_seq"), 5).alias("amount_tail"))
    return elements(tails, "amount_tail")


@query("label_counts", tx_sql("SELECT isFraud AS label, CAST(count(*) AS BIGINT) AS n FROM tx GROUP BY isFraud"))
def label_counts(spark, sf_dir):
    return transactions(spark, sf_dir).groupBy(F.col("isFraud").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("fraud_rate", tx_sql("SELECT CAST(count(*) AS BIGINT) AS n, round(avg(isFraud), 9) AS fraud_rate FROM tx"))
def fraud_rate(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    return tx.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("isFraud"), 9).alias("fraud_rate"))


@query("distinct_types", tx_sql("SELECT DISTINCT type FROM tx"))
def distinct_types(spark, sf_dir):
    return activity(spark, sf_dir).select("type").distinct()


@query(
    "preprocess_meta",
    tx_sql(
        f"""
, c AS (SELECT CAST(count(*) FILTER (WHERE isFraud = 1) AS BIGINT) AS pos,
               CAST(count(*) FILTER (WHERE isFraud = 0) AS BIGINT) AS neg FROM tx)
SELECT pos, neg, round({ratio('greatest(neg, 1)', 'greatest(pos, 1)')}, 9) AS pos_weight,
  '{','.join(NUMERIC)}' AS num_cols, '{','.join(CATEGORICAL)}' AS cat_cols FROM c"""
    ),
)
def preprocess_meta(spark, sf_dir):
    meta = encoding.preprocess_meta(transactions(spark, sf_dir), NUMERIC, CATEGORICAL, "isFraud")
    return meta.select(
        "pos", "neg", F.round("pos_weight", 9).alias("pos_weight"),
        F.array_join("num_cols", ",").alias("num_cols"), F.array_join("cat_cols", ",").alias("cat_cols"),
    )


@query(
    "first_n_rows",
    tx_sql("SELECT tx_id, step, type, amount FROM tx ORDER BY amount DESC, tx_id LIMIT 200"),
)
def first_n_rows(spark, sf_dir):
    tx = activity(spark, sf_dir).select("tx_id", "step", "type", "amount")
    return tx.orderBy(F.desc("amount"), "tx_id").limit(200)


@query(
    "missing_models",
    models_sql(
        """
, present AS (SELECT DISTINCT CASE model WHEN 'rule' THEN 'logreg' WHEN 'noise' THEN 'rf' ELSE model END AS model
              FROM scored_models)
SELECT model FROM (VALUES ('logreg'), ('rf'), ('gbt')) AS e(model) WHERE model NOT IN (SELECT model FROM present)"""
    ),
)
def missing_models(spark, sf_dir):
    code = F.when(F.col("model") == "rule", "logreg").when(F.col("model") == "noise", "rf").otherwise(F.col("model"))
    return reporting.missing_models(scored_models(spark, sf_dir).select(code.alias("model")), reporting.SPARK_MODELS)


@query(
    "append_rows",
    tx_sql(
        f"""
, half AS (SELECT *, {residue_sql('tx_id', 'subset')} % 2 AS h FROM tx)
SELECT tx_id, 'first' AS chunk, amount FROM half WHERE h = 0
UNION ALL SELECT tx_id, 'second', amount FROM half WHERE h = 1
UNION ALL SELECT tx_id, 'copy', amount FROM tx WHERE isFraud = 1"""
    ),
)
def append_rows(spark, sf_dir):
    """Two chunks and one copy of the minority class, one below the other."""
    tx = transactions(spark, sf_dir).withColumn("h", residue("tx_id", "subset") % 2)

    def chunk(rows, name):
        return rows.select("tx_id", F.lit(name).alias("chunk"), "amount")

    first, second = chunk(tx.where("h = 0"), "first"), chunk(tx.where("h = 1"), "second")
    return first.unionByName(second).unionByName(chunk(tx.where(F.col("isFraud") == 1), "copy"))


# Slot-wise statistics of the dense vectors; class 0 counts as the positive class.
SLOTS_SQL = """
WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS value, unnest(range(len(embedding))) AS i
           FROM embeddings)"""


def slots(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("slot", "value"))


def class_gap(spark, sf_dir):
    """Per slot, the mean of the positive class minus the mean of the others."""
    positive = F.col("label") == 0
    gap = F.avg(F.when(positive, F.col("value"))) - F.avg(F.when(~positive, F.col("value")))
    return slots(spark, sf_dir).groupBy("slot").agg(F.round(gap, 9).alias("value"))


GAP_SQL = SLOTS_SQL + """,
g AS (SELECT i, round(avg(value) FILTER (WHERE label = 0) - avg(value) FILTER (WHERE label <> 0), 9) AS value
      FROM e GROUP BY i)"""


@query(
    "topk_coefficients",
    GAP_SQL + " SELECT 'f' || CAST(i AS VARCHAR) AS feature, value FROM g ORDER BY abs(value) DESC, i LIMIT 10",
)
def topk_coefficients(spark, sf_dir):
    return explain.top_by_magnitude(class_gap(spark, sf_dir), 10)


@query(
    "topk_importances",
    GAP_SQL
    + " SELECT 'f' || CAST(i AS VARCHAR) AS feature, round(value * value, 9) AS value FROM g"
    + " ORDER BY round(value * value, 9) DESC, i LIMIT 20",
)
def topk_importances(spark, sf_dir):
    squared = class_gap(spark, sf_dir).select("slot", F.round(F.col("value") * F.col("value"), 9).alias("value"))
    return explain.top_by_value(squared, 20)


@query(
    "mean_abs_by_feature",
    SLOTS_SQL
    + ", m AS (SELECT i, round(avg(CASE WHEN value < -2.5e0 THEN 0e0 ELSE abs(value) END), 9) AS value FROM e GROUP BY i)"
    + " SELECT 'f' || CAST(i AS VARCHAR) AS feature, value AS mean_abs FROM m ORDER BY value DESC, i LIMIT 20",
)
def mean_abs_by_feature(spark, sf_dir):
    gaps = F.when(F.col("value") < F.lit(-2.5), F.lit(float("nan"))).otherwise(F.col("value"))
    return explain.mean_abs_by_feature(slots(spark, sf_dir).withColumn("value", gaps), 20)
