"""Encoded, scaled and assembled features, and samples."""

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe.functions.keyed import residue_sql, uniform_sql
from riskframe.operators import categories, features, sampling
from riskframe.operators.features import NUMERIC
from riskframe.plans.registry import query
from riskframe.plans.sql import tx_sql
from riskframe.session import shared_folder
from riskframe.sources.transactions import activity, transactions

SPLIT_SQL = (
    f"CASE WHEN {uniform_sql('tx_id', 'split')} < 0.7e0 THEN 'train' "
    f"WHEN {uniform_sql('tx_id', 'split')} < 0.85e0 THEN 'valid' ELSE 'test' END"
)
TRAIN_SQL = f", split_tx AS (SELECT *, {SPLIT_SQL} AS split FROM tx), train AS (SELECT * FROM split_tx WHERE split = 'train')"


def split_transactions(spark, sf_dir):
    return sampling.three_way_split(transactions(spark, sf_dir), "tx_id")


def train_part(split):
    return split.where(F.col("split") == "train")


def _index_sql(column, source):
    return (
        f"(SELECT {column} AS v, row_number() OVER (ORDER BY count(*) DESC, {column}) - 1 AS idx "
        f"FROM {source} GROUP BY {column})"
    )


@query(
    "string_index",
    tx_sql(
        f"""
, known AS (SELECT * FROM tx WHERE type <> 'DEBIT')
SELECT tx_id, CAST(coalesce(t.idx, 4) AS DOUBLE) AS type_idx, CAST(coalesce(m.idx, 8) AS DOUBLE) AS merchant_idx
FROM tx LEFT JOIN {_index_sql('type', 'known')} t ON t.v = type
        LEFT JOIN {_index_sql('merchant', 'known')} m ON m.v = merchant"""
    ),
)
def string_index(spark, sf_dir):
    """Fitted without DEBIT rows, so that applying it meets an unseen category."""
    tx = activity(spark, sf_dir).select("tx_id", "type", "merchant")
    indexer = StringIndexer(
        inputCols=["type", "merchant"], outputCols=["type_idx", "merchant_idx"], handleInvalid="keep"
    )
    return indexer.fit(tx.where(F.col("type") != "DEBIT")).transform(tx).select("tx_id", "type_idx", "merchant_idx")


@query(
    "one_hot",
    tx_sql(
        f"""
, known AS (SELECT * FROM tx WHERE type <> 'DEBIT'), slots AS (SELECT unnest(range(5)) AS i)
SELECT tx_id, CAST(i AS INTEGER) AS slot, CASE WHEN coalesce(t.idx, 4) = i THEN 1e0 ELSE 0e0 END AS value
FROM tx LEFT JOIN {_index_sql('type', 'known')} t ON t.v = type, slots"""
    ),
)
def one_hot(spark, sf_dir):
    indexer = StringIndexer(inputCol="type", outputCol="type_idx", handleInvalid="keep")
    tx = activity(spark, sf_dir).select("tx_id", "type")
    indexed = indexer.fit(tx.where(F.col("type") != "DEBIT")).transform(tx)
    encoder = OneHotEncoder(inputCols=["type_idx"], outputCols=["type_ohe"], handleInvalid="keep")
    encoded = encoder.fit(indexed).transform(indexed)
    return encoded.select("tx_id", F.posexplode(vector_to_array("type_ohe")).alias("slot", "value"))


_WIDE = ["nameOrig", "merchant"]


@query(
    "category_index",
    tx_sql(
        f"""
, known AS (SELECT * FROM tx WHERE type <> 'DEBIT'),
a AS {_index_sql('nameOrig', 'known')}, m AS {_index_sql('merchant', 'known')}
SELECT tx_id, CAST(coalesce(a.idx, (SELECT count(*) FROM a)) AS DOUBLE) AS nameOrig_idx,
       CAST(coalesce(m.idx, (SELECT count(*) FROM m)) AS DOUBLE) AS merchant_idx
FROM tx LEFT JOIN a ON a.v = nameOrig LEFT JOIN m ON m.v = merchant"""
    ),
)
def category_index(spark, sf_dir):
    """Accounts and merchants numbered by a dictionary table, fitted without DEBIT rows, loaded and joined."""
    tx = activity(spark, sf_dir).select("tx_id", "nameOrig", "merchant", "type")
    path = shared_folder(spark)
    categories.CategoryIndex.fit(tx.where(F.col("type") != "DEBIT"), _WIDE, path)
    index = categories.CategoryIndex.load(spark, path)
    return index.transform(tx.select("tx_id", *_WIDE)).select("tx_id", "nameOrig_idx", "merchant_idx")


@query(
    "sparse_slots",
    tx_sql(
        f"""
, known AS (SELECT * FROM tx WHERE type <> 'DEBIT'),
a AS {_index_sql('nameOrig', 'known')}, m AS {_index_sql('merchant', 'known')},
n AS (SELECT (SELECT count(*) FROM m) AS nm, (SELECT count(*) FROM a) AS na)
SELECT tx_id, CAST(coalesce(m.idx, nm) AS BIGINT) AS slot, 1e0 AS value FROM n, tx LEFT JOIN m ON m.v = merchant
UNION ALL SELECT tx_id, CAST(nm + 1 + coalesce(a.idx, na) AS BIGINT), 1e0 FROM n, tx LEFT JOIN a ON a.v = nameOrig
UNION ALL SELECT tx_id, CAST(nm + na + 2 AS BIGINT), amount FROM n, tx WHERE amount <> 0e0"""
    ),
)
def sparse_slots(spark, sf_dir):
    """The slots that are not 0 of one-hot merchants and accounts and of an amount, at any width."""
    tx = activity(spark, sf_dir).select("tx_id", "nameOrig", "merchant", "amount", "type")
    path = shared_folder(spark)
    index = categories.CategoryIndex.fit(tx.where(F.col("type") != "DEBIT"), ["merchant", "nameOrig"], path)
    found = index.sparse_slots(tx.select("tx_id", "nameOrig", "merchant", "amount"), ["amount"])
    return found.select("tx_id", F.inline(F.arrays_zip("slots", "values"))).toDF("tx_id", "slot", "value")


@query(
    "scale_unit_std",
    tx_sql(
        ", s AS (SELECT "
        + ", ".join(f"stddev_samp({n}) AS {n}_s" for n in NUMERIC)
        + " FROM tx) SELECT tx_id, "
        + ", ".join(f"round({n} / {n}_s, 6) AS {n}" for n in NUMERIC)
        + " FROM tx, s"
    ),
)
def scale_unit_std(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    fitted = features.fit_features(tx)
    scaled = fitted.transform(tx).select("tx_id", vector_to_array("num_scaled").alias("x"))
    return scaled.select("tx_id", *[F.round(F.col("x")[i], 6).alias(n) for i, n in enumerate(NUMERIC)])


@query(
    "assemble_features",
    tx_sql(
        TRAIN_SQL
        + ", s AS (SELECT "
        + ", ".join(f"stddev_samp({n}) AS {n}_s" for n in NUMERIC)
        + f""" FROM train),
coded AS (SELECT tx.*, coalesce(t.idx, 5) AS ti, coalesce(m.idx, 8) AS mi
  FROM tx LEFT JOIN {_index_sql('type', 'train')} t ON t.v = type
          LEFT JOIN {_index_sql('merchant', 'train')} m ON m.v = merchant),
slots AS (SELECT unnest(range(21)) AS i)
SELECT tx_id, CAST(i AS INTEGER) AS slot, round(CASE
  WHEN i < 6 THEN CASE WHEN ti = i THEN 1e0 ELSE 0e0 END
  WHEN i < 15 THEN CASE WHEN mi = i - 6 THEN 1e0 ELSE 0e0 END """
        + " ".join(f"WHEN i = {15 + j} THEN {n} / {n}_s" for j, n in enumerate(NUMERIC))
        + " END, 6) AS value FROM coded, s, slots"
    ),
)
def assemble_features(spark, sf_dir):
    split = split_transactions(spark, sf_dir)
    vectors = features.fit_features(train_part(split)).transform(split)
    return vectors.select("tx_id", F.posexplode(vector_to_array("features")).alias("slot", "value")).withColumn(
        "value", F.round("value", 6)
    )


@query(
    "zscore_train_apply",
    tx_sql(
        TRAIN_SQL
        + ", s AS (SELECT "
        + ", ".join(f"avg({n}) AS {n}_m, stddev_pop({n}) AS {n}_s" for n in NUMERIC)
        + " FROM train) SELECT tx_id, split, "
        + ", ".join(f"round(({n} - {n}_m) / ({n}_s + 1e-6), 6) AS {n}" for n in NUMERIC)
        + " FROM split_tx, s"
    ),
)
def zscore_train_apply(spark, sf_dir):
    split = split_transactions(spark, sf_dir).select("tx_id", "split", *NUMERIC)
    scaled = features.zscore(split, NUMERIC, train_part(split))
    return scaled.withColumns({n: F.round(n, 6) for n in NUMERIC})


@query("three_way_split", tx_sql(f"SELECT tx_id, isFraud AS label, {SPLIT_SQL} AS split FROM tx"))
def three_way_split(spark, sf_dir):
    return split_transactions(spark, sf_dir).select("tx_id", F.col("isFraud").alias("label"), "split")


@query(
    "bernoulli_sample",
    tx_sql(f"SELECT tx_id, isFraud FROM tx WHERE {uniform_sql('tx_id', 'sample')} < 0.05e0"),
)
def bernoulli_sample(spark, sf_dir):
    return sampling.bernoulli_sample(transactions(spark, sf_dir).select("tx_id", "isFraud"), "tx_id", 0.05)


@query(
    "stratified_split",
    tx_sql(
        f"""
, r AS (SELECT tx_id, isFraud AS label,
  row_number() OVER (PARTITION BY isFraud ORDER BY {residue_sql('tx_id', 'stratify')}, tx_id) AS rn,
  count(*) OVER (PARTITION BY isFraud) AS n FROM tx)
SELECT tx_id, label, CASE WHEN rn <= floor(n * 0.8e0) THEN 'train' ELSE 'valid' END AS part FROM r"""
    ),
)
def stratified_split(spark, sf_dir):
    labelled = transactions(spark, sf_dir).select("tx_id", F.col("isFraud").alias("label"))
    return sampling.stratified_split(labelled, "tx_id")


@query(
    "fixed_size_sample",
    tx_sql(f"SELECT tx_id, type, amount FROM tx ORDER BY {residue_sql('tx_id', 'foreground')}, tx_id LIMIT 200"),
)
def fixed_size_sample(spark, sf_dir):
    return sampling.fixed_size_sample(activity(spark, sf_dir).select("tx_id", "type", "amount"), "tx_id", 200)


@query(
    "oversample_minority",
    tx_sql(
        f"""
, sizes AS (SELECT count(*) FILTER (WHERE isFraud = 0) AS n0, count(*) FILTER (WHERE isFraud = 1) AS n1 FROM tx),
pool AS (SELECT *, row_number() OVER (ORDER BY {residue_sql('tx_id', 'minority')}, tx_id) - 1 AS pick
         FROM tx WHERE isFraud = 1),
draws AS (SELECT {residue_sql('j', 'draw')} % n1 AS pick
          FROM sizes, (SELECT unnest(range(CAST(floor(0.1e0 * n0) AS BIGINT) - n1)) AS j FROM sizes))
SELECT tx_id, isFraud AS label, amount, CAST(0 AS INTEGER) AS copy FROM tx
UNION ALL SELECT tx_id, isFraud, amount, 1 FROM draws JOIN pool USING (pick)"""
    ),
)
def oversample_minority(spark, sf_dir):
    labelled = transactions(spark, sf_dir).select("tx_id", F.col("isFraud").alias("label"), "amount")
    return sampling.oversample_minority(labelled, "tx_id", 0.1)


def _rung_sql():
    u = uniform_sql("tx_id", "sample")
    rows = [
        f"SELECT CAST({i + 1} AS INTEGER) AS rung, {f}e0 AS fraction, {str(w).lower()} AS weighted, "
        f"CAST(count(*) AS BIGINT) AS n_rows, CAST(coalesce(sum(isFraud), 0) AS BIGINT) AS positives FROM tx WHERE {u} < {f}e0"
        for i, (f, w) in enumerate(sampling.backoff_ladder(0.05))
    ]
    return " UNION ALL ".join(rows)


@query("backoff_fractions", tx_sql(_rung_sql()))
def backoff_fractions(spark, sf_dir):
    labelled = transactions(spark, sf_dir).select("tx_id", F.col("isFraud").alias("label"))
    return sampling.backoff_fractions(labelled, "tx_id", 0.05)
