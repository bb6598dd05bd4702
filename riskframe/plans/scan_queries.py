"""Sources and sinks: every query writes or reads a whole table."""

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskframe.functions.keyed import residue_sql
from riskframe.operators import encoding, features
from riskframe.operators.sampling import three_way_split
from riskframe.plans.feature_queries import SPLIT_SQL, TRAIN_SQL, split_transactions, train_part
from riskframe.plans.registry import query
from riskframe.plans.sql import ratio, scored_sql, tx_sql
from riskframe.session import shared_folder
from riskframe.sources import files
from riskframe.sources.transactions import TRANSACTION_SCHEMA, activity, scored, table, transactions

RAW = TRANSACTION_SCHEMA.fieldNames()


def raw_transactions(spark, sf_dir):
    return transactions(spark, sf_dir).select(*RAW)


@query("csv_scan", tx_sql(f"SELECT {', '.join(RAW)} FROM tx"))
def csv_scan(spark, sf_dir):
    path = shared_folder(spark)
    raw_transactions(spark, sf_dir).write.option("header", True).option("sep", ";").csv(path)
    return files.scan_csv(spark, path, TRANSACTION_SCHEMA, sep=";")


@query(
    "parquet_scan",
    "SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events "
    "WHERE value > 50 GROUP BY event_type",
)
def parquet_scan(spark, sf_dir):
    events = files.scan_parquet(spark, f"{sf_dir}/events.parquet").where(F.col("value") > 50)
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "split_scan",
    tx_sql(
        f"SELECT type, CAST(count(*) AS BIGINT) AS n, round(sum(amount), 4) AS total "
        f"FROM (SELECT *, {SPLIT_SQL} AS split FROM tx) WHERE split = 'valid' GROUP BY type"
    ),
)
def split_scan(spark, sf_dir):
    """One split of a folder written by split; the other folders are not read."""
    path = shared_folder(spark)
    split = three_way_split(activity(spark, sf_dir), "tx_id")
    files.write_splits(split, path, ("tx_id", "type", "amount"))
    valid = files.read_split(spark, path, "valid")
    return valid.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 4).alias("total"))


@query(
    "parquet_multi_scan",
    tx_sql(f"SELECT tx_id, amount FROM (SELECT *, {SPLIT_SQL} AS split FROM tx) WHERE split IN ('train', 'valid')"),
)
def parquet_multi_scan(spark, sf_dir):
    """Two of three folders by name, read in depth through a file pattern."""
    path = shared_folder(spark)
    split = three_way_split(activity(spark, sf_dir), "tx_id").select("tx_id", "amount", "split")
    split.write.partitionBy("split").parquet(path)
    return files.scan_parquet(
        spark, f"{path}/split=train", f"{path}/split=valid", glob="*.parquet", recursive=True
    ).select("tx_id", "amount")


@query(
    "scan_with_fallback",
    tx_sql(
        """
, s AS (SELECT CAST(count(*) AS BIGINT) AS n, round(sum(amount), 4) AS total FROM tx)
SELECT 'parquet' AS format, n, total FROM s UNION ALL SELECT 'csv', n, total FROM s"""
    ),
)
def scan_with_fallback(spark, sf_dir):
    raw = raw_transactions(spark, sf_dir)
    as_parquet, as_csv = shared_folder(spark), shared_folder(spark)
    raw.write.parquet(as_parquet)
    raw.write.option("header", True).csv(as_csv)

    def summary(path, name):
        scan = files.scan_any(spark, path, TRANSACTION_SCHEMA)
        return scan.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 4).alias("total")).select(
            F.lit(name).alias("format"), "n", "total"
        )

    return summary(as_parquet, "parquet").unionByName(summary(as_csv, "csv"))


@query(
    "bounded_scan",
    tx_sql(f"SELECT tx_id, isFraud AS label, amount FROM tx ORDER BY {residue_sql('tx_id', 'subset')}, tx_id LIMIT 500"),
)
def bounded_scan(spark, sf_dir):
    labelled = transactions(spark, sf_dir).select("tx_id", F.col("isFraud").alias("label"), "amount")
    return files.bounded_scan(labelled, "tx_id", 500)


@query(
    "split_sink",
    tx_sql(
        TRAIN_SQL
        + f"""
, w AS (SELECT {ratio('greatest(count(*) FILTER (WHERE isFraud = 0), 1)', 'greatest(count(*) FILTER (WHERE isFraud = 1), 1)')}
        AS pos_weight FROM train)
SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(sum(isFraud) AS BIGINT) AS positives,
       round(sum(CASE WHEN isFraud = 1 THEN pos_weight ELSE 1e0 END), 6) AS weight
FROM split_tx, w GROUP BY split"""
    ),
)
def split_sink(spark, sf_dir):
    """Encoded splits in one partitioned write, counted after reading each folder back."""
    path = shared_folder(spark)
    split = split_transactions(spark, sf_dir).withColumn("label", F.col("isFraud"))
    encoded = features.fit_features(train_part(split)).transform(split)
    files.write_splits(encoding.with_class_weight(encoded, train=train_part(split)), path)
    parts = [files.read_split(spark, path, s).withColumn("split", F.lit(s)) for s in ("train", "valid", "test")]
    back = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return back.groupBy("split").agg(
        F.count("features").alias("n"),
        F.sum(F.col("label").cast("long")).alias("positives"),
        F.round(F.sum("weight"), 6).alias("weight"),
    )


@query("csv_export", scored_sql("SELECT label, score FROM scored"))
def csv_export(spark, sf_dir):
    path = shared_folder(spark)
    files.export_scores(scored(spark, sf_dir), path)
    return files.scan_csv(spark, path, "label int, score double")


@query(
    "feature_sample_sink",
    f"""
WITH s AS (SELECT vec_id, embedding, label FROM embeddings ORDER BY {residue_sql('vec_id', 'foreground')}, vec_id LIMIT 200),
e AS (SELECT vec_id, CAST(label = 0 AS INTEGER) AS y, unnest(embedding) AS value, unnest(range(len(embedding))) AS i FROM s)
SELECT vec_id, y, CAST(i AS INTEGER) AS slot, CAST(value AS DOUBLE) AS value FROM e""",
)
def feature_sample_sink(spark, sf_dir):
    path = shared_folder(spark)
    wide = table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.col("label") == 0).cast("int").alias("label"),
        *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)],
    )
    vectors = VectorAssembler(inputCols=[f"e{i}" for i in range(64)], outputCol="features").transform(wide)
    files.export_feature_sample(vectors, "vec_id", 200, path)
    return files.scan_parquet(spark, path).select("vec_id", "y", F.posexplode("x").alias("slot", "value"))
