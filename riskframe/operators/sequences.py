"""Fixed-length event sequences per account."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators.encoding import dict_encode
from riskframe.operators.ranking import HOT_ROWS, rank_hot, rank_ordinary, split_hot

VALUE_COLUMNS = ["amount", "oldbalanceOrg", "newbalanceOrg"]


def txn_rank(
    df: DataFrame, key: str = "nameOrig", order: str = "step", id_col: str = "tx_id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``rn``: position of a transaction in its account by (step, id)."""
    ordinary, hot = split_hot(df, key, hot_rows)
    return rank_ordinary(ordinary, key, order, id_col).unionByName(rank_hot(hot, key, order, id_col))


def with_window_id(ranked: DataFrame, seq_len: int) -> DataFrame:
    """``win_id``: which run of ``seq_len`` consecutive rows of the account a row falls in."""
    return ranked.withColumn("win_id", F.floor((F.col("rn") - 1) / F.lit(seq_len)).cast("int"))


def _windows(ranked: DataFrame, key: str, seq_len: int, label: str) -> DataFrame:
    """Full windows; one struct per row keeps the four arrays aligned and ordered by rn."""
    row = F.struct("rn", "type_idx", *VALUE_COLUMNS)
    grouped = (
        with_window_id(ranked, seq_len)
        .groupBy(key, "win_id")
        .agg(F.sort_array(F.collect_list(row)).alias("events"), F.max(label).alias("label"))
        .where(F.size("events") >= seq_len)
    )
    return grouped.select(
        key,
        "win_id",
        F.col("events.type_idx").alias("type_seq"),
        *[F.col(f"events.{c}").alias(f"{c}_seq") for c in VALUE_COLUMNS],
        "label",
    )


def build_sequences(
    df: DataFrame,
    seq_len: int = 20,
    key: str = "nameOrig",
    order: str = "step",
    id_col: str = "tx_id",
    label: str = "isFraud",
    hot_rows: int = HOT_ROWS,
    survey: DataFrame | None = None,
) -> DataFrame:
    """(account, win_id, type_seq, amount_seq, oldbalanceOrg_seq, newbalanceOrg_seq, label).

    Ordinary accounts need one shuffle: the grouping by (account, win_id) runs on the
    window's own partitioning.  Accounts above ``hot_rows`` are ranked in chunks and
    regrouped by window, so their rows spread over many tasks.  Categories and account
    sizes are looked up in ``survey`` where a cheaper table than ``df`` holds both.
    """
    columns = [key, order, id_col, "type", *VALUE_COLUMNS, label]
    encoded = dict_encode(df.select(*columns), "type", "type_idx", source=survey)
    ordinary, hot = split_hot(encoded, key, hot_rows, survey)
    parts = [rank_ordinary(ordinary, key, order, id_col), rank_hot(hot, key, order, id_col)]
    first, second = (_windows(p, key, seq_len, label) for p in parts)
    return first.unionByName(second)


@dataclass(frozen=True)
class AccountLayout:
    """Transactions written once in the order of their accounts.

    Ordinary accounts are a table bucketed and sorted by account, so ranking and cutting
    them into sequences reads each account where it lies, without a shuffle.  Accounts
    above the row limit would fill a bucket, so they lie in a table of their own, ranked
    when it is written.  Categories are numbered when the layout is written.
    """

    ordinary: str  # names of the two tables
    hot: str
    key: str
    order: str
    id_col: str

    @classmethod
    def write(
        cls, df: DataFrame, name: str, path: str, buckets: int, key: str = "nameOrig", order: str = "step",
        id_col: str = "tx_id", hot_rows: int = HOT_ROWS, survey: DataFrame | None = None,
    ) -> "AccountLayout":
        layout = cls(f"{name}_ordinary", f"{name}_hot", key, order, id_col)
        encoded = dict_encode(df, "type", "type_idx", source=survey)
        ordinary, hot = split_hot(encoded, key, hot_rows, survey)
        # the same hash deals rows to tasks and to buckets: one file per bucket
        bucketed = ordinary.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key)
        bucketed.sortBy(key, order, id_col).option("path", f"{path}/ordinary").saveAsTable(layout.ordinary)
        ranked = rank_hot(hot, key, order, id_col)
        ranked.write.mode("overwrite").option("path", f"{path}/hot").saveAsTable(layout.hot)
        return layout

    def ranked(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """The rows of ordinary and of hot accounts with ``rn``."""
        ordinary = rank_ordinary(spark.table(self.ordinary), self.key, self.order, self.id_col)
        return ordinary, spark.table(self.hot)

    def sequences(self, spark: SparkSession, seq_len: int = 20, label: str = "isFraud") -> DataFrame:
        """As :func:`build_sequences`."""
        first, second = (_windows(part, self.key, seq_len, label) for part in self.ranked(spark))
        return first.unionByName(second)

    def drop(self, spark: SparkSession) -> None:
        for name in (self.ordinary, self.hot):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def n_types(sequences: DataFrame) -> DataFrame:
    """One row: number of category codes in use."""
    return sequences.agg((F.max(F.array_max("type_seq")) + 1).alias("n_types"))


def zscore_sequences(sequences: DataFrame, columns: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """(x - mean) / (population std + 1e-6) with one mean and std over all elements of a column."""
    source = sequences if train is None else train
    elements = source.select(F.inline(F.arrays_zip(*[F.col(c) for c in columns])))
    stats = elements.agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_mean") for c in columns],
            *[F.stddev_pop(c).alias(f"{c}_std") for c in columns],
        ).alias("s")
    ).scalar()
    # The scalar becomes a column first: subqueries may not appear inside a lambda.
    scaled = sequences.withColumn("_stats", stats)

    def standardised(c: str):
        mean, std = F.col(f"_stats.{c}_mean"), F.col(f"_stats.{c}_std")
        return F.transform(c, lambda v: (v - mean) / (std + F.lit(1e-6)))

    return scaled.withColumns({c: standardised(c) for c in columns}).drop("_stats")
