"""Category dictionaries of any length: numbered over distributed ranges, kept as a table, joined."""

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators.ranking import sorted_numbers


def frequency_numbers(train: DataFrame, column: str) -> DataFrame:
    """(value, idx) of the values that are not null, the most frequent first and equal counts by name.

    The counts are cut into sorted ranges, and only values of one range are ranked
    together: nothing is collected, whatever the number of values.
    """
    counts = train.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    entries = counts.select(F.struct((-F.col("n")).alias("rarer"), "value").alias("entry"))
    return sorted_numbers(entries).select(F.col("entry.value").alias("value"), F.col("number").alias("idx"))


@dataclass(frozen=True)
class CategoryIndex:
    """A fitted dictionary: a table (value, idx) per column in a folder of its own, and how many values each has."""

    path: str
    columns: tuple[str, ...]

    @classmethod
    def fit(cls, train: DataFrame, columns: Sequence[str], path: str) -> "CategoryIndex":
        for column in columns:
            frequency_numbers(train, column).write.mode("overwrite").parquet(f"{path}/values/{column}")
        spark = train.sparkSession
        sizes = [
            spark.read.parquet(f"{path}/values/{c}").agg(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"))
            for c in columns
        ]
        reduce(DataFrame.unionByName, sizes).coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")
        return cls(path, tuple(columns))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CategoryIndex":
        """The fitted dictionary that a folder holds; its values stay there."""
        return cls(path, tuple(sorted(r["column"] for r in spark.read.parquet(f"{path}/sizes").collect())))

    def size(self, spark: SparkSession, column: str) -> Column:
        """How many values a column has, as a scalar of the plan."""
        sizes = spark.read.parquet(f"{self.path}/sizes").where(F.col("column") == column)
        return sizes.agg(F.max("n")).scalar()

    def transform(self, df: DataFrame, suffix: str = "_idx") -> DataFrame:
        """``df`` with the index of each column's value; a value that is null or was not seen gets the next free index.

        An ordinary join: a short dictionary is broadcast by the optimizer, a long one is
        joined by value, and adaptive execution splits a value that fills a partition.
        """
        spark = df.sparkSession
        for column in self.columns:
            values = spark.read.parquet(f"{self.path}/values/{column}").toDF("_value", "_idx")
            joined = df.join(values, F.col(column) == F.col("_value"), "left")
            index = F.coalesce("_idx", self.size(spark, column)).cast("double").alias(f"{column}{suffix}")
            df = joined.select(*df.columns, index)
        return df

    def sparse_slots(self, df: DataFrame, numeric: Sequence[str] = ()) -> DataFrame:
        """``df`` with ``slots`` and ``values``, the slots that are not 0: what a sparse vector holds, at any width.

        A column of n values owns n + 1 slots, the last for values that were not seen;
        ``numeric`` columns come behind all of them.
        """
        indexed = self.transform(df, "_at")
        # where each column's slots begin, as columns first: scalars may not stand inside a lambda
        start: Column = F.lit(0).cast("long")
        slots = []
        for column in self.columns:
            slots.append(start + F.col(f"{column}_at").cast("long"))
            start = start + self.size(df.sparkSession, column) + F.lit(1)
        slots += [start + F.lit(i) for i in range(len(numeric))]
        values = [F.lit(1.0)] * len(self.columns) + [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in numeric]
        pairs = F.array(*[F.struct(s.alias("slot"), v.alias("value")) for s, v in zip(slots, values)])
        kept = F.filter("_pairs", lambda p: p["value"] != 0)
        kept = indexed.select(*df.columns, pairs.alias("_pairs")).withColumn("_pairs", kept)
        return kept.select(*df.columns, F.col("_pairs.slot").alias("slots"), F.col("_pairs.value").alias("values"))
