"""Category dictionaries and class weights."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.columns import safe_ratio
from riskframe.operators.ranking import sorted_numbers

def dictionary(df: DataFrame, column: str, start: int = 0) -> DataFrame:
    """(value, idx) of the sorted distinct values that are not null, numbered without a one-task sort."""
    values = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    return sorted_numbers(values).select("value", (F.col("number") + F.lit(start)).cast("int").alias("idx"))


def dict_encode(
    df: DataFrame, column: str, output: str, source: DataFrame | None = None, start: int = 0
) -> DataFrame:
    """Add the sorted-order index of a category; 0 for a value ``source`` does not have."""
    codes = dictionary(df if source is None else source, column, start)
    codes = codes.select(F.col("value").alias(f"{output}_value"), F.col("idx").alias(f"{output}_code"))
    joined = df.join(codes, F.col(column) == F.col(f"{output}_value"), "left")
    return joined.select(*df.columns, F.coalesce(F.col(f"{output}_code"), F.lit(0)).alias(output))


def class_stats(df: DataFrame, label: str = "label") -> Column:
    """(pos, neg) of a table as one scalar."""
    counts = F.struct(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    return df.agg(counts.alias("s")).scalar()


def with_class_weight(df: DataFrame, label: str = "label", train: DataFrame | None = None) -> DataFrame:
    """weight = negatives / positives for a positive row, else 1.0; an absent class counts as 1."""
    stats = class_stats(df if train is None else train, label)
    at_least_one = [F.greatest(stats.getField(c), F.lit(1)) for c in ("neg", "pos")]
    weight = safe_ratio(*at_least_one)
    return df.withColumn("weight", F.when(F.col(label) == 1, weight).otherwise(F.lit(1.0)))


def floored_class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: the positive weight, never below 1."""
    counts = df.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    raw = safe_ratio(F.col("neg"), F.greatest(F.col("pos"), F.lit(1)))
    return counts.withColumn("pos_weight", F.greatest(F.lit(1.0), raw))


def preprocess_meta(df: DataFrame, num_cols: list[str], cat_cols: list[str], label: str = "label") -> DataFrame:
    """One row: class counts, weight and the column lists."""
    counts = df.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    weight = safe_ratio(F.greatest(F.col("neg"), F.lit(1)), F.greatest(F.col("pos"), F.lit(1)))
    return counts.select(
        "pos",
        "neg",
        weight.alias("pos_weight"),
        F.array(*[F.lit(c) for c in num_cols]).alias("num_cols"),
        F.array(*[F.lit(c) for c in cat_cols]).alias("cat_cols"),
    )
