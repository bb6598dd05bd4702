"""Scalar rules on transactions, labels, probabilities and sequences."""

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the transaction model.
TYPES = ["PAYMENT", "TRANSFER", "CASH_OUT", "DEBIT", "CASH_IN"]
MERCHANTS = ["grocery", "electronics", "restaurants", "travel", "online", "atm", "utilities", "fashion"]
LABEL_ALIASES = ["isFraud", "is_fraud", "fraud", "Fraud", "Class", "target", "y"]


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0.0 where the bottom is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def clip(value: str, low: float, high: float) -> str:
    """SQL text of a value held inside [low, high]."""
    return f"least(greatest({value}, {low}D), {high}D)"


def risk(type_: str, amount: str, new_balance: str) -> str:
    """SQL text of the fraud probability of a transaction from additive rules."""
    rules = [
        (f"{type_} = 'TRANSFER'", 0.01),
        (f"{type_} = 'CASH_OUT'", 0.006),
        (f"{amount} > 1500D", 0.006),
        (f"{new_balance} = 0D", 0.005),
    ]
    return clip(" + ".join(["0.012D", *[f"IF({when}, {points}D, 0D)" for when, points in rules]]), 0, 0.25)


def boosted_amount(type_: Column, amount: Column) -> Column:
    """Amount raised by 30 % of the mean boost of its type: 1.75 for transfers, 1.5 for cash-outs."""
    factor = F.when(type_ == "TRANSFER", F.lit(1.75)).when(type_ == "CASH_OUT", F.lit(1.5)).otherwise(F.lit(0.0))
    return F.round(amount * (F.lit(1.0) + factor * F.lit(0.3)), 2)


def binarise(score: Column, threshold: float) -> Column:
    """1 where the score reaches the threshold, inclusive."""
    return (score >= F.lit(threshold)).cast("int")


def positive_probability(probability: Column) -> Column:
    """Second element of a probability vector; 0.0 where there is no vector."""
    return F.when(probability.isNotNull(), vector_to_array(probability)[1]).otherwise(F.lit(0.0))


def logistic(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def linear_margin(values: Column, weights: Column, intercept: float = 0.0) -> Column:
    """Dot product of two arrays plus an intercept."""
    products = F.zip_with(values, weights, lambda v, w: v * w)
    return F.aggregate(products, F.lit(float(intercept)), lambda total, p: total + p)


def array_tail(values: Column, n: int) -> Column:
    """Last n elements, the whole array where it is shorter."""
    return F.when(F.size(values) > n, F.slice(values, -n, n)).otherwise(values)


def sequence_row(sequences: Sequence[Column]) -> Column:
    """One flat array of doubles from equally long arrays."""
    return F.concat(*[s.cast("array<double>") for s in sequences])


def sequence_parts(row: Column, n_parts: int, length: int) -> list[Column]:
    """The inverse of :func:`sequence_row`."""
    return [F.slice(row, part * length + 1, length) for part in range(n_parts)]


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` itself, or an error that names every missing column."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; present: {df.columns}")
    return df


def with_label(df: DataFrame) -> DataFrame:
    """Add an integer ``label`` from the first known alias, matched with its case."""
    if "label" in df.columns:
        return df
    for alias in LABEL_ALIASES:
        if alias in df.columns:
            return df.withColumn("label", F.col(f"`{alias}`").cast("int"))
    raise ValueError(f"no label column: none of {LABEL_ALIASES} in {df.columns}")


def flat_feature_columns(df: DataFrame) -> list[str]:
    """Feature columns of a table without a vector: all but the label and its weight."""
    return [c for c in df.columns if c not in ("label", "weight")]


def slot_name(slot: Column) -> Column:
    return F.concat(F.lit("f"), slot.cast("string"))
