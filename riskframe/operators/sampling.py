"""Splits, samples and rebalancing by reproducible draws."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.keyed import residue, uniform
from riskframe.operators.ranking import numbered, ranked_in_class, within_smallest


def three_way_split(df: DataFrame, id_col: str, parts: Sequence[float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """Add ``split`` in (train, valid, test); no shuffle, the same row always falls the same way."""
    draw = uniform(id_col, "split")
    train, valid = parts[0], round(parts[0] + parts[1], 12)
    name = F.when(draw < F.lit(train), "train").when(draw < F.lit(valid), "valid").otherwise("test")
    return df.withColumn("split", name)


def bernoulli_sample(df: DataFrame, id_col: str, fraction: float) -> DataFrame:
    """Each row with probability ``fraction``, held inside 0.0005..1."""
    fraction = max(0.0005, min(1.0, fraction))
    return df if fraction >= 1.0 else df.where(uniform(id_col, "sample") < F.lit(fraction))


def stratified_split(df: DataFrame, id_col: str, label: str = "label", train: float = 0.8) -> DataFrame:
    """Add ``part`` in (train, valid) with floor(train * n) rows of every class in train; any number of classes."""
    ranked = ranked_in_class(df, id_col, "stratify", label)
    first = F.col("rn") <= F.floor(F.col("total") * F.lit(train))
    return ranked.select(*df.columns, F.when(first, "train").otherwise("valid").alias("part"))


def fixed_size_sample(df: DataFrame, id_col: str, n: int, purpose: str = "foreground") -> DataFrame:
    """Exactly n rows without replacement, or all of a smaller table."""
    return df.where(within_smallest(df, id_col, purpose, n))


def class_counts(df: DataFrame, label: str = "label") -> tuple[int, int]:
    """(class 0 rows, class 1 rows) from one aggregate."""
    row = df.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")).first()
    return row["n0"], row["n1"]


def oversample_minority(df: DataFrame, id_col: str, ratio: float, label: str = "label") -> DataFrame:
    """Append minority rows drawn with replacement until minority = int(ratio * majority).

    Class 0 counts as the majority on equal counts.  The table comes back unchanged
    when a class is empty or the minority is large enough.  Added rows carry
    ``copy`` = 1, the others 0.
    """
    n0, n1 = class_counts(df, label)
    majority = 0 if n0 >= n1 else 1
    n_major, n_minor = (n0, n1) if majority == 0 else (n1, n0)
    marked = df.withColumn("copy", F.lit(0))
    need = int(ratio * n_major) - n_minor
    if n_minor == 0 or n_major == 0 or need <= 0:
        return marked
    pool = numbered(marked.where(F.col(label) == 1 - majority), id_col, "minority", "pick")
    draws = df.sparkSession.range(need).select((residue("id", "draw") % F.lit(n_minor)).alias("pick"))
    copies = draws.join(pool, "pick").withColumn("copy", F.lit(1)).select(*marked.columns)
    return marked.unionByName(copies)


def backoff_ladder(first: float) -> list[tuple[float, bool]]:
    """(fraction, weighted) of each attempt, largest first."""
    f0 = max(0.0005, min(1.0, first))
    small = min(0.02, f0 / 2)
    return [(f0, True), (small, True), (small, False), (0.01, False), (0.005, False)]


def backoff_fractions(df: DataFrame, id_col: str, first: float = 0.05, label: str = "label") -> DataFrame:
    """Size and positives of every rung of the ladder from one scan."""
    draw = uniform(id_col, "sample")
    rungs = backoff_ladder(first)

    def chosen(fraction: float) -> Column:
        return F.lit(True) if fraction >= 1.0 else draw < F.lit(fraction)

    counts = df.agg(
        *[F.count_if(chosen(f)).alias(f"n{i}") for i, (f, _) in enumerate(rungs)],
        *[F.count_if(chosen(f) & (F.col(label) == 1)).alias(f"p{i}") for i, (f, _) in enumerate(rungs)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("rung"),
                F.lit(f).alias("fraction"),
                F.lit(w).alias("weighted"),
                F.col(f"n{i}").alias("n_rows"),
                F.col(f"p{i}").alias("positives"),
            )
            for i, (f, w) in enumerate(rungs)
        ]
    )
    return counts.select(F.inline(rows))
