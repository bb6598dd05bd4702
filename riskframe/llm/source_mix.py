"""Mixing sources to target weights with an exact cut in a random order.

Every row gets a hash-random key.  A source's rows, sorted by that key, are taken
from the front until the source's budget of words is spent; a budget above the
source's size first takes whole epochs.  The sort is distributed: keys fall into
4,096 equal ranges per source, prefix sums over the range totals name the one range
that holds the cut, and only that range is sorted row by row.  All other rows are
compared with the cut key, so the texts themselves are never shuffled.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_DIGITS = 3  # hexadecimal digits of the key that name a range
WEIGHTS = (1.0, 2.0, 3.0)
MAX_EPOCHS = 3


def row_key(id_col: str, size_col: str, seed: str) -> Column:
    """A uniform key that depends on the row's id and size only; equal rows share it."""
    parts = [F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(size_col).cast("string")]
    return F.md5(F.concat_ws("|", *parts))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """``target`` words per source from one row per source: (source, source_size).

    Sources in code point order, null last, weigh ``weights`` in turn and share all
    words; a target stops at ``max_epochs`` times its source and the excess is
    shared again by weight.  That ends at one level: target = min(cap, weight *
    level), and the level is the largest of the shares that result from capping the
    sources with the smallest cap per weight first.  The windows see one row per source.
    """
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", "turn")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    turn = (F.col("turn") - 1) % len(weights) + 1
    return (
        sizes.withColumn("turn", F.row_number().over(in_order))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("open_words", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.max(F.col("open_words") / F.col("open_weight")).over(whole))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
        .select("source", "source_size", "target")
    )


def cuts(
    rows: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    split_last: bool = True,
) -> DataFrame:
    """One row per source of (source, size, key): how much of it the mix takes.

    ``epochs`` times every row, rows below ``cut_key`` once more, and ``part`` words
    of each row that has ``cut_key``.  With ``split_last`` the budget is met to the
    word (rows that share the cut key share what is left evenly); otherwise the row
    at the cut is taken whole if at least half of it is inside the budget.
    """
    bucket = F.substring("key", 1, RANGE_DIGITS)
    ranges = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    sizes = ranges.groupBy("source").agg(F.sum("words").alias("source_size"))
    budget = F.floor(F.col("target") + 0.5)
    plan = (
        source_targets(sizes, weights, max_epochs)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(0))
        .withColumn("rest", F.when(F.col("source_size") > 0, budget - F.col("epochs") * F.col("source_size")).otherwise(0))
    )

    def join(left, right, *more):
        on = left["source"].eqNullSafe(right["source"])
        for c in more:
            on = on & (left[c] == right[c])
        return left.join(right, on).drop(*[right[c] for c in ("source", *more)])

    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    holding = join(offsets, plan.select("source", "rest")).filter(
        (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))
    )
    holding = holding.select("source", "bucket", (F.col("rest") - F.col("before")).alias("left_over"))

    sharers = join(rows.withColumn("bucket", bucket), holding, "bucket").groupBy("source", "key", "left_over")
    sharers = sharers.agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    before_key = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    at_cut = sharers.withColumn("inside", F.col("left_over") - F.coalesce(F.sum("words").over(before_key), F.lit(0)))
    at_cut = at_cut.filter((F.col("inside") >= 0) & (F.col("inside") < F.col("words")))
    half_in = F.when(F.col("inside") * 2 >= F.col("words"), F.expr("words div n")).otherwise(0)
    part = F.expr("inside div n") if split_last else half_in
    at_cut = at_cut.select("source", F.col("key").alias("cut_key"), part.alias("part"))
    on = plan["source"].eqNullSafe(at_cut["source"])
    return plan.join(at_cut, on, "left").select(
        plan["source"], "source_size", "target", "epochs", "cut_key", F.coalesce("part", F.lit(0)).alias("part")
    )


def with_taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, size, key, any others) with ``source_size``, ``target`` and ``taken`` words."""
    salt = F.substring("key", RANGE_DIGITS + 1, 1)  # deals the rows of a large source to 16 tasks
    salts = F.explode(F.array(*[F.lit(c) for c in "0123456789abcdef"])).alias("plan_salt")
    plan = plan.withColumnRenamed("source", "plan_source").select("*", salts)
    extra = (
        F.when(F.col("cut_key").isNull() | (F.col("key") > F.col("cut_key")), 0)
        .when(F.col("key") < F.col("cut_key"), F.col("size"))
        .otherwise(F.col("part"))
    )
    return (
        rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source")) & (salt == F.col("plan_salt")))
        .withColumn("taken", (F.col("epochs") * F.col("size") + extra).cast("long"))
        .drop("plan_source", "plan_salt", "epochs", "cut_key", "part")
    )


def mix(
    rows: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    split_last: bool = True,
    seed: str = "mix",
) -> DataFrame:
    """(doc_id, source, size) with ``source_size``, ``target`` and ``taken`` per row.

    A null source is a source of its own; a row of size 0 takes 0; equal rows take
    equal parts; a null id is keyed like any other value; an empty table gives no rows.
    ``rows`` is read several times: pass a written table where it is costly.
    """
    keyed = rows.select("doc_id", "source", "size").withColumn("key", row_key("doc_id", "size", seed))
    return with_taken(keyed, cuts(keyed, weights, max_epochs, split_last)).drop("key")
