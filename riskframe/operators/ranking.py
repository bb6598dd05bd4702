"""Exact ranks and running totals without a one-task sort.

Each operator first counts rows per bucket, turns the few bucket counts into
offsets, and only then ranks inside one bucket.  Buckets are small by
construction, so one key or one score holding a third of the table still spreads
over the cluster.
"""

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.keyed import residue
from riskframe.session import shared_folder

BUCKET_SHIFT = 15  # residues below 2^31 fall into at most 65,536 buckets
HOT_ROWS = 1_000_000  # an account with more rows than this is split
MAX_HOT_KEYS = 100_000
CHUNK_IDS = 1 << 20  # unique ids per chunk, hence rows per chunk at most


def _before(*partition: str, order: str):
    return Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def within_smallest(df: DataFrame, id_col: str, purpose: str, want: int) -> Column:
    """True for exactly ``want`` rows of ``df``, lowest draw first, or for all of a smaller table.

    The rows are never sorted or shuffled: a histogram of the draws finds the
    bucket that holds the last kept row, only that bucket is ranked, and every
    row is then compared with the (draw, id) of the last kept row.
    """
    keys = df.select(residue(id_col, purpose).alias("draw"), F.col(id_col).cast("long").alias("id"))
    bucket = F.shiftright("draw", BUCKET_SHIFT)
    counts = keys.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    running = counts.select("bucket", "n", F.sum("n").over(Window.orderBy("bucket")).alias("upto"))
    reached = F.col("upto") >= want
    edge = running.agg(
        F.struct(
            (F.coalesce(F.sum("n"), F.lit(0)) <= want).alias("whole"),
            F.min(F.when(reached, F.col("bucket"))).alias("bucket"),
            (want - F.coalesce(F.max(F.when(~reached, F.col("upto"))), F.lit(0))).alias("rest"),
        ).alias("edge")
    ).scalar()
    last = (
        keys.where(bucket == edge.getField("bucket"))
        .withColumn("rn", F.row_number().over(Window.orderBy("draw", "id")))
        .where(F.col("rn") == edge.getField("rest"))
        .agg(F.max(F.struct("draw", "id")).alias("last"))
        .scalar()
    )
    kept = F.struct(residue(id_col, purpose).alias("draw"), F.col(id_col).cast("long").alias("id")) <= last
    return edge.getField("whole") | F.coalesce(kept, F.lit(False))


def sorted_numbers(values: DataFrame) -> DataFrame:
    """``values`` (one column of distinct values) with their 0-based ``number`` in sorted order.

    Spark cuts the values into sorted ranges, which are written once; the counts of
    the ranges give each range its offset, and only rows of one range are ranked together.
    """
    (name,) = values.columns
    ranges = values.repartitionByRange(name).withColumn("part", F.spark_partition_id())
    path = shared_folder(values.sparkSession)
    ranges.write.parquet(path)
    ranges = values.sparkSession.read.schema(ranges.schema).parquet(path)
    counts = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("part", F.coalesce(F.sum("n").over(_before(order="part")), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy(name)
    number = F.col("start") + F.row_number().over(inside) - F.lit(1)
    return ranges.join(starts, "part").select(name, number.alias("number"))


def numbered(df: DataFrame, id_col: str, purpose: str, name: str = "index") -> DataFrame:
    """``df`` with a dense 0-based number in draw order."""
    keyed = df.withColumn("draw", residue(id_col, purpose)).withColumn("bucket", F.shiftright("draw", BUCKET_SHIFT))
    starts = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("bucket", F.coalesce(F.sum("n").over(_before(order="bucket")), F.lit(0)).alias("start"))
    inside = Window.partitionBy("bucket").orderBy("draw", id_col)
    # At most 65,536 starts whatever the table size.
    return (
        keyed.join(F.broadcast(starts), "bucket")
        .withColumn(name, F.col("start") + F.row_number().over(inside) - F.lit(1))
        .drop("bucket", "draw", "start")
    )


def ranked_in_class(df: DataFrame, id_col: str, purpose: str, by: str) -> DataFrame:
    """``df`` with ``rn`` (1-based, in draw order) and ``total`` per class, for any number of classes.

    One shuffle on (class, draw bucket) serves the join with the offsets and the
    ranking, so a class of any size spreads over its buckets.
    """
    unit = F.struct(F.col(by).alias("class"), F.shiftright(residue(id_col, purpose), BUCKET_SHIFT).alias("bucket"))
    rows = df.withColumn("unit", unit).withColumn("draw", residue(id_col, purpose))
    sizes = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).select("unit", "unit.class", "unit.bucket", "n")
    starts = sizes.select(
        "unit",
        F.coalesce(F.sum("n").over(_before("class", order="bucket")), F.lit(0)).alias("start"),
        F.sum("n").over(Window.partitionBy("class")).alias("total"),
    )
    inside = Window.partitionBy("unit").orderBy("draw", id_col)
    return (
        rows.join(starts, "unit")
        .withColumn("rn", F.col("start") + F.row_number().over(inside))
        .select(*df.columns, "rn", "total")
    )


def split_hot(
    df: DataFrame, key: str, hot_rows: int = HOT_ROWS, survey: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of keys holding more than ``hot_rows`` rows).

    ``survey`` may name a cheaper table to count the keys in, such as the raw scan
    below ``df``.

    The list of hot keys only routes rows, so bounding it is safe: a key past the
    bound takes the ordinary way and comes out the same.
    """
    hot = (
        (df if survey is None else survey).groupBy(F.col(key).alias("hot_key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > hot_rows)
        .orderBy(F.desc("n"), "hot_key")
        .limit(MAX_HOT_KEYS)
        .select("hot_key")
    )
    same = F.col(key).eqNullSafe(F.col("hot_key"))
    return df.join(F.broadcast(hot), same, "left_anti"), df.join(F.broadcast(hot), same, "left_semi")


def rank_ordinary(df: DataFrame, key: str, order: str, id_col: str) -> DataFrame:
    """``rn`` of each row in its account, one window per account."""
    account = Window.partitionBy(key).orderBy(order, id_col)
    return df.withColumn("rn", F.row_number().over(account).cast("long"))


def rank_hot(df: DataFrame, key: str, order: str, id_col: str, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """The same ``rn`` for accounts too large for one window.

    Rows are ranked inside (account, order value, id chunk); ids are unique, so a
    chunk holds at most ``chunk_ids`` rows.  Offsets come from the chunk counts.
    """
    chunk = F.floor(F.col(id_col) / F.lit(chunk_ids)).alias("chunk")
    # Struct keys: a null account or step inside one still equals itself in a join.
    rows = df.withColumn("unit", F.struct(key, order, chunk))
    chunks = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    chunks = chunks.select("unit", F.struct(f"unit.{key}", f"unit.{order}").alias("at"), "unit.chunk", "n")
    steps = chunks.groupBy("at").agg(F.sum("n").alias("n_step")).select("at", f"at.{key}", f"at.{order}", "n_step")
    steps = steps.select("at", F.coalesce(F.sum("n_step").over(_before(key, order=order)), F.lit(0)).alias("b0"))
    offsets = chunks.select(
        "unit", "at", F.coalesce(F.sum("n").over(_before("at", order="chunk")), F.lit(0)).alias("b1")
    ).join(steps, "at")
    inside = Window.partitionBy("unit").orderBy(id_col)
    return (
        rows.join(offsets, "unit")
        .withColumn("rn", (F.col("b0") + F.col("b1") + F.row_number().over(inside)).cast("long"))
        .select(*df.columns, "rn")
    )


def known_score(score: str = "score") -> Column:
    """The one rule for a missing score, in every matrix, sweep and curve: it counts as 0."""
    return F.coalesce(F.col(score).cast("double"), F.lit(0.0))


def score_curve(
    scored: DataFrame, by: tuple[str, ...] = (), buckets: int | None = None, label: str = "label",
    score: str = "score",
) -> DataFrame:
    """Running counts at every distinct score, highest first.

    Columns: ``by``, score, pos and n (rows with this score), tp and pp (positives
    and rows at or above it), positives and total (of the group).  Rows are
    aggregated per score first, so tied scores cost one row.  The distinct scores
    are then cut at approximate quantiles; the cut points balance the tasks and
    have no influence on the result.  ``buckets`` follows the shuffle partitions
    where it is not given.
    """
    keys = list(by)
    if buckets is None:
        buckets = max(32, 4 * int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    scored = scored.withColumn(score, known_score(score))
    per_score = scored.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    per_score = _bucketed(per_score, _score_bounds(scored.select(score), buckets))
    sums = per_score.groupBy(*keys, "bucket").agg(F.sum("pos").alias("b_pos"), F.sum("n").alias("b_n"))
    above = Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*keys)
    # A struct key: a null segment inside one still equals itself in a join.
    unit = F.struct(*keys, "bucket").alias("unit")
    offsets = sums.select(
        unit,
        F.coalesce(F.sum("b_pos").over(above), F.lit(0)).alias("tp_above"),
        F.coalesce(F.sum("b_n").over(above), F.lit(0)).alias("pp_above"),
        F.sum("b_pos").over(group).alias("positives"),
        F.sum("b_n").over(group).alias("total"),
    )
    # Both the join and the window hash on the unit: one shuffle serves both.
    downward = Window.partitionBy("unit").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return per_score.withColumn("unit", unit).join(offsets, "unit").select(
        *keys,
        "score",
        "pos",
        "n",
        (F.col("tp_above") + F.sum("pos").over(downward)).alias("tp"),
        (F.col("pp_above") + F.sum("n").over(downward)).alias("pp"),
        "positives",
        "total",
    )


def _score_bounds(scores: DataFrame, buckets: int) -> list[float]:
    (name,) = scores.columns
    points = [i / buckets for i in range(1, buckets)]
    return sorted({b for b in scores.approxQuantile(name, points, 0.5 / buckets) if b == b})


def _bucketed(per_score: DataFrame, bounds: list[float]) -> DataFrame:
    if not bounds:
        return per_score.withColumn("bucket", F.lit(0))
    splits = [float("-inf"), *[b for b in bounds if abs(b) != float("inf")], float("inf")]
    if len(splits) < 3:
        return per_score.withColumn("bucket", F.lit(0))
    cut = Bucketizer(splits=splits, inputCol="score", outputCol="bucket", handleInvalid="keep")
    # Known not to be null, so that joining on it puts no filter before the aggregation.
    return cut.transform(per_score).withColumn("bucket", F.coalesce(F.col("bucket").cast("int"), F.lit(-1)))
