"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

The terms of a text are its words, weighed by how often they occur.  For each of
SAMPLES samples every (term, sample) owns two gamma(2, 1) draws r and c and a
uniform draw b, all from hashes.  A weight S becomes t = floor(ln S / r + b), and the
term with the smallest ln c - r * (t - b + 1) is sampled together with its t.  Two
texts agree in a sample with probability sum(min) / sum(max) of their weights, so the
share of equal samples estimates their generalised Jaccard similarity.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 32
SIGNATURE_BITS = 24
DIGITS = SIGNATURE_BITS // 4
BUCKETS_PER_PARTITION = 8


def term_weights(text: Column) -> Column:
    """Sorted 64-bit hashes of all words of a text, one per occurrence; ASCII white space parts words."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.array_sort(F.transform(words, lambda w: F.xxhash64(w)))


def runs(hashes: str) -> Column:
    """Positions in a sorted array where a new value begins."""
    last = F.size(hashes) - 1
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: (i == 0) | (F.get(hashes, i) != F.get(hashes, i - 1)))


def run_weights(hashes: str, starts: str) -> Column:
    """Array of (term, weight): each distinct value with the length of its run."""
    return F.transform(
        starts,
        lambda p, k: F.struct(
            F.get(hashes, p).alias("term"),
            (F.coalesce(F.get(starts, k + 1), F.size(hashes)) - p).alias("weight"),
        ),
    )


def _uniform(bits: Column, shift: int, width: int) -> Column:
    part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))
    return (part + F.lit(0.5)) / F.lit(float(1 << width))


def sample_key(term: Column, log_weight: Column, sample: int) -> Column:
    """A number whose minimum over the terms of a text names the sampled (term, t) in its low bits."""
    one, two = F.xxhash64(term, F.lit(sample)), F.xxhash64(term, F.lit(sample + SAMPLES))
    r = -F.log(_uniform(one, 40, 24) * _uniform(one, 16, 24))
    b = _uniform(one, 0, 16)
    log_c = F.log(-F.log(_uniform(two, 40, 24) * _uniform(two, 16, 24)))
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t - b + 1)
    low = F.lit((1 << SIGNATURE_BITS) - 1)
    signature = (term.bitwiseAND(low) + t * F.lit(0x9E3779B1)).bitwiseAND(low)
    return F.floor(log_a * F.lit(float(1 << 30))) * F.lit(1 << SIGNATURE_BITS) + signature


def fingerprint(keys: Sequence[str]) -> Column:
    """The signatures of all samples as one string; empty for a text without words."""
    low = F.lit((1 << SIGNATURE_BITS) - 1)
    parts = [F.lpad(F.lower(F.hex(F.col(k).bitwiseAND(low))), DIGITS, "0") for k in keys]
    return F.when(F.col(keys[0]).isNull(), "").otherwise(F.concat(*parts))


def likeness(a: str, b: str) -> Column:
    """The share of equal samples; 1 for two texts without words, 0 if just one has none."""
    starts = F.sequence(F.lit(1), F.lit(SAMPLES * DIGITS), F.lit(DIGITS))
    same = F.filter(starts, lambda i: F.substr(a, i, F.lit(DIGITS)) == F.substr(b, i, F.lit(DIGITS)))
    both = F.size(same) / F.lit(float(SAMPLES))
    return F.when((F.col(a) == "") | (F.col(b) == ""), (F.col(a) == F.col(b)).cast("double")).otherwise(both)


def with_fingerprint(rows: DataFrame, keys: list[str], text: str, out: str = "fingerprint") -> DataFrame:
    """(``keys``, fingerprint of ``text``) per row of ``rows``, whose ``keys`` name a row.

    Each row's terms are weighed inside the row.  The minima over the terms are a
    grouping by the row's own keys: no shuffle where ``rows`` is partitioned by one of
    them, and a map-side reduction to one row otherwise.
    """
    hashed = rows.select(*keys, term_weights(F.coalesce(F.col(text), F.lit(""))).alias("hashes"))
    begun = hashed.select(*keys, "hashes", runs("hashes").alias("starts"))
    terms = begun.select(*keys, F.explode_outer(run_weights("hashes", "starts")).alias("w"))
    terms = terms.select(*keys, F.col("w.term").alias("term"), F.log(F.col("w.weight")).alias("log_weight"))
    names = [f"sample_{k}" for k in range(SAMPLES)]
    minima = [F.min(sample_key(F.col("term"), F.col("log_weight"), k)).alias(n) for k, n in enumerate(names)]
    return terms.groupBy(*keys).agg(*minima).select(*keys, fingerprint(names).alias(out))


def range_bucket(column: Column, bounds: list[float]) -> Column:
    """How many of the sorted ``bounds`` are at most the value, found in two steps; -1 for null."""
    if not bounds:
        return F.when(column.isNull(), -1).otherwise(0)
    width = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    block = F.size(F.filter(F.lit([b[0] for b in blocks]), lambda x: x <= column)) - 1
    inside = F.get(F.array(*[F.lit(b) for b in blocks]), F.greatest(block, F.lit(0)))
    found = F.greatest(block, F.lit(0)) * width + F.size(F.filter(inside, lambda x: x <= column))
    return F.when(column.isNull(), -1).otherwise(found)


def in_order_with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in buckets of descending doc_id, each row with its ``next_text``.

    (bucket, place, doc_id, text, next_text, extra).  Buckets are ranges of ids about
    as large as a fraction of a shuffle partition; only their bounds, a few per
    partition, pass the driver.  The first row of the bucket below stands once more,
    as ``extra``, at the end of each bucket, and the very first row at the end of the
    last, so every row finds its successor in its own bucket and texts are shuffled
    once.  Null ids come last; rows of one id are ordered by their texts.
    """
    spark = docs.sparkSession
    parts = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)
    bounds = sorted(set(bounds))
    rows = docs.select(
        range_bucket(F.col("doc_id"), bounds).alias("bucket"),
        "doc_id",
        F.xxhash64("text").alias("tie"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    heads = rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "tie")).alias("head"))
    same = rows["doc_id"].eqNullSafe(F.col("head_id")) & (rows["tie"] == F.col("head_tie"))
    heads = heads.select("bucket", F.col("head.doc_id").alias("head_id"), F.col("head.tie").alias("head_tie"))
    first = rows.join(heads.drop("bucket"), same).groupBy("bucket").agg(F.max("text").alias("text"))
    down = Window.orderBy(F.col("bucket").desc())  # one row per bucket
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = F.coalesce(F.lead("text").over(down), F.first("text").over(whole))
    extra = first.select("bucket", follows.alias("text"))
    extra = extra.select(
        "bucket",
        F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        F.lit(0).cast("long").alias("tie"),
        "text",
        F.lit(True).alias("extra"),
    )
    every = rows.withColumn("extra", F.lit(False)).unionByName(extra)
    order = Window.partitionBy("bucket").orderBy(
        "extra", F.col("doc_id").desc_nulls_last(), F.col("tie").desc(), F.col("text").desc()
    )
    return every.select(
        "bucket",
        F.row_number().over(order).alias("place"),
        "doc_id",
        "text",
        F.lead("text").over(order).alias("next_text"),
        "extra",
    )


def edited(text: str = "text", other: str = "next_text") -> Column:
    """The text with its last half (rounded down) replaced by as much of the start of another."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(
        F.substr(F.col(text), F.lit(1), F.length(text) - half),
        F.substr(F.coalesce(F.col(other), F.lit("")), F.lit(1), half),
    )


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text), of its edited text, and how alike they are.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next).  A null text counts as empty; texts without words have the empty
    fingerprint; the only row of a table follows itself; an empty table gives no rows.
    doc_id is an integer or null.
    """
    rows = in_order_with_next(docs.select("doc_id", "text"))
    rows = rows.withColumn("edited", edited())
    versions = F.explode(F.array(*[F.struct(F.lit(i).alias("version"), F.col(c).alias("of")) for i, c in enumerate(("text", "edited"))]))
    facts = ["bucket", "place", "doc_id", "extra", "n_chars", "edited_sha256"]
    rows = rows.select(
        "bucket",
        "place",
        "doc_id",
        "extra",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        versions.alias("v"),
    ).select(*facts, "v.version", "v.of")
    prints = with_fingerprint(rows, [*facts, "version"], "of")
    both = prints.groupBy(*facts).agg(
        F.max(F.when(F.col("version") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("version") == 1, F.col("fingerprint"))).alias("edited_fingerprint"),
    )
    order = Window.partitionBy("bucket").orderBy("place")
    both = both.withColumn("next_fingerprint", F.lead("fingerprint").over(order)).filter(~F.col("extra"))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
