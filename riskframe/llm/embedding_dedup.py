"""Near-duplicate vectors by random-hyperplane signs, exact cosines and components.

Each of several tables cuts space by BITS random hyperplanes; vectors with equal
sign codes meet in a bucket.  Two vectors at the threshold share a code with
probability (1 - angle / pi) ^ bits, so the number of tables follows from the recall
that is asked for.  Only short rows go to the buckets, an id and a long sign code of
LONG_BITS other hyperplanes: a bucket names, block by block, its members that have a
partner whose long code differs in no more signs than a pair at the threshold does (at
DEVIATIONS standard deviations above the mean).  These members alone come back with their
vectors, and all their cosines are computed in double precision.  A pair that shares
several codes counts only in the first table where it does, so links are counted without
ever writing the pairs; a block returns a sum per vector and a spanning forest of its
links.  Equal vectors are one class.
"""

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.blocks import grouped, sorted_groups, with_blocks
from riskframe.llm.components import connected_components
from riskframe.llm.tables import written

RECALL = 0.999  # of pairs right at the threshold; closer pairs are found more surely
BUCKET = 1024  # members that a bucket is meant to have
MAX_BITS = 31
BLOCK = 1024
LONG_BITS = 256
DEVIATIONS = 7.0  # a pair at the threshold has a larger distance of long codes with probability 3e-9


def plan_tables(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for ``n`` vectors: buckets of about BUCKET members at the recall asked for."""
    bits = min(MAX_BITS, max(1, round(math.log2(max(n, 1) / BUCKET)) if n > BUCKET else 1))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


@F.pandas_udf(T.BinaryType())
def _digest(vectors: pd.Series) -> pd.Series:
    """A digest of a usable vector; null for one that is null, zero, empty or not finite throughout."""
    out = []
    for v in vectors:
        v = None if v is None else np.asarray(v, np.float64)
        ok = v is not None and len(v) and np.isfinite(v).all() and v.any()
        out.append(blake2b((v + 0.0).tobytes(), digest_size=16).digest() if ok else None)
    return pd.Series(out, dtype=object)


def sign_codes(vector: Column, bits: int, tables: int, seed: int = 5) -> Column:
    """Struct of ``codes``, one integer of at most MAX_BITS = 31 signs per table, and of the ``long`` code."""

    @F.pandas_udf("codes array<int>, long binary")
    def signs_of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        planes = {}
        for part in parts:
            codes, long = [], []
            for v in part:
                v = np.asarray(v, np.float64)
                if len(v) not in planes:
                    rng = np.random.default_rng([seed, len(v)])
                    planes[len(v)] = rng.standard_normal((tables * bits + LONG_BITS, len(v)))
                signs = planes[len(v)] @ v >= 0
                codes.append((signs[:-LONG_BITS].reshape(tables, bits) @ (1 << np.arange(bits))).astype(np.int32))
                long.append(np.packbits(signs[-LONG_BITS:]).tobytes())
            yield pd.DataFrame({"codes": codes, "long": long})

    return signs_of(vector)


def largest_distance(threshold: float) -> int:
    """Signs of a long code in which a pair at the threshold may differ."""
    share = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return math.floor(LONG_BITS * share + DEVIATIONS * math.sqrt(LONG_BITS * share * (1 - share)))


def _with_partners(farthest: int):
    """The members of a block that have a partner within the distance, with the block they have it in."""

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in sorted_groups(frames, ["key", "block_a", "block_b"]):
            long = np.frombuffer(b"".join(group["long"]), np.uint64).reshape(len(group), -1)
            side = group["block"].to_numpy()
            crossing = group["block_a"].iat[0] != group["block_b"].iat[0]
            found = np.zeros(len(group), bool)
            for i in range(len(group) - 1):
                near = np.bitwise_count(long[i + 1 :] ^ long[i]).sum(axis=1) <= farthest
                if crossing:
                    near &= side[i + 1 :] != side[i]
                if near.any():
                    found[i] = True
                    found[i + 1 :] |= near
            if found.any():
                yield group.loc[found, ["class_id", "key", "block", "block_a", "block_b"]]

    return members


def spanning_forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """(member, root) for every node but the roots of the components of a symmetric matrix."""
    left = linked.any(axis=1)
    while left.any():
        root = int(left.argmax())
        reached = np.zeros(len(linked), bool)
        reached[root] = True
        edge = reached.copy()
        while edge.any():
            edge = linked[edge].any(axis=0) & ~reached
            reached |= edge
        for member in np.flatnonzero(reached):
            if member != root:
                yield int(member), root
        left &= ~reached


def _links(threshold: float):
    def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in sorted_groups(frames, ["key", "block_a", "block_b"]):
            vectors = [np.asarray(v, np.float64) for v in group["embedding"]]
            widths = np.array([len(v) for v in vectors])
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                v = np.stack([vectors[i] for i in at])
                norm = np.sqrt((v * v).sum(axis=1))
                linked = (v @ v.T) / (norm[:, None] * norm) >= threshold
                np.fill_diagonal(linked, False)
                if group["block_a"].iat[0] != group["block_b"].iat[0]:
                    side = group["block"].to_numpy()[at]
                    linked &= side[:, None] != side
                if not linked.any():
                    continue
                ids, size = group["class_id"].to_numpy()[at], group["n"].to_numpy()[at]
                edges = [(ids[a], ids[b], 0) for a, b in spanning_forest(linked)]
                codes = np.stack(group["codes"].iloc[at].to_numpy())
                i, j = np.nonzero(np.triu(linked))
                mine = (codes[i] == codes[j]).argmax(axis=1) == group["key"].iat[0] >> 32
                i, j = i[mine], j[mine]
                weight = np.bincount(i, size[j], len(at)) + np.bincount(j, size[i], len(at))
                edges += [(ids[k], None, weight[k]) for k in np.flatnonzero(weight)]
                out = pd.DataFrame(edges, columns=["a", "b", "weight"])
                yield out.astype({"a": "Int64", "b": "Int64", "weight": "int64"})

    return links


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, recall: float = RECALL
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Rows are linked where the cosine of their vectors is at least ``threshold``;
    component_id is the smallest vec_id reachable by links.  A vector that is null,
    empty, zero or not finite throughout links with nothing and keeps its own id;
    vectors of different widths never link; repeated rows link with each other.
    """
    rows = vectors.select("vec_id", "embedding", _digest("embedding").alias("digest"))
    rows = written(rows.withColumn("row_id", F.monotonically_increasing_id()))
    usable = rows.filter("digest is not null").groupBy("digest")
    classes = usable.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row_id", "embedding")).alias("f"))
    classes = written(classes.select("digest", "n", F.col("f.row_id").alias("class_id"), "f.embedding"))
    bits, tables = plan_tables(classes.count(), threshold, recall)
    signs = sign_codes(F.col("embedding"), bits, tables).alias("s")
    coded = written(classes.select("class_id", "n", "embedding", signs).select("class_id", "n", "embedding", "s.*"))

    members = coded.select("class_id", F.posexplode("codes").alias("place", "code"))
    members = members.select("class_id", (F.shiftleft(F.col("place").cast("long"), 32) + F.col("code")).alias("key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    placed = with_blocks(members.join(sizes, "key"), "members", "class_id", BLOCK)
    placed = placed.join(coded.select("class_id", "long"), "class_id")
    flagged = written(
        grouped(placed, "key", "class_id").mapInPandas(
            _with_partners(largest_distance(threshold)), "class_id long, key long, block int, block_a int, block_b int"
        )
    )
    near = flagged.join(coded.drop("long"), "class_id")
    found = grouped(near, "key", "class_id").mapInPandas(_links(threshold), "a long, b long, weight long")
    found = written(found)

    counts = found.filter("b is null").groupBy(F.col("a").alias("class_id")).agg(F.sum("weight").alias("others"))
    components = connected_components(found.filter("b is not null").select("a", "b"))
    of_class = classes.select("digest", "class_id", "n").join(counts, "class_id", "left")
    of_class = of_class.join(components.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "digest",
        (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("component", "class_id").alias("component"),
    )
    of_row = written(rows.select("vec_id", "digest").join(of_class, "digest", "left").drop("digest"))
    smallest = of_row.groupBy("component").agg(F.min("vec_id").alias("smallest"))
    own = F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("smallest"))
    out = of_row.join(smallest, "component", "left").withColumn("component_id", own)
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "component_id",
        F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
