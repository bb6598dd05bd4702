"""Lloyd's clustering of integer vectors with ns-bounds, exact in every assignment.

Every vector keeps, for each centroid, a lower bound on its distance and the round in
which the bound was measured.  All earlier centroids are kept too: a bound measured in
round t is loosened by the length of the centroid's *total* displacement since round t,
the norm of the sum of its moves, which is never more, and often much less, than the sum
of the lengths of its moves.  A centroid whose loosened bound exceeds the distance to the
vector's own centroid cannot be nearer and is left out; all others are measured again
exactly.  Measuring is whole-number arithmetic, so ties are seen as ties and go to the
smaller number, and results do not depend on how rows are spread.

A round writes one table of vectors with their state; the centroids, k * width whole
numbers a round, are all that passes the driver.  Their sums are kept as totals to which a
round adds only the vectors that changed their cluster, pre-aggregated in each task.

Defined results: a vector that is null, has another width or holds a null or non-finite
component is left out; components beyond 2^27 / scale count as that bound, since the
squared distances would not fit a long; fewer vectors than centroids give as many
centroids as there are vectors; equal rows get equal results, and among equal ids the
smaller vector is the earlier seed; a null id is a name like any other; an empty table
gives no rows; further columns are dropped.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.tables import drop_stored, stored, written

LARGEST = 1 << 27  # of a component; 4 * 64 * LARGEST^2 is the largest squared distance, 2^62
EXACT_IN_DOUBLE = 1 << 22  # up to here every sum of 64 products is exact in double precision
LARGEST_LONG = (1 << 63) - 1
SLACK = 1e-6  # relative safety of stored bounds, far above their rounding


def whole_vector(vector: Column, width: int, scale: int) -> Column:
    """The vector as whole numbers floor(scale * component); null if it is not usable."""
    x = F.transform(vector, lambda v: F.floor(F.least(F.greatest(v.cast("double") * scale, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))))
    odd = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return F.when((F.size(vector) == width) & ~odd, x)


@dataclass
class History:
    """The centroids of all rounds so far: ``rounds[t]`` is a (k, width) array of int64."""

    rounds: list[np.ndarray] = field(default_factory=list)

    def drift(self) -> np.ndarray:
        """(round, centroid): the length of the displacement from that round until now, rounded up."""
        now = self.rounds[-1].astype(np.float64)
        return np.stack([np.sqrt(((now - then) ** 2).sum(axis=1)) for then in self.rounds]) * (1 + SLACK)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(row, centroid) exact squared distances of whole vectors."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT_IN_DOUBLE and x.shape[1] <= 64:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        exact = (a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)
        return exact.astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def lower(squared: np.ndarray) -> np.ndarray:
    """Distances as short numbers that are never above the true ones."""
    return (np.sqrt(squared.astype(np.float64)) * (1 - SLACK)).astype(np.float32)


def assign(
    x: np.ndarray, cluster: np.ndarray, bound: np.ndarray, measured: np.ndarray, history: History
) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, distances measured); ``bound`` and ``measured`` are brought up to date.

    A row whose cluster is -1 has no bounds yet and is measured against all centroids.
    """
    now, centroids = len(history.rounds) - 1, history.rounds[-1]
    n, k = len(x), len(centroids)
    own = np.zeros(n, np.int64)
    fresh = cluster < 0
    cluster = cluster.copy()
    work = 0
    if fresh.any():
        d = squared_distances(x[fresh], centroids)
        cluster[fresh], own[fresh] = d.argmin(axis=1), d.min(axis=1)
        bound[fresh], measured[fresh] = lower(d), now
        work += d.size
    old = np.flatnonzero(~fresh)
    if not len(old):
        return cluster, own, work
    # the distance to the own centroid is always measured, so it bounds the nearest from above
    own[old] = ((x[old] - centroids[cluster[old]]) ** 2).sum(axis=1)
    work += len(old)
    near = np.sqrt(own[old].astype(np.float64)) * (1 + SLACK)
    loosened = bound[old] - history.drift()[measured[old], np.arange(k)]
    open_ = loosened <= near[:, None]
    open_[np.arange(len(old)), cluster[old]] = False
    bound[old, cluster[old]], measured[old, cluster[old]] = lower(own[old]), now
    best, at = own[old].copy(), cluster[old].copy()
    for j in np.flatnonzero(open_.any(axis=0)):
        rows = np.flatnonzero(open_[:, j])
        d = ((x[old[rows]] - centroids[j]) ** 2).sum(axis=1)
        work += len(rows)
        bound[old[rows], j], measured[old[rows], j] = lower(d), now
        wins = (d < best[rows]) | ((d == best[rows]) & (j < at[rows]))
        best[rows[wins]], at[rows[wins]] = d[wins], j
    cluster[old], own[old] = at, best
    return cluster, own, work


STATE = "vec_id {id}, x binary, cluster int, was int, distance long, bound binary, measured binary"


def _matrix(column, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(-1, width).copy()


def _reassigned(history: History, width: int):
    """One round over rows of the state table."""
    k = len(history.rounds[-1])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["x"].to_pylist(), np.int32, width).astype(np.int64)
            was = batch["cluster"].to_numpy(zero_copy_only=False).astype(np.int64)
            if (was < 0).all():
                bound, measured = np.zeros((len(x), k), np.float32), np.zeros((len(x), k), np.int16)
            else:
                bound = _matrix(batch["bound"].to_pylist(), np.float32, k)
                measured = _matrix(batch["measured"].to_pylist(), np.int16, k)
            cluster, distance, _ = assign(x, was, bound, measured, history)
            columns = {
                "vec_id": batch["vec_id"],  # as it came, so a null stays one
                "x": batch["x"],
                "cluster": pa.array(cluster, pa.int32()),
                "was": pa.array(was, pa.int32()),
                "distance": pa.array(distance, pa.int64()),
                "bound": pa.array([row.tobytes() for row in bound], pa.binary()),
                "measured": pa.array([row.tobytes() for row in measured], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return of


def _partial_sums(k: int, width: int):
    """Of a task's rows that moved: what each cluster won or lost, one row per cluster."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for frame in frames:
            x = _matrix(frame["x"], np.int32, width).astype(np.int64)
            for side, sign in (("cluster", 1), ("was", -1)):
                at = frame[side].to_numpy(np.int64)
                known = at >= 0
                np.add.at(sums, at[known], sign * x[known])
                np.add.at(counts, at[known], sign)
        changed = np.flatnonzero(counts.astype(bool) | sums.any(axis=1))
        if len(changed):
            yield pd.DataFrame({"cluster": changed.astype(np.int32), "n": counts[changed], "sums": list(sums[changed])})

    return of


def _moved_sums(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) to add to the totals: k * width numbers, whatever the number of rows."""
    moved = state.filter("cluster != was").select("x", "cluster", "was")
    parts = moved.mapInPandas(_partial_sums(k, width), "cluster int, n long, sums array<long>")
    cells = parts.select("cluster", "n", F.posexplode("sums").alias("i", "part"))
    totals = cells.groupBy("cluster", "i").agg(
        F.sum(F.col("part").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")
    )
    sums, counts = np.zeros((k, width), object), np.zeros(k, object)
    for r in totals.collect():
        sums[r["cluster"], r["i"]] = int(r["total"])
        counts[r["cluster"]] = int(r["n"])
    return sums, counts


def as_bytes(whole: Column, width: int) -> Column:
    """Whole numbers as ``width`` little-endian 32-bit integers."""

    @F.pandas_udf("binary")
    def of(rows: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(r, np.int64).astype("<i4").tobytes() for r in rows], dtype=object)

    return of(whole)


def clustered(
    vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) per usable row of ``vectors`` (vec_id, embedding), and the final centroids.

    The first centroids are the vectors with the smallest sha256 of ``seed:vec_id``.
    """
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    rows = vectors.select("vec_id", whole_vector(F.col("embedding"), width, scale).alias("whole"))
    rows, path = stored(rows.filter("whole is not null"))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    first = rows.select(F.sha2(name, 256).alias("draw"), "whole").orderBy("draw", "whole").limit(k).collect()
    history = History([np.array([r["whole"] for r in first], np.int64).reshape(-1, width)])
    k = len(first)
    state = rows.select(
        "vec_id", as_bytes(F.col("whole"), width).alias("x"), F.lit(-1).alias("cluster"),
        F.lit(None).cast("binary").alias("bound"), F.lit(None).cast("binary").alias("measured"),
    )
    if not k:
        return state.select("vec_id", "cluster", F.lit(0).cast("long").alias("distance")), []
    spark, schema = vectors.sparkSession, STATE.format(id=id_type)
    needed = ("vec_id", "x", "cluster", "bound", "measured")
    sums, counts = np.zeros((k, width), object), np.zeros(k, object)
    for _ in range(rounds):
        state, new_path = stored(state.select(*needed).mapInArrow(_reassigned(history, width), schema))
        drop_stored(spark, path)  # this round's table takes its place
        path = new_path
        more, joined = _moved_sums(state, k, width)
        sums, counts = sums + more, counts + joined
        centroids = history.rounds[-1].copy()
        for j in range(k):
            if counts[j]:
                centroids[j] = [int(s) // int(counts[j]) for s in sums[j]]
        history.rounds.append(centroids)
    last = state.select(*needed).mapInArrow(_reassigned(history, width), schema)
    last = written(last.select("vec_id", "cluster", "distance"))
    drop_stored(spark, path)
    return last, history.rounds[-1].tolist()


def with_inertia(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``rows`` of :func:`clustered` with cluster_inertia, inertia and centroid_sha256.

    Sums beyond a long count as the largest long.
    """
    totals = {
        r["cluster"]: int(r["total"])
        for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    }  # one number per centroid
    own = [min(totals.get(j, 0), LARGEST_LONG) for j in range(len(centroids))]
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of_cluster = rows.sparkSession.createDataFrame(
        list(zip(range(len(own)), own, digests)), "cluster int, cluster_inertia long, centroid_sha256 string"
    )
    whole = F.lit(min(sum(totals.values()), LARGEST_LONG)).cast("long").alias("inertia")
    found = rows.join(F.broadcast(of_cluster), "cluster")  # k rows
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", whole, "centroid_sha256")


def clusters(
    vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per usable row of ``vectors``."""
    return with_inertia(*clustered(vectors, k, rounds, width, scale, seed))
