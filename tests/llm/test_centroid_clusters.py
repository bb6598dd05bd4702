from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import centroid_clusters as cc


def plain_lloyd(rows, k, rounds, width, scale=256, seed=2):
    """Every distance in every round, in Python's whole numbers."""
    top = cc.LARGEST
    kept = []
    for vec_id, v in rows:
        if v is None or len(v) != width or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((vec_id, [int(np.floor(min(max(float(x) * scale, -top), top))) for x in v]))
    name = lambda i: sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[0], []).append(v)
        for j, vs in members.items():
            centroids[j] = [sum(xs) // len(vs) for xs in zip(*vs)]
    found = [(i, *nearest(v)) for i, v in kept]
    top = (1 << 63) - 1
    own = {j: sum(d for _, c, d in found if c == j) for j in range(len(centroids))}
    total = min(sum(own.values()), top)
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, min(own[j], top), total, digest[j]) for i, j, d in found), key=str)


def found(spark, rows, **settings):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.withColumns({"cluster": F.lit("x"), "bound": F.lit("y"), "distance": F.lit("z")})
    out = cc.clusters(df, **settings).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
    return sorted((tuple(r) for r in out.collect()), key=str)


def groups(n, width, centres, seed):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, width))
    return [(i, (middle[rng.integers(centres)] + 0.4 * rng.standard_normal(width)).tolist()) for i in range(n)]


def as_floats(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("n, k, rounds", [(400, 7, 5), (90, 40, 6), (300, 5, 0), (3, 40, 5), (0, 40, 5)])
def test_equals_plain_lloyd(spark, n, k, rounds):
    rows = as_floats(groups(n, 6, 5, n))
    assert found(spark, rows, k=k, rounds=rounds, width=6) == plain_lloyd(rows, k, rounds, 6)


def test_odd_rows_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 3), float(i % 2)]) for i in range(60)]  # few places, many ties and empty clusters
    rows += [(5, [1.0, 1.0]), (5, [1.0, 1.0]), (5, [0.0, 1.0]), (None, [2.0, 0.5]), (None, [0.25, -0.004])]
    rows += [(100, None), (101, []), (102, [1.0]), (103, [1.0, None]), (104, [nan, 0.0]), (105, [-inf, 0.0])]
    rows += [(106, [3e38, -3e38]), (107, [4e5, 0.0]), (108, [-0.0, 0.0])]
    rows = as_floats(rows)
    for k in (4, 12):
        assert found(spark, rows, k=k, rounds=4, width=2) == plain_lloyd(rows, k, 4, 2)


def test_large_components_are_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-cc.LARGEST, cc.LARGEST, (20, 64))
    c = rng.integers(-cc.LARGEST, cc.LARGEST, (7, 64))
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x]
    assert cc.squared_distances(x, c).tolist() == exact
    small = cc.squared_distances(x >> 6, c >> 6)
    assert small.tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c >> 6] for v in x >> 6]


def rounds_of(x, k, n_rounds, drift=None):
    """Assignments and the share of distances measured per round, driven by the operator's own step."""
    history = cc.History([x[:k].copy()])
    if drift:
        history.drift = lambda: drift(history.rounds)
    cluster = np.full(len(x), -1)
    bound, measured = np.zeros((len(x), k), np.float32), np.zeros((len(x), k), np.int16)
    shares = []
    for _ in range(n_rounds):
        cluster, distance, work = cc.assign(x, cluster, bound, measured, history)
        every = cc.squared_distances(x, history.rounds[-1])
        assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
        # a stored bound, loosened by the total displacement, is never above the true distance
        now = bound - history.drift()[measured, np.arange(k)]
        assert (now <= np.sqrt(every) * (1 + 1e-9)).all()
        shares.append(work / every.size)
        new = history.rounds[-1].copy()
        for j in range(k):
            if (cluster == j).any():
                new[j] = x[cluster == j].sum(axis=0) // (cluster == j).sum()
        history.rounds.append(new)
    return shares


def test_bounds_spare_distances_and_beat_summed_drifts():
    x = np.array([v for _, v in groups(3_000, 8, 30, 4)])
    x = np.floor(x * 256).astype(np.int64)

    def summed(rounds):
        steps = [np.sqrt(((b - a) ** 2.0).sum(axis=1)) for a, b in zip(rounds, rounds[1:])]
        return np.stack([np.sum(steps[t:], axis=0) if t < len(steps) else np.zeros(len(rounds[0])) for t in range(len(rounds))])

    total, sums = rounds_of(x, 30, 14), rounds_of(x, 30, 14, summed)
    assert total[0] == 1.0 and max(total[5:]) < 0.2
    assert sum(total) < sum(sums)
