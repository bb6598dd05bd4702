import numpy as np
import pytest

from riskframe.llm import embedding_dedup


def reference(rows, threshold=0.9):
    usable = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = np.asarray(v, np.float32).astype(float)
    links = {i: set() for i in range(len(rows))}
    for i in usable:
        for j in usable:
            if i < j and len(usable[i]) == len(usable[j]):
                a, b = usable[i], usable[j]
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((vec_id, len(links[i]), min(ids, default=None)))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = embedding_dedup.near_duplicates(df).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)


def test_groups_of_all_kinds(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BUCKET", 32)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)  # large buckets fall into several blocks
    monkeypatch.setattr(embedding_dedup, "RECALL", 0.999999)
    rng = np.random.default_rng(6)
    rows, base = [], rng.standard_normal(16)
    rows += [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 16)))]
    rows += [(1_000 + i, (base + rng.standard_normal(16) * 0.12).tolist()) for i in range(150)]
    rows += [(2_000 + i, base.tolist()) for i in range(100)]
    rows += [(3_000 + i, (rows[i][1] + rng.standard_normal(16) * 0.3).tolist()) for i in range(100)]
    rows = [(i, np.asarray(v, np.float32).tolist()) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = embedding_dedup.near_duplicates(df, recall=0.9999999).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == reference(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
        (7, [1.0, 2.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [1.0, 2.0, 0.0]), (None, [2.0, 4.0]), (11, [-1.0, -2.0]),
        (12, [1e-30, 2e-30]), (13, [-0.0, 1.0]), (14, [0.0, 1.0]),
    ]
    assert found(spark, rows) == reference(rows)


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(3, [1.0])]) == [(3, 0, 3)]


def test_tables_meet_the_recall():
    for n in (10, 10_000, 10**8):
        bits, tables = embedding_dedup.plan_tables(n, 0.9, 0.99)
        same = (1 - np.arccos(0.9) / np.pi) ** bits
        assert 1 - (1 - same) ** tables >= 0.99


@pytest.mark.parametrize("bits", [16, 24, 31])
def test_equal_codes_meet_at_every_width(spark, monkeypatch, bits):
    monkeypatch.setattr(embedding_dedup, "plan_tables", lambda *a: (bits, 1))
    rng = np.random.default_rng(bits)
    base = rng.standard_normal((1_000, 64)).astype(np.float32)
    # twice the vector is another row with the same signs
    rows = [(2 * i + k, ((1 + k) * v).tolist()) for i, v in enumerate(base) for k in (0, 1)]
    assert found(spark, rows) == sorted(((i, 1, i - i % 2) for i in range(2_000)), key=str)


@pytest.mark.parametrize("bits", [8, 12, 16])
def test_planted_pairs_are_linked_at_the_default_recall(spark, monkeypatch, bits):
    """Pairs just above the threshold, among vectors that link with nothing."""
    rng = np.random.default_rng(bits)
    n, cosine = 1_500, 0.902
    base = rng.standard_normal((n, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    away = rng.standard_normal((n, 64))
    away -= (away * base).sum(axis=1)[:, None] * base
    away /= np.linalg.norm(away, axis=1)[:, None]
    pairs = np.stack([base, cosine * base + np.sqrt(1 - cosine**2) * away], axis=1).reshape(-1, 64).astype(np.float32)
    monkeypatch.setattr(embedding_dedup, "BUCKET", 2 * n / 2**bits)
    assert embedding_dedup.plan_tables(2 * n, 0.9)[0] == bits
    got = found(spark, [(i, v.tolist()) for i, v in enumerate(pairs)])
    linked = sum(links == 1 and component == i - i % 2 for i, links, component in got)
    assert linked / len(got) >= 0.997  # 0.999 is meant, 1,500 pairs


def test_long_codes_keep_pairs_at_the_threshold_and_leave_others():
    rng = np.random.default_rng(0)
    for threshold in (0.5, 0.9, 0.99):
        farthest = embedding_dedup.largest_distance(threshold)
        share = np.arccos(threshold) / np.pi
        assert (rng.binomial(embedding_dedup.LONG_BITS, share, 1_000_000) <= farthest).all()
    assert (rng.binomial(embedding_dedup.LONG_BITS, 0.5, 1_000_000) > embedding_dedup.largest_distance(0.9)).all()
