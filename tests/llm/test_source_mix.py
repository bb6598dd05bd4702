import hashlib
import random
from collections import defaultdict

import pytest

from riskframe.llm import source_mix


def water_level(sizes, weights=(1.0, 2.0, 3.0)):
    """Targets by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, fixed = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in fixed)
        open_weight = sum(weight[s] for s in order if s not in fixed)
        target = {s: 3.0 * sizes[s] if s in fixed else left * weight[s] / open_weight for s in order}
        above = [s for s in order if s not in fixed and target[s] > 3 * sizes[s]]
        if not above:
            return target
        fixed.update(above)


def reference(rows):
    sizes = defaultdict(int)
    for _, source, size in rows:
        sizes[source] += size
    targets, out = water_level(sizes), []
    for source in sizes:
        keyed = sorted(
            (hashlib.md5(f"mix|{'null' if d is None else d}|{n}".encode()).hexdigest(), d, n)
            for d, s, n in rows
            if s == source
        )
        budget, size = int(targets[source] + 0.5), sizes[source]
        epochs, rest = divmod(budget, size) if size else (0, 0)
        before = 0
        for key in sorted({k for k, _, _ in keyed}):
            same = [(d, n) for k, d, n in keyed if k == key]
            words = sum(n for _, n in same)
            for d, n in same:
                part = n if before + words <= rest else max(0, rest - before) // len(same)
                out.append((d, n, size, round(targets[source], 6), epochs * n + part))
            before += words
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_reference(spark, seed):
    rng = random.Random(seed)
    sources = [None, "a", "b", "é", "Z", "zz", "tiny"]
    weights = [1, 30, 2, 5, 5, 3, 0.1]
    rows = [(i, s, rng.choice([0, 1, 5, 40, 400]) if s != "tiny" else 2) for i, s in enumerate(rng.choices(sources, weights, k=600))]
    rows += rows[:5] + [(None, "a", 7), (None, "a", 7), (None, None, 3)]
    got = rows_of(source_mix.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")))
    assert got == sorted(reference(rows), key=str)
    assert all(taken <= 3 * size for _, size, _, _, taken in got)


def test_budget_is_met_to_the_word(spark):
    rows = [(i, f"s{i % 5}", 1 + i * i % 97) for i in range(2_000)]
    df = source_mix.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"))
    for r in df.groupBy("source", "target").sum("taken").collect():
        assert abs(r["sum(taken)"] - r["target"]) <= 0.5


def test_whole_documents(spark):
    rows = [(i, f"s{i % 3}", 10 + i % 7) for i in range(900)]
    keyed = spark.createDataFrame(rows, "doc_id long, source string, size long")
    keyed = keyed.withColumn("key", source_mix.row_key("doc_id", "size", "mix"))
    taken = source_mix.with_taken(keyed, source_mix.cuts(keyed, split_last=False)).collect()
    assert len(taken) == 900 and all(r.taken % r["size"] == 0 for r in taken)
    for source in ("s0", "s1", "s2"):
        mine = [r for r in taken if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 8.5


def test_empty_and_wordless(spark):
    schema = "doc_id long, source string, size long"
    assert source_mix.mix(spark.createDataFrame([], schema)).count() == 0
    got = rows_of(source_mix.mix(spark.createDataFrame([(1, "a", 0), (2, None, 0)], schema)))
    assert got == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
