import random

import pytest
from pyspark.sql import functions as F

from riskframe.functions.keyed import HIGH_BITS, MODULUS, PURPOSES
from riskframe.operators import ranking as rk
from riskframe.operators import evaluation, sampling, sequences


def draw(i, purpose):
    a, b = PURPOSES[purpose]
    start = (i % MODULUS + (i >> 31) * HIGH_BITS) % MODULUS
    step = (start * a + b) % MODULUS
    return step * step % MODULUS


@pytest.fixture(scope="module")
def skewed(spark):
    """One account with more than a third of the rows and few distinct steps."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        account = "hot" if rng.random() < 0.4 else f"C{rng.randrange(60)}"
        kind = rng.choice(["PAYMENT", "DEBIT", "TRANSFER"])
        rows.append((i * 37 % 3001, account, rng.randrange(5), kind, rng.random(), 1.0 * i, 2.0 * i, int(rng.random() < 0.05)))
    schema = (
        "tx_id long, nameOrig string, step int, type string, amount double, oldbalanceOrg double, "
        "newbalanceOrg double, isFraud int"
    )
    return rows, spark.createDataFrame(rows, schema).repartition(5)


def expected_ranks(rows):
    ranks, seen = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        seen[r[1]] = seen.get(r[1], 0) + 1
        ranks[r[0]] = seen[r[1]]
    return ranks


@pytest.mark.parametrize("hot_rows", [10, 500, 10**6])
def test_rank_of_hot_and_ordinary_accounts(skewed, hot_rows):
    rows, df = skewed
    got = {r["tx_id"]: r["rn"] for r in sequences.txn_rank(df, hot_rows=hot_rows).collect()}
    assert got == expected_ranks(rows)


def test_chunks_smaller_than_a_step(skewed):
    rows, df = skewed
    got = {r["tx_id"]: r["rn"] for r in rk.rank_hot(df, "nameOrig", "step", "tx_id", chunk_ids=16).collect()}
    assert got == expected_ranks(rows)


def test_null_accounts_and_steps_keep_their_rows(spark):
    rows = [(i, None if i % 2 else "a", None if i % 5 == 0 else i % 4) for i in range(60)]
    df = spark.createDataFrame(rows, "tx_id long, nameOrig string, step int")
    expected, seen = {}, {}
    for i, account, step in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        seen[account] = seen.get(account, 0) + 1
        expected[i] = seen[account]
    for hot_rows in (5, 100):
        assert {r["tx_id"]: r["rn"] for r in sequences.txn_rank(df, hot_rows=hot_rows).collect()} == expected


@pytest.mark.parametrize("hot_rows", [10, 500, 10**6])
def test_sequences_of_hot_and_ordinary_accounts(skewed, hot_rows):
    rows, df = skewed
    codes = {t: i for i, t in enumerate(sorted({r[3] for r in rows}))}
    expected = {}
    by_account = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        by_account.setdefault(r[1], []).append(r)
    for account, items in by_account.items():
        for w in range(len(items) // 20):
            part = items[w * 20 : w * 20 + 20]
            expected[account, w] = (
                [codes[r[3]] for r in part], [r[4] for r in part], [r[5] for r in part], [r[6] for r in part],
                max(r[7] for r in part),
            )
    got = {
        (r["nameOrig"], r["win_id"]): (
            r["type_seq"], r["amount_seq"], r["oldbalanceOrg_seq"], r["newbalanceOrg_seq"], r["label"]
        )
        for r in sequences.build_sequences(df, 20, hot_rows=hot_rows).collect()
    }
    assert got == expected


def test_nulls_stay_in_their_place(spark):
    rows = [(i, "a", i, "PAYMENT", None if i % 3 == 0 else float(i), 1.0, None, 0) for i in range(20)]
    schema = (
        "tx_id long, nameOrig string, step int, type string, amount double, oldbalanceOrg double, "
        "newbalanceOrg double, isFraud int"
    )
    row = sequences.build_sequences(spark.createDataFrame(rows, schema), 20).first()
    assert row["amount_seq"] == [None if i % 3 == 0 else float(i) for i in range(20)]
    assert row["newbalanceOrg_seq"] == [None] * 20


@pytest.mark.parametrize("n", [0, 1, 7, 999, 1000, 5000])
def test_fixed_size_sample(spark, n):
    df = spark.range(1000).withColumnRenamed("id", "tx_id").repartition(4)
    got = {r["tx_id"] for r in sampling.fixed_size_sample(df, "tx_id", n).collect()}
    assert got == set(sorted(range(1000), key=lambda i: (draw(i, "foreground"), i))[:n])


def test_ids_past_the_modulus(spark):
    ids = [i + (k << 33) for i in range(50) for k in range(20)] + [2**62 + 5, -3]
    df = spark.createDataFrame([(i,) for i in ids], "tx_id long")
    got = {r["tx_id"] for r in sampling.fixed_size_sample(df, "tx_id", 333).collect()}
    assert got == set(sorted(ids, key=lambda i: (draw(i, "foreground"), i))[:333])


def test_stratified_split_sizes(spark):
    df = spark.range(1037).select(F.col("id").alias("tx_id"), (F.col("id") % 9 == 0).cast("int").alias("label"))
    counts = {(r["label"], r["part"]): r["count"] for r in sampling.stratified_split(df, "tx_id").groupBy("label", "part").count().collect()}
    n1 = sum(i % 9 == 0 for i in range(1037))
    n0 = 1037 - n1
    assert counts == {
        (0, "train"): int(0.8 * n0), (0, "valid"): n0 - int(0.8 * n0),
        (1, "train"): int(0.8 * n1), (1, "valid"): n1 - int(0.8 * n1),
    }


def test_numbering_is_dense(spark):
    df = spark.range(500).withColumnRenamed("id", "tx_id").repartition(3)
    got = {r["index"]: r["tx_id"] for r in rk.numbered(df, "tx_id", "minority").collect()}
    assert got == dict(enumerate(sorted(range(500), key=lambda i: (draw(i, "minority"), i))))


def labels(spark, n0, n1):
    return spark.range(n0 + n1).select(F.col("id").alias("tx_id"), (F.col("id") < n1).cast("int").alias("label"))


@pytest.mark.parametrize(
    "n0, n1, ratio, added", [(1000, 10, 0.1, 90), (10, 1000, 0.25, 240), (100, 100, 0.5, 0), (50, 0, 0.5, 0), (0, 50, 0.5, 0)]
)
def test_oversample_sizes(spark, n0, n1, ratio, added):
    out = sampling.oversample_minority(labels(spark, n0, n1), "tx_id", ratio)
    copies = out.where("copy = 1")
    assert out.count() == n0 + n1 + added
    assert copies.where(F.col("label") == (1 if n0 >= n1 else 0)).count() == added


def test_oversample_repeats_rows(spark):
    copies = sampling.oversample_minority(labels(spark, 2000, 20), "tx_id", 0.2).where("copy = 1")
    counts = [r["count"] for r in copies.groupBy("tx_id").count().collect()]
    assert sum(counts) == 380 and max(counts) > 19 > min(counts)


def test_splits_are_disjoint_complete_and_stable(spark):
    df = spark.range(20000).withColumnRenamed("id", "tx_id")
    first = {r["tx_id"]: r["split"] for r in sampling.three_way_split(df, "tx_id").collect()}
    second = {r["tx_id"]: r["split"] for r in sampling.three_way_split(df.repartition(7), "tx_id").collect()}
    assert first == second and len(first) == 20000
    share = {s: sum(v == s for v in first.values()) / 20000 for s in ("train", "valid", "test")}
    assert share == pytest.approx({"train": 0.7, "valid": 0.15, "test": 0.15}, abs=0.01)


def test_many_classes_are_split_like_few(spark):
    df = spark.range(3000).select(F.col("id").alias("tx_id"), (F.col("id") % 1500).alias("label"))
    parts = sampling.stratified_split(df, "tx_id", train=0.5).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"train": 1500, "valid": 1500}


def test_null_class_is_a_class(spark):
    rows = [(i, None if i % 11 == 0 else int(i % 4 == 0)) for i in range(2000)]
    df = spark.createDataFrame(rows, "tx_id long, label int")
    found = sampling.stratified_split(df, "tx_id").groupBy("label", "part").count().collect()
    sizes = {label: sum(1 for _, x in rows if x == label) for label in (None, 0, 1)}
    assert {(r["label"], r["part"]): r["count"] for r in found if r["part"] == "train"} == {
        (label, "train"): int(n * 0.8) for label, n in sizes.items()
    }
    assert sum(r["count"] for r in found) == 2000


def test_null_segments_and_scores_follow_one_rule(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.2), (None, 1, 0.7), (None, 0, 0.6), (None, 1, None)]
    df = spark.createDataFrame(rows, "seg string, label int, score double")
    table = {r["seg"]: r for r in evaluation.evaluate_models(df, ["seg"]).collect()}
    matrix = {r["seg"]: r for r in evaluation.confusion(df, by=["seg"]).collect()}
    sweep = {r["seg"]: r for r in evaluation.threshold_sweep(df, [0.5], by=["seg"]).collect()}
    assert set(table) == set(matrix) == set(sweep) == {"a", None}
    for seg in table:
        cells = [[t[seg][c] for c in ("tp", "fp", "tn", "fn")] for t in (table, matrix, sweep)]
        assert cells[0] == cells[1] == cells[2]
    assert [matrix[None][c] for c in ("tp", "fp", "tn", "fn")] == [1, 1, 0, 1]
    assert evaluation.threshold_sweep(df, [0.0]).first()["fn"] == 0  # a missing score is 0


def test_sorted_numbers_of_many_values(spark):
    values = spark.range(5000).select(F.format_string("k%05d", (F.col("id") * 7919) % 5000).alias("v"))
    found = rk.sorted_numbers(values.repartition(13)).collect()
    assert sorted((r["v"], r["number"]) for r in found) == [(f"k{i:05d}", i) for i in range(5000)]
    assert rk.sorted_numbers(values.where("v is null")).count() == 0

