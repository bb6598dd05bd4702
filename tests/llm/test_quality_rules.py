import numpy as np
from samples import ODD_TEXTS
from pyspark.sql import functions as F

from riskframe.llm import quality_rules, queries

TREE = """RandomForestClassificationTree: uid=x, depth=2, numNodes=5
  If (feature 0 <= 0.5)
   Predict: 0.0
  Else (feature 0 > 0.5)
   If (feature 0 <= 2.5)
    Predict: 1.0
   Else (feature 0 > 2.5)
    Predict: 0.0
"""


def test_paths_become_rules():
    rules = set(quality_rules.tree_rules(TREE, ("x",)))
    inf = float("inf")
    assert rules == {
        quality_rules.Rule((("x", -inf, 0.5),)),
        quality_rules.Rule((("x", 0.5, inf),)),
        quality_rules.Rule((("x", 0.5, 2.5),)),
        quality_rules.Rule((("x", 2.5, inf),)),
    }


def test_compiled_rules_score_like_the_rules(spark):
    model = quality_rules.RuleModel(
        0.25,
        ((quality_rules.Rule((("bars", 0.1, 0.5),)), -2.0), (quality_rules.Rule((("bars", 0.3, float("inf")),)), 1.5)),
    )
    rows = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.4, 0.9)], "bars double")
    got = [r[0] for r in rows.select(F.struct("bars").alias("statistics")).select(model.score()).collect()]
    z = np.array([0.25, -1.75, -0.25, 1.75])
    assert np.allclose(got, 1 / (1 + np.exp(-z)))


def test_held_out_fold(spark):
    from zlib import crc32

    rows = spark.range(500).select(F.col("id").alias("doc_id")).withColumn("held", quality_rules.held_out()).collect()
    assert all(r.held == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_held_out_accuracy(spark, sf_small):
    scored = queries.QUERIES["op1_quality_rules"](spark, sf_small)
    assert scored.count() == 1000
    labels = spark.read.parquet(f"{sf_small}/labels.parquet").select("doc_id", "quality")
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored.collect())


def test_without_usable_labels(spark, make_docs):
    docs = make_docs(ODD_TEXTS)
    for labels in ([], [(4, 1), (6, 1)], [(4, None), (None, 1), (9, 7)]):
        model = quality_rules.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        scored = quality_rules.score_documents(docs, model)
        assert scored.columns == [c for c in docs.columns if c != "score"] + ["score"]
        rows = scored.collect()
        assert len(rows) == len(ODD_TEXTS) and all(0 < r.score < 1 for r in rows)


def test_statistics_of_odd_texts():
    for text in ("", " \n", "a", "x" * 10_000, "\x00", "é é"):
        values = quality_rules.text_statistics(text)
        assert len(values) == len(quality_rules.STATISTICS) and np.isfinite(values).all()
