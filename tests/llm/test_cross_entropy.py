import math
from collections import Counter

import numpy as np
from samples import ODD_TEXTS

from riskframe.llm import cross_entropy as ce
from riskframe.llm import queries


def plain_scores(docs, targets):
    """The same models with dictionaries, token by token."""

    def grams(text):
        raw = b"\0\0" + (text or "").encode("utf-8", "replace") + b"\0"
        return [raw[i : i + 3] for i in range(len(raw) - 2)]

    every = Counter(g for _, t in docs for g in grams(t))
    target = Counter(g for d, t in docs if d in targets for g in grams(t))
    scale = sum(target.values()) / sum(every.values())

    def model(counts, scale):
        tri = {g: n * scale for g, n in counts.items()}
        ctx2, bi, ctx1, uni = Counter(), Counter(), Counter(), Counter()
        for g, n in tri.items():
            ctx2[g[:2]] += n
            bi[g[1:]] += n
            ctx1[g[1:2]] += n
            uni[g[2:]] += n
        total = sum(uni.values())

        def loss(g):
            p = (uni[g[2:]] + 1) / (total + 256)
            p = (bi[g[1:]] + ce.SMOOTHING * p) / (ctx1[g[1:2]] + ce.SMOOTHING)
            return -math.log((tri.get(g, 0) + ce.SMOOTHING * p) / (ctx2[g[:2]] + ce.SMOOTHING))

        return loss

    t, b = model(target, 1.0), model(every, scale)
    return [(d, len(grams(x)), np.mean([t(g) for g in grams(x)]), np.mean([b(g) for g in grams(x)])) for d, x in docs]


def compare(spark, make_docs, docs, targets):
    ids = spark.createDataFrame([(t,) for t in targets], "doc_id long")
    got = ce.score(make_docs(docs), ids).collect()
    expected = plain_scores(docs, set(targets) - {None})
    got = sorted(((str(r.doc_id), r.n_tokens, r.target_loss, r.background_loss, r.difference) for r in got))
    expected = sorted((str(d), n, t, b, t - b) for d, n, t, b in expected)
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert np.allclose([g[2:] for g in got], [e[2:] for e in expected], atol=2e-5)


def test_same_as_dictionaries(spark, make_docs, monkeypatch):
    monkeypatch.setattr(ce, "MERGE_AT", 50)
    docs = [(i, f"the cat {i} sat on the mat" * (i % 4 + 1)) for i in range(30)] + [(99, "überall ß")]
    compare(spark, make_docs, docs, [1, 5, 5, 99, None, 1234])


def test_odd_rows(spark, make_docs):
    compare(spark, make_docs, [r for r in ODD_TEXTS if len(r[1] or "") < 1000], [4, 8])
    compare(spark, make_docs, [(1, None), (2, "a")], [])
    assert len(ce.score(make_docs(ODD_TEXTS), spark.createDataFrame([(4,)], "doc_id long")).collect()) == len(ODD_TEXTS)


def test_empty_table(spark, make_docs):
    assert ce.score(make_docs([]), spark.createDataFrame([(4,)], "doc_id long")).count() == 0


def test_separates_quality(spark, sf_small):
    scored = queries.QUERIES["op4_cross_entropy"](spark, sf_small)
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    rows = scored.join(labels, "doc_id").select("difference", "quality").collect()
    good = [r.difference for r in rows if r.quality == 1]
    bad = [r.difference for r in rows if r.quality == 0]
    assert np.mean([g < b for g in good for b in bad]) > 0.8
