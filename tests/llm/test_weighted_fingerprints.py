import hashlib

import numpy as np
from samples import ODD_TEXTS
from pyspark.sql import functions as F

from riskframe.llm import weighted_fingerprints as wf


def expected_edits(docs):
    """(doc_id, n_chars, sha256 of the edited text, next text), in descending order of id."""
    order = sorted(docs, key=lambda d: -d[0])
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edit = text[: len(text) - half] + following[:half]
        out.append((doc_id, len(text), hashlib.sha256(edit.encode()).hexdigest(), edit, following))
    return out


def check(spark, docs, df):
    got = {r.doc_id: r for r in wf.fingerprints_with_edits(df).collect()}
    assert len(got) == len(docs)
    prints = {}
    expected = expected_edits(docs)
    texts = {t for _, t in docs} | {e[3] for e in expected}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(sorted(t or "" for t in texts))], "i long, text string")
    for r in rows.join(wf.with_fingerprint(rows, ["i"], "text"), "i").collect():
        prints[r.text] = r.fingerprint
    for doc_id, n, sha, edit, following in expected:
        r = got[doc_id]
        text = dict(docs)[doc_id] or ""
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert (r.fingerprint, r.edited_fingerprint) == (prints[text], prints[edit])

        def near(a, b):
            if not a or not b:
                return float(a == b)
            return np.mean([a[i : i + wf.DIGITS] == b[i : i + wf.DIGITS] for i in range(0, len(a), wf.DIGITS)])

        assert r.near_edited == near(prints[text], prints[edit])
        assert r.near_next == near(prints[text], prints[following])


def test_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], df)


def test_odd_rows(spark, make_docs):
    odd = [(i, t) for i, (d, t) in enumerate(ODD_TEXTS)] + [(2**40, "a b \U0001f600\U0001f600 c d"), (-5, "x y")]
    check(spark, odd, make_docs(odd))
    check(spark, [(3, "only one row")], make_docs([(3, "only one row")]))


def test_repeated_null_and_missing_rows(make_docs):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "d"), (None, None)]
    got = wf.fingerprints_with_edits(make_docs(rows)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "1", "None", "None"]
    same = {r.fingerprint for r in got if r.n_chars == 3}
    assert len(same) == 1
    assert wf.fingerprints_with_edits(make_docs([])).count() == 0


def test_collisions_follow_generalised_jaccard(spark):
    """Many hash families stand in for many samples: the mean of near is the similarity of the weights."""
    cases = [
        ({"a": 3, "b": 1, "c": 4}, {"a": 1, "b": 1, "d": 2}),
        ({"a": 10, "b": 10}, {"a": 10, "b": 5}),
        ({"a": 1}, {"a": 9}),
    ]
    for one, two in cases:
        truth = sum(min(one.get(t, 0), two.get(t, 0)) for t in {*one, *two}) / sum(
            max(one.get(t, 0), two.get(t, 0)) for t in {*one, *two}
        )
        rows = []
        for i in range(120):
            rows.append((i, *(" ".join(f"{t}{i}" for t, n in w.items() for _ in range(n)) for w in (one, two))))
        df = spark.createDataFrame(rows, "i long, one string, two string")
        a = wf.with_fingerprint(df, ["i"], "one", "a")
        b = wf.with_fingerprint(df, ["i"], "two", "b")
        mean = a.join(b, "i").select(F.avg(wf.likeness("a", "b"))).first()[0]
        assert abs(mean - truth) < 4 * np.sqrt(truth * (1 - truth) / (120 * wf.SAMPLES))


def test_no_python_in_the_plan(spark, sf_dir):
    df = wf.fingerprints_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_ranges_of_ids(spark):
    bounds = [float(b) for b in range(10, 1000, 7)]
    rows = spark.createDataFrame([(v,) for v in (-3, 9, 10, 11, 500, 5000, None)], "v long")
    for some in (bounds, bounds[:1], bounds[:5], []):
        got = [r[0] for r in rows.select(wf.range_bucket(F.col("v"), some)).collect()]
        assert got == [sum(b <= v for b in some) for v in (-3, 9, 10, 11, 500, 5000)] + [-1]
