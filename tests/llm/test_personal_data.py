import re

import numpy as np
import pytest
from samples import ODD_TEXTS
from hypothesis import given, settings
from hypothesis import strategies as st

from riskframe.llm import personal_data as pd_

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and not all(int(p) <= 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                double = [int(d) * 2 for d in digits[-2::-2]]
                total = sum(map(int, digits[-1::-2])) + sum(d // 10 + d % 10 for d in double)
                if not 16 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="aZ9@.-+ 0123()%_é\n", max_size=60))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert pd_.base_spans(text) == plain_spans(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "a@b.c", "+1 (555) 555-1234", "@", " ", "é", "256.1.1.1", "4111-1111-1111-1112"]), max_size=8))
def test_base_spans_of_near_misses(parts):
    text = "".join(parts)
    assert pd_.base_spans(text) == plain_spans(text)


def test_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in pd_.detect(docs).withColumn("shown", pd_.as_text()).collect()}
    assert len(got) == docs.count()
    order = {k: i for i, k in enumerate(pd_.KINDS)}
    for r in docs.collect():
        base = plain_spans(r.text)
        row = got[r.doc_id]
        assert row.base == ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert row.n == [sum(s[0] == k for s in base) for k in pd_.BASE_KINDS]
        shown = [s.split(":") for s in row.shown.split(",") if s]
        assert [(k, int(a), int(b)) for k, a, b in shown if k in pd_.BASE_KINDS] == base
        assert shown == sorted(shown, key=lambda s: (order[s[0]], int(s[1])))


def test_long_runs_stay_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 100_000, "a@" * 100_000, "1 " * 150_000, "0" * 9000 + ".1.1.1"):
        pd_.base_spans(text)
        pd_.wider_spans(text, [])


def test_reliabilities_are_found_without_labels():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.3
    right = np.array([0.95, 0.9, 0.85, 0.6, 0.55, 0.5])
    agree = rng.random((len(truth), 6)) < right
    given_ = np.where(agree == truth[:, None], 1, -1) * (rng.random((len(truth), 6)) < 0.9)
    patterns, counts = np.unique(given_, axis=0, return_counts=True)
    p, vote, prior = pd_.labeler_reliabilities(patterns, counts.astype(float))
    assert abs(prior[1] - 0.3) < 0.05
    strength = vote[1][:, 2] / vote[0][:, 2]
    assert (np.diff(strength[:4]) < 0).all()
    guess = {tuple(row): q for row, q in zip(patterns, p)}
    assert np.mean([(guess[tuple(row)] > 0.5) == t for row, t in zip(given_, truth)]) > 0.93


def test_learned_spans_join_the_base(make_docs):
    good = "please log in with password = a1b2c3d4e5f6 or write to jane.doe@mail.example.com today"
    rows = [(i, good.replace("a1b2", f"a{i}b2")) for i in range(60)] + [(100 + i, f"section 1.2.{i + 10} of the text") for i in range(60)]
    got = pd_.detect(make_docs(rows)).withColumn("shown", pd_.as_text()).collect()
    assert all("email:" in r.shown and "secret:" in r.shown for r in got if r.doc_id < 100)
    assert all(r.shown == "" for r in got if r.doc_id >= 100)


def test_odd_rows_and_empty_table(make_docs):
    got = pd_.detect(make_docs(ODD_TEXTS)).collect()
    assert len(got) == len(ODD_TEXTS) and all(r.base == "" and list(r.spans) == [] for r in got)
    assert pd_.detect(make_docs([])).count() == 0


def test_masks(make_docs):
    docs = make_docs([(1, "mail a.b@c.de or +1 (555) 555-1234."), (2, "clean"), (3, None)])
    found = docs.select("text", pd_.candidates().alias("c")).select("text", "c.*")
    rows = pd_.accepted(found, pd_.SpanModel((-30.0,) + (0.0,) * (len(pd_.KINDS) + pd_.N_FEATURES), ()))
    out = [r.m for r in rows.select(pd_.masked().alias("m")).collect()]
    assert out == ["mail [EMAIL] or [PHONE].", "clean", None]


@pytest.mark.parametrize("token", ["aZ3-" * 1_500, "eyJhbGciOiJIUzI1NiJ9." + "Qx7_" * 150])
def test_long_secrets_are_whole(token):
    text = f"use token={token} for now"
    assert pd_.wider_spans(text, pd_.base_spans(text)) == [("secret", 4, 10 + len(token))]


def test_long_secret_beside_an_address():
    head, tail = "token=" + "aZ3-" * 100, "&x=" + "bY4-" * 100
    text = head + "&mail=jane@example.com" + tail + " end"
    spans = pd_.wider_spans(text, pd_.base_spans(text))
    assert [s[0] for s in spans] == ["secret", "secret"]
    assert spans[0][1] == 0 and spans[0][2] >= len(head) and spans[1][2] == len(text) - 4
    text = "password: jane@example.com"
    assert pd_.wider_spans(text, pd_.base_spans(text)) == []


def test_long_secret_is_masked(make_docs):
    token = "aZ3-" * 1_500
    docs = make_docs([(1, f"use token={token} for now")])
    found = docs.select("text", pd_.candidates().alias("c")).select("text", "c.*")
    rows = pd_.accepted(found, pd_.SpanModel((30.0,) + (0.0,) * (len(pd_.KINDS) + pd_.N_FEATURES), ()))
    assert [r.m for r in rows.select(pd_.masked().alias("m")).collect()] == ["use [SECRET] for now"]
