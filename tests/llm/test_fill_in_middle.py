import random
import re
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from samples import ODD_TEXTS

from riskframe.llm import fill_in_middle as fim
from riskframe.llm.fill_in_middle import PieceTable

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
MARKED = [(20, "before <P> after"), (21, "<S>"), (22, "a<M>"), (23, "< P> <p> fine　here\x1c "), (2**62, " \tlead and tail \n ")]


def plain_transform(doc_id, text, fim_percent, spm_percent):
    """Strings put together directly, from the contract's words."""
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    n = len(units)
    digest = sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim_percent:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm_percent:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("fim_percent, spm_percent", [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_whole_texts(make_docs, fim_percent, spm_percent):
    docs = ODD_TEXTS + MARKED
    found = fim.fill_in_middle(make_docs(docs), fim_percent=fim_percent, spm_percent=spm_percent)
    back = fim.restored_text(F.col("output"), F.col("form")).alias("back")
    rows = found.select("*", back).collect()
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows]
    assert sorted(got, key=str) == sorted((plain_transform(*d, fim_percent, spm_percent) for d in docs), key=str)
    texts = {d: t or "" for d, t in docs}
    for r in rows:
        assert r.back == texts[r.doc_id]
        assert r.output_sha256 == sha256(r.output.encode()).hexdigest()
        assert r.restored_sha256 == sha256(texts[r.doc_id].encode()).hexdigest()


def test_many_ids_take_every_form(make_docs):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["é", "word", "x\n", "\U0001f600"]) for _ in range(rng.randint(0, 9)))) for i in range(600)]
    found = fim.fill_in_middle(make_docs(docs)).collect()
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found]
    assert sorted(got) == sorted(plain_transform(*d, 50, 80) for d in docs)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_empty_table(make_docs):
    assert fim.fill_in_middle(make_docs([])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.data())
def test_cuts_and_permutations(text, data):
    table = PieceTable.of(text)
    offsets = sorted(data.draw(st.lists(st.integers(0, len(text)), max_size=6)))
    cut = table.cut(*offsets)
    assert len(cut.pieces) == len(offsets) + 1 and cut.text() == text
    order = tuple(data.draw(st.permutations(range(len(cut.pieces)))))
    moved = cut.arranged(order)
    bounds = [0, *offsets, len(text)]
    assert moved.text() == b"".join(text[bounds[i] : bounds[i + 1]] for i in order)
    assert moved.sha256() == sha256(moved.text()).hexdigest()
    assert moved.arranged(fim.inverse(order)) == cut


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \t\nab<PSM>é\U0001f600", max_size=30), st.sampled_from(["psm", "spm"]), st.data())
def test_restored_from_the_output_alone(text, form, data):
    raw = text.encode()
    if any(s in raw for s in (fim.PREFIX, fim.SUFFIX, fim.MIDDLE)):
        return
    ends = [0, *fim.unit_ends(raw)]
    assert [raw[a:b].decode() for a, b in zip(ends, ends[1:])] == UNIT.findall(text)
    cuts = sorted(data.draw(st.lists(st.sampled_from(ends), min_size=2, max_size=2)))
    output = fim.arrange(PieceTable.of(raw).cut(*map(int, cuts)), form).text()
    assert fim.restore(output, form).text() == raw
