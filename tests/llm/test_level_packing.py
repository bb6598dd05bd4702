import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import ODD_TEXTS
from tokenizers import Tokenizer

from riskframe.llm import best_fit, level_packing, queries
from riskframe.llm.level_packing import Item, SquaresPacker

PATH = public_tokenizers.path(queries.TOKENIZER)
TOKENS = Tokenizer.from_file(PATH)


def item(number, length):
    return Item(number, 0, length, np.arange(length, dtype="<u4").tobytes())


def squares(levels, capacity):
    """The sum of squared counts of partially filled windows."""
    return sum(levels.count(h) ** 2 for h in set(levels) if h < capacity and bin(h).count("1") > 1)


def plain_levels(lengths, capacity):
    """Levels after placing one document at a time, each choice tried in full."""
    levels = []
    for s in lengths:
        choices = []
        for h in {0, *levels}:
            if h + s <= capacity:
                after = list(levels)
                if h:
                    after.remove(h)
                after.append(h + s)
                choices.append((squares(after, capacity), -h, after))
        levels = [h for h in min(choices)[2] if h < capacity]
    return sorted(levels)


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 24), st.data())
def test_places_where_the_squares_are_least(capacity, data):
    lengths = data.draw(st.lists(st.integers(1, capacity), max_size=50))
    packer = SquaresPacker(lambda window: None, capacity, max_open=1_000)
    for i, n in enumerate(lengths):
        packer.place(item(i, n))
    levels = sorted(h for h, same in enumerate(packer.open) for _ in same)
    assert levels == plain_levels(lengths, capacity)


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 24), st.integers(1, 6), st.data())
def test_every_token_once_and_no_padding(capacity, max_open, data):
    lengths = data.draw(st.lists(st.integers(1, 3 * capacity), max_size=40))
    done = []
    packer = SquaresPacker(done.append, capacity, max_open)
    for i, n in enumerate(lengths):
        packer.place(item(i, n))
        assert packer.n_open <= max_open
        assert packer.n_open == sum(map(len, packer.open))
    packer.laid_out()
    pieces = {}
    for window in done:
        at = 0
        for piece, offset in window.items:
            assert offset == at
            at += piece.length
            pieces.setdefault(piece.doc_id, []).append((piece.start, piece.ids))
        assert at == window.level and (at == capacity or at & (at - 1) == 0)
    for i, n in enumerate(lengths):
        assert b"".join(ids for _, ids in sorted(pieces.pop(i))) == item(i, n).ids
    assert not pieces
    assert len({window.number for window in done}) == len(done)


def test_few_documents_are_cut():
    rng = random.Random(2)
    done = []
    packer = SquaresPacker(done.append)
    for i in range(5_000):
        packer.place(item(i, rng.randint(1, 2_000)))
    rest = list(packer.rest())
    assert sum(len(w.items) for w in done) + len(rest) == 5_000  # none is cut
    assert sum(p.length for p in rest) < 0.7 * sum(p.length for w in done for p, _ in w.items)
    packer.laid_out()
    assert sum(len(w.items) for w in done) < 5_000 * 1.1


def expected_ids(text):
    return [*TOKENS.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, docs, capacity=4096, packers=None):
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in windows.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at == capacity or at & (at - 1) == 0
    total = sum(r.length for r in rows)
    assert total == sum(len(expected_ids(t)) for _, t in docs)
    assert sum(1 for w in windows.values() if sum(n for _, n in w) < capacity) <= capacity.bit_length()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    copies = {}
    for doc_id, text in docs:
        copies.setdefault(doc_id, []).append(text)
    for doc_id, texts in copies.items():
        ids = expected_ids(texts[0])
        covered = np.zeros(len(ids), int)
        for r in by_doc[doc_id]:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
            covered[r.start : r.start + r.length] += 1
        assert (covered == len(texts)).all()
    assert set(by_doc) == set(copies)


@pytest.mark.parametrize("capacity, max_open, parts", [(4096, 128, 3), (64, 2, 40), (2, 1, 5)])
def test_odd_texts(make_docs, monkeypatch, capacity, max_open, parts):
    monkeypatch.setattr(level_packing, "FAN_IN", 3)  # several levels of packers
    docs = ODD_TEXTS if capacity > 2 else [d for d in ODD_TEXTS if len(d[1] or "") < 100]
    with open(PATH, encoding="utf-8") as file:
        packed = level_packing.pack(make_docs(docs).repartition(parts), file.read(), 2, capacity, max_open)
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check(packed.collect(), docs, capacity)


def test_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(queries.QUERIES["op13_level_packing"](spark, sf_dir).collect(), docs)


def test_empty_table_and_stored_sequences(make_docs):
    with open(PATH, encoding="utf-8") as file:
        tokenizer = file.read()
    assert level_packing.pack(make_docs([]), tokenizer).count() == 0
    docs = [(1, "a b c"), (2, "d e"), (3, "")]
    rows = best_fit.sequences(level_packing.pack(make_docs(docs), tokenizer, capacity=8, keep_ids=True)).collect()
    got = sorted(i for r in rows for i in np.frombuffer(r.ids, "<u4"))
    assert got == sorted(i for _, t in docs for i in expected_ids(t))
