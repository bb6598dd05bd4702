import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from samples import ODD_TEXTS
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskframe.llm import best_fit, queries

PATH = public_tokenizers.path(queries.TOKENIZER)


def plain_best_fit(lengths, capacity):
    """Remaining capacities after placing one piece at a time."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= length
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


def unrolled(counts, capacity):
    bins, places = {}, best_fit.pack_counts(counts, capacity)
    for p in places:
        starts = [q.rank for q in places if q.length == p.length and q.rank > p.rank]
        for rank in range(p.rank, min(starts, default=counts[p.length])):
            step = rank - p.rank
            bins.setdefault(p.first_bin + step // p.each, []).append((p.offset + step % p.each * p.length, p.length))
    return bins


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.data())
def test_counts_pack_like_one_at_a_time(capacity, data):
    lengths = data.draw(st.lists(st.integers(1, capacity), max_size=60))
    counts = {n: lengths.count(n) for n in set(lengths)}
    bins = unrolled(counts, capacity)
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    rooms = sorted(capacity - sum(n for _, n in placed) for placed in bins.values())
    assert rooms == plain_best_fit(lengths, capacity)


def test_too_long_a_piece_is_refused():
    with pytest.raises(ValueError):
        best_fit.pack_counts({9: 1}, 8)


def test_pack_whole_table(spark, monkeypatch):
    monkeypatch.setattr(best_fit, "ROWS_PER_SLICE", 100)  # many slices, one hot length
    rng = random.Random(4)
    rows = [(i, 0, rng.choice([2048, 2048, 7, rng.randint(1, 2048)])) for i in range(3_000)] + [(5, 0, 7), (5, 0, 7), (None, 0, 7)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    placed = best_fit.pack(pieces, ["doc_id", "piece"]).collect()
    assert sorted((str(r.doc_id), r.length) for r in placed) == sorted((str(d), n) for d, _, n in rows)
    bins = {}
    for r in placed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in bins.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(2048 - sum(n for _, n in b) for b in bins.values()) == plain_best_fit([n for _, _, n in rows], 2048)
    empty = spark.createDataFrame([], "doc_id long, piece int, length long")
    assert best_fit.pack(empty, ["doc_id", "piece"]).count() == 0


def expected_ids(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, docs):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, {}).setdefault(r.piece, []).append(r)
    for doc_id, text in docs:
        ids = expected_ids(text)
        pieces = by_doc[doc_id]
        assert sorted(pieces) == list(range(-(-len(ids) // 2048)))
        for i, same in pieces.items():
            own = ids[i * 2048 : (i + 1) * 2048]
            for r in same:
                assert (r.start, r.length) == (i * 2048, len(own))
                assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())


def test_ids_of_odd_texts(make_docs):
    odd = ODD_TEXTS + [(20, "<|endoftext|> it's wide space\x0bé é ΑΣ ΣΑΣ. don't 12 3"), (21, "a\r\nb\tc")]
    check(queries.packed_pieces(make_docs(odd), PATH).collect(), odd)


def test_ids_of_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(queries.QUERIES["op8_best_fit"](spark, sf_dir).collect(), docs)


def test_sequences_hold_the_ids(make_docs):
    docs = make_docs([(1, "a b c"), (2, "d e"), (3, "")])
    from riskframe.llm.tables import written

    pieces = written(best_fit.tokenized(docs, open(PATH, encoding="utf-8").read(), capacity=8))
    rows = best_fit.sequences(best_fit.pack(pieces, ["doc_id", "piece"], capacity=8)).collect()
    assert len(rows) == 1
    assert sorted(np.frombuffer(rows[0].ids, "<u4")) == sorted(expected_ids("a b c") + expected_ids("d e") + [0])
