import public_tokenizers
import pytest
from samples import ODD_TEXTS
from hypothesis import given, settings
from hypothesis import strategies as st

from riskframe.llm import queries
from riskframe.llm import wordpiece_counts as wp


def greedy(word, starts, continuations):
    n, at, pieces, longest = 0, 0, starts, max(map(len, {*starts, *continuations}), default=0)
    while at < len(word):
        end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return wp.UNKNOWN
        n, at, pieces = n + 1, end, continuations
    return n


@settings(max_examples=500, deadline=None)
@given(
    st.sets(st.text("abc", min_size=1, max_size=5), max_size=12),
    st.sets(st.text("abc", min_size=1, max_size=5), max_size=12),
    st.lists(st.text("abcd", max_size=14), max_size=12),
)
def test_same_as_greedy_search(starts, continuations, words):
    automaton = wp.PieceAutomaton(starts, continuations)
    for word in words:
        assert automaton.count(word) == greedy(word, starts, continuations)


@pytest.fixture(scope="module")
def pieces():
    return wp.word_pieces(public_tokenizers.path(queries.PIECES))


def test_same_as_a_word_piece_tokenizer(spark, sf_small, pieces):
    from tokenizers.models import WordPiece

    starts, continuations = pieces
    vocabulary = ["[UNK]", *sorted(starts), *sorted(f"##{p}" for p in continuations)]
    model = WordPiece({p: i for i, p in enumerate(dict.fromkeys(vocabulary))}, unk_token="[UNK]", max_input_chars_per_word=10**9)
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(200)
    for r in wp.count_pieces(docs, wp.PieceAutomaton(*pieces)).join(docs, "doc_id").collect():
        words = [w.decode() for w in r.text.encode().split()]
        tokens = [[t.value for t in model.tokenize(w)] for w in words]
        assert (r.n_words, r.n_tokens) == (len(words), sum(map(len, tokens)))
        assert r.n_unknown == sum(t == ["[UNK]"] for t in tokens)


def test_odd_rows(make_docs, pieces):
    got = wp.count_pieces(make_docs(ODD_TEXTS), wp.PieceAutomaton(*pieces)).collect()
    assert len(got) == len(ODD_TEXTS)
    by_id = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in got}
    assert by_id[1] == by_id[2] == by_id[3] == (0, 0, 0)
    assert by_id[7] == (40_000, 40_000, 0)
    starts, continuations = pieces
    assert by_id[6] == (1, greedy("x" * 200_000, starts, continuations), 0)
    assert wp.count_pieces(make_docs([]), wp.PieceAutomaton(*pieces)).count() == 0


def test_empty_vocabulary():
    automaton = wp.PieceAutomaton([], [])
    assert automaton.count("") == 0 and automaton.count("a") == wp.UNKNOWN


def greedy_with_bytes(word, starts, continuations):
    """(pieces, whether a character is segmented into bytes)."""
    n, at, pieces, uncovered = 0, 0, starts, False
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            n, at, uncovered = n + len(word[at].encode()), at + 1, True
        else:
            n, at = n + 1, end
        pieces = continuations
    return n, uncovered


@settings(max_examples=500, deadline=None)
@given(
    st.sets(st.text("abé", min_size=1, max_size=5), max_size=10),
    st.sets(st.text("abé", min_size=1, max_size=5), max_size=10),
    st.lists(st.text("abé\u4e2d\U0001f600", max_size=14), max_size=12),
)
def test_byte_pieces_cover_every_word(starts, continuations, words):
    automaton = wp.PieceAutomaton(starts, continuations, byte_pieces=True)
    for word in words:
        n, uncovered = greedy_with_bytes(word, starts, continuations)
        assert automaton.count(word) == (-n if uncovered else n)


def test_an_unspaced_passage_with_a_rare_character(make_docs, pieces):
    starts, continuations = pieces
    common = [c for c in sorted(continuations) if len(c) == 1 and "\u4e00" <= c <= "\u9fff"][:300]
    rare = "\u9fa5"
    assert rare not in continuations
    passage = "".join(common) + rare + "".join(common)
    rows = wp.count_pieces(make_docs([(1, passage)]), wp.PieceAutomaton(*pieces, byte_pieces=True)).collect()
    n, uncovered = greedy_with_bytes(passage, starts, continuations)
    assert uncovered and n > 300
    assert (rows[0].n_words, rows[0].n_tokens, rows[0].n_unknown) == (1, n, 1)
