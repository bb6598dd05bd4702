"""Greedy word-piece counts in linear time, without building the pieces.

The vocabulary is a trie with two roots, one for pieces that begin a word and one
for pieces that continue it.  Where a match cannot go on, a failure link leads to
the node for the longest rest that could still be a piece, and the number of pieces
popped on the way is known beforehand; so a word is read once, left to right, and
its count is the sum of the pops.

A vocabulary with byte pieces covers every text: a character at which no piece fits is
as many pieces as it has UTF-8 bytes, and the word goes on behind it.  To the automaton
that character is a piece which pops several at once.
"""

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_MARK = "▁"
UNKNOWN = -1
MAX_CACHED_WORDS, LONGEST_CACHED = 300_000, 64


class PieceAutomaton:
    """Counts the pieces of longest-match-first segmentation.

    Without ``byte_pieces`` a word that cannot be segmented gives UNKNOWN.
    """

    def __init__(self, starts: Iterable[str], continuations: Iterable[str], byte_pieces: bool = False):
        self.step: dict[tuple[int, str], int] = {}
        self.fail: list[int | None] = [None, None]  # nodes 0 and 1 are the roots
        self.pops: list[int] = [0, 0]
        self.byte_pieces = byte_pieces
        self.in_bytes: set[int] = set()  # nodes on whose way to a root a character is segmented into bytes
        ends, children = {}, {0: [], 1: []}
        for root, pieces in ((0, starts), (1, continuations)):
            for piece in pieces:
                node = root
                for c in piece:
                    if (node, c) not in self.step:
                        self.step[node, c] = len(self.fail)
                        children[node].append((c, len(self.fail)))
                        children[len(self.fail)] = []
                        self.fail.append(None)
                        self.pops.append(0)
                    node = self.step[node, c]
                if node > 1:
                    ends[node] = 1
        if byte_pieces:  # what begins a piece, or the rest of one, and is none itself
            letters = sorted({c for _, c in self.step})
            for root in (0, 1):
                for c in letters:
                    if (root, c) not in self.step:
                        self.step[root, c] = len(self.fail)
                        children[root].append((c, len(self.fail)))
                        children[len(self.fail)] = []
                        self.fail.append(None)
                        self.pops.append(0)
                    node = self.step[root, c]
                    if node not in ends:
                        ends[node] = len(c.encode("utf-8", "replace"))
                        self.in_bytes.add(node)
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for c, node in children[parent]:
                queue.append(node)
                if node in ends:
                    self.fail[node], self.pops[node] = 1, ends[node]
                    continue
                back, popped, in_bytes = self.fail[parent], self.pops[parent], parent in self.in_bytes
                while back is not None and (back, c) not in self.step:
                    popped += self.pops[back]
                    in_bytes |= back in self.in_bytes
                    back = self.fail[back]
                if back is not None:
                    self.fail[node], self.pops[node] = self.step[back, c], popped
                    if in_bytes:
                        self.in_bytes.add(node)

    def count(self, word: str) -> int:
        """The number of pieces, below 0 where a character is segmented into bytes; or UNKNOWN."""
        step, fail, pops, in_bytes = self.step, self.fail, self.pops, self.in_bytes
        node, n, uncovered = 0, 0, False
        for c in word:
            while (node, c) not in step:
                if fail[node] is None:
                    if not self.byte_pieces:
                        return UNKNOWN
                    n += len(c.encode("utf-8", "replace"))  # a character that no piece holds
                    node, uncovered = 1, True
                    break
                n += pops[node]
                uncovered |= node in in_bytes
                node = fail[node]
            else:
                node = step[node, c]
        while node > 1:
            if fail[node] is None:
                return UNKNOWN
            n += pops[node]
            uncovered |= node in in_bytes
            node = fail[node]
        return -n if uncovered else n


def word_pieces(model_file: str) -> tuple[set[str], set[str]]:
    """Pieces that begin a word and pieces that continue one, from a piece vocabulary with word marks.

    A piece with the mark begins a word, one without continues it, and a single
    character may do either.  Control, unknown and byte entries are left out.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = [model.id_to_piece(i) for i in ids]
    starts = {p[1:] for p in pieces if p.startswith(WORD_MARK)}
    continuations = {p for p in pieces if WORD_MARK not in p}
    return {p for p in starts if p and WORD_MARK not in p} | {p for p in continuations if len(p) == 1}, continuations


class WordCounts(dict):
    """Counts of the words a task has seen; emptied when full."""

    def __init__(self, automaton: PieceAutomaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        value = self.automaton.count(word.decode("utf-8", "replace"))
        if len(word) <= LONGEST_CACHED:
            if len(self) >= MAX_CACHED_WORDS:
                self.clear()
            self[word] = value
        return value


def piece_counts(spark: SparkSession, text: str, automaton: PieceAutomaton) -> Column:
    """Struct (n_words, n_tokens, n_unknown) of whole texts.

    ``n_unknown`` words hold a character that no piece covers: one token each without
    byte pieces, else with that character's bytes as tokens.
    """
    shared = spark.sparkContext.broadcast(automaton)  # as large as the vocabulary, whatever the corpus

    @F.pandas_udf("n_words long, n_tokens long, n_unknown long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = WordCounts(shared.value)
        for part in texts:
            rows = []
            for text in part:
                counts = list(map(known.__getitem__, text.encode("utf-8", "replace").split()))
                rows.append((len(counts), sum(map(abs, counts)), sum(n < 0 for n in counts)))
            yield pd.DataFrame(rows, columns=["n_words", "n_tokens", "n_unknown"])

    return of(F.coalesce(F.col(text), F.lit("")))


def count_pieces(docs: DataFrame, automaton: PieceAutomaton) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) for every row of ``docs`` (doc_id, text).

    Words are runs of characters other than ASCII white space.  A null or empty text
    has no tokens; a null id is carried through; equal rows give equal counts.
    """
    counted = piece_counts(docs.sparkSession, "text", automaton).alias("c")
    return docs.select("doc_id", counted).select("doc_id", "c.*")
