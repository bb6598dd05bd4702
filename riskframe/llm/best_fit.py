"""Best-fit decreasing packing of token pieces into sequences of a fixed capacity.

A packing depends on the lengths alone, and there are at most ``capacity`` of them.
So the rows are counted per length, the counts are packed, and each row then finds
its place from its rank among the rows of its length.  The packing itself is exact
best-fit decreasing: for each piece, longest first, a segment tree over remaining
capacities names the tightest open bin; equal pieces and equal bins are handled as
one run, so its work and its result are bounded by the capacity, whatever the
number of documents.
"""

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.tables import written

CAPACITY = 2048
ROWS_PER_SLICE = 50_000


class OpenBins:
    """Runs of bins by remaining capacity, under a segment tree of which capacities occur."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any_open = [False] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _refresh(self, room: int) -> None:
        node = room + self.leaves
        self.any_open[node] = bool(self.runs[room])
        while node > 1:
            node //= 2
            self.any_open[node] = self.any_open[2 * node] or self.any_open[2 * node + 1]

    def push(self, room: int, first: int, n: int) -> None:
        if room and n:
            self.runs[room].append((first, n))
            self._refresh(room)

    def pop(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        self._refresh(room)
        return run

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` that an open bin has."""
        node = length + self.leaves
        if self.any_open[node]:
            return length
        while node > 1 and (node % 2 or not self.any_open[node + 1]):
            node //= 2
        if node <= 1:
            return None
        node += 1
        while node < self.leaves:
            node = 2 * node if self.any_open[2 * node] else 2 * node + 1
        return node - self.leaves


@dataclass(frozen=True)
class Place:
    """The pieces of ``length`` with ranks from ``rank`` on: ``each`` per bin from ``first_bin``."""

    length: int
    rank: int
    first_bin: int
    each: int
    offset: int


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[Place]:
    """Best-fit decreasing of ``counts[length]`` pieces of each length.

    The tightest bin that takes a piece stays the tightest for equal pieces until
    none fits, so a bin with room r takes r // length of them before the next bin.
    """
    bins, places, new_bin = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit a capacity of {capacity}")
        rank, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                room, first, n = capacity, new_bin, -(-left // (capacity // length))
                new_bin += n
            else:
                first, n = bins.pop(room)
            each = room // length
            full = min(n, left // each)
            used = full
            if full:
                places.append(Place(length, rank, first, each, capacity - room))
                bins.push(room - each * length, first, full)
            rank, left = rank + full * each, left - full * each
            if left and used < n:  # the last bin of this length takes what is left
                places.append(Place(length, rank, first + used, each, capacity - room))
                bins.push(room - left * length, first + used, 1)
                used, left = used + 1, 0
            bins.push(room, first + used, n - used)
    return places


def with_places(ranked: DataFrame, places: list[Place]) -> DataFrame:
    """``ranked`` (length, rank, any others) with ``sequence_id`` and ``offset``."""
    table = np.array(
        [(p.length, p.rank, p.first_bin, p.each, p.offset) for p in sorted(places, key=lambda p: (p.length, p.rank))],
        np.int64,
    ).reshape(-1, 5)
    shared = ranked.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks, bins, each, offsets = shared.value.T
        length, rank = length.to_numpy(), rank.to_numpy()
        at, low = np.zeros(len(length), np.int64), np.searchsorted(lengths, length, "left")
        high = np.searchsorted(lengths, length, "right")
        while (low < high).any():  # the last place of this length that starts at or before the rank
            middle = (low + high) // 2
            inside = low < high
            ok = inside & (ranks[np.minimum(middle, len(ranks) - 1)] <= rank)
            at = np.where(ok, middle, at)
            low, high = np.where(ok, middle + 1, low), np.where(inside & ~ok, middle, high)
        step = rank - ranks[at]
        return pd.DataFrame(
            {"sequence_id": bins[at] + step // each[at], "offset": offsets[at] + step % each[at] * length}
        )

    return ranked.select("*", place("length", "rank").alias("p")).select(*ranked.columns, "p.*")


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (length, any others) with ``sequence_id`` and ``offset``.

    ``order`` names columns that rank the pieces of one length; pieces equal in them
    are interchangeable.  Ranks come from counts per (length, slice) and a sort
    inside one slice of about ROWS_PER_SLICE rows, so a length that a third of all
    pieces share still spreads over the tasks.  The counts per length, at most
    ``capacity`` rows, are the only thing that passes the driver.  No pieces give no
    rows.  ``pieces`` is read several times: pass a written table.
    """
    slices = max(1, -(-pieces.count() // ROWS_PER_SLICE))
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    counts = sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    places = pack_counts({r["length"]: r["n"] for r in totals}, capacity)
    within = Window.partitionBy("length", "slice").orderBy(*order)
    ranked = sliced.withColumn("row", F.row_number().over(within)).join(counts.drop("n"), ["length", "slice"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("row") - 1)
    return with_places(ranked, places).select(*pieces.columns, "sequence_id", "offset")


def byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds(dict):
    """Token ids, as bytes, of the words a worker has seen; emptied when full.

    Most words are Latin letters with ASCII punctuation behind them.  A tokenizer that
    lower-cases and splits letters from punctuation gives such a word the ids of its
    two parts, so each part is encoded once, whatever stands beside it, and a run of
    letters goes straight to the tokenizer's own BPE model in its byte characters.
    All other words, and other kinds of tokenizers, take the whole encoder.
    """

    LIMIT, LONGEST = 300_000, 64
    PARTS = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:-@\[-`{-~]*)\Z")  # no apostrophe: it joins letters

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        described = json.loads(tokenizer_json)
        steps = [json.dumps(described.get(k)) for k in ("normalizer", "pre_tokenizer")]
        self.by_parts = (
            described["model"]["type"] == "BPE"
            and '"Lowercase"' in steps[0]
            and '"ByteLevel"' in steps[1]
            and "[\\\\p{L}]+" in steps[1]
        )
        self.characters = byte_characters()

    def __missing__(self, word: str) -> bytes:
        found = self.PARTS.match(word) if self.by_parts else None
        if not found:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        elif found[2]:
            return self.keep(word, self[found[1]] + (self[found[2]] if found[2] != word else b""))
        elif (lower := word.lower()) != word:
            return self.keep(word, self[lower])
        else:
            plain = word if word.isascii() else "".join(map(self.characters.__getitem__, word.encode()))
            ids = [token.id for token in self.tokenizer.model.tokenize(plain)]
        return self.keep(word, np.array(ids, "<u4").tobytes())

    def keep(self, word: str, value: bytes) -> bytes:
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = value
        return value


@lru_cache(maxsize=1)
def known_words(tokenizer_json: str) -> WordIds:
    """One table per worker process, which serves many tasks."""
    return WordIds(tokenizer_json)


def token_pieces(text: Column, tokenizer_json: str, end_id: int = 0, capacity: int = CAPACITY) -> Column:
    """Array of (piece, start, ids) of whole texts; ids are little-endian unsigned 32-bit.

    The tokenizer must drop white space, as word-level vocabularies do: a text's ids
    are then those of its words in turn, and a worker encodes each word once.
    ``end_id`` ends every document; a null or empty text is that id alone.
    """

    @F.pandas_udf("array<struct<piece: int, start: long, ids: binary>>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, end = known_words(tokenizer_json), np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for part in texts:
            out = []
            for text in part:
                words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
                ids = b"".join(map(known.__getitem__, words)) + end
                out.append([(i, i * capacity, ids[i * step : (i + 1) * step]) for i in range(-(-len(ids) // step))])
            yield pd.Series(out)

    return of(F.coalesce(text, F.lit("")))


def tokenized(docs: DataFrame, tokenizer_json: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids) per piece of every row of ``docs``.

    A document is cut only if it is longer than the capacity; repeated rows give
    repeated pieces.
    """
    pieces = docs.select("doc_id", F.explode(token_pieces(F.col("text"), tokenizer_json, end_id, capacity)).alias("p"))
    length = (F.octet_length("p.ids") / 4).cast("long")
    return pieces.select("doc_id", "p.piece", "p.start", length.alias("length"), "p.ids")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces that still carry ``ids``: each sequence's tokens in order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), ""))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
