"""Fill-in-the-middle rearrangement of whole texts with piece tables.

A document becomes a piece table: a list of (buffer, start, length) descriptors over
two buffers that are never changed, the text's own bytes and the three sentinels.
Cutting splits a descriptor in two, an arrangement is a permutation of descriptors
with sentinels between them, and its inverse permutation restores the text.  Only
descriptors move; a digest reads the buffers through them piece by piece, and a text is
copied once, when the result is written out.

A text is cut after whole units: a word with the white space before it, or white space
at the end of the text.  White space is ASCII white space.  Which documents are cut,
where and how follows from a hash of the seed and the document's id alone.

Defined results: a null text is an empty one; an empty text, or one that holds a
sentinel, stays as it is (form ``plain``); a null id draws like an id of its own; equal
rows give equal results; an empty table gives no rows; other columns are not looked at.
Every document is handled in the task that reads it: nothing is shuffled.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sentinels of the output format.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
TEXT_BUFFER, SENTINEL_BUFFER = 0, 1
ROWS_AT_ONCE = 200


@dataclass(frozen=True)
class Piece:
    """``length`` bytes of a buffer from ``start`` on."""

    buffer: int
    start: int
    length: int


@dataclass(frozen=True)
class PieceTable:
    """A text as pieces of two immutable buffers."""

    buffers: tuple[bytes, bytes]
    pieces: tuple[Piece, ...]

    @classmethod
    def of(cls, text: bytes) -> "PieceTable":
        return cls((text, SENTINELS), (Piece(TEXT_BUFFER, 0, len(text)),))

    def cut(self, *offsets: int) -> "PieceTable":
        """The same text with a boundary between pieces at each of the ascending byte ``offsets``.

        Every offset adds one piece, an empty one where there already is a boundary, so
        the number of pieces depends on the number of offsets only.
        """
        pieces, at = list(self.pieces), 0
        i = 0
        for offset in offsets:
            while offset > at + pieces[i].length:
                at += pieces[i].length
                i += 1
            piece, left = pieces[i], offset - at
            pieces[i : i + 1] = [
                Piece(piece.buffer, piece.start, left),
                Piece(piece.buffer, piece.start + left, piece.length - left),
            ]
            at, i = offset, i + 1
        return PieceTable(self.buffers, tuple(pieces))

    def with_sentinels(self, *sentinels: bytes) -> "PieceTable":
        """The sentinels as pieces of their own, behind all others."""
        marks = tuple(Piece(SENTINEL_BUFFER, SENTINELS.index(s), len(s)) for s in sentinels)
        return PieceTable(self.buffers, self.pieces + marks)

    def arranged(self, order: tuple[int, ...]) -> "PieceTable":
        """The pieces in ``order``; :func:`inverse` of the order takes them back."""
        return PieceTable(self.buffers, tuple(self.pieces[i] for i in order))

    def slices(self) -> Iterator[memoryview]:
        views = tuple(map(memoryview, self.buffers))
        for p in self.pieces:
            yield views[p.buffer][p.start : p.start + p.length]

    def sha256(self) -> str:
        """The digest of the text, read through the descriptors without putting it together."""
        digest = sha256()
        for part in self.slices():
            digest.update(part)
        return digest.hexdigest()

    def text(self) -> bytes:
        return b"".join(self.slices())


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    back = [0] * len(order)
    for place, item in enumerate(order):
        back[item] = place
    return tuple(back)


# The pieces are prefix 0, middle 1, suffix 2 and the sentinels <P> 3, <S> 4, <M> 5.
ORDERS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}


def arrange(table: PieceTable, form: str) -> PieceTable:
    """A table of prefix, middle and suffix in the order of ``form``."""
    return table.with_sentinels(PREFIX, SUFFIX, MIDDLE).arranged(ORDERS[form])


def restore(output: bytes, form: str) -> PieceTable:
    """The text that was rearranged, as pieces of ``output``.

    The output alone is read: the texts that are rearranged hold no sentinel, so each
    sentinel is found where it stands first, the output is cut around them, and the
    inverse permutation puts the parts back.
    """
    table = PieceTable.of(output)
    if form == "plain":
        return table
    marks = [(PREFIX, SUFFIX, MIDDLE)[i - 3] for i in ORDERS[form] if i >= 3]
    offsets = []
    for mark in marks:
        found = output.index(mark, offsets[-1] if offsets else 0)
        offsets += [found, found + len(mark)]
    # the cut before the first sentinel leaves an empty piece in front
    parts = PieceTable(table.buffers, table.cut(*offsets).pieces[1:])
    return PieceTable(parts.buffers, parts.arranged(inverse(ORDERS[form])).pieces[:3])


def unit_ends(text: bytes) -> np.ndarray:
    """The byte offset behind each unit of a text."""
    codes = np.frombuffer(text, np.uint8)
    if not len(codes):
        return np.empty(0, np.int64)
    blank = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
    word_ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return np.r_[word_ends, len(codes)]


def n_code_points(text: bytes, start: int, end: int) -> int:
    codes = np.frombuffer(text, np.uint8)[start:end]
    return int(np.count_nonzero((codes & 0xC0) != 0x80))


@dataclass(frozen=True)
class Draws:
    """What decides about a document: two cuts and two percentages, each from a hash."""

    first: int
    second: int
    rearranged: int
    suffix_first: int


def rearranged(text: bytes, draws: Draws, fim_percent: int, spm_percent: int) -> tuple[int, str, int, int, PieceTable]:
    """(units, form, code points of prefix and middle, output) of one text."""
    ends = unit_ends(text)
    n = len(ends)
    marked = any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE))
    if not n or marked or draws.rearranged % 100 >= fim_percent:
        return n, "plain", -1, -1, PieceTable.of(text)
    form = "spm" if draws.suffix_first % 100 < spm_percent else "psm"
    cuts = sorted((draws.first % (n + 1), draws.second % (n + 1)))
    low, high = (int(ends[c - 1]) if c else 0 for c in cuts)
    output = arrange(PieceTable.of(text).cut(low, high), form)
    return n, form, n_code_points(text, 0, low), n_code_points(text, low, high), output


def draws_of(id_col: str, seed: int) -> Column:
    """The first four groups of eight digits of the hex sha256 of ``seed:id``, as numbers."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    digest = F.sha2(name, 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


RESULT = (
    "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, "
    "restored_sha256 string"
)


def fill_in_middle(
    docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80, with_output: bool = True
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256) per row of ``docs``.

    ``fim_percent`` of the documents are rearranged, ``spm_percent`` of these with the
    suffix first.  ``restored_sha256`` is the digest of the text that :func:`restore`
    gets from the output and the form.  Without ``with_output`` the output stays in the
    task and only its digests leave it.
    """

    @F.pandas_udf(RESULT)
    def rows(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, draws in batches:
            # outputs leave in small parts, so a worker holds few of them at a time
            for start in range(0, len(texts), ROWS_AT_ONCE):
                out = []
                for text, drawn in zip(texts.iloc[start : start + ROWS_AT_ONCE], draws.iloc[start : start + ROWS_AT_ONCE]):
                    text = bytes(text)
                    n, form, prefix, middle, table = rearranged(text, Draws(*map(int, drawn)), fim_percent, spm_percent)
                    chars = (None, None) if form == "plain" else (prefix, middle)
                    output = table.text()
                    shown = output.decode("utf-8", "replace") if with_output else None
                    out.append((n, form, *chars, shown, table.sha256(), restore(output, form).sha256()))
                names = [part.split(" ")[0] for part in RESULT.split(", ")]
                yield pd.DataFrame(out, columns=names).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    found = docs.select("doc_id", rows(text, draws_of("doc_id", seed)).alias("r")).select("doc_id", "r.*")
    return found if with_output else found.drop("output")


def restored_text(output: Column, form: Column) -> Column:
    """The text that an output was made of, for readers of stored outputs; null for a null output."""

    @F.pandas_udf("binary")
    def of(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series(
            [None if o is None else restore(bytes(o), f).text() for o, f in zip(outputs, forms)], dtype=object
        )

    return of(output.cast("binary"), form).cast("string")
