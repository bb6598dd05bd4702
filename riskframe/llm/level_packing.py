"""Sum-of-squares online packing of documents into windows of tokens.

A packer reads documents one after the other and puts each into the open window whose
fill level makes the sum of squared counts of partially filled windows smallest: with
``count[h]`` windows filled up to level h, moving one from h to h + s costs
2 * count[h + s] + 1 - (2 * count[h] - 1).  Two level arrays hold these costs, so a
document is placed by one subtraction over the levels.  A window at a power of two needs
no padding, so it is not counted as partially filled.

A packer keeps at most MAX_OPEN windows open.  Where one more would be needed, the
document is cut so that its first part fills a window up.  A document longer than a window
first fills whole windows of its own.

On Spark every task packs the documents that it reads; texts are not shuffled.  What the
open windows of a task hold, at most MAX_OPEN windows, goes on with its token ids to the
next level, where one packer takes the rest of FAN_IN packers, until one packer is left.
That one lays its last windows out end to end, cuts them at full windows and parts what
remains, less than a window, into powers of two: so nothing is padded at all, and no task
ever holds more than the open windows of one packer.

Defined results: a null or empty text is the end id alone; repeated rows are packed each
for itself; a null id stays null; an empty table gives no rows; other columns are not
looked at.  Sequence numbers say nothing but which pieces share a sequence.
"""

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from riskframe.llm.best_fit import known_words
from riskframe.llm.tables import written

CAPACITY = 4096
MAX_OPEN = 512  # the given documents need some 180; then none is cut before the last packer
FAN_IN = 8  # packers whose rest one packer of the next level takes
ID_BYTES = 4
ROWS_PER_BATCH = 2_000


@dataclass(frozen=True)
class Item:
    """Some tokens of a document: its row's id, where they start, all tokens of the document, the ids."""

    doc_id: object
    start: int
    doc_tokens: int
    ids: bytes

    @property
    def length(self) -> int:
        return len(self.ids) // ID_BYTES

    def split(self, at: int) -> tuple["Item", "Item"]:
        cut = at * ID_BYTES
        return (
            Item(self.doc_id, self.start, self.doc_tokens, self.ids[:cut]),
            Item(self.doc_id, self.start + at, self.doc_tokens, self.ids[cut:]),
        )


def item_order(item: Item) -> tuple:
    """Longest first; what is equal in all of it is interchangeable."""
    return -item.length, str(item.doc_id), item.start, item.ids


@dataclass
class Window:
    number: int
    level: int = 0
    items: list[tuple[Item, int]] = field(default_factory=list)  # with its offset

    def add(self, item: Item) -> None:
        self.items.append((item, self.level))
        self.level += item.length


class SquaresPacker:
    """Online packing into windows of ``capacity``; ``closed`` receives every window that is full."""

    def __init__(self, closed: Callable[[Window], None], capacity: int = CAPACITY, max_open: int = MAX_OPEN):
        self.closed, self.capacity, self.max_open = closed, capacity, max_open
        self.numbered = 0
        self.n_open = 0
        self.open: list[list[Window]] = [[] for _ in range(capacity)]
        levels = np.arange(capacity + 1)
        self.counted = (levels & (levels - 1) != 0) & (levels < capacity)
        self.entering = self.counted.astype(np.int64)  # what one more window at a level costs
        self.leaving = np.full(capacity + 1, -(1 << 40), np.int64)  # what one less saves; no window, no choice
        self.leaving[0] = 0  # a new window can always be opened

    def _update(self, level: int) -> None:
        n = len(self.open[level])
        if self.counted[level]:
            self.entering[level] = 2 * n + 1
        self.leaving[level] = (2 * n - 1 if self.counted[level] else 0) if n else -(1 << 40)

    def _push(self, window: Window) -> None:
        if window.level == self.capacity:
            self.closed(window)
            return
        self.open[window.level].append(window)
        self.n_open += 1
        self._update(window.level)

    def _take(self, level: int) -> Window:
        if not level:
            self.numbered += 1
            return Window(self.numbered)
        window = self.open[level].pop()
        self.n_open -= 1
        self._update(level)
        return window

    def _cheapest_cut(self, size: int) -> int:
        """The level of the window to fill up with the first of ``size`` tokens, none of which has room for all."""
        low = self.capacity - size + 1
        cost = self.entering[1:size] - self.leaving[low : self.capacity]
        return low + len(cost) - 1 - int(cost[::-1].argmin())

    def _cheapest(self, size: int, low: int) -> int | None:
        """The level, at least ``low``, of the window to take ``size`` tokens; of equal ones the fullest."""
        last = self.capacity - size
        if last < low:
            return None
        cost = self.entering[size + low : self.capacity + 1] - self.leaving[low : last + 1]
        at = len(cost) - 1 - int(cost[::-1].argmin())
        return at + low if cost[at] < 1 << 39 else None

    def place(self, item: Item) -> None:
        while item.length > self.capacity:
            head, item = item.split(self.capacity)
            self._into(self._take(0), head)
        while True:
            full = self.n_open >= self.max_open and item.length < self.capacity
            level = self._cheapest(item.length, 1 if full else 0)
            if level is not None:
                self._into(self._take(level), item)
                return
            level = self._cheapest_cut(item.length)
            head, item = item.split(self.capacity - level)
            self._into(self._take(level), head)

    def _into(self, window: Window, item: Item) -> None:
        window.add(item)
        self._push(window)

    def rest(self) -> Iterator[Item]:
        """The items of the windows that are still open, longest first."""
        yield from sorted((item for same in self.open for window in same for item, _ in window.items), key=item_order)

    def laid_out(self) -> None:
        """Closes everything: open windows end to end, cut at full windows, the last part in powers of two."""
        left = list(self.rest())
        total = sum(item.length for item in left)
        sizes = [self.capacity] * (total // self.capacity)
        remains = total % self.capacity
        sizes += [1 << bit for bit in reversed(range(remains.bit_length())) if remains >> bit & 1]
        left.reverse()
        for size in sizes:
            window = self._take(0)
            while window.level < size:
                item, room = left.pop(), size - window.level
                if item.length > room:
                    item, back = item.split(room)
                    left.append(back)
                window.add(item)
            self.closed(window)


PLACED = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, packer int"


class _Rows:
    """Rows of the result table of one packer, handed out in batches."""

    names = [part.split(" ")[0] for part in PLACED.split(", ")]

    def __init__(self, id_type: pa.DataType, level: int, number: int, keep_ids: bool):
        self.types = [id_type, *[pa.int64()] * 6, pa.binary(), pa.int32()]
        self.number, self.keep_ids = number, keep_ids
        self.first = (level << 56) | (number << 28)
        self.rows: list[tuple] = []

    def closed(self, window: Window) -> None:
        for item, offset in window.items:
            ids = item.ids if self.keep_ids else None
            crc = zlib.crc32(item.ids)
            self.rows.append(
                (item.doc_id, item.start, item.length, crc, item.doc_tokens, self.first + window.number, offset, ids, None)
            )

    def left(self, item: Item) -> None:
        self.rows.append(
            (item.doc_id, item.start, item.length, None, item.doc_tokens, None, None, item.ids, self.number)
        )

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[] for _ in self.names]
        arrays = [pa.array(list(c), t) for c, t in zip(columns, self.types)]
        self.rows = []
        return pa.RecordBatch.from_arrays(arrays, self.names)


@dataclass(frozen=True)
class Settings:
    id_type: pa.DataType
    capacity: int
    max_open: int
    keep_ids: bool


def _pack_texts(settings: Settings, tokenizer_json: str, end_id: int):
    """Whole texts, one packer per task: each document's ids with the end id behind them."""
    end = np.array([end_id], "<u4").tobytes()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(settings.id_type, 0, TaskContext.get().partitionId(), settings.keep_ids)
        packer = SquaresPacker(rows.closed, settings.capacity, settings.max_open)
        known = known_words(tokenizer_json)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                # the tokenizer drops white space: a text's ids are those of its words in turn
                words = (text.as_py() or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
                ids = b"".join(map(known.__getitem__, words)) + end
                packer.place(Item(doc_id.as_py(), 0, len(ids) // ID_BYTES, ids))
                if len(rows.rows) >= ROWS_PER_BATCH:
                    yield rows.batch()
        for item in packer.rest():
            rows.left(item)
        yield rows.batch()

    return of


def _pack_rest(settings: Settings, level: int, last: bool):
    """What up to FAN_IN packers left over, at most FAN_IN * max_open windows."""

    def of(key: tuple, table: pa.Table) -> pa.Table:
        rows = _Rows(settings.id_type, level, key[0].as_py(), settings.keep_ids)
        packer = SquaresPacker(rows.closed, settings.capacity, settings.max_open)
        left = [Item(r["doc_id"], r["start"], r["doc_tokens"], r["ids"]) for r in table.to_pylist()]
        for item in sorted(left, key=item_order):
            packer.place(item)
        if last:
            packer.laid_out()
        else:
            for item in packer.rest():
                rows.left(item)
        return pa.Table.from_batches([rows.batch()])

    return of


def pack(
    docs: DataFrame, tokenizer_json: str, end_id: int = 2, capacity: int = CAPACITY, max_open: int = MAX_OPEN,
    keep_ids: bool = False,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece of ``docs`` (doc_id, text).

    With ``keep_ids`` a column ids holds the piece's tokens, little-endian unsigned
    32-bit, for :func:`riskframe.llm.best_fit.sequences`.  The tokenizer must drop white
    space.  ``capacity`` is at least 2.
    """
    id_field = docs.schema["doc_id"]
    settings = Settings(to_arrow_type(id_field.dataType), capacity, max_open, keep_ids)
    schema = PLACED.format(id=id_field.dataType.simpleString())
    step = written(docs.select("doc_id", "text").mapInArrow(_pack_texts(settings, tokenizer_json, end_id), schema))
    placed, level, packers = [step], 0, 0
    while packers != 1:
        left = step.filter("packer is not null")
        highest = left.agg(F.max("packer")).first()[0]  # one number
        if highest is None:
            break
        level, packers = level + 1, highest // FAN_IN + 1
        of_packer = F.floor(F.col("packer") / FAN_IN).cast("int").alias("packer")
        groups = left.select(of_packer, "doc_id", "start", "doc_tokens", "ids").groupBy("packer")
        step = written(groups.applyInArrow(_pack_rest(settings, level, packers == 1), schema))
        placed.append(step)
    done = reduce(DataFrame.unionByName, [p.filter("sequence_id is not null").drop("packer") for p in placed])
    return done if keep_ids else done.drop("ids")
