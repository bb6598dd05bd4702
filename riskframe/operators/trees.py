"""Fitted tree ensembles as tables of nodes: column expressions, batch scores, exact attributions."""

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.session import shared_folder


@dataclass(frozen=True)
class Node:
    """An inner node sends a row left by its slot; a leaf (``left`` is -1) holds a value."""

    left: int
    right: int
    slot: int
    threshold: float  # left is at most this; unused where ``values`` are given
    values: tuple[float, ...]  # of a category slot: these go to one side
    values_left: bool  # whether that side is the left one
    value: float
    n: int  # training rows

    @property
    def is_leaf(self) -> bool:
        return self.left < 0


@dataclass(frozen=True)
class Ensemble:
    """Trees in the order of their table; the margin is the sum of weight * leaf value."""

    trees: tuple[tuple[Node, ...], ...]
    weights: tuple[float, ...]
    boosted: bool  # the score of a boosted model is the logistic of twice its margin, of a forest the margin itself


def is_ensemble(model: PipelineModel) -> bool:
    return isinstance(model.stages[-1], (GBTClassificationModel, RandomForestClassificationModel))


def node_table(model: PipelineModel) -> DataFrame:
    """(tree, node, left, right, slot, tests, arity, value, n) of a fitted ensemble, read from its saved form.

    ``value`` is the prediction of a boosted tree, and a forest tree's share of class 1.
    ``tests`` holds the threshold of a number, where ``arity`` is -1, or the categories
    that go left.  The table is as long as the model, not as the data.
    """
    last = model.stages[-1]
    if not is_ensemble(model):
        raise ValueError(f"{type(last).__name__} is no forest and no boosted model")
    spark = SparkSession.active()
    folder = shared_folder(spark)
    last.write().save(folder)
    node, stats = F.col("nodeData"), F.col("nodeData.impurityStats")
    total = F.aggregate(stats, F.lit(0.0), lambda a, s: a + s)
    share = F.when(total > 0, F.get(stats, F.lit(1)) / total).otherwise(0.0)
    value = node["prediction"] if isinstance(last, GBTClassificationModel) else share
    return spark.read.parquet(f"{folder}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("node"), node["leftChild"].alias("left"),
        node["rightChild"].alias("right"), node["split"]["featureIndex"].alias("slot"),
        node["split"]["leftCategoriesOrThreshold"].alias("tests"), node["split"]["numCategories"].alias("arity"),
        value.alias("value"), node["rawCount"].alias("n"),
    )


def _node(row) -> Node:
    tests, arity = tuple(row["tests"]), row["arity"]
    values_left = True
    if arity >= 0 and len(tests) > arity / 2:  # the model remembers the smaller side; values of neither go to the larger
        tests, values_left = tuple(float(v) for v in range(arity) if float(v) not in tests), False
    threshold = tests[0] if row["left"] >= 0 and arity < 0 else 0.0
    values = tests if arity >= 0 else ()
    return Node(row["left"], row["right"], row["slot"], threshold, values, values_left, row["value"], row["n"])


def ensemble(model: PipelineModel) -> Ensemble:
    """The node table of a model on the driver."""
    trees: dict[int, list[Node]] = {}
    for row in node_table(model).orderBy("tree", "node").collect():  # bounded by the model
        trees.setdefault(row["tree"], []).append(_node(row))
    last = model.stages[-1]
    boosted = isinstance(last, GBTClassificationModel)
    weights = tuple(last.treeWeights) if boosted else (1.0 / len(trees),) * len(trees)
    return Ensemble(tuple(tuple(trees[t]) for t in sorted(trees)), weights, boosted)


def _number(value: float) -> str:
    return f"{float(value)!r}D"


def question_sql(node: Node, slots: Sequence[str]) -> str:
    """The question of an inner node: whether a row goes left."""
    if not node.values and node.values_left:
        return f"{slots[node.slot]} <= {_number(node.threshold)}"
    inside = f"{slots[node.slot]} IN ({', '.join(map(_number, node.values))})" if node.values else "false"
    return inside if node.values_left else f"NOT ({inside})"


def tree_sql(nodes: Sequence[Node], test: Callable[[Node], str], at: int = 0) -> str:
    """One tree as nested conditions; ``test`` is the SQL of a node's question."""
    node = nodes[at]
    if node.is_leaf:
        return _number(node.value)
    sides = [tree_sql(nodes, test, side) for side in (node.left, node.right)]
    return f"CASE WHEN {test(node)} THEN {sides[0]} ELSE {sides[1]} END"


def array_slots(width: int, column: str = "x") -> list[str]:
    """The SQL of each slot of a dense array column."""
    return [f"{column}[{i}]" for i in range(width)]


def _margin_sql(model: Ensemble, test: Callable[[Node], str]) -> str:
    return " + ".join(f"{_number(w)} * {tree_sql(nodes, test)}" for nodes, w in zip(model.trees, model.weights))


def _score_of(model: Ensemble, margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin)) if model.boosted else margin


def margin_column(model: Ensemble, slots: Sequence[str]) -> Column:
    """The margin as one expression over columns: no vector, no transformer, no Python."""
    return F.expr(_margin_sql(model, lambda node: question_sql(node, slots)))


def score_column(model: Ensemble, slots: Sequence[str]) -> Column:
    """P(class 1) as one expression over columns."""
    return _score_of(model, margin_column(model, slots))


def scored(df: DataFrame, model: Ensemble, slots: Sequence[str], *keep: str) -> DataFrame:
    """(kept columns, score) of a table under a model whose slots are the SQL expressions ``slots``.

    The trees of a model ask few different questions.  Each is answered once per row, as a
    truth value, and the trees test these: the code that Spark generates stays below the
    size at which it gives up compiling.  Names that begin with ``_slot`` or ``_asked`` are
    its own.  A null slot is read as NaN, which goes right.
    """
    names = [f"_slot{i}" for i in range(len(slots))]
    made = [F.coalesce(F.expr(sql).cast("double"), F.lit(float("nan"))).alias(n) for sql, n in zip(slots, names)]
    asked = {_question(node): node for nodes in model.trees for node in nodes if not node.is_leaf}
    place = {question: f"_asked{k}" for k, question in enumerate(sorted(asked))}
    answers = [F.expr(question_sql(asked[question], names)).alias(name) for question, name in place.items()]
    rows = df.select(*keep, *made).select(*keep, *answers)
    margin = F.expr(_margin_sql(model, lambda node: place[_question(node)]))
    return rows.select(*keep, _score_of(model, margin).alias("score"))


def leaf_counts(model: Ensemble, rows: DataFrame, width: int) -> list[dict[int, int]]:
    """Per tree, how many of ``rows`` (x) end in each leaf; one pass, counted in each task."""
    batch = BatchTrees(model, width)

    def of_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """At most one row per leaf of the model."""
        sums = [np.zeros(len(nodes), np.int64) for nodes in model.trees]
        for frame in frames:
            if len(frame):
                for total, at in zip(sums, batch.leaves(np.array(frame["x"].tolist(), float))):
                    total += np.bincount(at, minlength=len(total))
        for tree, total in enumerate(sums):
            leaf = np.flatnonzero(total)
            yield pd.DataFrame({"tree": np.full(len(leaf), tree), "leaf": leaf, "n": total[leaf]})

    counts = rows.select("x").mapInPandas(of_task, "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n"))
    found: list[dict[int, int]] = [{} for _ in model.trees]
    for row in counts.collect():  # at most one row per leaf of the model
        found[row["tree"]][row["leaf"]] = row["n"]
    return found


class BatchTrees:
    """Scores of matrices of rows, for work inside a task.

    The trees of a model ask few different questions, so each is answered once for a
    batch, slot by slot; walking down a tree only picks from the answers.
    """

    def __init__(self, model: Ensemble, width: int):
        self.model, self.boosted = model, model.boosted
        inner = [node for nodes in model.trees for node in nodes if not node.is_leaf]
        questions = sorted({_question(node) for node in inner})
        place = {question: k for k, question in enumerate(questions)}
        self.n_questions = len(questions)
        # per slot: from which row of the answers on, the thresholds, and the category questions behind them
        self.slots = []
        for slot in sorted({q[0] for q in questions}):
            of_slot = [q for q in questions if q[0] == slot]
            numbers = np.array([q[2] for q in of_slot if not q[1]])[:, None]
            self.slots.append((slot, place[of_slot[0]], numbers, [q[3:] for q in of_slot if q[1]]))
        self.trees = []
        for nodes, weight in zip(model.trees, model.weights):
            # a leaf stays where it is whatever the answer, here that of a row behind all others
            asked = np.array([self.n_questions if n.is_leaf else place[_question(n)] for n in nodes])
            sides = np.array([(i, i) if n.is_leaf else (n.right, n.left) for i, n in enumerate(nodes)]).ravel()
            values = np.array([weight * n.value if n.is_leaf else 0.0 for n in nodes])
            self.trees.append((asked, sides, values, _depth(nodes)))

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Tree by tree, the leaf of each row."""
        n, row = len(x), np.arange(len(x))
        goes_left = np.zeros((self.n_questions + 1, n), bool)
        for slot, first, numbers, categories in self.slots:
            column = np.ascontiguousarray(x[:, slot])
            np.less_equal(column, numbers, out=goes_left[first : first + len(numbers)])
            for k, (values, values_left) in enumerate(categories, first + len(numbers)):
                goes_left[k] = (column == values[0] if len(values) == 1 else np.isin(column, values)) == values_left
        flat = goes_left.ravel()
        for asked, sides, _, depth in self.trees:
            at = np.zeros(n, np.intp)
            for _ in range(depth):
                at = sides.take(2 * at + flat.take(asked.take(at) * n + row))
            yield at

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for (_, _, values, _), at in zip(self.trees, self.leaves(x)):
            out += values.take(at)
        return out

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-2.0 * margin)) if self.boosted else margin

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.score(self.margin(x))


def _question(node: Node) -> tuple:
    """What an inner node asks: (slot, whether of a category, threshold, categories, whether they go left)."""
    of_category = bool(node.values) or not node.values_left
    return node.slot, of_category, 0.0 if of_category else node.threshold, node.values, node.values_left


def _depth(nodes: Sequence[Node], at: int = 0) -> int:
    node = nodes[at]
    return 0 if node.is_leaf else 1 + max(_depth(nodes, node.left), _depth(nodes, node.right))


@dataclass(frozen=True)
class Path:
    """A leaf with the tests on the way to it, one entry per slot that is tested."""

    slots: tuple[int, ...]
    tests: tuple[tuple[tuple[Node, bool], ...], ...]  # per slot: nodes, and whether the way goes left
    shares: tuple[float, ...]  # per slot: the share of the background that takes the way at its nodes
    value: float


def paths(model: Ensemble, counts: list[dict[int, int]]) -> list[Path]:
    """All leaves of all trees, with shares of a background whose ``leaf_counts`` are given.

    Where no background row reaches a node, its sides are shared as in training.
    """
    found = []
    for nodes, weight, of_leaf in zip(model.trees, model.weights, counts):
        reached: dict[int, int] = {}

        def reach(at: int) -> int:
            node = nodes[at]
            reached[at] = of_leaf.get(at, 0) if node.is_leaf else reach(node.left) + reach(node.right)
            return reached[at]

        def walk(at: int, way: dict[int, tuple[tuple[tuple[Node, bool], ...], float]]) -> None:
            node = nodes[at]
            if node.is_leaf:
                tests, shares = zip(*way.values()) if way else ((), ())
                found.append(Path(tuple(way), tests, shares, weight * node.value))
                return
            for side, left in ((node.left, True), (node.right, False)):
                if reached[at]:
                    share = reached[side] / reached[at]
                else:
                    share = nodes[side].n / max(nodes[node.left].n + nodes[node.right].n, 1)
                before, product = way.get(node.slot, ((), 1.0))
                walk(side, {**way, node.slot: ((*before, (node, left)), product * share)})

        reach(0)
        walk(0, {})
    return found


def _takes(x: np.ndarray, tests: tuple[tuple[Node, bool], ...]) -> np.ndarray:
    """Whether each value of a slot takes the way at all of the slot's nodes."""
    takes = np.ones(len(x), bool)
    for node, left in tests:
        if node.values or not node.values_left:
            goes_left = np.isin(x, node.values) == node.values_left
        else:
            goes_left = x <= node.threshold
        takes &= goes_left == left
    return takes


def extended(weights: list[np.ndarray], share: float, takes: np.ndarray) -> list[np.ndarray]:
    """Subset weights by size after one more slot: each subset is joined by it, or leaves it to the background."""
    bigger = [w * share for w in weights] + [np.zeros_like(weights[0])]
    for size, w in enumerate(weights):
        bigger[size + 1] = bigger[size + 1] + w * takes
    return bigger


def unwound(weights: list[np.ndarray], share: float, takes: np.ndarray) -> list[np.ndarray]:
    """The weights without a slot: the inverse of :func:`extended`.

    A slot with share 0 that the row does not take adds nothing to any attribution; its
    weights are returned as 0.
    """
    n = len(weights) - 1
    without: list[np.ndarray] = [np.zeros_like(weights[0])] * n
    rest = np.zeros_like(weights[0])
    for size in range(n - 1, -1, -1):  # for rows that take the way, from the largest subsets down
        rest = weights[size + 1] - share * rest
        without[size] = rest
    if share > 0:
        return [np.where(takes, w, weights[size] / share) for size, w in enumerate(without)]
    return [np.where(takes, w, 0.0) for w in without]


class LeafTests:
    """Which slots of a row fail which leaf of an ensemble.

    A row mixed from two others ends in the leaf that neither fails by a slot taken from it.
    """

    WORD = 32  # slots per word of bits

    def __init__(self, model: Ensemble, width: int):
        leaves = paths(model, [{} for _ in model.trees])
        self.values = np.array([leaf.value for leaf in leaves])
        self.words = -(-max(width, 1) // self.WORD)
        depth = max(1, *(len(leaf.slots) for leaf in leaves))
        self.slots = np.zeros((len(leaves), depth), np.intp)  # of the tests on the way to a leaf
        self.tests = np.full((len(leaves), depth), -1)  # their numbers among the distinct tests; -1: no more
        distinct: dict[tuple, int] = {}
        for i, leaf in enumerate(leaves):
            for k, test in enumerate(zip(leaf.slots, leaf.tests)):
                self.slots[i, k] = test[0]
                self.tests[i, k] = distinct.setdefault(test, len(distinct))
        self.distinct = list(distinct)

    def as_words(self, slots: np.ndarray) -> np.ndarray:
        """Truth values per slot as words of bits."""
        slot = np.flatnonzero(slots)
        out = np.zeros(self.words, np.uint32)
        np.bitwise_or.at(out, slot // self.WORD, np.uint32(1) << (slot % self.WORD).astype(np.uint32))
        return out

    def failing(self, x: np.ndarray) -> np.ndarray:
        """(word, leaf, row): the slots of each row that fail the leaf, as bits."""
        fails = np.zeros((len(self.distinct) + 1, len(x)), bool)  # the last for no test at all
        for k, (slot, tests) in enumerate(self.distinct):
            fails[k] = ~_takes(x[:, slot], tests)
        out = np.zeros((self.words, len(self.values), len(x)), np.uint32)
        for slot, test in zip(self.slots.T, self.tests.T):
            bit = np.uint32(1) << (slot % self.WORD).astype(np.uint32)
            for word in range(self.words):
                out[word] |= fails[test] * np.where(slot // self.WORD == word, bit, np.uint32(0))[:, None]
        return out


def passing(failing: np.ndarray, words: np.ndarray) -> np.ndarray:
    """(leaf, row): whether none of the slots given as ``words`` is failing."""
    out = (failing[0] & words[0]) == 0
    for more, word in zip(failing[1:], words[1:]):
        out &= (more & word) == 0
    return out


def path_attributions(x: np.ndarray, leaves: Sequence[Path]) -> np.ndarray:
    """(row, slot) exact Shapley values of the margin of a matrix of rows.

    The value of a set of slots is the margin with these slots as in the row, and the
    sides of all other nodes averaged by the background's shares.  For one leaf the
    weights of all subsets of its d slots are the coefficients of a product of d
    factors, so they are extended slot by slot and unwound for each slot in turn: d^2
    steps in place of 2^d subsets.
    """
    out = np.zeros(x.shape)
    takes_of: dict[tuple, np.ndarray] = {}
    for leaf in leaves:
        takes = []
        for slot, tests in zip(leaf.slots, leaf.tests):
            key = (slot, tests)
            if key not in takes_of:
                takes_of[key] = _takes(x[:, slot], tests)
            takes.append(takes_of[key])
        weights = [np.ones(len(x))]
        for share, t in zip(leaf.shares, takes):
            weights = extended(weights, share, t)
        n = len(leaf.slots)
        chances = [factorial(size) * factorial(n - 1 - size) / factorial(n) for size in range(n)]
        for slot, share, t in zip(leaf.slots, leaf.shares, takes):
            without = unwound(weights, share, t)
            out[:, slot] += leaf.value * (t - share) * sum(c * w for c, w in zip(chances, without))
    return out


def shap_tree(rows: DataFrame, id_col: str, model: Ensemble, background: DataFrame, width: int) -> DataFrame:
    """(id, slot, phi): exact Shapley values of the margin of a tree ensemble.

    ``rows`` and ``background`` hold a dense array ``x``.  The background may be of any
    size: it is counted once per leaf, and only these counts are used.  Per row the phi
    add up to the row's margin minus the mean margin of the background.
    """
    leaves = paths(model, leaf_counts(model, background, width))

    @F.pandas_udf("array<double>")
    def attributions(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            matrix = np.array(x.tolist(), float).reshape(-1, width)
            yield pd.Series(list(path_attributions(matrix, leaves)))

    found = rows.select(id_col, attributions("x").alias("phi"))
    return found.select(id_col, F.posexplode("phi").alias("slot", "phi"))
