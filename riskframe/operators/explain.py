"""Feature rankings and attributions."""

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.columns import slot_name
from riskframe.operators.training import BatchScorer, LinearScorer, batch_scorer, score_column
from riskframe.operators.trees import BatchTrees, LeafTests, passing


def top_by_magnitude(values: DataFrame, n: int) -> DataFrame:
    """The n slots of largest absolute value, as (feature, value)."""
    ordered = values.orderBy(F.desc(F.abs("value")), "slot").limit(n)
    return ordered.select(slot_name(F.col("slot")).alias("feature"), "value")


def top_by_value(values: DataFrame, n: int) -> DataFrame:
    """The n slots of largest value, as (feature, value)."""
    ordered = values.orderBy(F.desc("value"), "slot").limit(n)
    return ordered.select(slot_name(F.col("slot")).alias("feature"), "value")


def mean_abs_by_feature(values: DataFrame, n: int | None = 20, digits: int = 9) -> DataFrame:
    """Mean absolute value per slot with NaN counted as 0, largest first."""
    means = values.groupBy("slot").agg(F.round(F.avg(F.abs(F.nanvl("value", F.lit(0.0)))), digits).alias("mean_abs"))
    if n is not None:
        means = means.orderBy(F.desc("mean_abs"), "slot").limit(n)
    return means.select(slot_name(F.col("slot")).alias("feature"), "mean_abs")


def positive_class(values: DataFrame, column: str = "class") -> DataFrame:
    """The slice of class 1 where attributions exist per class, all rows elsewhere."""
    return values.where(F.col(column) == 1).drop(column) if column in values.columns else values


def shap_linear(rows: DataFrame, weights: Column, x: str = "x") -> DataFrame:
    """(kept columns, slot, phi): phi = w * (x - mean x), exact for a linear margin."""
    keep = [c for c in rows.columns if c != x]
    # one mean vector over the rows, not one row per slot
    means = rows.agg(vector_to_array(Summarizer.mean(array_to_vector(x))).alias("m")).scalar()
    with_stats = rows.select(*keep, F.col(x).alias("_x"), weights.alias("_w"), means.alias("_m"))
    phi = F.transform("_x", lambda v, i: F.col("_w")[i] * (v - F.col("_m")[i]))
    return with_stats.select(*keep, F.posexplode(phi).alias("slot", "phi"))


def as_array(per_slot: DataFrame, value: str) -> Column:
    """The values of a one-row-per-slot table as one array scalar in slot order."""
    ordered = F.sort_array(F.collect_list(F.struct("slot", value)))
    return per_slot.agg(F.transform(ordered, lambda e: e[value]).alias("a")).scalar()


# A scorer adds column ``p`` to a table with a dense array column ``x``.
Scorer = Callable[[DataFrame], DataFrame]


class ModelScorer:
    """The scorer of a fitted model.

    ``batch`` scores a matrix of rows inside a task, to the model's own scores, where the
    kind of model is known; else it is None and explanations go through the table form.
    """

    def __init__(self, model: PipelineModel):
        self.model = model
        self.batch = batch_scorer(model)

    def __call__(self, df: DataFrame) -> DataFrame:
        predicted = self.model.transform(df.withColumn("features", array_to_vector("x")))
        return predicted.withColumn("p", score_column(predicted, self.model)).select(*df.columns, "p")


def model_scorer(model: PipelineModel) -> ModelScorer:
    return ModelScorer(model)


def background_array(background: DataFrame) -> Column:
    """All background rows as one array scalar in a fixed order; the caller chooses how many they are."""
    return background.agg(F.array_sort(F.collect_list("x")).alias("b")).scalar()


def rebalanced(rows: DataFrame) -> DataFrame:
    """``rows`` in tasks of the advisory size, before each row is multiplied; large tasks are split too."""
    return rows.hint("rebalance")


def coalition_values(
    rows: DataFrame, id_col: str, background: DataFrame, masks: list[list[int]], scorer: Scorer
) -> DataFrame:
    """(id, mask, value): mean score of a row with the slots outside the mask taken from the background.

    Every (row, mask, background row) is generated and scored in the row's own task;
    only the averages are shuffled.
    """
    # one literal per mask: its slots as a string of 0 and 1
    patterns = F.split(F.lit(",".join("".join(map(str, map(int, bits))) for bits in masks)), ",")
    at = F.sequence(F.lit(1), F.length("pattern"))
    bits = F.transform(at, lambda i: F.substr(F.col("pattern"), i, F.lit(1)).cast("int"))
    expanded = (
        rebalanced(rows.select(id_col, F.col("x").alias("own")))
        .select(id_col, "own", background_array(background).alias("others"))
        .select(id_col, "own", "others", F.posexplode(patterns).alias("mask", "pattern"))
        .select(id_col, "own", "others", "mask", bits.alias("bits"))
        .select(id_col, "own", "mask", "bits", F.explode("others").alias("other"))
    )
    mixed = F.transform("own", lambda v, i: F.when(F.col("bits")[i] == 1, v).otherwise(F.col("other")[i]))
    scored = scorer(expanded.select(id_col, "mask", mixed.alias("x")))
    return scored.groupBy(id_col, "mask").agg(F.avg("p").alias("value"))


def kernel_masks(width: int, n: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(masks, weights) of a kernel attribution: whole subset sizes first, then paired random ones."""
    sizes = np.arange(1, width)
    size_weight = (width - 1) / (sizes * (width - sizes))
    size_weight = size_weight / size_weight.sum()
    masks: list[np.ndarray] = []
    weights: list[float] = []
    done = 0  # sizes 1..done and width-done..width-1 are complete
    while done < width // 2:
        s = done + 1
        both = s != width - s
        subsets = comb(width, s) * (2 if both else 1)
        if len(masks) + subsets > n:
            break
        total = size_weight[s - 1] * (2 if both else 1)
        for members in combinations(range(width), s):
            bits = np.zeros(width, dtype=int)
            bits[list(members)] = 1
            for b in [bits, 1 - bits] if both else [bits]:
                masks.append(b)
                weights.append(total / subsets)
        done = s
    left = n - len(masks)
    inner = sizes[(sizes > done) & (sizes < width - done)]
    if left > 1 and len(inner):
        rng = np.random.default_rng(seed)
        chances = size_weight[inner - 1] / size_weight[inner - 1].sum()
        share = size_weight[inner - 1].sum() / (left - left % 2)
        for _ in range(left // 2):
            bits = np.zeros(width, dtype=int)
            bits[rng.choice(width, size=rng.choice(inner, p=chances), replace=False)] = 1
            masks += [bits, 1 - bits]
            weights += [share, share]
    return np.array(masks), np.array(weights)


def kernel_solution(masks: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted least squares fit as fixed linear maps of the coalition values.

    phi = gain @ (value - base) + share * (f(x) - base), which sums to f(x) - base.
    The masks are the same for every row, so the maps are computed once.
    """
    z = masks.astype(float)
    gram_inverse = np.linalg.pinv(z.T @ (weights[:, None] * z))
    free = gram_inverse @ (z.T * weights)
    ones = gram_inverse.sum(axis=1)
    share = ones / ones.sum()
    gain = free - np.outer(share, free.sum(axis=0))
    return gain, share


class Mixes:
    """Scores of rows mixed into background rows, each distinct mix of a row scored once.

    Mix j takes the slots of ``masks[j]`` from the row and the others from background row
    ``of[j]``.  Where row and background agree, a slot changes nothing.  So a mix in
    which nothing changes has the background's own score, one in which everything
    changes the row's, and one in which a single slot changes is looked up in a table
    by (background row, slot, value) that all rows of a task share.  Of the others,
    those that come to the same values are one: background rows that agree in the slots
    that are left to them make no difference.
    """

    LARGEST_TABLE = 2_000  # (slot, value) entries that a task keeps, one score per background row each

    def __init__(self, background: np.ndarray, of: np.ndarray, masks: np.ndarray, score: BatchScorer):
        self.background, self.of, self.masks, self.score = background, of, masks.astype(bool), score
        self.base = score(background)
        # a number per slot and distinct background value; 0 is the row's own value
        codes = np.stack([np.unique(column, return_inverse=True)[1] + 1 for column in background.T], axis=1)
        self.codes = codes.astype(np.uint64)
        self.spread = np.random.default_rng(7).integers(1, 1 << 62, background.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
        self.changed: dict[tuple[int, float], np.ndarray] = {}  # (slot, value): the score of every background row with it
        self.scored = len(background)  # mixes that were scored

    def of_row(self, own: np.ndarray, p: float) -> np.ndarray:
        """The score of every mix of a row whose own score is ``p``."""
        differs = self.background != own
        moved = self.masks & differs[self.of]
        n_moved, n_differs = moved.sum(axis=1), differs.sum(axis=1)[self.of]
        out = np.where(n_moved == 0, self.base[self.of], p)
        single = np.flatnonzero((n_moved == 1) & (n_differs > 1))
        slots = moved[single].argmax(axis=1)
        open_ = np.flatnonzero((n_moved > 1) & (n_moved < n_differs))
        moved, of = moved[open_], self.of[open_]
        # slots in which both agree count as the row's own, so equal mixes have equal codes
        codes = np.where(moved | ~differs[of], np.uint64(0), self.codes[of])
        _, first, same = np.unique(codes @ self.spread, return_index=True, return_inverse=True)
        if (codes[first][same] != codes).any():  # two mixes with one number
            _, first, same = np.unique(codes, axis=0, return_index=True, return_inverse=True)
        mixed = np.where(moved[first], own, self.background[of[first]])
        # what the table lacks is scored together with the mixes
        lacking = [s for s in np.unique(slots) if (s, own[s]) not in self.changed]
        changed = np.tile(self.background, (len(lacking), 1))
        n = len(self.background)
        for k, slot in enumerate(lacking):
            changed[k * n : (k + 1) * n, slot] = own[slot]
        new = np.flatnonzero((changed != np.tile(self.background, (len(lacking), 1))).any(axis=1))
        scores = np.tile(self.base, len(lacking))
        scored = self.score(np.concatenate([mixed, changed[new]]))
        self.scored += len(scored)
        scores[new] = scored[len(mixed) :]
        if len(self.changed) + len(lacking) > self.LARGEST_TABLE:
            self.changed = {(s, own[s]): self.changed[s, own[s]] for s in np.unique(slots) if (s, own[s]) in self.changed}
        for k, slot in enumerate(lacking):
            self.changed[slot, own[slot]] = scores[k * n : (k + 1) * n]
        for slot in np.unique(slots):
            at = single[slots == slot]
            out[at] = self.changed[slot, own[slot]][self.of[at]]
        out[open_] = scored[: len(mixed)][same.ravel()]
        return out


class RowMixes:
    """Attributions of any batch scorer, row by row, see :class:`Mixes`."""

    def __init__(self, background: np.ndarray, of: np.ndarray, masks: np.ndarray, gains: np.ndarray, score: BatchScorer):
        self.mixes, self.gains, self.score = Mixes(background, of, masks, score), gains, score

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """(row, slot): the scores of all mixes of a row times the gains."""
        return np.array([self.mixes.of_row(own, p) @ self.gains for own, p in zip(x, self.score(x))]).reshape(x.shape)


class LinearMixes:
    """The same for a linear scorer: what a mix takes from the background is a constant, the rest a matrix product."""

    ROWS = 64  # at a time

    def __init__(self, background: np.ndarray, of: np.ndarray, masks: np.ndarray, gains: np.ndarray, score: LinearScorer):
        self.masks, self.gains, self.weights = masks.astype(float), gains, score.weights
        self.others = ((1.0 - self.masks) * background[of]) @ score.weights + score.intercept
        self.by_row = RowMixes(background, of, masks, gains, score)
        self.finite = np.isfinite(background).all()

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        finite = np.isfinite(x).all(axis=1) & self.finite
        out = np.empty(x.shape)
        out[~finite] = self.by_row.of_rows(x[~finite])  # 0 times such a value is not 0
        rows = np.flatnonzero(finite)
        for start in range(0, len(rows), self.ROWS):
            part = rows[start : start + self.ROWS]
            out[part] = 1.0 / (1.0 + np.exp(-((x[part] * self.weights) @ self.masks.T + self.others))) @ self.gains
        return out


class TreeMixes:
    """The same for trees: a mix ends in a leaf that neither its row nor its background row fails.

    Whether the background row fails a leaf outside a mask is the same for all rows, so per
    mask the leaf values that are left are a matrix, leaves by background row, and the
    margins of all its mixes are a product with the leaves that the rows pass inside the mask.
    Background rows that leave the same leaves are one column; leaves that ask the same
    inside the mask are one line.
    """

    ROWS = 256  # at a time
    KEPT = 64 << 20  # bytes of matrices that a task keeps; others are made again

    def __init__(self, background: np.ndarray, of: np.ndarray, masks: np.ndarray, gains: np.ndarray, score: BatchTrees):
        self.score, self.gains = score.score, gains
        self.leaves = LeafTests(score.model, masks.shape[1])
        self.of_background = self.leaves.failing(background)
        self.masks, of_mask = np.unique(masks.astype(bool), axis=0, return_inverse=True)
        order = np.argsort(of_mask.ravel(), kind="stable")
        self.mixes = np.split(order, np.cumsum(np.bincount(of_mask.ravel()))[:-1])
        self.of, self.kept, self.room = of, {}, self.KEPT

    def of_mask(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(mask as words, a leaf per line, leaf values by line and column, gains by column and slot)."""
        if k in self.kept:
            return self.kept[k]
        leaves, mask, mixes = self.leaves, self.masks[k], self.mixes[k]
        left = passing(self.of_background[:, :, self.of[mixes]], leaves.as_words(~mask)).T  # (mix, leaf)
        packed = np.packbits(left, axis=1)
        _, first, column = np.unique(packed.view(f"V{packed.shape[1]}").ravel(), return_index=True, return_inverse=True)
        gains = np.zeros((len(first), self.gains.shape[1]))
        np.add.at(gains, column, self.gains[mixes])
        alive = np.flatnonzero(left.any(axis=0))
        asked = np.where(mask[leaves.slots[alive]], leaves.tests[alive], -1)
        _, leaf, line = np.unique(asked, axis=0, return_index=True, return_inverse=True)
        values = np.zeros((len(leaf), len(first)))
        np.add.at(values, line.ravel(), (left[first][:, alive] * leaves.values[alive]).T)
        made = leaves.as_words(mask), alive[leaf], values, gains
        if values.nbytes <= self.room:
            self.kept[k], self.room = made, self.room - values.nbytes
        return made

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape)
        for start in range(0, len(x), self.ROWS):
            part = slice(start, start + self.ROWS)
            failing = self.leaves.failing(x[part])
            for k in range(len(self.masks)):
                words, leaf, values, gains = self.of_mask(k)
                passes = passing(failing[:, leaf], words).astype(float)
                out[part] += self.score(passes.T @ values) @ gains
        return out


def mixes_of(background: np.ndarray, of: np.ndarray, masks: np.ndarray, gains: np.ndarray, score: BatchScorer):
    """The way to attribute that suits the kind of scorer."""
    kinds = {LinearScorer: LinearMixes, BatchTrees: TreeMixes}
    return kinds.get(type(score), RowMixes)(background, of, masks, gains, score)


def background_matrix(background: DataFrame) -> np.ndarray:
    """The background rows in a fixed order; the caller chooses how many they are."""
    return np.array(background.select(F.array_sort(F.collect_list("x"))).first()[0], float)


def _matrix(x: pd.Series) -> np.ndarray:
    return np.array(x.tolist(), float)


def _by_change(
    rows: DataFrame, id_col: str, background: DataFrame, of, masks: np.ndarray, gains, share, batch: BatchScorer
) -> DataFrame:
    """(id, slot, phi) from the scores of each row's mixes less the background's mean, in the row's own task.

    A phi is the sum of ``gains`` * score over the mixes, and ``share`` of the row's own score.
    """
    others = background_matrix(background)
    if not len(others):
        raise ValueError("an attribution needs at least one background row")
    of = np.asarray(of(len(others)))

    @F.pandas_udf("array<double>")
    def attributions(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        factors = gains(len(others))
        mixes, base = mixes_of(others, of, masks(len(others)), factors, batch), batch(others).mean()
        for part in parts:
            x = _matrix(part)
            phi = mixes.of_rows(x) - base * factors.sum(axis=0) + np.outer(batch(x) - base, share) if len(x) else []
            yield pd.Series(list(phi), dtype=object)

    found = rebalanced(rows.select(id_col, "x")).select(id_col, attributions("x").alias("phi"))
    return found.select(id_col, F.posexplode("phi").alias("slot", "phi"))


def shap_kernel(
    rows: DataFrame, id_col: str, background: DataFrame, width: int, scorer: Scorer, n_masks: int = 100
) -> DataFrame:
    """(id, slot, phi): kernel estimate of Shapley values of any scored model.

    ``rows`` and ``background`` hold a dense array ``x``.  Per row the phi add up to
    f(x) minus the mean score of the background.  A scorer with a batch form scores the
    mixes inside the row's task, see :func:`mixes_of`.
    """
    masks, weights = kernel_masks(width, n_masks)
    gain, share = kernel_solution(masks, weights)
    if getattr(scorer, "batch", None):
        return _by_change(
            rows, id_col, background, lambda n: np.tile(np.arange(n), len(masks)), lambda n: np.repeat(masks, n, axis=0),
            lambda n: np.repeat(gain.T / n, n, axis=0), share, scorer.batch,
        )
    base = scorer(background.select("x")).agg(F.avg("p").alias("b")).scalar()
    values = coalition_values(rows, id_col, background, masks.tolist(), scorer)
    # one flat literal: the gains of a mask are a slice of it
    flat = F.transform(F.split(F.lit(",".join(map(repr, gain.T.ravel().tolist()))), ","), lambda g: g.cast("double"))
    of_mask = F.slice("gains", F.col("mask") * width + 1, width)
    from_masks = values.withColumn("gains", flat).select(
        id_col, (F.col("value") - base).alias("d"), of_mask.alias("g")
    )
    own = scorer(rows.select(id_col, "x")).select(
        id_col, (F.col("p") - base).alias("d"), F.lit([float(s) for s in share]).alias("g")
    )
    parts = from_masks.unionByName(own).select(id_col, "d", F.posexplode("g").alias("slot", "factor"))
    return parts.groupBy(id_col, "slot").agg(F.sum(F.col("d") * F.col("factor")).alias("phi"))


def sampled_orders(width: int, pairs: int, seed: int = 42) -> list[tuple[int, np.ndarray]]:
    """(number of the background row, order of the slots): each drawn order next to its reverse."""
    rng = np.random.default_rng(seed)
    orders = []
    for k in range(pairs):
        order = rng.permutation(width)
        orders += [(k, order), (k, order[::-1])]
    return orders


def shap_permutation(
    rows: DataFrame, id_col: str, background: DataFrame, width: int, scorer: Scorer, pairs: int = 2, seed: int = 42
) -> DataFrame:
    """(id, slot, phi): Shapley values from sampled orders, each next to its reverse.

    Walking an order moves one slot at a time from a background row to the row; a
    slot's share is the change of the score at its step.  A scorer with a batch form
    scores the steps inside the row's task, see :func:`mixes_of`.
    """
    orders = sampled_orders(width, pairs, seed)
    if getattr(scorer, "batch", None):
        ranks = np.stack([np.argsort(order) for _, order in orders])
        steps = np.arange(width + 1)
        entered = ranks[:, None, :] < steps[None, :, None]  # (walk, step, slot)
        # the slot that enters at a step takes the score there less the one before
        changes = np.diff(entered.astype(float), axis=1, prepend=0.0)
        changes[:, :-1] -= changes[:, 1:].copy()
        gains = changes.reshape(-1, width) / len(orders)
        return _by_change(
            rows, id_col, background, lambda n: np.repeat([k % n for k, _ in orders], width + 1),
            lambda n: entered.reshape(-1, width), lambda n: gains, np.zeros(width), scorer.batch,
        )
    # one literal: the orders as numbers in a string, each next to the number of its background row
    text = ";".join(",".join(map(str, [k, *order])) for k, order in orders)
    walks = F.transform(F.split(F.lit(text), ";"), lambda w: F.transform(F.split(w, ","), lambda i: i.cast("int")))
    at = F.sequence(F.lit(0), F.lit(width - 1))
    expanded = (
        rebalanced(rows.select(id_col, F.col("x").alias("own")))
        .select(id_col, "own", background_array(background).alias("others"))
        .select(id_col, "own", "others", F.explode(walks).alias("walk"))
        .select(id_col, "own", "others", F.get("walk", F.lit(0)).alias("k"), F.slice("walk", 2, width).alias("order"))
        .select("*", F.transform(at, lambda i: (F.array_position("order", i) - 1).cast("int")).alias("rank"))
        .select(
            id_col, "own", "order", "rank",
            F.col("others")[F.col("k") % F.size("others")].alias("other"),
            F.explode(F.sequence(F.lit(0), F.lit(width))).alias("step"),
        )
    )
    mixed = F.transform("own", lambda v, i: F.when(F.col("rank")[i] < F.col("step"), v).otherwise(F.col("other")[i]))
    scored = scorer(expanded.select(id_col, "order", "step", mixed.alias("x")))
    entered = F.struct(F.get("order", F.col("step") - 1).alias("slot"), F.col("p").alias("change"))
    enters_next = F.struct(F.get("order", F.col("step")).alias("slot"), (-F.col("p")).alias("change"))
    changes = scored.select(id_col, F.inline(F.array(entered, enters_next))).where(F.col("slot").isNotNull())
    return changes.groupBy(id_col, "slot").agg((F.sum("change") / F.lit(float(len(orders)))).alias("phi"))


def shap_summary(values: DataFrame, n: int = 20) -> DataFrame:
    """Top slots by mean absolute attribution of the positive class."""
    return mean_abs_by_feature(positive_class(values).withColumn("value", F.col("phi")), n)


def quartile_bins(train: DataFrame) -> list[dict]:
    """Per slot of ``x``: inner quartile edges and each bin's share, lowest and highest value."""
    width = train.select(F.max(F.size("x"))).first()[0] or 0
    quartiles = [F.array_distinct(F.percentile_approx(F.col("x")[i], [0.25, 0.5, 0.75], 10000)) for i in range(width)]
    edges = [np.array(e, float) for e in train.agg(F.array(*quartiles)).first()[0]] if width else []

    def of_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """At most four rows per slot and task."""
        found: dict[tuple[int, int], list] = {}
        for frame in frames:
            x = _matrix(frame["x"])
            for slot in range(width if len(x) else 0):
                bin_ = np.searchsorted(edges[slot], x[:, slot], side="left")
                for b in np.unique(bin_):
                    inside = x[bin_ == b, slot]
                    n, low, high = found.get((slot, int(b)), (0, np.inf, -np.inf))
                    found[slot, int(b)] = [n + len(inside), min(low, inside.min()), max(high, inside.max())]
        if found:
            yield pd.DataFrame([(*key, *stats) for key, stats in found.items()], columns=["slot", "bin", "n", "low", "high"])

    parts = train.select("x").mapInPandas(of_task, "slot int, bin int, n long, low double, high double")
    stats = parts.groupBy("slot", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    slots: dict[int, dict] = {i: {"edges": e.tolist(), "n": [], "low": [], "high": []} for i, e in enumerate(edges)}
    for r in stats.orderBy("slot", "bin").collect():  # at most four rows per slot
        for key in ("n", "low", "high"):
            slots[r["slot"]][key].append(r[key])
    return [slots[i] for i in range(len(slots))]


class Surrogates:
    """Weighted ridge fits of neighbours' scores on "same bin as the row", one set of sums per pattern of bins.

    How close a neighbour is depends on the bins of the row only, so rows with the same
    bins share the weighted sums of all neighbours.  The row itself, closest of all,
    is added to them as one more observation.
    """

    LARGEST_TABLE = 2_000  # patterns whose sums a task keeps

    def __init__(self, drawn: np.ndarray, scores: np.ndarray, kernel: float, n_features: int):
        self.drawn, self.scores, self.n_features = drawn, scores, n_features
        self.width = drawn.shape[1]
        # by the number of slots in which a neighbour is in another bin
        self.closeness = np.sqrt(np.exp(-np.arange(self.width + 1.0) / kernel**2))
        self.sums: dict[bytes, np.ndarray] = {}

    def of_pattern(self, own_bin: np.ndarray) -> np.ndarray:
        """Weighted sums of products of (1, same bin per slot, score) over the neighbours."""
        key = own_bin.tobytes()
        if key not in self.sums:
            if len(self.sums) >= self.LARGEST_TABLE:
                self.sums.clear()
            design = np.empty((len(self.drawn), self.width + 2))
            design[:, 0], design[:, 1:-1], design[:, -1] = 1.0, self.drawn == own_bin, self.scores
            apart = self.width - design[:, 1:-1].sum(axis=1).astype(int)
            self.sums[key] = design.T @ (self.closeness[apart][:, None] * design)
        return self.sums[key]

    def weights(self, own_bin: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
        """(slots, weights) of the surrogate of a row, largest first."""
        own = np.ones(self.width + 2)
        own[-1] = p
        sums = self.of_pattern(own_bin) + np.outer(own, own)
        total, sides = sums[0, 0], sums[0, 1:]
        centred = sums[1:, 1:] - np.outer(sides, sides) / total
        first = np.linalg.solve(centred[:-1, :-1] + 0.01 * np.eye(self.width), centred[:-1, -1])
        chosen = np.argsort(-np.abs(first), kind="stable")[: self.n_features]
        inner = centred[np.ix_(chosen, chosen)] + np.eye(len(chosen))
        weight = np.linalg.solve(inner, centred[chosen, -1])
        order = np.argsort(-np.abs(weight), kind="stable")
        return chosen[order], weight[order]


def lime_local(
    rows: DataFrame, id_col: str, train: DataFrame, scorer: Scorer, n_samples: int = 5000, n_features: int = 10,
    kernel_width: float | None = None, seed: int = 42,
) -> DataFrame:
    """(id, rank, feature, weight): a local linear surrogate per row on quartile bins.

    The row itself and ``n_samples`` - 1 neighbours, which draw a bin per slot by its
    share in ``train`` and a value evenly inside the bin, are scored; all rows share
    the neighbours.  A ridge regression on "same bin as the row" indicators, weighted
    by closeness, gives the slot weights.
    """
    bins = quartile_bins(train)
    width = len(bins)
    kernel = kernel_width if kernel_width is not None else 0.75 * width**0.5

    # the draws do not depend on the explained row: made and scored once, n_samples bounds what is collected
    rng = np.random.default_rng(seed)
    drawn, values = [], []
    for b in bins:
        cum = np.cumsum(np.array(b["n"]) / sum(b["n"]))[:-1]
        bin_ = np.searchsorted(cum, rng.random(n_samples - 1), side="right")
        low, high = np.array(b["low"], float)[bin_], np.array(b["high"], float)[bin_]
        drawn.append(bin_)
        values.append(low + rng.random(n_samples - 1) * (high - low))
    drawn, values = np.stack(drawn, axis=1).astype(np.int8), np.stack(values, axis=1)
    neighbours = rows.sparkSession.createDataFrame(
        [(i, v) for i, v in enumerate(values.tolist())], "sample int, x array<double>"
    )
    scores = scorer(neighbours).select("sample", "p").toPandas().sort_values("sample")["p"].to_numpy(float)
    tops = [np.array(b["high"][:-1], float) for b in bins]

    @F.pandas_udf("array<struct<rank: int, feature: string, weight: double>>")
    def surrogates(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        fits = Surrogates(drawn, scores, kernel, n_features)
        for x, p in parts:
            x = _matrix(x).reshape(-1, width)
            own_bins = np.stack([np.searchsorted(t, x[:, i], side="left") for i, t in enumerate(tops)], axis=1)
            out = []
            for own_bin, score in zip(own_bins.astype(np.int8), p):
                found = zip(*fits.weights(own_bin, score))
                out.append([(i, f"f{slot}", float(w)) for i, (slot, w) in enumerate(found, 1)])
            yield pd.Series(out, dtype=object)

    # each row is explained in its own task, against the same neighbours: nothing is shuffled but whole rows
    scored = scorer(rebalanced(rows.select(id_col, "x"))).select(id_col, surrogates("x", "p").alias("s"))
    return scored.select(id_col, F.inline("s"))
