"""A feed-forward network, with or without weights, fitted by gradients summed over all rows.

Spark's own network takes no weights, and its fit multiplies matrices in the JVM.  Here
every task sums the (weighted) loss and its gradient over its rows by matrix products, the
sums of the tasks are added in groups, and a limited-memory quasi-Newton step on the driver
moves the parameters, whose number depends on the layers only.  The fitted parameters become
one of Spark's own network models, so saving, scoring and evaluating it are those of any model.
"""

from collections import deque
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.columns import require_columns

ROWS_AT_ONCE = 512  # a layer's values of so many rows stay in a core's cache
TASKS_PER_CORE = 4  # of an evaluation over many kept rows
MANY_ROWS = 16_384  # a task
NUMBERS_PER_BLOCK = 512  # 10,000 blocks, a batch of Spark's, are 40 MB
GROUPS = 16  # sums of tasks are added in so many groups before the driver adds those
STEPS_KEPT = 10  # of the quasi-Newton method

# Parameters to (mean weighted loss, its gradient).
Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


def n_parameters(sizes: list[int]) -> int:
    return sum((n_in + 1) * n_out for n_in, n_out in zip(sizes, sizes[1:]))


def layers_of(flat: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(matrix out x in, bias) per layer, as views of the parameters in the order of Spark's model."""
    at, layers = 0, []
    for n_in, n_out in zip(sizes, sizes[1:]):
        matrix = flat[at : at + n_in * n_out].reshape((n_out, n_in), order="F")
        at += n_in * n_out
        layers.append((matrix, flat[at : at + n_out]))
        at += n_out
    return layers


def starting_parameters(sizes: list[int], seed: int = 42) -> np.ndarray:
    """Even draws as wide as the layers ask for; the biases start at 0."""
    rng, flat = np.random.default_rng(seed), np.zeros(n_parameters(sizes))
    for (matrix, _), n_in, n_out in zip(layers_of(flat, sizes), sizes, sizes[1:]):
        wide = np.sqrt(6.0 / (n_in + n_out))
        matrix[...] = rng.uniform(-wide, wide, matrix.shape)
    return flat


def _room(space: dict, name: str, n: int, width: int) -> np.ndarray:
    """An array of n rows in ``space``, the same one at each call, so that a batch asks for no new memory."""
    if name not in space or len(space[name]) < n:
        space[name] = np.empty((n, width))
    return space[name][:n]


def loss_and_gradient(
    flat: np.ndarray, sizes: list[int], x: np.ndarray, label: np.ndarray, weight: np.ndarray, space: dict | None = None
) -> tuple[float, np.ndarray]:
    """Weighted cross-entropy of a batch, summed, and its gradient; sigmoid layers below a softmax.

    With a ``space`` to work in, the gradient lies there and holds until the next call.
    """
    space = {} if space is None else space
    layers, inputs, n = layers_of(flat, sizes), [x], len(x)
    for i, (matrix, bias) in enumerate(layers[:-1]):
        out = np.matmul(inputs[-1], matrix.T, out=_room(space, f"out {i}", n, len(bias)))
        out += bias
        np.exp(np.negative(out, out=out), out=out)
        out += 1.0
        inputs.append(np.reciprocal(out, out=out))
    matrix, bias = layers[-1]
    top = inputs[-1] @ matrix.T + bias
    top -= top.max(axis=1, keepdims=True)
    log_share = top - np.log(np.exp(top).sum(axis=1, keepdims=True))
    row = np.arange(n)
    loss = -float((weight * log_share[row, label]).sum())
    error = np.exp(log_share)
    error[row, label] -= 1.0
    error *= weight[:, None]
    gradient = _room(space, "gradient", 1, len(flat))[0]
    for i, (to_matrix, to_bias) in reversed(list(enumerate(layers_of(gradient, sizes)))):
        below = inputs[i]
        np.matmul(below.T, error, out=to_matrix.T)
        np.sum(error, axis=0, out=to_bias)
        if i:
            matrix = layers[i][0]
            error = np.matmul(error, matrix, out=_room(space, f"error {i}", n, matrix.shape[1]))
            error *= below
            error *= np.subtract(1.0, below, out=below)
    return loss, gradient


_SUMS = "part int, loss double, weight double, gradient binary"


def _sums(part: int, loss: float, weight: float, gradient: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int32()), pa.array([loss]), pa.array([weight]), pa.array([gradient.tobytes()])]
    return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in _SUMS.split(", ")])


def _packed(width: int, classes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(x, label) to blocks of rows (x, label, weight) as bytes; rows equal to the one before add to its weight.

    A value that lies alone costs more to hand to a Python worker than its share of the arithmetic.
    A row that Spark's own fit would refuse is refused.
    """
    per_block = max(1, NUMBERS_PER_BLOCK // (width + 2))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.empty((batch.num_rows, width + 2))
            if (np.diff(batch["x"].offsets.to_numpy()) != width).any():
                raise ValueError(f"features must be {width} numbers")
            rows[:, :width] = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            rows[:, width] = batch["label"].to_numpy(zero_copy_only=False)  # NaN where null
            if not np.isfinite(rows[:, :width]).all():
                raise ValueError("features must be finite numbers")
            if not np.isin(rows[:, width], np.arange(classes)).all():
                raise ValueError(f"labels must be 0 to {classes - 1}, none null")
            other = (rows[1:, : width + 1] != rows[:-1, : width + 1]).any(axis=1)
            first = np.flatnonzero(np.concatenate([[True], other]))
            rows[first, width + 1] = np.diff(first, append=batch.num_rows)
            rows = rows[first]
            blocks = [rows[i : i + per_block].tobytes() for i in range(0, len(rows), per_block)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], ["block"])

    return pack


def _matrices(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, label, weight) of a batch of rows or of blocks."""
    if batch.schema.names == ["block"]:
        rows = np.frombuffer(b"".join(batch["block"].to_pylist())).reshape(-1, width + 2)
        return rows[:, :width], rows[:, width].astype(int), rows[:, width + 1]
    x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
    return x, batch["label"].to_numpy(zero_copy_only=False).astype(int), batch["weight"].to_numpy(zero_copy_only=False)


def distributed_objective(rows: DataFrame, sizes: list[int], tasks: int | None = None) -> Objective:
    """The objective over ``rows`` (x, label, weight), or blocks of them: one job per evaluation, no row leaves its task.

    Sums are added in the order of the tasks, so an evaluation gives the same numbers again.
    Those of a few ``tasks``, where their number is known, are added without groups.
    """
    spark = rows.sparkSession

    def objective(flat: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast(flat)  # as long as the network has parameters

        def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parameters = shared.value
            loss, weight, gradient, space = 0.0, 0.0, np.zeros_like(parameters), {}
            for batch in batches:
                x, label, weights = _matrices(batch, sizes[0])
                for start in range(0, len(x), ROWS_AT_ONCE):
                    part = slice(start, start + ROWS_AT_ONCE)
                    more = loss_and_gradient(parameters, sizes, x[part], label[part], weights[part], space)
                    loss += more[0]
                    gradient += more[1]
                weight += float(weights.sum())
            if weight:
                yield _sums(TaskContext.get().partitionId(), loss, weight, gradient)

        def of_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for row in batch.to_pylist():
                    own = [row["loss"], row["weight"], np.frombuffer(row["gradient"])]
                    total = [row["part"], *own] if total is None else [total[0], *(a + b for a, b in zip(total[1:], own))]
            if total is not None:
                yield _sums(*total)

        sums = rows.mapInArrow(of_task, _SUMS)
        if tasks is None or tasks > 4 * GROUPS:
            group = F.pmod(F.col("part"), F.lit(GROUPS))
            sums = sums.repartition(GROUPS, group).sortWithinPartitions("part").mapInArrow(of_group, _SUMS)
        found = sorted(sums.collect(), key=lambda r: r["part"])  # one row per group or task
        shared.destroy()
        if not found:
            raise ValueError("no rows with a weight to learn from")
        weight = sum(r["weight"] for r in found)
        gradient = np.sum([np.frombuffer(r["gradient"]) for r in found], axis=0)
        return sum(r["loss"] for r in found) / weight, gradient / weight

    return objective


def _direction(gradient: np.ndarray, steps: deque) -> np.ndarray:
    """Minus the gradient, bent by what the kept steps say about its change."""
    bent, shares = -gradient, []
    for moved, changed in reversed(steps):
        share = (moved @ bent) / (moved @ changed)
        shares.append(share)
        bent = bent - share * changed
    if steps:
        moved, changed = steps[-1]
        bent = bent * (moved @ changed) / (changed @ changed)
    for (moved, changed), share in zip(steps, reversed(shares)):
        bent = bent + (share - (changed @ bent) / (moved @ changed)) * moved
    return bent


def minimised(objective: Objective, start: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, list[float]]:
    """(parameters, loss after each step); steps end when the loss falls by less than ``tol`` of itself."""
    at, (loss, gradient) = start, objective(start)
    losses, steps = [loss], deque(maxlen=STEPS_KEPT)
    for _ in range(max_iter):
        direction = _direction(gradient, steps)
        slope = float(gradient @ direction)
        if slope >= 0:
            break
        length = 1.0 if steps else min(1.0, 1.0 / float(np.linalg.norm(gradient)))
        for _ in range(20):
            new = at + length * direction
            new_loss, new_gradient = objective(new)
            if new_loss <= loss + 1e-4 * length * slope:
                break
            length /= 2
        else:
            break
        moved, changed = new - at, new_gradient - gradient
        if moved @ changed > 1e-12 * float(changed @ changed):
            steps.append((moved, changed))
        fell = loss - new_loss
        at, loss, gradient = new, new_loss, new_gradient
        losses.append(loss)
        if fell <= tol * max(abs(loss), 1e-12):
            break
    return at, losses


class _Point(NamedTuple):
    """A point of a line: its place, the loss, the slope along the line, the parameters and their gradient."""

    t: float
    loss: float
    slope: float
    at: np.ndarray
    gradient: np.ndarray


def _cubic_minimum(left: _Point, right: _Point) -> float:
    """Where the cubic through two points with their slopes is lowest, a tenth of the way inside at least."""
    wide = right.t - left.t
    bend = left.slope + right.slope - 3 * (right.loss - left.loss) / wide
    root = np.sqrt(max(bend * bend - left.slope * right.slope, 0.0))
    below = right.slope - left.slope + 2 * root
    share = 1 - (right.slope + root - bend) / below if below else 0.5
    return left.t + wide * min(max(float(share), 0.1), 0.9)


def _wolfe_point(
    objective: Objective, at: np.ndarray, loss: float, gradient: np.ndarray, direction: np.ndarray, length: float
) -> _Point | None:
    """A point along ``direction`` under the strong Wolfe conditions: the loss fell enough and is flat enough there."""

    def point(t: float) -> _Point:
        new = at + t * direction
        new_loss, new_gradient = objective(new)
        return _Point(t, new_loss, float(new_gradient @ direction), new, new_gradient)

    first = _Point(0.0, loss, float(gradient @ direction), at, gradient)

    def too_high(p: _Point) -> bool:
        return p.loss > first.loss + 1e-4 * p.t * first.slope

    def flat(p: _Point) -> bool:
        return abs(p.slope) <= 0.9 * abs(first.slope)

    def between(low: _Point, high: _Point) -> _Point | None:
        for _ in range(10):
            p = point(_cubic_minimum(*sorted((low, high), key=lambda q: q.t)))
            if too_high(p) or p.loss >= low.loss:
                high = p
                continue
            if flat(p):
                return p
            if (p.slope > 0) == (high.t > low.t):
                high = low
            low = p
        return None

    if first.slope >= 0:
        return None
    low, t = first, length
    for i in range(10):
        p = point(t)
        if not np.isfinite(p.loss):
            t /= 2
            continue
        if too_high(p) or (i and p.loss >= low.loss):
            return between(low, p)
        if flat(p):
            return p
        if p.slope >= 0:
            return between(p, low)
        low, t = p, t * 1.5
    return None


def minimised_by_wolfe(
    objective: Objective, start: np.ndarray, max_iter: int, tol: float
) -> tuple[np.ndarray, list[float]]:
    """(parameters, loss after each step) by the steps of Spark's own fit.

    They end after ``max_iter``, when the gradient is below ``tol`` of the loss, when the
    last twenty losses lie within ``tol`` of the first loss, or when no step helps.
    """
    at, (loss, gradient) = start, objective(start)
    losses, steps = [loss], deque(maxlen=STEPS_KEPT)
    while len(losses) <= max_iter:
        still = len(losses) > 20 and max(losses[-20:]) - loss <= tol * abs(losses[0])
        if still or np.linalg.norm(gradient) <= max(tol * abs(loss), 1e-8):
            break
        direction = _direction(gradient, steps)
        length = 1.0 if len(losses) > 1 else 1.0 / float(np.linalg.norm(direction))
        found = _wolfe_point(objective, at, loss, gradient, direction, length)
        if found is None:
            if not steps:
                break
            steps.clear()  # once more, straight down
            continue
        steps.append((found.at - at, found.gradient - gradient))
        _, loss, _, at, gradient = found
        losses.append(loss)
    return at, losses


def as_spark_model(flat: np.ndarray, sizes: list[int], example: DataFrame, **settings) -> PipelineModel:
    """Spark's own network model with the given parameters.

    Spark builds it from ``example``, a row or two, starting at the parameters and
    moving them by a step too short to change a number.
    """
    shell = MultilayerPerceptronClassifier(
        layers=sizes, solver="gd", maxIter=1, stepSize=1e-300, initialWeights=Vectors.dense(flat), **settings
    )
    return Pipeline(stages=[shell]).fit(example)


def train_weighted_network(
    train: DataFrame, hidden: tuple[int, ...], weight: str | None = "weight", max_iter: int = 20, tol: float = 1e-6,
    seed: int = 42, features: str = "features", label: str = "label",
) -> tuple[PipelineModel, list[float]]:
    """(model, loss after each step) of a network with two outputs, each row counting by its ``weight``.

    A weight of 2 is the same as the row twice; without a weight column every row counts
    once.  ``train`` is read once per evaluation: pass a written table.
    """
    require_columns(train, [features, label, *([weight] if weight else [])])
    counts = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = train.select(
        vector_to_array(features).alias("x"), F.col(label).cast("int").alias("label"), counts.alias("weight")
    )
    example = train.select(F.col(features).alias("features"), F.col(label).cast("double").alias("label")).limit(1)
    first = example.first()
    if first is None:
        raise ValueError("no rows to learn from")
    sizes = [first["features"].size, *hidden, 2]
    flat, losses = minimised(distributed_objective(rows, sizes), starting_parameters(sizes, seed), max_iter, tol)
    return as_spark_model(flat, sizes, example, featuresCol="features", labelCol="label"), losses


def fit_as_spark(network: MultilayerPerceptronClassifier, train: DataFrame) -> PipelineModel:
    """The fit that ``network`` makes by its L-BFGS steps, with gradients by matrix products.

    It starts at Spark's own starting parameters of the seed.  The loss is the mean over all
    rows; Spark's is the mean over blocks, so that a row counts more in a block that is not
    full.  The rows are dealt evenly to tasks and kept until the fit ends.
    """
    sizes, spark = list(network.getLayers()), train.sparkSession
    features, label = network.getFeaturesCol(), network.getLabelCol()
    example = spark.createDataFrame([(Vectors.dense([0.0] * sizes[0]), 0.0)], [features, label])
    still = {network.solver: "gd", network.maxIter: 1, network.stepSize: 1e-300}  # moves no parameter
    if network.isSet(network.initialWeights):
        start = network.getInitialWeights().toArray()
    else:
        start = network.copy(still).fit(example).weights.toArray()
    cores = spark.sparkContext.defaultParallelism
    rows = train.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("label"))
    blocks = rows.mapInArrow(_packed(sizes[0], sizes[-1]), "block binary").repartition(TASKS_PER_CORE * cores)
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n_rows = blocks.count() * NUMBERS_PER_BLOCK // (sizes[0] + 2)  # about
        if not n_rows:
            return Pipeline(stages=[network]).fit(train)
        tasks = cores if n_rows < TASKS_PER_CORE * cores * MANY_ROWS else TASKS_PER_CORE * cores
        objective = distributed_objective(blocks.coalesce(tasks), sizes, tasks)
        flat, _ = minimised_by_wolfe(objective, start, network.getMaxIter(), network.getTol())
    finally:
        blocks.unpersist()
    model = Pipeline(stages=[network.copy({**still, network.initialWeights: Vectors.dense(flat)})]).fit(example)
    last = model.stages[-1]
    for param in (*still, network.initialWeights):
        if network.isSet(param):
            last.set(last.getParam(param.name), network.getOrDefault(param))
        else:
            last.clear(last.getParam(param.name))
    return model
