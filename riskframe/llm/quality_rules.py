"""A sparse rule ensemble that scores the quality of whole texts.

Shallow trees grown on text statistics give conjunctive rules, one per path from a
root to a node.  A lasso logistic regression weighs the rules and drops most of
them; what is left is compiled into one Spark column expression.
"""

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.tables import written

STATISTICS = (
    "log_words",
    "mean_word_bytes",
    "longest_word",
    "distinct_share",
    "top_word_share",
    "adjacent_repeats",
    "short_word_share",
    "upper_share",
    "symbol_share",
    "exclamations",
    "bars",
    "sentence_marks",
    "digit_share",
    "high_byte_share",
    "lines_per_word",
    "repeated_lines",
)
MAX_LABELLED = 20_000  # labelled rows a fit may use, the first in the order of a hash of their id
TREES, DEPTH = 30, 3
LASSO = 0.002
LASSO_STEPS = 25
SYMBOLS = b"#$%&*+/<=>@[]\\^_`{|}~"


def text_statistics(text: str) -> tuple[float, ...]:
    """The STATISTICS of one whole text; all 0 for an empty one."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    per_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    upper, lower = per_byte[65:91].sum(), per_byte[97:123].sum()
    visible = int(lengths.sum())
    return (
        float(np.log1p(n)),
        visible / n,
        float(np.log1p(lengths.max())),
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(eq, words, islice(words, 1, None))) / n,
        float((lengths <= 3).mean()),
        float(upper / max(1, upper + lower)),
        float(per_byte[list(SYMBOLS)].sum() / visible),
        float(per_byte[ord("!")] / n),
        float(per_byte[ord("|")] / n),
        float(per_byte[[ord("."), ord("?"), ord("!")]].sum() / n),
        float(per_byte[48:58].sum() / visible),
        float(per_byte[128:].sum() / visible),
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
    )


@F.pandas_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS]))
def _statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_statistics(t) for t in texts], columns=list(STATISTICS), dtype=float)


def statistics(text: str = "text") -> Column:
    """The statistics of a text column as one struct; null counts as empty."""
    return _statistics(F.coalesce(F.col(text), F.lit("")))


@dataclass(frozen=True)
class Rule:
    """All of: low < statistic <= high, for each (statistic, low, high)."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self, struct: str) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            if low > -np.inf:
                out = out & (F.col(f"{struct}.{name}") > F.lit(low))
            if high < np.inf:
                out = out & (F.col(f"{struct}.{name}") <= F.lit(high))
        return out


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    weighted: tuple[tuple[Rule, float], ...]

    def score(self, struct: str = "statistics") -> Column:
        """The probability of label 1 as an expression over a struct of statistics."""
        z = F.lit(self.intercept)
        for rule, weight in self.weighted:
            z = z + F.when(rule.column(struct), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def tree_rules(tree: str, names: tuple[str, ...] = STATISTICS) -> Iterable[Rule]:
    """A rule for every node below the root of a tree printed by Spark ML."""
    path: list[tuple[str, float, float]] = []
    for line in tree.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not found:
            continue
        depth = len(found[1])
        path = [step for step in path if step[0] < depth]
        cut = float(found[4])
        low, high = (-np.inf, cut) if found[3] == "<=" else (cut, np.inf)
        path.append((depth, names[int(found[2])], low, high))
        bounds: dict[str, tuple[float, float]] = {}
        for _, name, a, b in path:
            was = bounds.get(name, (-np.inf, np.inf))
            bounds[name] = (max(a, was[0]), min(b, was[1]))
        yield Rule(tuple(sorted((name, a, b) for name, (a, b) in bounds.items())))


def fit_rules(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleModel:
    """A model of ``label`` (0 or 1) from rows of (statistics, label).

    With rows of one class only, or none, the model is the smoothed share of label 1.
    """
    seen = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = seen.get(1, 0), seen.get(0, 0)
    prior = float(np.log((ones + 1) / (zeros + 1)))
    if not ones or not zeros:
        return RuleModel(prior, ())
    vectors = labelled.select(
        array_to_vector(F.array(*[F.col(f"statistics.{s}") for s in STATISTICS])).alias("features"),
        F.col("label").cast("double").alias("label"),
        "statistics",
    )
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, subsamplingRate=0.5, seed=7
    ).fit(vectors.select("features", "label"))
    rules = sorted({r for t in forest.trees for r in tree_rules(t.toDebugString)}, key=lambda r: r.bounds)
    if not rules:
        return RuleModel(prior, ())
    fired = vectors.select(
        array_to_vector(F.array(*[r.column("statistics").cast("double") for r in rules])).alias("features"), "label"
    )
    lasso_fit = LogisticRegression(
        elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=LASSO_STEPS, tol=1e-4
    ).fit(fired)
    weighted = tuple((r, float(w)) for r, w in zip(rules, lasso_fit.coefficients.toArray()) if abs(w) > 1e-6)
    return RuleModel(float(lasso_fit.intercept), weighted)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fifth of the ids that no fit may see; a null id is never used in a fit."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> RuleModel:
    """A model from ``labels`` (doc_id, quality), of which the held-out fold is left aside.

    The fit reads at most ``max_labelled`` labels, the lowest in the order of a hash
    of the id; so the side that is broadcast to find their texts is bounded too.  Labels
    with a null id, or a quality other than 0 and 1, are left out; a repeated label, and
    a document that occurs several times, counts as often as it occurs; a null text is
    an empty one.  Without a label, or with labels of one class only, the model is the
    smoothed share of label 1.  Columns beside the named ones are not looked at.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out()).select("doc_id", F.col("quality").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_labelled)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return fit_rules(written(found.select(statistics().alias("statistics"), "label")))


def score_documents(docs: DataFrame, model: RuleModel) -> DataFrame:
    """``docs`` with a ``score`` in 0 to 1 from the whole text only.

    A null text scores like an empty one, equal texts score alike, an empty table stays
    empty.  A column ``score`` or ``statistics`` of ``docs`` is replaced or dropped; a
    caller that needs it keeps the row in a struct, as the pipeline does.
    """
    columns = [F.col(c) for c in docs.columns if c not in ("statistics", "score")]
    return docs.select(*columns, statistics().alias("statistics")).select(*columns, model.score().alias("score"))
