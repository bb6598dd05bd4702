"""Cross-entropy difference of whole texts under two matched n-gram models.

Tokens are the UTF-8 bytes of a text and an end mark, so both models share one closed
vocabulary of 256 values, and trigram counts over all documents are at most 2^24
rows however large the corpus.  The target model counts the documents chosen as
target, the background model all documents; its counts are scaled to the target's
number of tokens, so that equal smoothing weighs them equally.  A document's score is
the mean over its tokens of target loss minus background loss: lower is closer to
the target.
"""

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.tables import written

VALUES = 256
SMOOTHING = 8.0  # tokens of belief in the shorter context
MERGE_AT = 4_000_000


def trigrams(text: str) -> np.ndarray:
    """The codes of all trigrams of a text between two start marks and an end mark, each mark byte 0."""
    raw = np.frombuffer(b"\0\0" + text.encode("utf-8", "replace") + b"\0", np.uint8).astype(np.uint32)
    return (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(code, n_all, n_target) of one task's documents."""
    keys, n_all, n_target = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    waiting: tuple[list, list] = ([], [])

    def merged():
        parts = [np.unique(np.concatenate(w), return_counts=True) if w else ([], []) for w in waiting]
        code = np.concatenate([keys, *(np.asarray(k, np.int64) for k, _ in parts)])
        zero = [np.zeros(len(k), np.int64) for k, _ in parts]
        new, at = np.unique(code, return_inverse=True)
        others, targets = (np.asarray(n, np.int64) for _, n in parts)
        a = np.concatenate([n_all, others, targets])
        t = np.concatenate([n_target, zero[0], targets])
        return new, np.bincount(at, a, len(new)).astype(np.int64), np.bincount(at, t, len(new)).astype(np.int64)

    held = 0
    for frame in frames:
        for text, target in zip(frame["text"], frame["target"]):
            codes = trigrams(text)
            waiting[bool(target)].append(codes)
            held += len(codes)
            if held >= MERGE_AT:
                keys, n_all, n_target = merged()
                waiting, held = ([], []), 0
    if held:
        keys, n_all, n_target = merged()
    yield pd.DataFrame({"code": keys, "n_all": n_all, "n_target": n_target})


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(code, n_all, n_target) over every row of ``docs`` (text, target)."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("target", F.lit(False)).alias("target"))
    counted = texts.mapInPandas(_counted, "code long, n_all long, n_target long")
    return counted.groupBy("code").agg(F.sum("n_all").alias("n_all"), F.sum("n_target").alias("n_target"))


def losses(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """-log p(byte | two bytes before) for all 2^24 trigrams, smoothed by shorter contexts."""
    tri = np.zeros(VALUES**3, np.float32)
    tri[codes] = counts
    tri = tri.reshape(VALUES, VALUES, VALUES)
    bi = tri.sum(axis=0, dtype=np.float64)
    uni = bi.sum(axis=0)
    p1 = (uni + 1) / (uni.sum() + VALUES)
    p2 = (bi + SMOOTHING * p1) / (bi.sum(axis=1, keepdims=True) + SMOOTHING)
    out = tri
    for a in range(VALUES):  # in place: one 64 MB table per model
        context = tri[a].sum(axis=1, keepdims=True, dtype=np.float64)
        out[a] = -np.log((tri[a] + SMOOTHING * p2) / (context + SMOOTHING))
    return out.reshape(-1)


_TABLES: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _tables(model: str, shared) -> tuple[np.ndarray, np.ndarray]:
    """Both loss tables of a model, built once per worker process; an older model's go first."""
    if model not in _TABLES:
        _TABLES.clear()
        codes, n_all, n_target = shared.value
        scale = n_target.sum() / max(1, n_all.sum())
        _TABLES[model] = losses(codes, n_target), losses(codes, n_all * scale)
    return _TABLES[model]


def loss_columns(counts: DataFrame, text: str = "text") -> Column:
    """Struct (n_tokens, target_loss, background_loss), means per token of a whole text.

    ``counts`` has at most 2^24 rows (some 10^5 in real text), which bounds what is
    collected and broadcast.
    """
    found = counts.toPandas().sort_values("code")
    table = tuple(found[c].to_numpy(np.int64) for c in ("code", "n_all", "n_target"))
    shared, model = counts.sparkSession.sparkContext.broadcast(table), uuid4().hex

    @F.pandas_udf("n_tokens long, target_loss double, background_loss double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        target, background = _tables(model, shared)
        for part in texts:
            rows = []
            for text in part:
                codes = trigrams(text)
                rows.append((len(codes), target[codes].mean(dtype=float), background[codes].mean(dtype=float)))
            yield pd.DataFrame(rows, columns=["n_tokens", "target_loss", "background_loss"])

    return of(F.coalesce(F.col(text), F.lit("")))


def score(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference) for every row of ``docs`` (doc_id, text).

    ``target_ids`` (doc_id) names the target documents; repeated and null ids change
    nothing.  A null or empty text is the end mark alone.  Without any target document
    the target model is uniform.
    """
    ids = target_ids.select("doc_id").filter("doc_id is not null").distinct().withColumn("target", F.lit(True))
    # the target grows with the corpus: it is never broadcast, at any size
    marked = docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left")
    counts = written(trigram_counts(marked))
    scored = docs.select("doc_id", loss_columns(counts).alias("l")).select("doc_id", "l.*")
    return scored.withColumn("difference", F.col("target_loss") - F.col("background_loss"))
