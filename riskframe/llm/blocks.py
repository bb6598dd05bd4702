"""Comparing the members of large buckets in pieces of bounded size."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_blocks(rows: DataFrame, size: str, item: str, block: int) -> DataFrame:
    """``rows`` of buckets with ``size`` members, with ``block``, ``block_a`` and ``block_b``.

    A bucket is cut by a hash of ``item`` into blocks of about ``block`` members; every
    two blocks, and each with itself, meet in one group (bucket, block_a, block_b).  A
    bucket of one block is sent once; one of b blocks is sent b times, in groups that
    go to different tasks.
    """
    blocks = F.ceil(F.col(size) / block).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(item, F.lit(5)), blocks).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    sides = {"block_a": F.least("block", "other"), "block_b": F.greatest("block", "other")}
    return rows.withColumns(sides).drop("other", size)


def grouped(rows: DataFrame, key: str, item: str) -> DataFrame:
    """``rows`` laid out for :func:`sorted_groups` by (key, block_a, block_b)."""
    group = [key, "block_a", "block_b"]
    return rows.repartition(*group).sortWithinPartitions(*group, item)


def sorted_groups(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """The runs of equal ``columns`` with at least two rows, from frames sorted by them."""
    rest = None
    for frame in frames:
        if rest is not None:
            frame = pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        keys = frame[columns].to_numpy()
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        for start, end in zip(starts[:-1], starts[1:]):
            if end - start > 1:
                yield frame.iloc[start:end]
        rest = frame.iloc[starts[-1] :].reset_index(drop=True)
    if rest is not None and len(rest) > 1:
        yield rest
