"""Near-duplicate texts by HyperMinHash registers, banding and exact verification.

A text's shingle hashes are dealt to REGISTERS buckets.  A register keeps the
smallest hash of its bucket as a floating point number: the count of leading zeros
and MANTISSA_BITS bits after the leading one.  Bands of registers propose
candidates, registers estimate their Jaccard similarity with a correction for
chance collisions, and full shingle sets confirm it.

Texts with equal sets are one class from the start, so copies cost one row each.
Within a bucket of a band, every class is first compared with one random member;
what that links is merged, and then all members of different components are
compared block by block.  Only classes of one component are never compared, so
no link that could join two components is lost.

That second comparison never writes a pair.  A block first names, from registers
alone, its members that have a candidate in another component; only these members
come back to it with their full sets, are compared there, and what is linked leaves it
as a spanning forest.  Members of a bucket's largest component need no comparison with
each other, so each of them lies in one block only; the others visit every block.  So a
bucket of m members, o of them outside its largest component, makes at most m + o rows
per further block.
"""

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.blocks import sorted_groups
from riskframe.llm.components import connected_components
from riskframe.llm.shingles import WordHashes, mix, shingle_set
from riskframe.llm.tables import written

REGISTERS = 160
BAND_REGISTERS = 5  # at similarity 0.8 all 32 bands miss with probability 3e-6
BANDS = REGISTERS // BAND_REGISTERS
MANTISSA_BITS = 10
ROWS_AT_ONCE = 500
BLOCK = 2048  # members of one bucket that are compared in one piece
BLOCK_SHINGLES = 2_000_000  # and their shingles, on average
DEVIATIONS = 5.0  # an estimate this many standard errors below the threshold is still verified

_ORDERS = np.argsort(np.random.default_rng(11).random((REGISTERS, REGISTERS)), axis=1)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The compressed registers of a set; 0 marks an empty bucket."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(shingles):
        return out
    spread = mix(shingles + np.uint64(0x632BE59BD9B4E019))
    bucket = ((spread >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    packed = np.sort((bucket << np.uint64(56)) | (mix(spread) >> np.uint64(8)))
    bucket = (packed >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    smallest = (packed[first] & np.uint64((1 << 56) - 1)).astype(np.float64)
    fraction, exponent = np.frexp(smallest)
    zeros = np.where(smallest > 0, 56 - exponent, 56).astype(np.int64)
    mantissa = np.where(smallest > 0, (2 * fraction - 1) * (1 << MANTISSA_BITS), 0).astype(np.int64)
    out[bucket[first]] = (np.clip(zeros, 0, 56) << MANTISSA_BITS) + mantissa + 1
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One key per band; an empty register borrows the first filled one in its own random order."""
    filled = regs > 0
    own = np.arange(REGISTERS)
    source = np.where(filled, own, _ORDERS[own, filled[_ORDERS].argmax(axis=1)])
    cells = ((source.astype(np.uint64) << np.uint64(16)) | regs[source]).reshape(BANDS, BAND_REGISTERS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(BAND_REGISTERS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, i])
    return key.view(np.int64)


def corrected_jaccard(a: np.ndarray, b: np.ndarray, size_a, size_b) -> tuple[np.ndarray, np.ndarray]:
    """Estimates from rows of registers, and how many buckets each rests on.

    Two unrelated buckets share a register by chance.  With n and m elements their
    minima fall like exponentials with rates n and m, and a register covers 2^-bits
    of its own octave, 1/(2 ln 2) of the value on average; hence the expected share.
    """
    used = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    n, m = np.asarray(size_a, float), np.asarray(size_b, float)
    chance = n * m / np.maximum(n + m, 1) ** 2 / (2 * np.log(2) * (1 << MANTISSA_BITS))
    return (same / np.maximum(used, 1) - chance) / (1 - chance), used


def worth_verifying(a, b, size_a, size_b, threshold: float) -> np.ndarray:
    estimate, used = corrected_jaccard(a, b, size_a, size_b)
    slack = DEVIATIONS * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))
    ratio = np.minimum(size_a, size_b) >= threshold * np.maximum(size_a, size_b)
    return (estimate >= threshold - slack) & ratio


def in_parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The batches in parts of ROWS_AT_ONCE rows, so that results leave a task before many are held."""
    for batch in batches:
        for start in range(0, len(batch), ROWS_AT_ONCE):
            yield batch.iloc[start : start + ROWS_AT_ONCE]


def sketch(text: Column, width: int) -> Column:
    """Struct of n_shingles, digest of the set and registers; null counts as empty."""

    @F.pandas_udf("n_shingles long, digest binary, registers binary")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for part in in_parts(texts):
            rows = []
            for text in part:
                shingles = shingle_set(text, width, hashes)
                digest = blake2b(shingles.tobytes(), digest_size=16).digest()
                rows.append((len(shingles), digest, registers(shingles).tobytes()))
            yield pd.DataFrame(rows, columns=["n_shingles", "digest", "registers"])

    return of(F.coalesce(text, F.lit("")))


def bands(registers_: str) -> Column:
    """The band keys of a set from its registers, which must not all be empty."""

    @F.pandas_udf("array<long>")
    def of(packed: pd.Series) -> pd.Series:
        return pd.Series([band_keys(regs) for regs in _matrix(packed)], dtype=object)

    return of(F.col(registers_))


def full_sets(text: Column, width: int) -> Column:
    @F.pandas_udf("digest binary, shingles array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for part in in_parts(texts):
            sets = [shingle_set(text, width, hashes) for text in part]
            digests = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pd.DataFrame({"digest": digests, "shingles": [s.view(np.int64) for s in sets]})

    return of(F.coalesce(text, F.lit("")))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, REGISTERS)


def promising(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose registers do not rule out the threshold, with the ``estimate``."""

    @F.pandas_udf("double")
    def estimate(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        a, b, n, m = _matrix(a), _matrix(b), n.to_numpy(), m.to_numpy()
        return pd.Series(np.where(worth_verifying(a, b, n, m, threshold), corrected_jaccard(a, b, n, m)[0], -1.0))

    side = classes.select("class_id", "n_shingles", "registers")
    both = pairs.join(side.toDF("a", "n_a", "regs_a"), "a").join(side.toDF("b", "n_b", "regs_b"), "b")
    both = both.select("a", "b", estimate("regs_a", "regs_b", "n_a", "n_b").alias("estimate"))
    return both.filter("estimate >= 0")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` (a, b, any others) with 100 * intersection >= percent * union on their full sets."""
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b")).alias("common")
    both = both.select(*pairs.columns, common, (F.size("set_a") + F.size("set_b")).alias("sizes"))
    linked = F.col("common") * 100 >= (F.col("sizes") - F.col("common")) * percent
    return both.filter(linked).select(*pairs.columns)


def _first_band(regs: np.ndarray, key: int) -> tuple[np.ndarray, int]:
    """The band keys of rows of registers that share ``key``, and which band it is."""
    keys = np.stack([band_keys(r) for r in regs])
    return keys, int((keys[0] == key).argmax())


def _with_candidates(threshold: float):
    """The members of a block that have a candidate in another component, with the block they have it in.

    Compared are the members at home in the block with each other and with the block's
    visitors.  A pair that shares several bands is looked at in the first of them only.
    """

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in sorted_groups(frames, ["key", "block"]):
            comps = group["component"].to_numpy()
            if (comps == comps[0]).all():
                continue
            regs, sizes = _matrix(group["registers"]), group["n_shingles"].to_numpy()
            at_home = group["home"].to_numpy() == group["block"].iat[0]
            keys, band = _first_band(regs, group["key"].iat[0])
            found = np.zeros(len(comps), bool)
            for i in range(len(comps) - 1):
                open_ = comps[i + 1 :] != comps[i]
                if not at_home[i]:
                    open_ &= at_home[i + 1 :]
                if found[i]:
                    open_ &= ~found[i + 1 :]
                other = np.flatnonzero(open_) + i + 1
                if band and len(other):
                    other = other[~(keys[other, :band] == keys[i, :band]).any(axis=1)]
                if len(other):
                    other = other[worth_verifying(regs[[i]], regs[other], sizes[i], sizes[other], threshold)]
                    found[other] = True
                    found[i] |= bool(len(other))
            if found.any():
                yield group.loc[found, ["class_id", "component", "key", "block"]]

    return members


class Joined(dict):
    """Which components a block has joined so far; one that is not here stands for itself."""

    def root(self, component: int) -> int:
        while (up := self.get(component, component)) != component:
            self[component] = component = self.get(up, up)
        return component


def linked_forest(comps: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of components that links between their members join: a spanning forest of them.

    Compared are all members whose components are not joined yet, on their full sets.
    Members are ordered by size, so a set is compared with those that are not too large
    for it only.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    comps, sets = comps[order].tolist(), [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    _, numbered = np.unique(np.concatenate(sets), return_inverse=True)
    numbered, ends = numbered.ravel(), np.cumsum(sizes)
    inside = np.zeros(int(numbered.max()) + 1, bool)
    joined, forest = Joined(), []
    for i in range(len(sets) - 1):
        last = int(np.searchsorted(sizes, sizes[i] * 100 // percent, side="right"))
        own = numbered[ends[i] - sizes[i] : ends[i]]
        open_ = [j for j in range(i + 1, last) if joined.root(comps[j]) != joined.root(comps[i])]
        if not open_:
            continue
        inside[own] = True
        for j in open_:
            common = np.count_nonzero(inside[numbered[ends[j] - sizes[j] : ends[j]]])
            a, b = joined.root(comps[i]), joined.root(comps[j])
            if a != b and 100 * common >= percent * (sizes[i] + sizes[j] - common):
                joined[max(a, b)] = min(a, b)
                forest.append((comps[i], comps[j]))
        inside[own] = False
    return forest


def _links(percent: int):
    """A block's spanning forest of components, from its members' full sets."""

    def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in sorted_groups(frames, ["key", "block"]):
            sets = [np.asarray(s, np.int64) for s in group["shingles"]]
            forest = linked_forest(group["component"].to_numpy(), sets, percent)
            if forest:
                yield pd.DataFrame(forest, columns=["a", "b"])

    return links


def open_members(labelled: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, once per block that they are compared in.

    ``labelled`` holds (key, class_id, component, n_shingles).  A bucket is cut by a hash
    into blocks of about BLOCK members and BLOCK_SHINGLES shingles.  A member of its
    largest component is sent to its own block, ``home``, only; any other to all of them.
    """
    parts = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"))
    largest = F.max_by("component", F.struct("n", "component")).alias("largest")
    blocks = F.ceil(F.greatest(F.sum("n") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    mixed = parts.groupBy("key").agg(F.count(F.lit(1)).alias("components"), largest, blocks)
    rows = labelled.join(mixed.filter("components > 1").drop("components"), "key")
    rows = rows.withColumn("home", F.pmod(F.xxhash64("class_id", F.lit(5)), F.col("blocks")).cast("int"))
    visited = F.when(F.col("component") == F.col("largest"), F.array("home")).otherwise(
        F.sequence(F.lit(0), F.col("blocks") - 1)
    )
    return rows.withColumn("block", F.explode(visited)).drop("blocks", "largest")


def in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` laid out for :func:`riskframe.llm.blocks.sorted_groups` by (key, block)."""
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "class_id")


def row_hashes(id_col: str = "doc_id", text: str = "text") -> list[Column]:
    """Two independent 64-bit hashes that together name a row by its id and text; equal rows share them."""
    return [F.xxhash64(id_col, text).alias("hash_a"), F.xxhash64(F.lit(1), text, F.lit(2), id_col).alias("hash_b")]


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Beside these, ``component`` names the group (null for texts without shingles) and
    hash_a and hash_b the row, for callers that go back to the texts.

    Rows are linked where 100 * intersection >= percent * union of their distinct
    ``width``-word shingle sets.  component_id is the smallest doc_id reachable by
    links, kept says whether the row has it.  A null or empty text has no shingles,
    is linked with nothing and keeps its own id.  Null ids are never smallest unless
    alone; repeated rows get equal results.  Reads ``docs`` twice.
    """
    threshold = percent / 100
    texts = docs.select("doc_id", "text")
    rows = texts.select("doc_id", *row_hashes(), sketch(F.col("text"), width).alias("s")).select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", "hash_a", "hash_b", "s.*"
    )
    rows = written(rows)
    first = F.min(F.struct("row_id", "doc_id", "n_shingles", "registers")).alias("f")
    classes = rows.filter("n_shingles > 0").groupBy("digest").agg(first)
    classes = written(
        classes.select(F.col("f.row_id").alias("class_id"), "digest", "f.doc_id", "f.n_shingles", "f.registers")
    )
    members = classes.select("class_id", "n_shingles", F.explode(bands("registers")).alias("key"))
    # a random member of each bucket of at least two
    pick = F.min(F.struct(F.xxhash64("class_id", "key").alias("draw"), "class_id"))
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), pick.alias("pick")).filter("n > 1")
    shared = written(members.join(buckets.select("key", "n", F.col("pick.class_id").alias("pivot")), "key"))
    stars = shared.filter("class_id != pivot").select(F.col("class_id").alias("a"), F.col("pivot").alias("b"))
    stars = written(promising(stars.distinct(), classes, threshold))

    best = stars.groupBy("a").agg(F.max_by("b", "estimate").alias("b"))
    # the classes of shared buckets are all that the two rounds can compare
    wanted = shared.select("class_id").distinct().join(classes.select("class_id", "doc_id", "digest"), "class_id")
    wanted = written(wanted)
    same_id = texts["doc_id"].eqNullSafe(F.col("wanted_id"))
    sets = texts.join(wanted.select(F.col("doc_id").alias("wanted_id")).distinct(), same_id, "left_semi")
    sets = sets.select(full_sets(F.col("text"), width).alias("s")).select("s.*")
    sets = sets.join(wanted.select("digest", "class_id"), "digest").dropDuplicates(["class_id"])
    sets = written(sets.select("class_id", "shingles"))
    links = written(verified(best, sets, percent))

    merged = connected_components(links)
    labelled = shared.join(merged.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "key", "class_id", "n_shingles", F.coalesce("component", "class_id").alias("component")
    )
    flagged = written(
        in_blocks(open_members(labelled).join(classes.select("class_id", "registers"), "class_id")).mapInPandas(
            _with_candidates(threshold), "class_id long, component long, key long, block int"
        )
    )
    compared = in_blocks(flagged.join(sets, "class_id")).select("component", "shingles", "key", "block")
    across = compared.mapInPandas(_links(percent), "a long, b long")
    # whole components are the nodes now, so the second contraction is as small as what was still open
    joined = connected_components(across).toDF("first", "last")
    components = merged.join(joined, merged["component"] == joined["first"], "left")
    components = components.select("node", F.coalesce("last", "component").alias("component"))
    alone = joined.join(merged, joined["first"] == merged["node"], "left_anti").toDF("node", "component")
    components = components.unionByName(alone).withColumnRenamed("node", "class_id")
    of_class = classes.select("class_id", "digest").join(components, "class_id", "left")
    of_class = of_class.select("digest", F.coalesce("component", "class_id").alias("component"))
    of_row = rows.select("doc_id", "hash_a", "hash_b", "n_shingles", "digest").join(of_class, "digest", "left")
    of_row = written(of_row.drop("digest"))
    smallest = of_row.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = of_row.join(smallest, "component", "left").withColumn("component_id", own)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return out.select("doc_id", "n_shingles", "component_id", kept, "component", "hash_a", "hash_b")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates.

    The row with the smallest doc_id of a group stays; of several with that id, the one
    whose hashes of id and text are smallest, and of rows equal in both the first in the
    order of all columns, so a rerun keeps the same row.  A null or empty text is a
    group of its own per id; equal rows stay once; an empty table stays empty; names of
    other columns do not matter.
    """
    kept = near_duplicates(docs, width, percent).filter("kept")
    alone = F.when(F.col("component").isNull(), F.col("hash_a")).alias("alone")
    stays = kept.groupBy("component", alone).agg(F.min(F.struct("hash_a", "hash_b")).alias("h")).select("h.*")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), *row_hashes())
    found = rows.join(stays.distinct(), ["hash_a", "hash_b"], "left_semi")
    return found.groupBy("hash_a", "hash_b").agg(F.min("doc").alias("doc")).select("doc.*")
