"""Reproducible random draws as a function of a row's integer id.

A draw depends on the id and the purpose only, so it does not change when the
data is repartitioned, a task is retried or a file is split differently, which
``rand``, ``sample`` and ``randomSplit`` cannot promise.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2147483647  # 2^31 - 1: products of two residues stay inside a BIGINT
HIGH_BITS = 1000003  # keeps ids that differ above bit 31 apart

# One multiplier and offset per purpose keeps the draws independent.
PURPOSES = {
    "split": (1103515245, 12345),
    "sample": (1664525, 1013904223),
    "stratify": (69069, 362437),
    "subset": (1812433253, 1),
    "foreground": (134775813, 907633385),
    "background": (214013, 2531011),
    "category": (22695477, 41),
    "boost": (16843009, 826366247),
    "minority": (1140671485, 12820163),
    "draw": (279470273, 77),
}


def residue(id_col, purpose: str) -> Column:
    """Integer in [0, MODULUS): the id folded to 31 bits, an affine step, a square."""
    multiplier, offset = PURPOSES[purpose]
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    id_col = id_col.cast("long")
    folded = F.pmod(id_col, F.lit(MODULUS)) + F.shiftright(id_col, 31) * F.lit(HIGH_BITS)
    start = F.pmod(folded, F.lit(MODULUS))
    step = (start * F.lit(multiplier).cast("long") + F.lit(offset).cast("long")) % F.lit(MODULUS)
    return (step * step) % F.lit(MODULUS)


def uniform(id_col, purpose: str) -> Column:
    """Double in [0, 1)."""
    return residue(id_col, purpose).cast("double") / F.lit(float(MODULUS))


def residue_sql(id_expr: str, purpose: str) -> str:
    """The same draw as SQL text for non-negative ids."""
    multiplier, offset = PURPOSES[purpose]
    start = f"((({id_expr}) % {MODULUS} + (({id_expr}) >> 31) * {HIGH_BITS}) % {MODULUS})"
    step = f"({start} * {multiplier} + {offset}) % {MODULUS}"
    return f"((({step}) * ({step})) % {MODULUS})"


def uniform_sql(id_expr: str, purpose: str) -> str:
    return f"(CAST({residue_sql(id_expr, purpose)} AS DOUBLE) / CAST({MODULUS} AS DOUBLE))"
