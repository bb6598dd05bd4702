"""Side-by-side comparison of a registered query with its SQL twin in DuckDB."""

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return f"{value + 0.0:.12g}" if value != 0 else "0"
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql) -> str | None:
    """None where both agree, else a short description of the first difference."""
    left_cols, left = df.columns, [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    right_cols, right = [d[0] for d in result.description], result.fetchall()
    right_types = {d[0]: str(d[1]) for d in result.description}
    if sorted(left_cols) != sorted(right_cols):
        return f"columns {sorted(left_cols)} vs {sorted(right_cols)}"
    wide = [c for c, t in right_types.items() if "HUGEINT" in t or "DECIMAL" in t]
    if wide:
        return f"oracle columns {wide} need a cast: {right_types}"
    names = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = {c: (t, right_types[c]) for c, t in df.dtypes if t in names and names[t] != right_types[c]}
    if odd:
        return f"types differ: {odd}"
    a, b = _rows(left_cols, left), _rows(right_cols, right)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    if not a:
        return "no rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]} (columns {sorted(left_cols)})" if bad else None
