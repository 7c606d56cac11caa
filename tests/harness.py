"""Spark results against DuckDB's on the same Parquet tables, order aside."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings collection queries run qrel "
    "train_concepts_units_extended unit_ref concept_ref eval_items mix_target"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return c


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    if hasattr(x, "asDict"):
        return tuple(_cell(v) for v in x)
    if isinstance(x, (list, tuple)):
        return tuple(_cell(v) for v in x)
    return x


def differences(df, sql: str, c: duckdb.DuckDBPyConnection) -> list[str]:
    """What differs: columns, row counts, rows."""
    got = df.collect()
    want = c.execute(sql)
    names = [d[0] for d in want.description]
    rows = want.fetchall()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    types = {r[0]: kinds.get(r[1], r[1]) for r in c.execute(f"DESCRIBE {sql}").fetchall()}
    if wrong := {n: (t, types[n]) for n, t in df.dtypes if t != types[n]}:
        return [f"types {wrong}"]
    order = sorted(names)
    a = Counter(tuple(_cell(r[n]) for n in order) for r in got)
    b = Counter(tuple(_cell(r[names.index(n)]) for n in order) for r in rows)
    out = [f"rows {len(got)} and {len(rows)}"] if len(got) != len(rows) else []
    if a != b:
        out.append(f"{sum((a - b).values())} rows only in Spark, as {list((a - b))[:2]}; {sum((b - a).values())} only in SQL, as {list((b - a))[:2]}")
    return out
