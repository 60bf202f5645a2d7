"""Comparison of a query with its SQL."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(x):
    return round(x, 6) if isinstance(x, float) else x


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(_value(r[k]) for k in order) for r in rows], key=repr)


def differences(df, sql, folder):
    """What differs between ``df`` and the SQL over the tables of ``folder``; empty if nothing does."""
    base = duckdb.connect()
    for name in TABLES:
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    result = base.execute(sql)
    columns = [c[0] for c in result.description]
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(columns)}"]
    mine, theirs = _rows([tuple(r) for r in df.collect()], df.columns), _rows(result.fetchall(), columns)
    if len(mine) != len(theirs):
        return [f"{len(mine)} and {len(theirs)} rows", *mine[:2], *theirs[:2]]
    return [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b][:3]
