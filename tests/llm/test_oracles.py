"""Queries against their SQL over the smallest generated tables."""

import duckdb
import pytest

from loglattice.llm import queries
from loglattice.llm.oracles import ORACLES


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, small, name):
    df = queries.queries()[name](spark, small)
    base = duckdb.connect()
    for table_name in ("documents", "labels"):
        base.execute(f"CREATE VIEW {table_name} AS SELECT * FROM '{small}/{table_name}.parquet'")
    result = base.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert table([tuple(r) for r in df.collect()], df.columns) == table(result.fetchall(), columns)


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.queries()) == list(range(1, 14))
