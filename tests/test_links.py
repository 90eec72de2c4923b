"""Queries on links over the tables' own values, against their SQL."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__  # noqa: F401  (registers the queries)
from histora.plans import links, tables
from histora.plans.queries import ORACLE, QUERIES

from .conftest import SMALL

NAMES = [n for module in (links, tables) for n, f in vars(module).items() if n in ORACLE and getattr(f, "__module__", None) == module.__name__]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, SMALL)
    want = con.sql(ORACLE[name])
    columns = sorted(df.columns)
    plain = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    got = plain(tuple(r[c] for c in columns) for r in df.collect())
    assert columns == sorted(want.columns) and (len(got) > 0 or name.startswith("tool_"))
    assert got == plain(want.select(*(f'"{c}"' for c in columns)).fetchall())
