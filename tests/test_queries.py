"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

import faultline.plans.contracts
import faultline.plans.reports
import faultline.plans.sequences
import faultline.plans.signals
import faultline.plans.stores
import faultline.plans.streams
import faultline.plans.windows  # noqa: F401
from faultline.plans.incident import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, columns):
    """Comparable rows: numbers as floats, the rest as text."""
    out = []
    for r in rows:
        out.append(tuple("null" if x is None else f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in (r[c] for c in columns)))
    return sorted(out)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = plain([r.asDict() for r in df.collect()], columns)
    if name not in SQL:
        assert got
        return
    rel = duck.sql(SQL[name]() if callable(SQL[name]) else SQL[name])
    assert sorted(rel.columns) == columns
    assert got == plain([dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()], columns)


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
