"""Every reference-operator query against its SQL, on the small tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from lucera.plans import queries as q  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def shown(rows):
    show = lambda v: f"{v:.7g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in rows)


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_query(spark, con, name):
    df = q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    theirs = con.sql(q.SQL[name])
    assert sorted(theirs.columns) == cols
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert shown(df.select(*[f"`{c}`" for c in cols]).collect()) == shown(theirs.select(quoted).fetchall())


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
