"""Every query of the catalog against its SQL, on the small tables."""

import duckdb
import pytest
from lucera.plans import catalog, estimators, queries
from test_queries import SF, shown


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_names_are_apart():
    names = [*queries.QUERIES, *estimators.QUERIES, *catalog.QUERIES]
    assert len(names) == len(set(names))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    theirs = con.sql(catalog.SQL[name])
    assert sorted(theirs.columns) == cols
    quoted = ", ".join(f'"{c}"' for c in cols)
    ours = df.select(*[f"`{c}`" for c in cols]).collect()
    assert ours and shown(ours) == shown(theirs.select(quoted).fetchall())
