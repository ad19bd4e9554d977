"""concatenate, edge_average and cluster_table read every frame and position of embeddings."""

import numpy as np
import pandas as pd
import pytest
from lucera.plans import estimators, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def values():
    e = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    return np.stack(e["embedding"]).astype(float)


def test_concatenate(spark, values):
    got = queries.QUERIES["concatenate"](spark, SF).toPandas().sort_values(["channel", "t"])
    assert len(got) == values.size
    assert np.allclose(got["t"].to_numpy().reshape(64, -1), np.arange(len(values)) / 10)
    assert np.allclose(got["v"].to_numpy().reshape(64, -1), values.T, atol=1e-6)


def test_edges(spark, values):
    n = len(values)
    got = queries.QUERIES["edge_average"](spark, SF).toPandas().sort_values(["channel", "block"])
    cuts = [0, n // 4, n // 2, n]
    expect = np.array([values[a:b].mean(0) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    assert np.allclose(got["v"].to_numpy().reshape(64, 3), expect.T, atol=2e-6)
    assert np.allclose(got["t"].to_numpy().reshape(64, 3), [(a + b - 1) / 20 for a, b in zip(cuts[:-1], cuts[1:], strict=True)], atol=2e-6)


def test_clusters(spark, values):
    got = estimators.QUERIES["cluster_table"](spark, SF).toPandas()
    seen = got.groupby(["contrast", "sign"])["size"].sum()
    expect = {(c, s): int((s * 10 * values[:, c] > 1).sum()) for c in range(64) for s in (1, -1)}
    assert {k: int(seen.get(k, 0)) for k in expect} == expect
