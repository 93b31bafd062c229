"""The cheapest path against all paths by dense matrices, at sizes where those are small, and its memory where they are not."""

import tracemalloc

import numpy as np

from tracewell.operators.kernels import cheapest_path
from tracewell.plans.catalogue import QUERIES


def _dense(columns):
    cost = np.zeros(len(columns[0]))
    for prev, now in zip(columns, columns[1:]):
        cost = (cost[:, None] + (now[None, :] - prev[:, None]) ** 2).min(0)
    return cost.min()


def test_cheapest_path_by_dense():
    r = np.random.default_rng(3)
    for t in range(300):
        columns = [r.normal(size=r.integers(1, 40)).round(t % 3) for _ in range(r.integers(1, 7))]
        path = cheapest_path(columns)
        assert all(x in c for x, c in zip(path, columns, strict=True))
        assert abs((np.diff(path) ** 2).sum() - _dense(columns)) < 1e-9


def test_cheapest_path_memory():
    r = np.random.default_rng(4)
    columns = [np.sort(r.normal(size=6000)) for _ in range(3)]
    tracemalloc.start()
    cheapest_path(columns)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6


def test_tracks_are_bounded(spark, tmp_path):
    """More vectors make more tracks."""
    rows = [(k, k % 10, [float(k % 7)]) for k in range(2600)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["cheapest_track"](spark, str(tmp_path)).collect()
    assert {(x.track, x.x) for x in got} == {(t, x) for t in range(6) for x in range(10)}
