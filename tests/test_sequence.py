"""Folds over series that are long and dense, against loops."""

import random

from tracewell.operators import sequence as seq


def test_long_dense_series(spark):
    """One series holds most rows, in one island: an array that is copied for each sample kept would not end."""
    r = random.Random(1)
    rows, at = [(1, 5), (1, 7), (1, 10), (2, 0), (None, 3), (None, 4), (None, 9)], 0
    for _ in range(100_000):
        at += r.randint(1, 4)
        rows.append((0, at))
    df = spark.createDataFrame(rows, "k int, i int").repartition(3)
    want, merged = {}, {}
    for k, i in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        own, means = want.setdefault(k, []), merged.setdefault(k, [])
        if not own or i - own[-1] >= 5:
            own.append(i)
        if means and i - means[-1] < 3:
            means[-1] = (means[-1] + i) / 2
        else:
            means.append(float(i))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    try:
        got, close = {}, {}
        for x in seq.spaced_rows(df, ["k"], "i", 5).collect():
            got.setdefault(x.k, []).append(x.i)
        for x in seq.merged_close_rows(df, ["k"], "i", 3.0).collect():
            close.setdefault(x.k, []).append(x.i)
        assert {k: sorted(v) for k, v in got.items()} == want
        assert {k: sorted(v) for k, v in close.items()} == merged
        assert seq.spaced_rows(df, ["k"], "i", 0).count() == len(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
