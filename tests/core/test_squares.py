"""Neighbours and near vectors found square by square."""

import numpy as np
import pandas as pd

from twinspark.operators import pairs


def test_neighbours_by_squares_are_those_of_the_whole_matrix(monkeypatch):
    monkeypatch.setattr(pairs, "SQUARE", 7, raising=False)
    monkeypatch.setattr(pairs, "COLUMNS", 11, raising=False)
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (60, 4)).astype(float) + 0.5  # many ties
    left = pd.DataFrame({"qid": range(60), "qv": list(v)})
    right = pd.DataFrame({"id": rng.permutation(60), "embedding": list(v)})
    seen, product = [], np.partition
    monkeypatch.setattr(np, "partition", lambda d, *a, **k: seen.append(d.shape) or product(d, *a, **k))
    for k in (1, 5, 20, 70):
        got = pairs.best_of(k, 6)(left, right)
        by_id = right.sort_values("id")
        d = np.round(1 - pairs.unit_rows(left["qv"]) @ pairs.unit_rows(by_id["embedding"]).T, 6) + 0.0
        want = [(q, int(m), d[q, m]) for q in range(60) for m in np.lexsort((np.arange(60), d[q]))[:k]]
        assert list(got.itertuples(index=False, name=None)) == want
    assert all(rows <= 7 and columns <= 11 for rows, columns in seen)  # never all vectors at once


def test_near_vectors_by_squares(spark, monkeypatch):
    monkeypatch.setattr(pairs, "SQUARE", 7, raising=False)
    monkeypatch.setattr(pairs, "COLUMNS", 11, raising=False)
    rng = np.random.default_rng(4)
    v = rng.integers(-2, 3, (90, 4)).astype(float) + 0.5
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    d = np.round(1 - pairs.unit_rows(pd.Series(list(v))) @ pairs.unit_rows(pd.Series(list(v))).T, 6) + 0.0
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if d[i, j] <= 0.3}
    got = [(r.id1, r.id2) for r in pairs.cosine_within(df, 0.3, 6).collect()]
    assert len(got) == len(want) > 0 and set(got) == want
