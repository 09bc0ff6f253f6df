import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from twinspark.llm import centroids, negatives
from twinspark.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, key long, cluster string, score int"


def rows(width, n=260, seed=1):
    """Ties, repeated rows and ids, null ids, labels and vectors, odd widths and values, columns with names that the operators use."""
    rng = random.Random(seed)
    draw = lambda: [rng.choice([-0.5, -0.25, 0.0, 0.013, 0.25, 0.5, rng.uniform(-1, 1)]) for _ in range(width)]
    common = draw()
    out = [(k, common if k % 3 == 0 else draw(), k % 10, k, "x", None) for k in range(n)]
    out += [out[100], out[100], (100, draw(), 4, None, None, 1), (None, draw(), 2, 1, "", 1), (None, common, 3, 1, "", 1)]
    out += [(n, draw(), None, 1, "", 1), (n + 1, None, 2, 1, "", 1), (n + 2, [], 2, 1, "", 1), (n + 3, draw()[:-1], 5, 1, "", 1), (n + 4, [*draw(), 1.0], 5, 1, "", 1)]
    for bad in (None, math.nan, math.inf, -math.inf):
        out.append((1000, [bad, *draw()[1:]], 1, 1, "", 1))
    return out


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_clusters(table, k, rounds, seed, width, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in table if sound(v) and len(v) == width]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()))[:k]
    centres = [v for _, v in first]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for left in range(rounds, -1, -1):
        best = [min((square(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
        for j in range(len(centres)) if left else ():
            own = [v for (_, v), (_, b) in zip(kept, best) if b == j]
            centres[j] = [sum(x) // len(own) for x in zip(*own)] if own else centres[j]
    sums = [sum(d for d, b in best if b == j) for j in range(len(centres))]
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, b, d, sums[b], sum(sums), name[b]) for (i, _), (d, b) in zip(kept, best)]


@pytest.mark.parametrize("width,k,rounds,scale", [(3, 8, 10, 1024), (5, 40, 3, 4), (64, 8, 2, 1024)])
def test_clusters_as_by_comparing_all(spark, width, k, rounds, scale, monkeypatch):
    monkeypatch.setattr(centroids, "PAIRS", 50)
    table = [r for r in rows(width) if r[0] != 100]  # of the rows that repeat an id, any may start a centroid
    got = centroids.digest(spark.createDataFrame(table, SCHEMA).repartition(3), k=k, rounds=rounds, seed=3, width=width, scale=scale)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_clusters(table, k, rounds, 3, width, scale), key=repr)


def test_repeated_rows_are_vectors_of_their_own(spark):
    table = [(7, [0.5, 0.5], 1, 1, "", 1)] * 5
    got = centroids.digest(spark.createDataFrame(table, SCHEMA), k=2, width=2).collect()
    assert [(r["vec_id"], r["cluster"], r["distance"]) for r in got] == [(7, 0, 0)] * 5


def test_the_annulus_leaves_out_only_what_is_farther():
    rng = np.random.default_rng(0)
    centres = rng.integers(-50, 50, (60, 4)) * rng.integers(1, 40, (60, 1))
    vectors = np.concatenate([rng.integers(-900, 900, (400, 4)), centres, (centres[:30] + centres[30:]) // 2])
    squares = ((vectors[:, None] - centres[None]) ** 2).sum(2)
    annuli = centroids.Annuli(centres)
    for before in (np.full(len(vectors), -1), rng.integers(0, 60, len(vectors)), squares.argmin(1)):
        cluster, distance = annuli.nearest(vectors, before)
        assert (cluster == squares.argmin(1)).all() and (distance == squares.min(1)).all()
    first, last = annuli.within(vectors, squares.argmin(1))
    assert (last - first).mean() < 30  # of 60


def test_too_large_components_raise(spark):
    table = spark.createDataFrame([(1, [1e30, 0.0], 1), (100, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="not below"):
        centroids.digest(table, width=2).collect()
    with pytest.raises(Exception, match="not below"):
        negatives.mine(table, F.col("vec_id") == 100, F.col("label")).collect()


def plain_negatives(table, scale, n_positives, n_negatives, window=(30, 90)):
    kept = [(k, i, lab if i is None or i % 7 else (lab + 1) % 10, [math.floor(scale * x) for x in v]) for k, (i, v, lab, *_) in enumerate(table) if lab is not None and sound(v)]
    out = []
    for k, i, lab, v in kept:
        if i is None or i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j is None, j or 0, m, other) for m, j, other, w in kept if m != k)
        for p, none, positive, _, _ in [s for s in scored if s[4] == lab][:n_positives]:
            inside = [s for s in scored if s[4] != lab and window[0] * -p <= 100 * -s[0] <= window[1] * -p][:n_negatives]
            out += [(i, None if none else positive, rank, None if s[1] else s[2], -p, -s[0]) for rank, s in enumerate(inside, 1)]
    return out


def label():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


@pytest.mark.parametrize("width,scale,cells,anchors", [(3, 256, 256, 8192), (6, 256, 4, 2), (4, 8, 2, 1), (1, 100000, 16, 3)])
def test_negatives_as_by_comparing_all(spark, width, scale, cells, anchors, monkeypatch):
    for name, value in (("CELLS", cells), ("ANCHORS", anchors), ("TILE", 2), ("PAIRS", 7), ("SAMPLE", 40), ("AT_A_TIME", 37)):
        monkeypatch.setattr(negatives, name, value)
    table = rows(width, 420, seed=width)
    got = negatives.mine(spark.createDataFrame(table, SCHEMA).repartition(3), F.col("vec_id") % 100 == 0, label(), scale=scale)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(table, scale, 5, 10)
    assert want and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    vectors, anchors = rng.integers(-3000, 3000, (500, 8)), rng.integers(-3000, 3000, (20, 8))
    vectors[7], vectors[8] = 90000, -90000  # outside what the cells' borders come from
    cells = negatives.Cells.of(vectors[20:], vectors.min(0), vectors.max(0))
    low, high = negatives.Bounds(cells, cells.cell(vectors)).of(anchors)
    scores = vectors @ anchors.T
    assert (low <= scores).all() and (scores <= high).all()
    assert np.median(high - low) < np.median(np.abs(scores)) / 10


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert centroids.digest(empty).collect() == [] and negatives.mine(empty, F.col("vec_id") % 100 == 0, label()).collect() == []
    alone = spark.createDataFrame([(100, [], 1, 1, "", 1), (200, [0.5], 1, 1, "", 1)], SCHEMA)
    assert negatives.mine(alone, F.col("vec_id") % 100 == 0, label()).collect() == []


@pytest.mark.parametrize("name", ["op12_centroids", "op13_hard_negatives"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF).select(*columns).collect()
    assert got and sorted(map(tuple, got)) == sorted(want.fetchall())
