import random

import pytest
from pyspark.sql import functions as F

from twinspark.operators import metric


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def words(rng, n):
    seeds = ["".join(rng.choices("abcde", k=rng.randrange(0, 14))) for _ in range(12)]
    out = []
    for _ in range(n):
        w = list(rng.choice(seeds))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choices("abcde", k=rng.randrange(2))
        out.append("".join(w))
    return out


@pytest.mark.parametrize("radius,n", [(0, 3), (1, 1), (2, 4), (5, 6)])
def test_edit_distance_as_by_comparing_all(spark, radius, n):
    values = words(random.Random(radius), 150)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "value string").repartition(3)
    some = sorted(set(values))
    want = {(a, b, edits(a, b)) for a in some for b in some if a < b and edits(a, b) <= radius}
    pivots = metric.pivots(df, n)
    got = [tuple(r) for r in metric.range_join(df, metric.edit_distance, radius, pivots).collect()]
    assert len(got) == len(want) and set(got) == want
    all_pairs, compared = metric.pruning(df, metric.edit_distance, radius, pivots).select("pairs", "compared").first()
    assert all_pairs == len(some) * (len(some) - 1) // 2 and len(want) <= compared < all_pairs


@pytest.mark.parametrize("radius", [2, 9, 64])
def test_bits_as_by_comparing_all(spark, radius):
    rng = random.Random(radius)
    values = [rng.getrandbits(64) - (1 << 63) for _ in range(8)]
    values += [v ^ sum(1 << rng.randrange(63) for _ in range(3)) for v in values for _ in range(8)]
    df = spark.createDataFrame([(v,) for v in values * 2], "value long")
    some, mask = sorted(set(values)), (1 << 64) - 1
    want = {(a, b, ((a ^ b) & mask).bit_count()) for a in some for b in some if a < b and ((a ^ b) & mask).bit_count() <= radius}
    got = [tuple(r) for r in metric.range_join(df, metric.bits_apart, radius, metric.pivots(df, 5)).collect()]
    assert len(got) == len(want) > 0 and set(got) == want


def test_rows_behind_the_values(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abc"), (3, "ab"), (4, None), (5, "zzzzz")], "id long, value string")
    found = metric.range_join(df, metric.edit_distance, 1, metric.pivots(df, 2))
    assert {tuple(r) for r in metric.rows_of(found, df).collect()} == {(1, 2, 1), (2, 3, 1)}
    empty = df.where(F.lit(False))
    assert metric.range_join(empty, metric.edit_distance, 1, metric.pivots(empty, 2)).count() == 0


def test_without_pivots_and_of_other_metrics(spark):
    df = spark.createDataFrame([("ab",), ("abc",), ("zzzzz",)], "value string")
    assert [tuple(r) for r in metric.range_join(df, metric.edit_distance, 1, []).collect()] == [("ab", "abc", 1)]
    hashes = spark.createDataFrame([(-1,), (0,), (1,), (7,)], "value long")
    got = sorted(map(tuple, metric.range_join(hashes, metric.bits_apart, 2, []).collect()))
    assert got == [(0, 1, 1), (1, 7, 2)]
    far = [3 * i * i - 700 for i in range(60)]
    apart = lambda a, b: F.abs(a - b) / 2
    df = spark.createDataFrame([(v,) for v in far], "value long")
    for pivots in ([], [far[3], far[50]]):
        got = sorted(map(tuple, metric.range_join(df, apart, 40.5, pivots).collect()))
        assert got == sorted((a, b, (b - a) / 2) for a in far for b in far if a < b and b - a <= 81)


def test_alike_values_are_dealt_evenly(spark):
    """All have the same distances to the pivots, so rings would bring them to one task."""
    texts = [f"é{i:04d}" for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in texts], "value string")
    pivots = ["zzzzz", "yyyyyyy"]
    sizes = [r["count"] for r in metric.parts_met(df, metric.edit_distance, pivots).groupBy("low", "high").count().collect()]
    assert sum(sizes) == 3000 * 12 and max(sizes) < 2 * 3000 * 2 / 12
    assert metric.pruning(df, metric.edit_distance, 2, pivots).first()["compared"] == 3000 * 2999 // 2
    few = df.where("value < 'é0150'")
    want = {(a, b, edits(a, b)) for a in texts[:150] for b in texts[:150] if a < b and edits(a, b) <= 1}
    assert {tuple(r) for r in metric.range_join(few, metric.edit_distance, 1, pivots).collect()} == want
