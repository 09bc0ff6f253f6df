"""Hashes by brute force and by blocks of two parts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinspark.functions import hashes
from twinspark.operators import graph, pairs


def some_hashes(seed, n=8):
    rng = random.Random(seed)
    values = [rng.getrandbits(64) for _ in range(n)] + [0, (1 << 64) - 1, 1 << 63]
    return values + [v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 16))) for v in values for _ in range(12)]


@pytest.mark.parametrize("t", [4, 5, 6, 8, 10, 14])
def test_all_pairs_within_bits_each_once(spark, monkeypatch, t):
    monkeypatch.setattr(pairs, "PART", 20, raising=False)
    values = some_hashes(t)
    rows = [(i, f"{v:016x}") for i, v in enumerate(values * 2)] + [(10**6, None)]
    files = hashes.with_chunks(spark.createDataFrame(rows, "id long, phash string"))
    some = sorted(set(values))
    want = {(f"{a:016x}", f"{b:016x}", (a ^ b).bit_count()) for a in some for b in some if a < b and (a ^ b).bit_count() <= t}
    got = [tuple(r) for r in pairs.distinct_hash_pairs(files, t).collect()]
    assert len(got) == len(want) > 0 and set(got) == want


def test_few_hashes_with_many_pairs_are_dealt_to_many_tasks(spark):
    h = hashes.with_chunks(spark.range(70_000).select("id", F.substring(F.md5(F.col("id").cast("string")), 1, 16).alias("phash")))
    assert pairs.distinct_hash_pairs(h, 10).rdd.getNumPartitions() >= 10  # 1 MB of hashes, 2.4 billion pairs


def spread_and_alike(seed, n=3_000):
    """Numbers anywhere, a group of near copies, one that shares a quarter, and both ends."""
    rng = np.random.default_rng(seed)
    near = lambda x, bits: x ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (len(x), bits)).astype(np.uint64), axis=1)
    some = rng.integers(0, 2**64, n, np.uint64)
    alike = near(np.full(n // 8, some[0]), 7)
    common = (rng.integers(0, 2**64, n // 8, np.uint64) & ~np.uint64(0xFFFF)) | np.uint64(77)
    return rng.permutation(np.unique(np.concatenate([some, near(some[: n // 2], 6), alike, common, np.array([0, 2**63, 2**64 - 1], np.uint64)])))


@pytest.mark.parametrize("t", [0, 3, 8, 10, 13, 40])
@pytest.mark.parametrize("dear", [0, 12, 10**6])
def test_numbers_looked_up_by_quarters_are_those_of_all_squares(monkeypatch, t, dear):
    monkeypatch.setattr(pairs, "AT_ONCE", 500)
    monkeypatch.setattr(pairs, "DEAR", dear)
    some = spread_and_alike(t)
    left, right = (some[:300], some[300:]) if t < 40 else (some[:60], some[60:900])
    d = np.bitwise_count(left[:, None] ^ right)
    want = {(int(left[i]), int(right[j])) for i, j in zip(*np.nonzero(d <= t))}
    got = [(int(a), int(b)) for one, two in pairs.within(left.view(np.int64), right.view(np.int64), t) for a, b in zip(one, two)]
    assert len(got) == len(want) and set(got) == want and (t < 8 or want)


def test_few_of_many_numbers_are_compared(monkeypatch):
    """All pairs of two parts were: 400 million here."""
    compared, count = [0], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x, **k: compared.append(x.size) or count(x, **k))
    some = spread_and_alike(1, 32_000)
    left, right = some[:20_000], some[20_000:40_000]
    assert sum(len(a) for a, _ in pairs.within(left, right, 10)) > 100_000  # the group of near copies
    assert sum(compared) < len(left) * len(right) / 5


def test_blocks_of_a_hash(spark):
    h = spark.createDataFrame([(v - (1 << 63),) for v in some_hashes(1)], "x long").distinct()
    n = h.count()
    assert pairs.near_rows(h, 5).count() == pairs.block_rows(h, 5).count() == 21 * n


def test_links_have_the_components_of_all_pairs(spark):
    rng = random.Random(5)
    some = [rng.getrandbits(64) for _ in range(6)]
    some += [v ^ sum(1 << rng.randrange(64) for _ in range(4)) for v in some for _ in range(3)]
    rows = [(i, f"{v:016x}" if i % 2 else f"{v:016X}") for i, v in enumerate(some + some[:9] + [some[0]] * 200)] + [(900, None), (901, "")]
    files = hashes.with_chunks(spark.createDataFrame(rows, "id long, phash string"))
    keep = lambda df: df.localCheckpoint()
    edges = lambda df: df.select(F.col("id1").alias("src"), F.col("id2").alias("dst"))
    known, links = pairs.hamming_join(files, 5), pairs.hamming_links(files, 5)
    want, got = (graph.components(edges(x), keep) for x in (known, links))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert links.count() < len(rows) + 100 < known.count()  # all pairs of 200 copies are 20,000
    full = graph.cliques(want, known)
    short = graph.hash_cliques(got, files.select("id", pairs.as_number(F.col("phash")).alias("x")), 5)
    assert short.columns == full.columns and sorted(map(str, short.collect())) == sorted(map(str, full.collect()))
