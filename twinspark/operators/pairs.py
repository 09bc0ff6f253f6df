"""Similarity self-joins: exact, Hamming range and cosine nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinspark.functions import hashes

CHUNKS = hashes.CHUNKS


#: Files of one key that are a part of it, about. A key with more of them has parts, each of which is joined on its own.
COPIES = 1_000


def large_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, n): keys of more than COPIES rows and their number of parts; a row for COPIES rows at most, so it may be sent to all."""
    return F.broadcast(rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / COPIES).cast("int").alias("n")).where("n > 1"))


def in_parts(rows: DataFrame, large: DataFrame, key: str) -> DataFrame:
    """``rows`` with the ``part`` of their key that their id belongs to."""
    rows = rows.join(large, key, "left")
    return rows.withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("n", F.lit(1))).cast("int")).drop("n")


def by_parts(rows: DataFrame, large: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` once for every part of their key, as the column ``name``."""
    rows = rows.join(large, key, "left")
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1))).drop("n")


def exact_pairs(files: DataFrame, key: str = "phash") -> DataFrame:
    """All (id1, id2) with an equal key. For components ``exact_stars`` has the same result with fewer rows."""
    rows = files.where(F.col(key) != "").select("id", F.col(key).alias("k"))
    large = large_keys(rows, "k")
    a, b = by_parts(rows, large, "k", "part"), in_parts(rows, large, "k")
    return a.withColumnRenamed("id", "id1").join(b.withColumnRenamed("id", "id2").hint("merge"), ["k", "part"]).where("id1 < id2").select("id1", "id2")


def exact_stars(files: DataFrame, key: str = "phash") -> DataFrame:
    """(id1, id2): the least id of every group of equal keys with each of the others."""
    some = files.where(F.col(key) != "")
    least = some.groupBy(key).agg(F.min("id").alias("id1"))
    return some.join(least, key).where("id <> id1").select("id1", F.col("id").alias("id2"))


def exact_groups(files: DataFrame, key: str = "phash") -> DataFrame:
    """key, size, least id of groups of more than one."""
    return files.where(F.col(key) != "").groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


def mih_candidates(files: DataFrame) -> DataFrame:
    """(id1, id2, distance) of hashes that share a chunk in the same place.

    Each file stands under its four chunks, and one join by place and value meets them; a pair is kept at its first common chunk.
    """
    chunks = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in enumerate(CHUNKS)])
    rows = files.where(F.col(CHUNKS[0]).isNotNull()).select("id", *CHUNKS, F.explode(chunks).alias("b"))
    side = lambda s: rows.select("b.k", "b.v", F.col("id").alias(f"id{s}"), *[F.col(c).alias(f"{c}_{s}") for c in CHUNKS])
    met = side(1).join(side(2), ["k", "v"]).where("id1 < id2")
    first = [(F.col("k") <= j) | (F.col(f"{c}_1") != F.col(f"{c}_2")) for j, c in enumerate(CHUNKS[:-1])]
    distance = hashes.hamming([F.col(f"{c}_1") for c in CHUNKS], [F.col(f"{c}_2") for c in CHUNKS])
    return met.where(reduce(lambda x, y: x & y, first)).select("id1", "id2", distance.alias("distance"))


def hamming_mih(files: DataFrame, t: int) -> DataFrame:
    """Pairs within t bits that share a chunk; complete for t <= 3."""
    return mih_candidates(files).where(F.col("distance") <= t)


def as_number(phash: Column) -> Column:
    """A hash of 16 hex digits as a 64-bit number, NULL for anything else."""
    parts = [hashes.chunk(phash, k).cast("long") for k in range(4)]
    return reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(c, 48 - 16 * k) for k, c in enumerate(parts)])


def as_hex(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def _cut(n: int) -> list[tuple[int, int]]:
    """First bit (from the low end) and width of n blocks of 64 bits."""
    return [(64 * k // n, 64 * (k + 1) // n - 64 * k // n) for k in range(n)]


def _blocks(t: int) -> tuple[list[tuple[tuple[int, int], ...]], int]:
    """The blocks that hashes meet by, each of one or two parts, and in how many bits one of them may differ at most.

    For 4 <= t <= 6 there are t + 2 parts, of which two have no differing bit: every two of them are a block of about
    20 bits. Else a block is one part, and of n parts one differs in at most t // n bits.
    """
    if 4 <= t <= 6:
        return list(combinations(_cut(t + 2), 2)), 0
    n = 4 if t <= 7 else min(t // 2 + 1, 32)
    return [(part,) for part in _cut(n)], t // n


def block_rows(h: DataFrame, t: int) -> DataFrame:
    """(k, v, x): the blocks of every hash x."""

    def value(parts: tuple[tuple[int, int], ...]) -> Column:
        out, filled = F.lit(0).cast("long"), 0
        for at, width in parts:
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("x", at).bitwiseAND(F.lit((1 << width) - 1)), filled))
            filled += width
        return out

    blocks = F.array(*[F.struct(F.lit(k).alias("k"), value(parts).alias("v")) for k, parts in enumerate(_blocks(t)[0])])
    return h.select("x", F.explode(blocks).alias("b")).select("b.k", "b.v", "x")


def near_rows(h: DataFrame, t: int) -> DataFrame:
    """(k, v, x): the blocks of every hash x and, where the threshold needs it, all that differ in one bit."""
    cut, spare = _blocks(t)
    if spare == 0:
        return block_rows(h, t)
    width = F.element_at(F.array(*[F.lit(sum(w for _, w in parts)) for parts in cut]), F.col("k") + 1)
    bits = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.col("v").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    return block_rows(h, t).select("k", F.explode(F.concat(F.array("v"), bits)).alias("v"), "x")


def blocks_meet(around: DataFrame, blocks: DataFrame, t: int) -> DataFrame:
    """(x, y, distance) within t bits, of hashes x of ``near_rows`` and y of ``block_rows``, x <> y, each once.

    The distance is taken in the join, and a pair is kept at its first common block only: no part that comes before
    those of the block fits. A block is one number there, as rows are sorted by their first column at once and by others
    one by one; and what few pairs are asked is a function of arrays, as code of all parts would be too long to be compiled.
    """
    cut, spare = _blocks(t)
    differ = F.col("x").bitwiseXOR(F.col("y"))
    parts = sorted({p for block in cut for p in block})
    masks = [((1 << width) - 1) << at for at, width in parts]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    before = [[m for p, m in zip(parts, signed) if p < block[-1] and p not in block] for block in cut]
    before = F.array(*[F.array(*[F.lit(m).cast("long") for m in some]).cast("array<long>") for some in before])
    first = F.forall(F.element_at(before, F.shiftright("b", PLACE).cast("int") + 1), lambda m: F.bit_count(differ.bitwiseAND(m)) > spare)
    block = lambda rows, x: rows.select(F.shiftleft(F.col("k").cast("long"), PLACE).bitwiseOR(F.col("v")).alias("b"), F.col("x").alias(x))
    # The blocks are few bytes on disk, but many rows in a driver that would send them.
    met = block(around, "x").join(block(blocks, "y").hint("merge"), "b")
    return met.where((F.bit_count(differ) <= t) & (F.col("x") != F.col("y")) & first).select("x", "y", F.bit_count(differ).alias("distance"))


#: Bits of a block's value, at most; its number stands above them.
PLACE = 32
#: Up to this threshold hashes meet by blocks; beyond it most of them have a block in common, and all parts of them meet.
BY_BLOCKS = 7
#: Hashes of a part, about; every two parts are compared in one task, where that is needed in squares of so many rows and columns.
PART, ROWS, COLUMNS = 262_144, 64, 4_096
#: Bits of the quarters that hashes of two parts are looked up by; lookups, candidates or found pairs in memory at a time, about.
WIDTH, AT_ONCE = 16, 65_536
#: A lookup or a candidate takes about as long as so many hashes of a square.
DEAR = 12


def all_compared(h: DataFrame, t: int) -> DataFrame:
    """(x, y, distance) of all different hashes x < y (x; each once) within t bits: parts of them meet two by two.

    A task holds two parts and what it has found of a few hashes. The number of tasks follows from the number of
    pairs, not from the bytes of the hashes, which are few.
    """
    n = max(4, -(-h.count() // PART))
    v = h.select("x", F.pmod(F.xxhash64("x"), F.lit(n)).cast("int").alias("own"))
    v = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    v = v.select("x", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            one, two = (np.concatenate(side) for side in zip(*held))
            held.clear()
            distance, one, two = bits_between(one, two).astype(np.int32), one.view(np.int64), two.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(distance)], ["x", "y", "distance"])

        for low, high, own, x in sorted_groups(batches):
            for one, two in within(x[own == low], x[own == high], t):
                if low == high:
                    keep = one.view(np.int64) < two.view(np.int64)
                    one, two = one[keep], two[keep]
                held.append((one, two))
                if sum(len(some) for some, _ in held) >= AT_ONCE:
                    yield out()
            if held:
                yield out()

    spread = v.repartition(tasks_for(h, n), "low", "high").sortWithinPartitions("low", "high")
    return spread.select("low", "high", "own", "x").mapInArrow(compared, "x long, y long, distance int")


def bits_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)  # of numbers without a sign; of a signed one it would count the absolute value's


def within(left: np.ndarray, right: np.ndarray, t: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a number of left and one of right within t bits, each once, some at a time as two arrays.

    Of four quarters one differs in few bits at most, so a number looks up what is around each of its quarters. A number
    with so many candidates there that it is not worth it is compared with all.
    """
    left, right = left.view(np.uint64), right.view(np.uint64)
    spare = [(t - 3 + k) // 4 for k in range(4)]  # more than these in every quarter are more than t
    cost = np.zeros(len(left), np.int64)
    for k, d in enumerate(spare):
        cost += around(np.bincount(quarter(right, k), minlength=1 << WIDTH), d)[quarter(left, k)] + sum(comb(WIDTH, i) for i in range(d + 1))
    dense = DEAR * cost > len(right)
    yield from in_squares(left[dense], right, t)
    yield from by_quarters(left[~dense], right, t, spare)


def quarter(x: np.ndarray, k: int) -> np.ndarray:
    return ((x >> np.uint64(WIDTH * k)) & np.uint64((1 << WIDTH) - 1)).astype(np.uint16)


def around(counts: np.ndarray, d: int) -> np.ndarray:
    """For every number of WIDTH bits, the sum of ``counts`` of all within d bits of it."""
    total, before, at = np.zeros_like(counts), np.zeros_like(counts), counts
    for k in range(d + 1):
        total += at
        beside = sum(at.reshape(-1, 2, 1 << b)[:, ::-1].reshape(-1) for b in range(WIDTH))
        before, at = at, (beside - (WIDTH - k + 1) * before) // (k + 1)  # a bit more, or the same bit again
    return total


def in_squares(left: np.ndarray, right: np.ndarray, t: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    differ, bits = np.empty((ROWS, COLUMNS), np.uint64), np.empty((ROWS, COLUMNS), np.uint8)
    for i in range(0, len(left), ROWS):
        a = left[i : i + ROWS]
        for j in range(0, len(right), COLUMNS):
            b = right[j : j + COLUMNS]
            d = np.bitwise_xor(a[:, None], b[None, :], out=differ[: len(a), : len(b)])
            close = np.flatnonzero(np.bitwise_count(d, out=bits[: len(a), : len(b)]) <= t)  # by rows and columns it takes three times as long
            if len(close):
                yield a[close // len(b)], b[close % len(b)]


def by_quarters(left: np.ndarray, right: np.ndarray, t: int, spare: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within t bits, at the first quarter in which they differ in no more bits than are spare there."""
    for k, d in enumerate(spare):
        near = np.flatnonzero(np.bitwise_count(np.arange(1 << WIDTH)) <= d)
        if not len(near) or not len(left):
            continue
        value, mine = quarter(right, k), left[np.argsort(quarter(left, k), kind="stable")]
        there, counts = right[np.argsort(value, kind="stable")], np.bincount(value, minlength=1 << WIDTH)
        starts, step = np.cumsum(counts) - counts, max(1, AT_ONCE // len(near))
        for i in range(0, len(mine), step):
            asked = (quarter(mine[i : i + step], k).astype(np.int64)[:, None] ^ near).ravel()
            found = counts[asked]
            some = np.flatnonzero(found)
            found, first, own = found[some], starts[asked[some]], mine[i + some // len(near)]
            cuts = np.flatnonzero(np.diff(np.cumsum(found) // AT_ONCE)) + 1
            for at, to in zip([0, *cuts], [*cuts, len(found)]):
                n = found[at:to]
                before = np.cumsum(n) - n
                a, b = np.repeat(own[at:to], n), there[np.repeat(first[at:to] - before, n) + np.arange(n.sum())]
                close = np.flatnonzero(bits_between(a, b) <= t)
                a, b = a[close], b[close]
                for j in range(k):
                    new = bits_between(quarter(a, j), quarter(b, j)) > spare[j]
                    a, b = a[new], b[new]
                if len(a):
                    yield a, b


def tasks_for(df: DataFrame, n: int) -> int:
    """Tasks for the meetings of ``n`` parts, two by two: as many as there are meetings, at most 2,000 and what the session shuffles to."""
    return min(n * (n + 1) // 2, max(2_000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(low, high, and the other columns) of each group of rows (low, high, ...) that come sorted by these two; numbers as numpy arrays."""
    held: list[pa.RecordBatch] = []

    def plain(column: pa.ChunkedArray) -> np.ndarray | pa.Array:
        return column.to_numpy() if pa.types.is_integer(column.type) else pa.concat_arrays(column.chunks)

    def out() -> tuple:
        t = pa.Table.from_batches(held)
        return held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py(), *(plain(t.column(k)) for k in range(2, t.num_columns))

    for b in batches:
        low, high = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = np.flatnonzero((np.diff(low) != 0) | (np.diff(high) != 0)) + 1
        for at, to in zip([0, *cuts], [*cuts, b.num_rows]):
            if at == to:
                continue
            part = b.slice(at, to - at)
            if held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != (low[at], high[at]):
                yield out()
                held = []
            held.append(part)
    if held:
        yield out()


def numbers_of(files: DataFrame) -> DataFrame:
    """(id, x): the hashes of files as numbers, of their chunks; files without one are left out."""
    parts = [F.shiftleft(F.col(c).cast("long"), 48 - 16 * k) for k, c in enumerate(CHUNKS)]
    return files.where(F.col(CHUNKS[0]).isNotNull()).select("id", reduce(lambda x, y: x.bitwiseOR(y), parts).alias("x"))


def near_numbers(h: DataFrame, t: int) -> DataFrame:
    """(x, y, distance) of all different numbers x < y (x; each once) within t bits; complete for every t.

    By blocks up to BY_BLOCKS bits; above, all parts of them meet.
    """
    return all_compared(h, t) if t > BY_BLOCKS else blocks_meet(near_rows(h, t), block_rows(h, t), t).where("x < y")


def distinct_hash_pairs(files: DataFrame, t: int) -> DataFrame:
    """(h1, h2, distance) of all different hashes within t bits, h1 < h2; complete for every t."""
    a, b = as_hex(F.col("x")), as_hex(F.col("y"))
    return near_numbers(numbers_of(files).select("x").distinct(), t).select(F.least(a, b).alias("h1"), F.greatest(a, b).alias("h2"), "distance")


def near_or_equal(ids: DataFrame, t: int) -> DataFrame:
    """(x, y, distance): hashes of files (id, x) within t bits, in both orders, and those of more than one file with themselves."""
    both = F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    apart = near_numbers(ids.select("x").distinct(), t).select(F.explode(both).alias("p"), "distance").select("p.*", "distance")
    several = ids.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return apart.unionByName(several.select("x", F.col("x").alias("y"), F.lit(0).alias("distance")))


def pairs_of(near: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(id1, id2, distance, other columns of left, other columns of right): the files (id, x, ...) of the hashes of ``near_or_equal``, id1 < id2.

    Joined and exchanged are lists of the files of a hash, of about COPIES each, and every two lists become pairs where they
    are then dealt to; so pairs are never sorted or exchanged, and no task makes all pairs of a hash.
    """

    def lists(rows: DataFrame, x: str, name: str) -> DataFrame:
        parts = in_parts(rows, large_keys(rows, "x"), "x")
        made = parts.groupBy(F.col("x").alias(x), F.col("part").alias(f"{x}_part")).agg(F.collect_list(F.struct("id", *others(rows))).alias(name))
        return made.hint("merge")  # few bytes on disk, but many rows in a driver that would send them

    others = lambda rows: [c for c in rows.columns if c not in ("id", "x")]
    met = near.join(lists(left, "x", "a"), "x").join(lists(right, "y", "b"), "y")
    # A number that is given is not lowered for few bytes, which are many pairs here.
    met = met.repartition(int(near.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x", "y", "x_part", "y_part")
    met = met.select("distance", F.explode("a").alias("a"), "b").select("distance", "a", F.explode("b").alias("b")).where("a.id < b.id")
    return met.select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), "distance", *[f"a.{c}" for c in others(left)], *[f"b.{c}" for c in others(right)])


def hamming_join(files: DataFrame, t: int) -> DataFrame:
    """All (id1, id2, distance) within t bits, equal hashes included; different hashes are compared once each."""
    ids = numbers_of(files)
    return pairs_of(near_or_equal(ids, t), ids, ids)


def hamming_links(files: DataFrame, t: int) -> DataFrame:
    """(id1, id2) with the components of ``hamming_join``: the least ids of hashes within t bits of each other, and the least id of every hash with its others.

    Rows grow with the different hashes and the files, not with the square of equal ones.
    """
    ids = numbers_of(files)
    least = ids.groupBy("x").agg(F.min("id").alias("id"))
    a, b = (least.select(F.col("x").alias(x), F.col("id").alias(i)) for x, i in (("x", "a"), ("y", "b")))
    apart = near_numbers(ids.select("x").distinct(), t).join(a, "x").join(b, "y").select(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"))
    stars = ids.join(least.select("x", F.col("id").alias("id1")), "x").where("id <> id1").select("id1", F.col("id").alias("id2"))
    return apart.unionByName(stars)


def best_of(k: int, digits: int | None):
    """Of two blocks (qid, qv) and (id, embedding): each query's k nearest (id, match_id, distance), ties by id."""

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "match_id": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})
        right = right.sort_values("id")
        a, b, ids, slack = unit_rows(left["qv"]), unit_rows(right["embedding"]), right["id"].to_numpy(), 10.0**-digits if digits is not None else 0
        out = []
        for lo in range(0, len(a), SQUARE):
            some = a[lo : lo + SQUARE]
            r, c, v = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            edge = np.full((len(some), 1), np.inf)  # no one beyond it is among a query's k nearest
            for at in range(0, len(b), COLUMNS):
                d = 1 - some @ b[at : at + COLUMNS].T
                if at == 0 and d.shape[1] >= k:
                    edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                x, y = np.nonzero(d <= edge + slack)  # rounding may bring in who lies just behind
                r, c, v = np.concatenate((r, x)), np.concatenate((c, at + y)), np.concatenate((v, d[x, y]))
                order = np.lexsort((c, v, r))
                r, c, v = r[order], c[order], v[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                last = place == k - 1
                edge[r[last], 0] = v[last]
                near = v <= edge[r, 0] + slack
                r, c, v = r[near], c[near], v[near]
            v = np.round(v, digits) + 0.0 if digits is not None else v  # no negative zero
            order = np.lexsort((c, v, r))
            r, c, v = r[order], c[order], v[order]
            first = np.arange(len(r)) - np.searchsorted(r, r) < k
            out.append(pd.DataFrame({"id": left["qid"].to_numpy()[lo + r[first]], "match_id": ids[c[first]], "distance": v[first]}))
        return pd.concat(out)

    return best


def knn(queries: DataFrame, vectors: DataFrame, k: int = 20, digits: int | None = None) -> DataFrame:
    """(id, match_id, distance, rank): the k nearest by cosine distance, a query itself included; ties by id.

    Queries are cut into blocks; each block meets every part of the vectors once as
    a matrix product, and only a block's best k of that part go on to the last
    ranking, so what is exchanged is queries times parts times k.
    """
    blocks, parts = blocks_of(queries), blocks_of(vectors)
    q = queries.select(F.col("id").alias("qid"), F.col("embedding").alias("qv"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("qb"))
    v = vectors.select("id", "embedding", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).alias("vp"))
    q = q.withColumn("vp", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("vp", F.col("vp").cast("long"))
    v = v.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("qb", F.col("qb").cast("long"))

    near = q.groupBy("qb", "vp").cogroup(v.groupBy("qb", "vp")).applyInPandas(best_of(k, digits), "id long, match_id long, distance double")
    rank = F.row_number().over(W.partitionBy("id").orderBy("distance", "match_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def cosine_within(vectors: DataFrame, t: float, digits: int | None = None) -> DataFrame:
    """All (id1, id2, distance) of a table (id, embedding) within a cosine distance.

    Vectors are cut into blocks and every two blocks meet once, as a matrix product; only pairs within ``t`` leave it.
    """
    n = blocks_of(vectors)
    v = vectors.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("own"))
    v = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    v = v.select("id", "embedding", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def near(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        low, high = key
        rows = rows.sort_values("id")
        left, right = rows[rows["own"] == low], rows[rows["own"] == high]
        out = [pd.DataFrame({"id1": pd.Series(dtype="int64"), "id2": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})]
        if not len(left) or not len(right):
            return out[0]
        a, b, i, j = unit_rows(left["embedding"]), unit_rows(right["embedding"]), left["id"].to_numpy(), right["id"].to_numpy()
        for lo in range(0, len(a), SQUARE):
            for at in range(0, len(b), COLUMNS):
                d = 1 - a[lo : lo + SQUARE] @ b[at : at + COLUMNS].T
                d = np.round(d, digits) + 0.0 if digits is not None else d
                x, y = np.nonzero(d <= t)
                one, two = i[lo + x], j[at + y]
                keep = one < two if low == high else np.ones(len(one), bool)
                out.append(pd.DataFrame({"id1": np.minimum(one, two)[keep], "id2": np.maximum(one, two)[keep], "distance": d[x, y][keep]}))
        return pd.concat(out)

    return v.groupBy("low", "high").applyInPandas(near, "id1 long, id2 long, distance double")


#: Queries whose products with COLUMNS vectors are in memory at a time.
SQUARE = 256
#: Vectors of a block, about, and the least number of blocks.
BLOCK_ROWS, LEAST_BLOCKS = 50_000, 4


def blocks_of(vectors: DataFrame) -> int:
    return max(LEAST_BLOCKS, -(-vectors.count() // BLOCK_ROWS))


def unit_rows(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_list()).astype(float)
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)


def knn_pairs(near: DataFrame, t: float) -> DataFrame:
    """Unordered pairs (id1, id2, distance) of a kNN result within t, without self matches."""
    pairs = near.where((F.col("id") != F.col("match_id")) & (F.col("distance") <= t))
    return pairs.groupBy(F.least("id", "match_id").alias("id1"), F.greatest("id", "match_id").alias("id2")).agg(F.min("distance").alias("distance"))
