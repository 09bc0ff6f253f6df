"""Range joins in any metric, by pivots and the triangle inequality.

A few values are pivots. For values within ``radius`` of each other the distances to
any pivot differ by no more than ``radius``; pairs that no pivot keeps apart are the
candidates. Values are dealt to parts, and every two parts meet in one group of rows,
sorted by the first pivot, where arrays of distances are compared in squares: a task
holds two parts, and all tasks have the same work however alike the values are.

What is left may be tried by a bound of the metric's own (for edit distances, how
often letters occur), and only then its distance is computed. A metric for which all
pairs within a radius can be found by equal keys (bits of hashes) is joined by these.

Values are made distinct first: a value that many rows share is one row. ``metric``
must be symmetric, 0 for equal values, and obey the triangle inequality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspark.operators.pairs import BY_BLOCKS, all_compared, block_rows, blocks_meet, near_rows, sorted_groups, tasks_for

Metric = Callable[[Column, Column], Column]


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def bits_apart(a: Column, b: Column) -> Column:
    """Of two 64-bit hashes as numbers."""
    return F.bit_count(a.bitwiseXOR(b))


def letter_counts(values: pa.Array) -> np.ndarray:
    """How often letters (64 kinds of code points) stand in each text, 255 at most."""
    texts = [v.decode("utf-8", "replace") for v in values.cast(pa.binary()).to_pylist()]
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    kind = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32) % 64
    return np.minimum(np.bincount(row * 64 + kind, minlength=64 * len(texts)), 255).astype(np.int16).reshape(-1, 64)


def letters_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edits that are needed at least: each brings one letter in or takes one out, or both."""
    differ = a - b
    return np.maximum(np.maximum(differ, 0).sum(1), np.maximum(-differ, 0).sum(1))


def bits_within(values: DataFrame, radius: float) -> DataFrame:
    """(a, b, distance) of different hashes within the radius, by blocks that they share, or by comparing all."""
    h, t = values.select(F.col("value").alias("x")).where("x is not null").distinct(), int(radius)
    found = blocks_meet(near_rows(h, t), block_rows(h, t), t).where("x < y") if t <= BY_BLOCKS else all_compared(h, t)
    return found.select(F.col("x").alias("a"), F.col("y").alias("b"), "distance")


#: Of a metric: what its own bound is taken from, and the bound of two arrays of that.
BOUNDS: dict[Metric, tuple[Callable, Callable]] = {edit_distance: (letter_counts, letters_apart)}
#: Of a metric: its distance of two columns, negative if it is over a radius.
SHORT: dict[Metric, Callable[[Column, Column, float], Column]] = {edit_distance: lambda a, b, radius: F.levenshtein(a, b, int(radius))}
#: Of a metric: all pairs of values within a radius by equal keys.
BY_KEYS: dict[Metric, Callable[[DataFrame, float], DataFrame]] = {bits_apart: bits_within}

#: Values of a part, about, and the least number of parts; rows and columns that are compared at a time.
PART, LEAST_PARTS, ROWS, COLUMNS = 16_384, 12, 256, 4_096


def pivots(values: DataFrame, n: int) -> list:
    """The ``n`` different values with the least md5 of their text."""
    some = values.select("value").where("value is not null").distinct()
    return [r["value"] for r in some.orderBy(F.md5(F.col("value").cast("string")), "value").limit(n).collect()]


def placed(values: DataFrame, metric: Metric, pivots: list) -> DataFrame:
    """value and d, its distances to the pivots."""
    some = values.select("value").where("value is not null").distinct()
    return some.select("value", F.array(*[metric(F.col("value"), F.lit(p)).cast("double") for p in pivots]).cast("array<double>").alias("d"))


def parts_met(values: DataFrame, metric: Metric, pivots: list) -> DataFrame:
    """(low, high, own, value, d): every two parts of the values as the rows of one group, sorted by it."""
    at = placed(values, metric, pivots)
    n = max(LEAST_PARTS, -(-at.count() // PART))
    at = at.withColumn("own", F.pmod(F.xxhash64("value"), F.lit(n)).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = at.select(F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "value", "d")
    return at.repartition(tasks_for(values, n), "low", "high").sortWithinPartitions("low", "high")


def _distances(d: pa.Array, radius: float) -> np.ndarray:
    """The distances to the pivots as rows, in single bytes if these hold their differences too."""
    out = np.asarray(d.flatten()).reshape(len(d), -1)
    out = out if out.shape[1] else np.zeros((len(d), 1))
    small = len(out) and out.min() >= 0 and out.max() + radius < 256 and radius < 128 and (out == np.floor(out)).all()
    return out.astype(np.uint8) if small else out


def _near(a: np.ndarray, b: np.ndarray, radius: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a and b, both sorted by their first column, of pairs that differ by the radius at most in all columns; if both are the same, each pair once."""
    first = b[:, 0].astype(float)
    whole = np.uint8(int(radius)) if a.dtype == np.uint8 else None
    for i in range(0, len(a), ROWS):
        some = a[i : i + ROWS]
        start, end = np.searchsorted(first, float(some[0, 0]) - radius), np.searchsorted(first, float(some[-1, 0]) + radius, "right")
        for j in range(max(start, i) if same else start, end, COLUMNS):
            others, near = b[j : min(j + COLUMNS, end)], None
            for k in range(a.shape[1]):
                differ = some[:, None, k] - others[None, :, k]
                # In bytes, differences from -radius to radius are 0 to twice the radius after adding it, and no others.
                close = differ + whole <= 2 * whole if whole is not None else np.abs(differ) <= radius
                near = close if near is None else near & close
            r, c = np.nonzero(near)
            r, c = i + r, j + c
            if same:
                r, c = r[r < c], c[r < c]
            if len(r):
                yield r, c


def _groups(batches: Iterator[pa.RecordBatch], radius: float) -> Iterator[tuple]:
    """Of every two parts that meet: their values and distances, sorted by the first of these, and whether they are the same."""
    for low, high, own, value, d in sorted_groups(batches):
        value, rows = pa.array(value) if isinstance(value, np.ndarray) else value, _distances(d, radius)
        order = np.argsort(rows[:, 0], kind="stable")
        left, right = order[own[order] == low], order[own[order] == high]
        yield value.take(pa.array(left)), rows[left], value.take(pa.array(right)), rows[right], low == high


def candidates(values: DataFrame, metric: Metric, radius: float, pivots: list) -> DataFrame:
    """(a, b) of different values that neither a pivot nor the metric's own bound keeps apart, each pair once: all within the radius are among them."""
    counts, bound = BOUNDS.get(metric, (None, None))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, a, two, b, same in _groups(batches, radius):
            of_one, of_two = (counts(one), counts(two)) if counts else (None, None)
            for r, c in _near(a, b, radius, same):
                for at in range(0, len(r), 8 * COLUMNS):
                    i, j = r[at : at + 8 * COLUMNS], c[at : at + 8 * COLUMNS]
                    if bound:
                        near = bound(of_one[i], of_two[j]) <= radius
                        i, j = i[near], j[near]
                    if len(i):
                        yield pa.RecordBatch.from_arrays([one.take(pa.array(i)), two.take(pa.array(j))], ["a", "b"])

    kind = values.schema["value"].dataType.simpleString()
    return parts_met(values, metric, pivots).mapInArrow(met, f"a {kind}, b {kind}")


def range_join(values: DataFrame, metric: Metric, radius: float, pivots: list) -> DataFrame:
    """(a, b, distance) of all different values (value) within the radius, a < b; nulls have no partner."""
    if metric in BY_KEYS:
        return BY_KEYS[metric](values, radius)
    found = candidates(values, metric, radius, pivots).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    short = SHORT.get(metric, lambda a, b, _: metric(a, b))(F.col("a"), F.col("b"), radius)
    return found.withColumn("distance", short).where((F.col("distance") >= 0) & (F.col("distance") <= radius))


def rows_of(found: DataFrame, rows: DataFrame) -> DataFrame:
    """(id1, id2, distance) of the rows (id, value) behind pairs of different values, id1 < id2; rows that share a value are in ``rows`` itself."""
    a, b = rows.select(F.col("id").alias("i"), F.col("value").alias("a")), rows.select(F.col("id").alias("j"), F.col("value").alias("b"))
    return found.join(a, "a").join(b, "b").select(F.least("i", "j").alias("id1"), F.greatest("i", "j").alias("id2"), "distance")


def pruning(values: DataFrame, metric: Metric, radius: float, pivots: list) -> DataFrame:
    """One row: how many different values there are, how many pairs they have, and how many of these no pivot keeps apart."""
    n = values.select("value").where("value is not null").distinct().agg(F.count(F.lit(1)).alias("n"))
    n = n.select(F.col("n").alias("different"), ((F.col("n") * (F.col("n") - 1)) / 2).cast("long").alias("pairs"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, a, _, b, same in _groups(batches, radius):
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(r) for r, _ in _near(a, b, radius, same))], pa.int64())], ["n"])

    met = parts_met(values, metric, pivots).mapInArrow(counted, "n long")
    return n.crossJoin(met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared")))  # one row each
