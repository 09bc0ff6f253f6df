"""Clusters around centroids by annulus search, in whole numbers.

Centroids are sorted by norm. The distance from a vector to the centroid it was
assigned to before, where that now lies, bounds the distance to its nearest one.
As norms differ by no more than the distance, only centroids with a norm within
that bound of the vector's own can be nearer: two binary searches give them, and
these alone are compared, exactly. The annulus is widened by more than rounding
can take away, so centroids on its border (ties among them) are compared too. In
the first round the bound is the distance to the centroid nearest in norm.

Every round is one pass: tasks assign their vectors, write them with the number
of their centroid, and add a row of sums for each centroid. Sums of all tasks
are added in Spark; ``k`` centroids come to the driver and go back to tasks.
Only two rounds' tables exist at a time.

Defined results: vectors of another width, null, or with a null or non-finite
component take no part; a component of which ``scale`` times is 2**26 or more
raises, as distances would not fit 64 bits; repeated rows and null ids count as
vectors of their own, null ids being the last to start a centroid; of equal
distances the smaller centroid number wins; with fewer than ``k`` vectors there
are as many centroids; an empty table gives an empty result; further columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.llm.common import dropped, settled, tidy
from twinspark.llm.vectors import as_bytes, from_bytes, sound, whole_numbers

WIDTH, SCALE = 64, 1024
#: Vectors that go to Python at a time, and pairs of a vector and a centroid that are compared at a time.
AT_A_TIME, PAIRS = 8192, 65536

_ASSIGNED = "vec_id {id}, vector binary, cluster int, distance long, n long, sums array<long>, summed int"


class Annuli:
    """Centroids by norm."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        norms = np.sqrt((centroids * centroids).sum(1))
        self.number = np.argsort(norms, kind="stable")
        self.norms = norms[self.number]

    def within(self, vectors: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in the order of norms, from first to before last, that can be as near as ``before`` (-1: none yet)."""
        norms = np.sqrt((vectors * vectors).sum(1))
        by_norm = np.clip(np.searchsorted(self.norms, norms), 1, len(self.norms)) - 1
        next_up = np.minimum(by_norm + 1, len(self.norms) - 1)
        nearer = np.where(np.abs(self.norms[next_up] - norms) < np.abs(self.norms[by_norm] - norms), next_up, by_norm)
        away = vectors - self.centroids[np.where(before < 0, self.number[nearer], before)]
        bound = np.sqrt((away * away).sum(1))
        bound += 1e-9 * (bound + norms + 1)
        return np.searchsorted(self.norms, norms - bound, "left"), np.searchsorted(self.norms, norms + bound, "right")

    def nearest(self, vectors: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each vector's nearest centroid and the squared distance to it."""
        first, last = self.within(vectors, before)
        cluster, distance = np.empty(len(vectors), np.int64), np.empty(len(vectors), np.int64)
        ends = np.cumsum(last - first)
        start = 0
        while start < len(vectors):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
            sizes = (last - first)[start:stop]
            begins = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(start, stop), sizes)
            number = self.number[np.arange(len(row)) - np.repeat(begins - first[start:stop], sizes)]
            away = vectors[row] - self.centroids[number]
            squares = np.einsum("ij,ij->i", away, away)
            distance[start:stop] = np.minimum.reduceat(squares, begins)
            cluster[start:stop] = np.minimum.reduceat(np.where(squares == distance[row], number, len(self.number)), begins)
            start = stop
        return cluster, distance


def _assign(centroids: np.ndarray):
    """Rows of ``vec_id, vector, cluster`` to these with the nearest centroid; last a row of sums for each centroid met."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli, (k, width) = Annuli(centroids), centroids.shape
        n, inertia, sums, kind = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, width), np.int64), pa.int64()
        row = lambda ids, vectors, cluster, distance, n, sums, summed: pa.RecordBatch.from_arrays(
            [ids, vectors, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), n, sums, pa.array(np.full(len(cluster), summed, np.int32))],
            ["vec_id", "vector", "cluster", "distance", "n", "sums", "summed"],
        )
        for batch in batches:
            kind, m = batch.column(0).type, batch.num_rows
            vectors = from_bytes(batch.column(1), "<i4", width).astype(np.int64)
            cluster, distance = annuli.nearest(vectors, batch.column(2).to_numpy(zero_copy_only=False))
            n += np.bincount(cluster, minlength=k)
            np.add.at(inertia, cluster, distance)
            for c in np.unique(cluster):
                sums[c] += vectors[cluster == c].sum(0)
            yield row(batch.column(0), batch.column(1), cluster, distance, pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int64())), 0)
        met = np.flatnonzero(n)
        if len(met):
            yield row(pa.nulls(len(met), kind), pa.nulls(len(met), pa.binary()), met, inertia[met], pa.array(n[met]), pa.array(sums[met].tolist(), pa.list_(pa.int64())), 1)

    return tidy(work)


def cluster(embeddings: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, width: int = WIDTH, scale: int = SCALE) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, cluster, distance) of every vector that takes part; the final centroids; the sum of squared distances to each.

    The first centroids are the ``k`` vectors with the least SHA-256 of ``seed:vec_id``.
    """
    spark, kind = embeddings.sparkSession, embeddings.schema["vec_id"].dataType.simpleString()

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), as_bytes(whole_numbers(b.column(1), scale, width), "<i4"), pa.array(np.full(b.num_rows, -1, np.int32))], ["vec_id", "vector", "cluster"])

    wide = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(sound(F.col("embedding"), width))
    table = settled(wide.mapInArrow(tidy(numbers), f"vec_id {kind}, vector binary, cluster int"), AT_A_TIME)
    first = table.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "vector").limit(k).collect()
    vectors = table
    centroids = np.array([np.frombuffer(r["vector"], "<i4") for r in first], np.int64).reshape(len(first), width)
    inertia = [0] * len(first)
    for left in range(rounds if first else -1, -1, -1):
        found = settled(vectors.select("vec_id", "vector", "cluster").mapInArrow(_assign(centroids), _ASSIGNED.format(id=kind)), AT_A_TIME, ("summed",))
        dropped(table)
        table, vectors, sums = found, found.where("summed = 0"), found.where("summed = 1")
        if left:
            each = sums.select("cluster", "n", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("sum"), F.sum("n").alias("n"))
            centroids = centroids.copy()
            for r in each.collect():  # k * width rows
                centroids[r["cluster"], r["pos"]] = int(r["sum"]) // r["n"]
        else:
            for r in sums.groupBy("cluster").agg(F.sum("distance").alias("distance")).collect():
                inertia[r["cluster"]] = r["distance"]
    return vectors.select("vec_id", "cluster", "distance" if first else F.lit(None).cast("long").alias("distance")), centroids, inertia


def digest(embeddings: DataFrame, **how: int) -> DataFrame:
    """``cluster`` with its centroid as a hash and the sums of squared distances, of the cluster and of all."""
    found, centroids, inertia = cluster(embeddings, **how)
    rows = [(c, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()) for c, centre in enumerate(centroids.tolist())]
    of = embeddings.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 8, rounds: int = 10, seed: int = 3, width: int = WIDTH, scale: int = SCALE) -> str:
    """The same in SQL, round after round."""
    dot = "list_inner_product({0}, {1})"
    square = f"{dot.format('v', 'v')} - 2 * {dot.format('v', 'w')} + {dot.format('w', 'w')}"
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, [floor({scale} * x::DOUBLE) FOR x IN embedding] AS v, row_number() OVER () AS k FROM embeddings
  WHERE len(embedding) = {width} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {width})""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1)::INT AS c, v AS w FROM v ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT k, min((({square})::HUGEINT * {k} + c)) AS best FROM v, c{r} GROUP BY k)")
        if r < rounds:
            steps.append(f"""s{r} AS MATERIALIZED (SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n
  FROM (SELECT (best % {k})::INT AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v JOIN a{r} USING (k)) GROUP BY c, i)""")
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c, coalesce(moved, w) AS w FROM c{r}
  LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS moved FROM s{r} GROUP BY c) USING (c))""")
    return f"""WITH {", ".join(steps)}, f AS (SELECT vec_id, (best % {k})::INT AS cluster, (best // {k})::BIGINT AS distance FROM v JOIN a{rounds} USING (k))
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string([x::BIGINT FOR x IN w], ',')) AS centroid_sha256
FROM f JOIN c{rounds} ON c = cluster"""
