"""Nearest neighbours by an inverted file: vectors in cells around centroids, of which a query looks into the nearest few.

Centroids come from a few k-means rounds over a bounded sample; all vectors are
then put into the cell of their nearest centroid, in Parquet folders of that
cell, next to a table of the cells and their sizes. A search finds each query's
``probe`` nearest centroids, meets the vectors of these cells only, and ranks
what they give by the exact distance. What is left out is a neighbour in a cell
that isn't looked into: ``recall`` measures how many of them there are, and
``probes_for`` finds the least number of cells that is good enough. ``pairs.knn``
is the exact way.

Centroids are whole numbers (unit vectors times SCALE, rounded down), so the same
sample gives the same cells everywhere. A cell of more than PART vectors, and more
than that many queries of a cell, meet in parts: a hot cell is dealt to many tasks.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinspark.operators.pairs import best_of, knn, unit_rows

SCALE = 4096
#: Vectors that centroids are learned from; vectors or queries of a cell that meet in one task.
SAMPLE, PART = 20_000, 50_000


class Index(NamedTuple):
    """Centroids, one a row; the folder of the vectors (id, embedding, cell); how many are in each cell."""

    centroids: np.ndarray
    path: str
    sizes: np.ndarray


def _order() -> Column:
    return F.md5(F.col("id").cast("string"))


def _grid(vectors: pd.Series) -> np.ndarray:
    return np.floor(unit_rows(vectors) * SCALE).astype(np.int64)


def _away(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact: whole numbers below 2**53."""
    a, b = rows.astype(float), centroids.astype(float)
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)


def train(vectors: DataFrame, cells: int, rounds: int = 5, sample: int = SAMPLE) -> np.ndarray:
    """Centroids from the ``sample`` vectors with the least md5 of their id; the first ``cells`` of them begin, empty cells stay."""
    rows = vectors.select("id", "embedding").where("embedding is not null").orderBy(_order(), "id").limit(sample).toPandas()
    if not len(rows):
        raise ValueError("no vector to learn from")
    grid = _grid(rows["embedding"])
    centroids = grid[:cells].copy()
    for _ in range(rounds):
        cell = _away(grid, centroids).argmin(1)
        for c in np.unique(cell):
            own = grid[cell == c]
            centroids[c] = own.sum(0) // len(own)
    return centroids


def _cell_of(centroids: np.ndarray, probe: int):
    """The ``probe`` nearest cells of a vector, nearest first; of equal distances the smaller number."""

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.argsort(_away(_grid(vectors), centroids), axis=1, kind="stable")[:, :probe].astype(np.int32)))

    return nearest


def build(vectors: DataFrame, centroids: np.ndarray, path: str) -> Index:
    """All vectors (id, embedding) in folders of their cells; null vectors have no cell."""
    rows = vectors.select("id", "embedding").where("embedding is not null")
    placed = rows.withColumn("cell", F.get(_cell_of(centroids, 1)("embedding"), F.lit(0)))
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
    return opened(vectors.sparkSession, centroids, path)


def add(index: Index, vectors: DataFrame) -> Index:
    """The index with more vectors; cells stay as they were learned."""
    rows = vectors.select("id", "embedding").where("embedding is not null")
    placed = rows.withColumn("cell", F.get(_cell_of(index.centroids, 1)("embedding"), F.lit(0)))
    placed.hint("rebalance", "cell").write.partitionBy("cell").mode("append").parquet(index.path)
    return opened(vectors.sparkSession, index.centroids, index.path)


def contents(spark: SparkSession, index: Index) -> DataFrame:
    return spark.read.parquet(index.path)


def opened(spark: SparkSession, centroids: np.ndarray, path: str) -> Index:
    """An index that was written before; one row a cell comes to the driver."""
    sizes = np.zeros(len(centroids), np.int64)
    for r in spark.read.parquet(path).groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    return Index(centroids, path, sizes)


def search(queries: DataFrame, index: Index, k: int = 20, probe: int = 8, digits: int | None = None) -> DataFrame:
    """(id, match_id, distance, rank): the k nearest in the ``probe`` nearest cells of each query, a query itself included; ties by id."""
    spark = queries.sparkSession
    parts = np.maximum(1, -(-index.sizes // PART))
    asked = queries.select("id", "embedding").where("embedding is not null").withColumn("cell", F.explode(_cell_of(index.centroids, probe)("embedding")))
    blocks = {r["cell"]: -(-r["count"] // PART) for r in asked.groupBy("cell").count().collect()}  # one row a cell
    rows = [(c, int(parts[c]), int(blocks.get(c, 1))) for c in range(len(parts)) if index.sizes[c]]
    deal = F.broadcast(spark.createDataFrame(rows, "cell int, parts int, blocks int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = asked.join(deal, "cell").select(F.col("id").alias("qid"), F.col("embedding").alias("qv"), "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("qb"), every("parts").alias("vp"))
    v = contents(spark, index).join(deal, "cell").select("id", "embedding", "cell", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int").alias("vp"), every("blocks").alias("qb"))
    near = q.groupBy("cell", "qb", "vp").cogroup(v.groupBy("cell", "qb", "vp")).applyInPandas(best_of(k, digits), "id long, match_id long, distance double")
    rank = F.row_number().over(W.partitionBy("id").orderBy("distance", "match_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours (id, match_id) that were found."""
    both = exact.join(found.select("id", "match_id"), ["id", "match_id"], "left_semi")
    return both.count() / max(1, exact.count())


def probes_for(vectors: DataFrame, index: Index, k: int = 20, wanted: float = 0.9, queries: int = 256) -> int:
    """The least number of cells with the wanted recall over the ``queries`` vectors with the least md5 of their id: these are searched exactly."""
    some = vectors.select("id", "embedding").where("embedding is not null").orderBy(_order(), "id").limit(queries)
    exact = knn(some, vectors, k).select("id", "match_id")
    cell = contents(vectors.sparkSession, index).select(F.col("id").alias("match_id"), "cell")
    order = some.select("id", F.posexplode(_cell_of(index.centroids, len(index.centroids))("embedding")).alias("place", "cell"))
    places = exact.join(cell, "match_id").join(order, ["id", "cell"]).groupBy("place").count().collect()  # one row a cell
    found, total, at = 0, sum(r["count"] for r in places), 0
    for r in sorted(places):
        found, at = found + r["count"], r["place"] + 1
        if found >= wanted * total:
            break
    return max(1, at)
