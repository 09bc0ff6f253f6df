"""Hard negatives from a vector-approximation file.

Every dimension is cut into 256 cells at quantiles of a bounded sample (the sample
decides how tight bounds are, never what is found; the outer cells reach to the
exact least and largest component of all rows). The file holds a byte a dimension
for each vector, beside the vector itself.

For an anchor, a cell's least and largest product with the anchor's component lie
around the cell's middle, half its width times the component's size to either
side. Tables of middles and halves, looked up by cell, so give a lower and an
upper bound of every score, many anchors at a time. Only rows whose bounds reach
a window (and its last place so far) are scored exactly.

Anchors go in blocks of about ANCHORS, each sent to all tasks; each block makes two
passes over all rows: one for the first positives of its anchors, one for the
windows that these open. A task keeps no more than the first rows of every window
and sends these on, so nothing grows with a label or a vector that many rows share.

Defined results: rows with a null label, a null vector, or a null or non-finite
component take no part; a component of which ``scale`` times is 2**26 or more
raises; shorter vectors count as if zeros followed; of equal scores the smaller
id comes first, null ids last; a null id is no anchor; repeated rows are rows of
their own, as anchors, positives and negatives, and "other" means another row;
where there are no positives or no row in a window, there is no row in the result;
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinspark.llm.common import joined, settled, tidy
from twinspark.llm.vectors import as_bytes, from_bytes, sound, whole_numbers

SCALE, CELLS = 256, 256
#: Rows whose components give the borders of cells.
SAMPLE = 4096
#: Anchors of one block (about so many), rows that go to Python at a time, anchors compared with these at a time, pairs scored at a time.
ANCHORS, AT_A_TIME, TILE, PAIRS = 8192, 4096, 256, 65536


class Cells(NamedTuple):
    """For each dimension the borders between cells, and the least and largest component of each cell."""

    borders: np.ndarray
    least: np.ndarray
    largest: np.ndarray

    @staticmethod
    def of(sample: np.ndarray, least: np.ndarray, largest: np.ndarray) -> Cells:
        borders = np.sort(np.quantile(sample, np.arange(1, CELLS) / CELLS, axis=0, method="nearest").T, axis=1)
        low, high = np.hstack([least[:, None], borders]), np.hstack([borders - 1, largest[:, None]])
        low, high = np.minimum(np.maximum(low, least[:, None]), largest[:, None]), np.maximum(np.minimum(high, largest[:, None]), least[:, None])
        return Cells(borders, low, np.maximum(low, high))

    def cell(self, vectors: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, v, "right") for b, v in zip(self.borders, vectors.T)], axis=1).astype(np.uint8)


class Block(NamedTuple):
    """Anchors: key of the row, id, label, vector."""

    key: np.ndarray
    id: np.ndarray
    label: np.ndarray
    vector: np.ndarray


class Firsts:
    """The first ``most`` rows of every slot by score, then id (null last); ``bar``: the score of a full slot's last row."""

    def __init__(self, slots: int, most: int):
        self.most, self.bar = most, np.full(slots, -np.inf)
        self.slot, self.score, self.id, self.none = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def add(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray, none: np.ndarray) -> None:
        slot, score, ident, none = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ident), (self.none, none)))
        order = np.lexsort((ident, none, -score, slot))
        slot = slot[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = place < self.most
        order, last = order[keep], place[keep] == self.most - 1
        self.slot, self.score, self.id, self.none = slot[keep], score[order], ident[order], none[order]
        self.bar[self.slot[last]] = self.score[last]


class Bounds:
    """Lower and upper bounds of the scores of a batch's rows with anchors."""

    def __init__(self, cells: Cells, of: np.ndarray):
        at = np.arange(of.shape[1])
        least, largest = cells.least[at, of], cells.largest[at, of]
        self.middle, self.half = (least + largest) / 2, (largest - least) / 2

    def of(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        anchors = anchors.astype(np.float64)
        score, away = self.middle @ anchors.T, self.half @ np.abs(anchors).T
        away += 1e-12 * (np.abs(self.middle) @ np.abs(anchors).T) if np.abs(anchors).max(initial=0) * np.abs(self.middle).max(initial=0) >= 2**40 else 0
        return score - away, score + away


def _scores(rows: np.ndarray, anchors: np.ndarray, r: np.ndarray, a: np.ndarray) -> np.ndarray:
    parts = [np.einsum("ij,ij->i", rows[r[k : k + PAIRS]], anchors[a[k : k + PAIRS]]) for k in range(0, len(r), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _nth(values: np.ndarray, there: np.ndarray, n: int) -> np.ndarray:
    """Of each column the n-th largest of the values that are there; minus infinity where there are fewer."""
    if len(values) < n:
        return np.full(values.shape[1], -np.inf)
    return np.partition(np.where(there, values, -np.inf), len(values) - n, axis=0)[len(values) - n]


def _batch(b: pa.RecordBatch, width: int) -> tuple:
    """(key, id, whether it is null, label, cells, vectors) of a batch of the file."""
    ids = b.column(1)
    return (
        b.column(0).to_numpy(),
        ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
        ids.is_null().to_numpy(zero_copy_only=False),
        b.column(2).to_numpy(),
        from_bytes(b.column(3), "u1", width),
        from_bytes(b.column(4), "<i4", width).astype(np.int64),
    )


def _positives(block: Block, cells: Cells, most: int):
    """Each task's first rows of an anchor's label: anchor (its place in the block), score, vec_id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = Firsts(len(block.key), most)
        for batch in batches:
            key, ident, none, label, of, vectors = _batch(batch, len(cells.borders))
            found = []
            for same in np.unique(label):
                rows, anchors = np.flatnonzero(label == same), np.flatnonzero(block.label == same)
                bounds = Bounds(cells, of[rows])
                for tile in (anchors[k : k + TILE] for k in range(0, len(anchors), TILE)):
                    low, high = bounds.of(block.vector[tile])
                    other = key[rows][:, None] != block.key[tile]
                    r, a = np.nonzero(other & (high >= np.maximum(_nth(low, other, most), firsts.bar[tile])))
                    r, a = rows[r], tile[a]
                    found.append((a, _scores(vectors, block.vector, r, a), ident[r], none[r]))
            if found:
                firsts.add(*map(np.concatenate, zip(*found)))
        yield pa.RecordBatch.from_arrays([pa.array(firsts.slot), pa.array(firsts.score), pa.array(firsts.id, mask=firsts.none)], ["anchor", "score", "vec_id"])

    return tidy(work)


def _negatives(block: Block, cells: Cells, anchor: np.ndarray, lowest: np.ndarray, highest: np.ndarray, most: int):
    """Each task's first rows of every window: slot, score, vec_id. A slot is a window; ``anchor`` is its place in the block, in order."""
    begins = np.searchsorted(anchor, np.arange(len(block.key) + 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = Firsts(len(anchor), most)
        for batch in batches:
            _, ident, none, label, of, vectors = _batch(batch, len(cells.borders))
            bounds, found = Bounds(cells, of), []
            for start in range(0, len(block.key), TILE):
                stop = min(start + TILE, len(block.key))
                low, high = bounds.of(block.vector[start:stop])
                other = label[:, None] != block.label[start:stop]
                pairs, most_windows = [], int(np.diff(begins[start : stop + 1]).max(initial=0))
                for j in range(most_windows):  # the j-th window of each anchor
                    slot = begins[start:stop] + j
                    there = np.flatnonzero(slot < begins[start + 1 : stop + 1])
                    slot = slot[there]
                    lo, hi = low[:, there], high[:, there]
                    inside = other[:, there] & (lo >= lowest[slot]) & (hi <= highest[slot])
                    bar = np.maximum(np.maximum(_nth(lo, inside, most), firsts.bar[slot]), lowest[slot])
                    r, a = np.nonzero(other[:, there] & (hi >= bar) & (lo <= highest[slot]))
                    pairs.append((r, there[a] + start, slot[a]))
                r, a, slot = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 3
                once, back = np.unique(r * (stop - start) + a - start, return_inverse=True)  # windows share rows: each pair is scored once
                score = _scores(vectors, block.vector, once // (stop - start), once % (stop - start) + start)[back]
                keep = (score >= np.maximum(lowest[slot], firsts.bar[slot])) & (score <= highest[slot])
                found.append((slot[keep], score[keep], ident[r[keep]], none[r[keep]]))
            if found:
                firsts.add(*map(np.concatenate, zip(*found)))
        yield pa.RecordBatch.from_arrays([pa.array(firsts.slot), pa.array(firsts.score), pa.array(firsts.id, mask=firsts.none)], ["slot", "score", "vec_id"])

    return tidy(work)


def _measured(rows: DataFrame, scale: int) -> tuple[int, Cells] | None:
    """The width of the longest vector, and cells; two passes over the components, a bounded answer."""
    width = rows.agg(F.max(F.size("embedding"))).first()[0]
    if width is None:
        return None
    width = max(width, 1)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, largest = np.full(width, np.iinfo(np.int64).max), np.full(width, np.iinfo(np.int64).min)
        for b in batches:
            if b.num_rows:
                v = whole_numbers(b.column(0), scale, width)
                least, largest = np.minimum(least, v.min(0)), np.maximum(largest, v.max(0))
        if width and least[0] <= largest[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(least), pa.array(largest)], ["at", "least", "largest"])

    of = rows.select("embedding").mapInArrow(tidy(ranges), "at long, least long, largest long").groupBy("at").agg(F.min("least"), F.max("largest"))
    extremes = np.array(sorted(map(tuple, of.collect())), np.int64).reshape(-1, 3)  # a row a dimension
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(SAMPLE).toArrow()
    return width, Cells.of(whole_numbers(sample["embedding"].combine_chunks(), scale, width), extremes[:, 1], extremes[:, 2])


def _file(rows: DataFrame, cells: Cells, width: int, scale: int) -> DataFrame:
    """The vector-approximation file: key, vec_id, label, cells, vector, is_anchor."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = whole_numbers(b.column(3), scale, width)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), as_bytes(cells.cell(v), "u1"), as_bytes(v, "<i4"), b.column(4)], ["key", "vec_id", "label", "cells", "vector", "is_anchor"])

    keyed = rows.select(F.monotonically_increasing_id().alias("key"), "vec_id", "label", "embedding", "is_anchor")
    return settled(keyed.mapInArrow(tidy(work), "key long, vec_id long, label long, cells binary, vector binary, is_anchor boolean"), AT_A_TIME)


def _first(rows: DataFrame, slot: str, most: int) -> DataFrame:
    """The first ``most`` rows of every slot, and their rank."""
    order = W.partitionBy(slot).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(embeddings: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` tells which rows are anchors, ``label`` gives a row's label (a whole
    number). A window reaches from window[0] to window[1] hundredths of the
    positive's score.
    """
    spark, out = embeddings.sparkSession, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = embeddings.select("vec_id", label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    rows = rows.where(F.col("label").isNotNull() & sound(F.col("embedding")))
    measured = _measured(rows, scale)
    if measured is None:
        return spark.createDataFrame([], out)
    width, cells = measured
    file = _file(rows, cells, width, scale)
    chosen = file.where("is_anchor")
    blocks = chosen.count() // ANCHORS + 1
    chosen = settled(chosen.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))))
    read, done = file.select("key", "vec_id", "label", "cells", "vector"), []
    for k in range(blocks):  # each block is a pass over all rows
        some = chosen.where(F.col("block") == k).select("key", "vec_id", "label", "vector").toArrow().combine_chunks()
        if not some.num_rows:
            continue
        key, ident, labels = (some[c].to_numpy() for c in ("key", "vec_id", "label"))
        block = Block(key, ident, labels, from_bytes(some["vector"].combine_chunks(), "<i4", width).astype(np.int64))
        found = settled(read.mapInArrow(_positives(block, cells, positives), "anchor long, score long, vec_id long"), AT_A_TIME)
        first = _first(found, "anchor", positives).orderBy("anchor", "rank").toArrow()  # ``positives`` rows an anchor of the block
        anchor, score = first["anchor"].to_numpy(), first["score"].to_numpy()
        lowest, highest = -((-window[0] * score) // 100), (window[1] * score) // 100
        inside = settled(read.mapInArrow(_negatives(block, cells, anchor, lowest, highest, negatives), "slot long, score long, vec_id long"), AT_A_TIME)
        names = pa.table({"slot": np.arange(len(anchor)), "anchor_id": ident[anchor], "positive_id": first["vec_id"], "positive_score": score})
        of = _first(inside, "slot", negatives).join(F.broadcast(spark.createDataFrame(names)), "slot")
        done.append(settled(of.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
    return joined(spark, done) if done else spark.createDataFrame([], out)


def sql(scale: int = SCALE) -> str:
    """The query's rows by comparing each anchor with all rows."""
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor({scale} * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
s AS MATERIALIZED (SELECT a.k, a.vec_id AS anchor_id, b.k AS other, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.k <> b.k),
p AS (SELECT k, other, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id, other) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.k, p.other ORDER BY score DESC, vec_id, s.other))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.k = s.k AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""
