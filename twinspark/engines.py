"""Engines as pure functions: fingerprints and pairs of a table of files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark import schemas
from twinspark.functions import hashes
from twinspark.operators import pairs


@dataclass(frozen=True)
class Engine:
    """``fingerprint`` adds what ``pairs`` compares; ``pairs`` gives (id1, id2, distance) within a threshold."""

    name: str
    fingerprint: Callable[[DataFrame], DataFrame]
    pairs: Callable[[DataFrame, float], DataFrame]

    @property
    def threshold(self) -> float:
        return schemas.THRESHOLDS[self.name]


def _hash_images(images: DataFrame) -> DataFrame:
    """Grey values (pixels: 32 x 32) to their hash."""
    low = images.withColumn("low", hashes.low_frequencies(F.col("pixels")))
    return hashes.with_chunks(low.withColumn("phash", hashes.median_hash(F.col("low"))).drop("pixels", "low"))


def _vector_pairs(vectors: DataFrame, t: float) -> DataFrame:
    return pairs.knn_pairs(pairs.knn(vectors, vectors), t)


def embedding_engine(name: str, embed: Callable[[DataFrame], DataFrame] | None = None, normalise: bool = True) -> Engine:
    """``embed`` adds the column embedding; without one the table has it already."""

    def fingerprint(files: DataFrame) -> DataFrame:
        out = embed(files) if embed else files
        return out.withColumn("embedding", hashes.l2_normalised(F.col("embedding"))) if normalise else out

    return Engine(name, fingerprint, _vector_pairs)


ENGINES: dict[str, Engine] = {
    "phash": Engine("phash", _hash_images, lambda df, t: pairs.hamming_join(df, int(t))),
    "clip": embedding_engine("clip"),
    "blip": embedding_engine("blip"),
    "mobilenet": embedding_engine("mobilenet", normalise=False),
}


def engine(name: str) -> Engine:
    """Unknown names give the hash engine."""
    return ENGINES.get(name, ENGINES["phash"])


@dataclass
class Session:
    """What a scan is asked for."""

    roots: list[str] = field(default_factory=list)
    engine: str = "phash"
    threshold: float | None = None
    include_ignored: bool = False
    types: tuple[str, ...] = ("duplicate", "near_duplicate")
    exact_hash: bool = True

    @property
    def limit(self) -> float:
        return schemas.THRESHOLDS.get(self.engine, schemas.THRESHOLDS["phash"]) if self.threshold is None else self.threshold
