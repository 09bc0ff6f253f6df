"""Connected components and what is built on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame], rounds: int = 50) -> DataFrame:
    """(id, component) of all ends of the edges (src, dst); component is the least id in it.

    Large-star and small-star rounds (Kiveris et al., SoCC 2014): each turns a
    node's edges into edges to the least node around it, so the number of edges
    never grows and hubs stay spread by their neighbours. ``keep`` stores a round's
    edges where every executor can read them again.
    """
    start = edges.select(F.least("src", "dst").alias("v"), F.greatest("src", "dst").alias("u")).where("u <> v").distinct()
    now, before = keep(start), None
    for _ in range(rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above a node go to the least of it and its neighbours.
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and those below it go to the least of them.
        least = _least(large)
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = keep(small)
        state = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def without_negatives(edges: DataFrame, negatives: DataFrame) -> DataFrame:
    """Edges (src, dst) that no negative edge (src, dst) names, in either direction."""
    key = lambda df: df.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return key(edges).distinct().join(key(negatives).distinct(), ["src", "dst"], "left_anti")


def relation_edges(files: DataFrame, relations: DataFrame, types: tuple[str, ...], exact_hash: bool = True) -> tuple[DataFrame, DataFrame]:
    """Positive and negative edges between files: enabled relation types, and equal hashes as stars."""
    from twinspark.operators.pairs import exact_stars

    known = files.select("id")
    inside = relations.join(known.withColumnRenamed("id", "id1"), "id1", "left_semi").join(known.withColumnRenamed("id", "id2"), "id2", "left_semi")
    edge = [F.col("id1").alias("src"), F.col("id2").alias("dst")]
    positive = inside.where(F.col("relation_type").isin(*[t for t in types if t != "not_duplicate"])).select(*edge)
    if exact_hash:
        positive = positive.unionByName(exact_stars(files).select(*edge))
    negative = inside.where((F.col("relation_type") == "not_duplicate") & F.lit("not_duplicate" not in types)).select(*edge)
    return positive, negative


def edge_counts(files: DataFrame, relations: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Edges by kind: pairs of equal hashes and relations."""
    from twinspark.operators.pairs import exact_groups

    n = exact_groups(files).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("long").alias("n")).select(F.lit("hash").alias("kind"), "n")
    known = files.select("id")
    inside = relations.join(known.withColumnRenamed("id", "id1"), "id1", "left_semi").join(known.withColumnRenamed("id", "id2"), "id2", "left_semi")
    return n.unionByName(inside.where(F.col("relation_type").isin(*[t for t in types if t != "not_duplicate"])).agg(F.count(F.lit(1)).alias("n")).select(F.lit("db").alias("kind"), "n"))


def groups(found: DataFrame) -> DataFrame:
    """component and size, the largest first."""
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "component")


def hash_cliques(found: DataFrame, hashed: DataFrame, t: int) -> DataFrame:
    """All pairs of each component with the distance of their ``hashed`` numbers (id, x), NULL beyond t bits: ``cliques`` without a table of known pairs."""
    rows = found.join(hashed, "id")
    a = rows.select(F.col("id").alias("id1"), "component", "x")
    b = rows.select(F.col("id").alias("id2"), "component", F.col("x").alias("y"))
    apart = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    return a.join(b, "component").where("id1 < id2").select("id1", "id2", "component", F.when(apart <= t, apart).alias("distance"))


def cliques(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """All pairs of each component. With ``known`` (id1, id2, distance) their distance, NULL where never compared; else 0.0.

    The number of rows grows with the square of a component; it is a report for reviewing, no step of another operator.
    """
    a = found.select(F.col("id").alias("id1"), "component")
    b = found.select(F.col("id").alias("id2"), "component")
    pairs = a.join(b, "component").where("id1 < id2").select("id1", "id2", "component")
    if known is None:
        return pairs.withColumn("distance", F.lit(0.0))
    return pairs.join(known.select("id1", "id2", "distance"), ["id1", "id2"], "left")
