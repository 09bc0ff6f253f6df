"""Files: lookups, upserts, deletes, moves, staleness and maintenance, all as DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinspark.functions.hashes import CHUNKS, with_chunks
from twinspark.operators.clusters import numbered
from twinspark.operators.store import Store


def by_ids(files: DataFrame, ids: DataFrame) -> DataFrame:
    return files.join(ids.select("id").distinct(), "id", "left_semi")


def missing_ids(files: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("id").distinct().join(files.select("id"), "id", "left_anti")


def upsert(files: DataFrame, new: DataFrame, order: str = "seq", keep_hash: bool = False, largest: int | None = None) -> DataFrame:
    """Insert or update by path; ids stay, new ones follow the largest in the order of paths, the last row of a path wins.

    ``keep_hash``: a missing new hash leaves the stored one. ``largest``: the largest id so far, where ``files`` is a part of the table.
    """
    w = W.partitionBy("path").orderBy(F.desc(order))
    new = new.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", order)
    cols = [c for c in new.columns if c != "path" and c not in CHUNKS]
    side = new.select("path", F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in cols])
    both = files.drop(*CHUNKS).join(side, "path", "full_outer")
    value = {c: F.coalesce(f"_{c}", c) if keep_hash and c == "phash" else F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in cols}
    both = both.select("path", "id", *[value[c].alias(c) if c in value else F.col(c) for c in files.columns if c not in ("path", "id", *CHUNKS)])
    old, fresh = both.where("id is not null"), both.where("id is null").drop("id")
    if largest is None:
        top = files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
        fresh = numbered(fresh, "path").crossJoin(F.broadcast(top))  # one row
    else:
        fresh = numbered(fresh, "path").withColumn("_top", F.lit(largest).cast("long"))
    fresh = fresh.withColumn("id", F.col("number") + F.col("_top")).drop("number", "_top")
    out = old.unionByName(fresh)
    return with_chunks(out).select(*files.columns) if CHUNKS[0] in files.columns else out.select(*files.columns)


def upsert_into(store: Store, new: DataFrame, table: str = "files", order: str = "seq", keep_hash: bool = False) -> int:
    """``upsert`` into a table that a store keeps in buckets of the path: k paths read and write k buckets at most. Returns the version."""
    buckets = store.touched(table, new)
    largest = store.note(f"{table}.largest_id")
    if largest is None:  # nothing was upserted yet; later upserts needn't read the whole table
        largest = store.read(table).agg(F.max("id")).first()[0] or 0
    change = store.rewritten(table, upsert(store.read(table, buckets=buckets), new, order, keep_hash, largest), buckets)
    written = [f"{store.root}/{folder}" for folder in change.buckets.values() if folder]
    top = store.spark.read.parquet(*written).agg(F.max("id")).first()[0] if written else 0
    return store.publish([change], notes={f"{table}.largest_id": max(largest, top or 0)})


def delete(files: DataFrame, relations: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the paths, and relations without their files."""
    left = files.join(paths.select("path").distinct(), "path", "left_anti")
    return left, cascade(left, relations)


def cascade(files: DataFrame, relations: DataFrame) -> DataFrame:
    ids = files.select("id")
    return relations.join(ids.withColumnRenamed("id", "id1"), "id1", "left_semi").join(ids.withColumnRenamed("id", "id2"), "id2", "left_semi")


def move(files: DataFrame, moves: DataFrame, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """moves: path, new_path. A file at the new path goes; ids stay; memberships follow."""
    m = moves.select("path", "new_path")
    real = m.join(files.select("path"), "path", "left_semi")
    over = real.select(F.col("new_path").alias("path")).join(real.select("path"), "path", "left_anti")
    left = files.join(over, "path", "left_anti")
    cols = files.columns
    out = left.join(real, "path", "left").withColumn("path", F.coalesce("new_path", "path")).select(*cols)
    if members is None:
        return out, None
    follow = real.select(F.col("path").alias("file_path"), "new_path")
    return out, members.join(follow, "file_path", "left").select("cluster_id", F.coalesce("new_path", "file_path").alias("file_path")).distinct()


def stale(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Listed paths that are to be hashed: unknown, changed since, or without a hash; unreadable ones (NULL time) are skipped."""
    known = files.select("path", F.col("last_modified").alias("_t"), F.col("phash").alias("_h"))
    same = (F.col("last_modified") == F.col("_t")) & (F.coalesce("_h", F.lit("")) != "")
    return listing.join(known, "path", "left").where(F.col("last_modified").isNotNull() & ~F.coalesce(same, F.lit(False))).drop("_t", "_h")


def unindexed(listing: DataFrame, vectors: DataFrame, engine: str) -> DataFrame:
    """Paths without a vector of the engine."""
    return listing.join(vectors.where(F.col("engine") == engine).select("path"), "path", "left_anti")


def upsert_vectors(vectors: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    key = ["path", "engine"]
    one = new.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order)))).where("_k = 1").select(*vectors.columns)
    return one.unionByName(vectors.join(one.select(*key), key, "left_anti").select(*vectors.columns))


def mark_indexed(status: DataFrame, new: DataFrame) -> DataFrame:
    key = ["path", "engine"]
    last = new.groupBy(*key).agg(F.max("indexed_at").alias("indexed_at"))
    return last.unionByName(status.join(last.select(*key), key, "left_anti").select(*key, "indexed_at"))


def clear_indexed(status: DataFrame, path: str | None = None) -> DataFrame:
    return status.where(F.lit(False)) if path is None else status.where(F.col("path") != path)


def add_scanned(scanned: DataFrame, new: DataFrame) -> DataFrame:
    return scanned.select("path").union(new.select("path")).distinct()


def root_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Roots that came and went."""
    came = new.select("path").subtract(old.select("path")).withColumn("change", F.lit("added"))
    return came.unionByName(old.select("path").subtract(new.select("path")).withColumn("change", F.lit("removed")))


def maintain(files: DataFrame, listing: DataFrame, relations: DataFrame, members: DataFrame, clusters: DataFrame, status: DataFrame) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """Missing files go, then what is left without an owner; the tables and the counts of what went."""
    out = {"files": files.join(listing.select("path"), "path", "left_semi")}
    paths = out["files"].select("path")
    out["status"] = status.join(paths, "path", "left_semi")
    out["members"] = members.join(paths.withColumnRenamed("path", "file_path"), "file_path", "left_semi")
    out["relations"] = cascade(out["files"], relations)
    out["clusters"] = clusters.join(out["members"].select(F.col("cluster_id").alias("id")), "id", "left_semi")
    was = {"files": files, "status": status, "members": members, "relations": relations, "clusters": clusters}
    return out, {k: was[k].count() - out[k].count() for k in was}


def integrity(files: DataFrame, relations: DataFrame, members: DataFrame, clusters: DataFrame) -> DataFrame:
    """metric, value: totals and orphans."""
    ids = files.select("id").distinct()
    ends = relations.join(ids.select(F.col("id").alias("id1"), F.lit(1).alias("x1")), "id1", "left").join(ids.select(F.col("id").alias("id2"), F.lit(1).alias("x2")), "id2", "left")
    lost = ends.where("x1 is null or x2 is null")
    stray = members.join(files.select(F.col("path").alias("file_path")), "file_path", "left_anti")
    empty = clusters.join(members.select(F.col("cluster_id").alias("id")), "id", "left_anti")
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")
    out = one("files", files)
    for name, df in (("relations", relations), ("members", members), ("clusters", clusters), ("orphan_relations", lost), ("orphan_members", stray), ("empty_clusters", empty)):
        out = out.unionByName(one(name, df))
    return out
