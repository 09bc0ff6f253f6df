"""Persistent clusters and their reconciliation with components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinspark.operators.running import numbered


def membership(members: DataFrame) -> DataFrame:
    """file_path, cluster_id; a path in several clusters counts to the lowest."""
    return members.groupBy("file_path").agg(F.min("cluster_id").alias("cluster_id"))


def reconcile(components: DataFrame, members: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components (path, component) shown as clusters, and the memberships to add.

    A component that touches clusters is shown under the lowest of them; its paths
    that are in no cluster become members. Members in no component stay where they
    are if their file is there. Other components of two or more files get transient
    ids -1, -2, ... in the order of their component label.

    Returns (cluster_id, path) and (cluster_id, file_path).
    """
    owner = membership(members).withColumnRenamed("file_path", "path").withColumnRenamed("cluster_id", "owner")
    here = files.select("path").distinct()
    found = components.select("path", "component").join(owner, "path", "left")
    primary = found.groupBy("component").agg(F.min("owner").alias("primary"))
    found = found.join(primary, "component")
    delta = found.where(F.col("primary").isNotNull() & F.col("owner").isNull()).select(F.col("primary").alias("cluster_id"), F.col("path").alias("file_path"))
    shown = found.join(here, "path", "left_semi")
    kept = shown.where("primary is not null").select(F.col("primary").alias("cluster_id"), "path")
    sticky = members.select("cluster_id", F.col("file_path").alias("path")).join(components.select("path"), "path", "left_anti").join(here, "path", "left_semi").select("cluster_id", "path")
    fresh = shown.where("primary is null")
    sizes = fresh.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    number = numbered(sizes, "component").select("component", (-F.col("number")).alias("cluster_id"))
    new = fresh.join(number, "component").select("cluster_id", "path")
    return kept.unionByName(sticky).unionByName(new).distinct(), delta


def inside_roots(shown: DataFrame, inside: Column) -> DataFrame:
    """Clusters all paths of which are inside the roots."""
    ok = shown.groupBy("cluster_id").agg(F.bool_and(inside).alias("ok")).where("ok").select("cluster_id")
    return shown.join(ok, "cluster_id", "left_semi")


def preview(shown: DataFrame, n: int = 4) -> DataFrame:
    """cluster_id, size and the first n paths."""
    w = W.partitionBy("cluster_id").orderBy("path")
    some = shown.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list("path")), "|").alias("paths"))
    return shown.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).join(some, "cluster_id")


def create(clusters: DataFrame, name: str, target_folder: str = "") -> tuple[DataFrame, int]:
    new = (clusters.agg(F.max("id")).first()[0] or 0) + 1
    row = clusters.sparkSession.range(1).select(F.lit(new).cast("long").alias("id"), F.lit(name).alias("name"), F.lit(target_folder).alias("target_folder"))
    return clusters.unionByName(row, allowMissingColumns=True), new


def update(clusters: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: id, name, target_folder, NULL where nothing changes."""
    c = changes.select("id", F.col("name").alias("_name"), F.col("target_folder").alias("_folder"))
    return clusters.join(c, "id", "left").withColumns({"name": F.coalesce("_name", "name"), "target_folder": F.coalesce("_folder", "target_folder")}).drop("_name", "_folder")


def delete(clusters: DataFrame, members: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters and members without the given ids (id)."""
    return clusters.join(ids, "id", "left_anti"), members.join(ids.select(F.col("id").alias("cluster_id")), "cluster_id", "left_anti")


def add_members(members: DataFrame, new: DataFrame) -> DataFrame:
    return members.select("cluster_id", "file_path").unionByName(new.select("cluster_id", "file_path")).distinct()


def remove_members(members: DataFrame, gone: DataFrame) -> DataFrame:
    return members.join(gone, ["cluster_id", "file_path"], "left_anti")


def move_member(members: DataFrame, moves: DataFrame) -> DataFrame:
    """moves: file_path, from_id, to_id."""
    left = remove_members(members, moves.select(F.col("from_id").alias("cluster_id"), "file_path"))
    return add_members(left, moves.select(F.col("to_id").alias("cluster_id"), "file_path"))


def persisted(clusters: DataFrame, members: DataFrame, shown: DataFrame, transient_id: int, name: str) -> tuple[DataFrame, DataFrame, int]:
    """A transient cluster made persistent: new clusters and members, and its id."""
    made, new = create(clusters, name)
    rows = shown.where(F.col("cluster_id") == transient_id).select(F.lit(new).cast("long").alias("cluster_id"), F.col("path").alias("file_path"))
    return made, add_members(members, rows), new
