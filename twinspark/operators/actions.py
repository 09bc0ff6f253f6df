"""Reviewing actions, resolution of identifiers, pages and samples, all as DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinspark.functions import paths
from twinspark.operators import files as file_ops
from twinspark.operators import relations as relation_ops
from twinspark.operators.clusters import numbered


def trashed(files: DataFrame, gone: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Without the paths (path); and the trash: path, trash_path (a free name of the folder) and the row as it was."""
    row = F.struct(*[F.col(c) for c in files.columns])
    named = files.join(gone.select("path").distinct(), "path", "left_semi").select("path", row.alias("row"))
    # The id keeps names of the trash apart.
    name = F.concat(F.lit(f"{folder}/"), F.col("row.id").cast("string"), F.lit("_"), paths.basename(F.col("path")))
    return files.join(gone.select("path"), "path", "left_anti").select(*files.columns), named.select("path", name.alias("trash_path"), "row")


def restored(files: DataFrame, trash: DataFrame) -> DataFrame:
    """The inverse of ``trashed``: rows come back without a hash and with sizes of 0, as they are to be scanned anew.

    A path that is taken meanwhile stays as it is.
    """
    empty = {"phash": None, "width": 0, "height": 0}
    kinds = dict(files.dtypes)
    back = [F.lit(empty[c]).cast(kinds[c]).alias(c) if c in empty else F.col(f"row.{c}").alias(c) for c in files.columns]
    return files.unionByName(trash.join(files.select("path"), "path", "left_anti").select(*back))


def replaced(files: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs: path, by. The content columns of ``by`` take the place of those of ``path``; and the rows as they were, for ``put_back``."""
    content = [c for c in files.columns if c not in ("id", "path")]
    new = files.join(pairs.select(F.col("by").alias("path"), F.col("path").alias("target")), "path").select(F.col("target").alias("path"), F.struct(*content).alias("new"))
    both = files.join(new, "path", "left")
    out = [F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) if c in content else F.col(c) for c in files.columns]
    return both.select(*out), files.join(new.select("path"), "path", "left_semi").select(*files.columns)


def put_back(files: DataFrame, before: DataFrame) -> DataFrame:
    """The inverse of ``replaced``."""
    return files.join(before.select("path"), "path", "left_anti").select(*files.columns).unionByName(before)


def ignored(stored: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs (id1, id2) marked as similar but not the same; and what was stored of them, for ``unignored``."""
    marks = pairs.withColumn("relation_type", F.lit("ignored"))
    before = stored.join(relation_ops.canonical(pairs).select("id1", "id2"), ["id1", "id2"], "left_semi")
    return relation_ops.annotate(stored, marks), before


def unignored(stored: DataFrame, pairs: DataFrame, before: DataFrame) -> DataFrame:
    """The inverse of ``ignored``."""
    return relation_ops.remove(stored, pairs).unionByName(before.select(*stored.columns))


def gathered(files: DataFrame, members: DataFrame, cluster_id: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """The files of a cluster moved into a folder: names that are taken there get the next free number; members follow."""
    own = members.where(F.col("cluster_id") == cluster_id).select(F.col("file_path").alias("path")).join(files.select("path"), "path", "left_semi")
    aim = own.select("path", F.concat(F.lit(f"{folder}/"), paths.basename(F.col("path"))).alias("aim"))
    aim = aim.where("path <> aim")
    taken = files.select("path").join(aim.select("path"), "path", "left_anti")
    # Of files with one aim the first by path gets its first name, and so on.
    of = W.partitionBy("aim")
    names = paths.free_names(aim.select(F.col("aim").alias("path")), taken).withColumnRenamed("path", "aim")
    names = names.withColumn("k", F.row_number().over(of.orderBy(F.length("new_path"), "new_path")))
    moves = aim.withColumn("k", F.row_number().over(of.orderBy("path"))).join(names, ["aim", "k"]).select("path", "new_path")
    return file_ops.move(files, moves, members)


def resolved(files: DataFrame, idents: DataFrame) -> DataFrame:
    """(ident, path): the file of that path, or else all files with that hash."""
    exact = idents.join(files.select(F.col("path").alias("ident")), "ident", "left_semi").select("ident", F.col("ident").alias("path"))
    rest = idents.join(exact.select("ident"), "ident", "left_anti")
    return exact.unionByName(rest.join(files.select(F.col("phash").alias("ident"), "path"), "ident"))


def remove_scanned(scanned: DataFrame, gone: DataFrame) -> DataFrame:
    return scanned.join(gone.select("path"), "path", "left_anti")


def without_members(members: DataFrame, ids: DataFrame) -> DataFrame:
    """Clusters (id) lose all members, but stay."""
    return members.join(ids.select(F.col("id").alias("cluster_id")), "cluster_id", "left_anti")


def paged(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` with ``page`` (from 0) in the order of a unique key; a page is read by its number, not by skipping rows."""
    return numbered(rows, key).withColumn("page", F.floor((F.col("number") - 1) / size).cast("long")).drop("number")


def first_of(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """A report's n first rows."""
    return rows.orderBy(*order).limit(n)


def from_tuples(rows: DataFrame) -> DataFrame:
    """Relations from legacy arrays (id1, id2, type[, distance])."""
    t = F.col("t")
    return relation_ops.canonical(rows.select(F.get(t, F.lit(0)).cast("long").alias("id1"), F.get(t, F.lit(1)).cast("long").alias("id2"), F.get(t, F.lit(2)).alias("relation_type"), F.get(t, F.lit(3)).cast("double").alias("distance")))
