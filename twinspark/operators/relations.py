"""Relations between files: merging, annotating, reconciling and viewing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinspark import schemas
from twinspark.operators.running import running

KEY = ["id1", "id2"]


def canonical(pairs: DataFrame) -> DataFrame:
    """id1 < id2; pairs of a file with itself go."""
    return pairs.withColumns({"id1": F.least("id1", "id2"), "id2": F.greatest("id1", "id2")}).where("id1 < id2")


def valid(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs both ends of which are files."""
    ids = files.select("id")
    return pairs.join(ids.withColumnRenamed("id", "id1"), "id1", "left_semi").join(ids.withColumnRenamed("id", "id2"), "id2", "left_semi")


def validation_counts(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """added (pairs that pass) and skipped."""
    ids = files.select("id").distinct()
    marked = pairs.join(ids.select(F.col("id").alias("id1"), F.lit(1).alias("x1")), "id1", "left").join(ids.select(F.col("id").alias("id2"), F.lit(1).alias("x2")), "id2", "left")
    both = F.col("x1").isNotNull() & F.col("x2").isNotNull()
    return marked.agg(F.count_if(both).alias("added"), F.count_if(~both).alias("skipped"))


def _one(pairs: DataFrame, order, first: bool) -> DataFrame:
    by = [o.asc() if first else o.desc() for o in order]
    return pairs.withColumn("_k", F.row_number().over(W.partitionBy(*KEY).orderBy(*by))).where("_k = 1").drop("_k")


def merge(stored: DataFrame, new: DataFrame, overwrite: bool, order: str = "seq") -> DataFrame:
    """(id1, id2, relation_type, distance) after new pairs are added.

    With overwrite the last of the new ones (by ``order``) replaces what is stored;
    without it what is stored stays and of new ones the first counts.
    """
    cols = [*KEY, "relation_type", "distance"]
    new = _one(canonical(new), [F.col(order)], first=not overwrite).select(*cols)
    base, extra = (stored, new) if not overwrite else (new, stored)
    return base.select(*cols).unionByName(extra.select(*cols).join(base.select(*KEY), KEY, "left_anti"))


def annotate(stored: DataFrame, marks: DataFrame, preserve_distance: bool = True) -> DataFrame:
    """Marks (id1, id2, relation_type) take the place of stored types; distances are kept unless asked otherwise."""
    marks = canonical(marks).select(*KEY, F.col("relation_type").alias("_mark"))
    return annotated(stored.select(*KEY, "relation_type", "distance").join(marks, KEY, "full_outer"), preserve_distance)


def annotated(both: DataFrame, preserve_distance: bool = True) -> DataFrame:
    """What ``annotate`` makes of pairs that have what is stored of them (relation_type, distance) and their mark (_mark), or NULL."""
    distance = F.col("distance") if preserve_distance else F.when(F.col("_mark").isNull(), F.col("distance"))
    return both.select(*KEY, F.coalesce("_mark", "relation_type").alias("relation_type"), distance.alias("distance"))


def remove(stored: DataFrame, pairs: DataFrame) -> DataFrame:
    return stored.join(canonical(pairs).select(*KEY), KEY, "left_anti")


def scan(stored: DataFrame, threshold: float | None = None) -> DataFrame:
    """Relations as read: unknown types are new matches, a missing distance is 0.0 and passes every threshold."""
    rows = stored if threshold is None else stored.where(F.col("distance").isNull() | (F.col("distance") <= threshold))
    return rows.select(*KEY, schemas.relation_type(F.col("relation_type")).alias("relation_type"), F.coalesce("distance", F.lit(0.0)).alias("distance"))


def ignored(pairs: DataFrame, stored: DataFrame) -> DataFrame:
    """Pairs with ``ignored`` (a stored type other than new match) and the ``reason``."""
    marks = stored.select(*KEY, F.col("relation_type").alias("reason"))
    joined = canonical(pairs).join(marks, KEY, "left")
    return joined.withColumn("ignored", F.coalesce(F.col("reason") != schemas.NEW_MATCH, F.lit(False)))


def reconcile(found: DataFrame, stored: DataFrame, include_ignored: bool = False) -> DataFrame:
    """Found pairs with the stored type where there is one; only new matches are shown unless asked otherwise."""
    old = stored.select(*KEY, F.col("relation_type").alias("_old"))
    rows = canonical(found).join(old, KEY, "left").withColumn("relation_type", F.coalesce("_old", F.col("relation_type"))).drop("_old")
    return visible(rows, include_ignored)


def reconcile_counts(found: DataFrame, stored: DataFrame, include_ignored: bool = False) -> DataFrame:
    rows = reconcile(found, stored, include_ignored=True)
    seen = F.lit(True) if include_ignored else F.col("relation_type") == schemas.NEW_MATCH
    return rows.agg(F.count_if(F.col("relation_type") != schemas.NEW_MATCH).alias("annotated"), F.count_if(seen).alias("returned"), F.count(F.lit(1)).alias("total"))


def visible(rows: DataFrame, include_ignored: bool = False) -> DataFrame:
    return rows if include_ignored else rows.where(F.col("relation_type") == schemas.NEW_MATCH)


def hydrate(pairs: DataFrame, files: DataFrame, *cols: str) -> DataFrame:
    """Pairs with columns of both files, as left_* and right_*; pairs without a file row go."""
    side = lambda i, s: files.select(F.col("id").alias(i), *[F.col(c).alias(f"{s}_{c}") for c in cols])
    return pairs.join(side("id1", "left"), "id1").join(side("id2", "right"), "id2")


def both_in(pairs: DataFrame, scoped: DataFrame) -> DataFrame:
    return valid(pairs, scoped)


def without_file(pairs: DataFrame, file_id: int) -> DataFrame:
    return pairs.where((F.col("id1") != file_id) & (F.col("id2") != file_id))


def smart_resolve(pairs: DataFrame, by: str, *keep: str) -> DataFrame:
    """Which id of a hydrated pair to delete: the one with the smaller size or resolution, none if equal; ``keep`` are columns that stay."""
    value = {"size": ("left_file_size", "right_file_size"), "resolution": (F.col("left_width") * F.col("left_height"), F.col("right_width") * F.col("right_height"))}[by]
    a, b = (F.col(x) if isinstance(x, str) else x for x in value)
    return pairs.select("id1", "id2", *keep, F.when(a < b, F.col("id1")).when(b < a, F.col("id2")).alias("delete_id"))


def next_visible(group: DataFrame, index: int, step: int) -> int:
    """The next index (1 or more) after or before ``index`` whose pair with the hub is not ignored; -1 if there is none."""
    rows = group.where((~F.col("ignored")) & (F.col("idx") >= 1))
    rows = rows.where(F.col("idx") >= index) if step > 0 else rows.where(F.col("idx") <= index)
    got = rows.agg(F.min("idx") if step > 0 else F.max("idx")).first()[0]
    return -1 if got is None else got


def visible_neighbours(rows: DataFrame, group: str, idx: str, hidden: Column) -> DataFrame:
    """``rows`` with next_visible and previous_visible: for every row the nearest of its group that isn't hidden, itself included; else -1."""
    seen = F.when(~hidden, F.col(idx))
    near = running(rows, [group], [idx], next_visible=(seen, "min", "down"), previous_visible=(seen, "max", "up"))
    return near.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("next_visible", "previous_visible")})


def stamped(rows: DataFrame, column: str = "created_at") -> DataFrame:
    """Rows without a time get the current one."""
    return rows.withColumn(column, F.coalesce(F.col(column), F.current_timestamp()))


def type_counts(stored: DataFrame) -> DataFrame:
    return stored.groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"))
