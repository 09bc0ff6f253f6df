"""A reviewer's commands on clusters and their members, over a store.

Each command reads the version that is current and commits one of its own, so each
can be undone and done again, and one whose input is refused changes nothing. What
is shown for transient clusters (ids below 0) comes with the call, as it is not
stored before it is made persistent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.operators import clusters
from twinspark.operators.running import numbered
from twinspark.operators.store import Store

CLUSTERS, MEMBERS = "clusters", "cluster_members"


def listed(store: Store) -> DataFrame:
    """Clusters with their place in the order of ids and the number of their members."""
    sizes = store.read(MEMBERS).groupBy(F.col("cluster_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    places = numbered(store.read(CLUSTERS).select("id", "name", "target_folder"), "id").withColumnRenamed("number", "place")
    return places.join(sizes, "id", "left").withColumn("n", F.coalesce("n", F.lit(0))).orderBy("place")


def members_of(store: Store, cluster_id: int) -> DataFrame:
    return store.read(MEMBERS).where(F.col("cluster_id") == cluster_id)


class Review:
    def __init__(self, store: Store):
        self.store = store

    def create(self, name: str, target_folder: str = "") -> int | None:
        """The id of the new cluster."""
        made = []

        def command(store: Store) -> dict[str, DataFrame]:
            table, new = clusters.create(store.read(CLUSTERS), name, target_folder)
            made.append(new)
            return {CLUSTERS: table}

        return made[-1] if self.store.run(command) else None

    def change(self, cluster_id: int, name: str | None = None, target_folder: str | None = None) -> bool:
        """What is None stays."""
        row = [(cluster_id, name, target_folder)]
        return self.store.run(lambda s: {CLUSTERS: clusters.update(s.read(CLUSTERS), s.spark.createDataFrame(row, "id long, name string, target_folder string"))})

    def delete(self, *ids: int) -> bool:
        """Clusters with their memberships; the files stay."""

        def command(store: Store) -> dict[str, DataFrame]:
            left = clusters.delete(store.read(CLUSTERS), store.read(MEMBERS), store.spark.createDataFrame([(i,) for i in ids], "id long"))
            return dict(zip((CLUSTERS, MEMBERS), left))

        return self.store.run(command)

    def add(self, cluster_id: int, paths: DataFrame) -> bool:
        """Paths (path) become members."""
        rows = paths.select(F.lit(cluster_id).cast("long").alias("cluster_id"), F.col("path").alias("file_path"))
        return self.store.run(lambda s: {MEMBERS: clusters.add_members(s.read(MEMBERS), rows)})

    def remove(self, cluster_id: int, paths: DataFrame) -> bool:
        rows = paths.select(F.lit(cluster_id).cast("long").alias("cluster_id"), F.col("path").alias("file_path"))
        return self.store.run(lambda s: {MEMBERS: clusters.remove_members(s.read(MEMBERS), rows)})

    def move(self, paths: DataFrame, source: int, target: int) -> bool:
        """Members go from one cluster to another."""
        rows = paths.select(F.col("path").alias("file_path"), F.lit(source).cast("long").alias("from_id"), F.lit(target).cast("long").alias("to_id"))
        return self.store.run(lambda s: {MEMBERS: clusters.move_member(s.read(MEMBERS), rows)})

    def persist(self, shown: DataFrame, transient_id: int, name: str) -> int | None:
        """A transient cluster of ``shown`` (cluster_id, path) becomes a stored one with all its files; its id."""
        made = []

        def command(store: Store) -> dict[str, DataFrame]:
            if transient_id >= 0:
                raise ValueError(f"cluster {transient_id} is stored already")
            table, members, new = clusters.persisted(store.read(CLUSTERS), store.read(MEMBERS), shown, transient_id, name)
            made.append(new)
            return {CLUSTERS: table, MEMBERS: members}

        return made[-1] if self.store.run(command) else None
