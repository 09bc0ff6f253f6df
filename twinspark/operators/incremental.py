"""Similar pairs and connected components kept up to date batch by batch, in a store.

A batch reads and writes only the buckets that it touches: what is new meets what
is there and itself, never does all meet all again. Each batch is one commit, so
a batch that fails leaves the version before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string as schema_of

from twinspark.operators.graph import components
from twinspark.operators.pairs import as_hex, as_number, block_rows, blocks_meet, near_rows
from twinspark.operators.store import Store

Keep = Callable[[DataFrame], DataFrame]


def _tables(store: Store, wanted: dict[str, tuple[str, list[str]]], buckets: int) -> None:
    for name, (schema, key) in wanted.items():
        if store.entry(name) is None:
            store.in_buckets(name, schema_of(schema), key, buckets)


def large(rows: DataFrame) -> DataFrame:
    """The side of a join that grows with a batch or a table: never sent through the driver, as its few bytes on disk would suggest."""
    return rows.hint("merge")


class Pairs:
    """Pairs of files whose hashes are within ``t`` bits of each other, complete for t up to 63.

    Kept are different hashes: ``blocks`` (their blocks by place and value), ``near``
    (each hash with those near it, from both sides), ``members`` (hash, id) and ``ids``
    (id, hash). A hash that any number of files share is compared once, and equal
    files cost a row each, not a pair each.
    """

    def __init__(self, store: Store, t: int, keep: Keep, name: str = "pairs", buckets: int = 16):
        self.store, self.t, self.keep = store, t, keep
        self.ids, self.members, self.blocks, self.near = (f"{name}_{x}" for x in ("ids", "members", "blocks", "near"))
        wanted = {
            self.ids: ("id long, x long", ["id"]),
            self.members: ("x long, id long", ["x"]),
            self.blocks: ("k int, v long, x long", ["k", "v"]),
            self.near: ("x long, y long, distance int", ["x"]),
        }
        _tables(store, wanted, buckets)

    def _of(self, table: str, keys: DataFrame) -> tuple[DataFrame, list[int]]:
        """All rows of the buckets of some keys, and these buckets."""
        buckets = self.store.touched(table, keys)
        return self.store.read(table, buckets=buckets), buckets

    def update(self, new: DataFrame, gone: DataFrame | None = None) -> int:
        """Puts in files (id, phash), instead of what their ids had, and takes out ids (id). A file without a hash has no pairs.

        Returns the version. Ids that come twice in ``new`` count with their least hash.
        """
        store, keep = self.store, self.keep
        put = new.groupBy("id").agg(F.min(as_number(F.col("phash"))).alias("x"))
        out = new.select("id") if gone is None else new.select("id").unionByName(gone.select("id"))
        out = keep(out.where("id is not null").distinct())
        ids, id_buckets = self._of(self.ids, out)
        had = keep(ids.join(large(out), "id", "left_semi"))
        put = keep(put.where("id is not null and x is not null"))
        leaving, coming = keep(had.join(large(put), ["id", "x"], "left_anti")), keep(put.join(large(had), ["id", "x"], "left_anti"))
        members, member_buckets = self._of(self.members, leaving.select("x").unionByName(coming.select("x")))
        after = keep(members.join(large(leaving), ["x", "id"], "left_anti").unionByName(coming.select("x", "id")))
        dead = keep(leaving.select("x").distinct().join(large(after), "x", "left_anti"))
        born = keep(coming.select("x").distinct().join(large(members), "x", "left_anti"))
        # What is near a hash that goes: its own rows, and one row of each of its neighbours.
        near, _ = self._of(self.near, dead)
        lost = near.join(large(dead), "x", "left_semi")
        lost = keep(lost.unionByName(lost.select(F.col("y").alias("x"), F.col("x").alias("y"), "distance")))
        # What is near a hash that comes: blocks one bit around its own are looked up among the old and the new.
        around, own = near_rows(born, self.t), keep(block_rows(born, self.t))
        old, _ = self._of(self.blocks, around.select("k", "v"))
        met = blocks_meet(around, old.join(large(dead), "x", "left_anti").unionByName(own), self.t)
        met = met.join(large(born.select(F.col("x").alias("y"), F.lit(True).alias("both"))), "y", "left").where("both is null or x < y").drop("both")
        met = keep(met.unionByName(met.select(F.col("y").alias("x"), F.col("x").alias("y"), "distance")))
        near, near_buckets = self._of(self.near, lost.select("x").unionByName(met.select("x")))
        blocks, block_buckets = self._of(self.blocks, block_rows(dead, self.t).select("k", "v").unionByName(own.select("k", "v")))
        changes = [
            store.rewritten(self.ids, ids.join(large(out), "id", "left_anti").unionByName(put), id_buckets),
            store.rewritten(self.members, after, member_buckets),
            store.rewritten(self.near, near.join(large(lost), ["x", "y"], "left_anti").unionByName(met.select(*near.columns)), near_buckets),
            store.rewritten(self.blocks, blocks.join(large(dead), "x", "left_anti").unionByName(own.select(*blocks.columns)), block_buckets),
        ]
        return store.publish(changes, reads=(self.ids, self.members, self.near, self.blocks))

    def hashes(self) -> DataFrame:
        """(h1, h2, distance) of different hashes, h1 < h2."""
        a, b = as_hex(F.col("x")), as_hex(F.col("y"))
        return self.store.read(self.near).select(a.alias("h1"), b.alias("h2"), "distance").where("h1 < h2")

    def pairs(self) -> DataFrame:
        """(id1, id2, distance) of all files within t bits, equal hashes included; a report whose rows grow with the square of equal files."""
        a = self.store.read(self.members)
        b = a.select(F.col("x").alias("y"), F.col("id").alias("id2"))
        apart = self.store.read(self.near).join(large(a.withColumnRenamed("id", "id1")), "x").join(large(b), "y").where("id1 < id2").select("id1", "id2", "distance")
        equal = a.join(large(b), a["x"] == b["y"]).where("id < id2").select(F.col("id").alias("id1"), "id2", F.lit(0).alias("distance"))
        return apart.unionByName(equal)

    def links(self) -> DataFrame:
        """(id, n_links) of every file with a hash: how many others are within t bits. A row a file, however large a group of equal files is."""
        members = self.store.read(self.members)
        size = members.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
        around = self.store.read(self.near).join(large(size.select(F.col("x").alias("y"), "n")), "y").groupBy("x").agg(F.sum("n").alias("m"))
        total = size.join(large(around), "x", "left").select("x", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
        return members.join(large(total), "x").select("id", "n_links")


class Components:
    """Connected components of edges that come, go and are rejected; a component's label is its least id.

    Kept are ``labels`` (id, component), ``edges`` under the label of their component,
    and ``rejected`` edges, which do not count while they are there. Edges that come
    join labels, not nodes: the graph of a batch has as many edges as the batch.
    Only a component that loses an edge is opened again, and only one whose label
    changes is written anew.
    """

    def __init__(self, store: Store, keep: Keep, name: str = "components", buckets: int = 16):
        self.store, self.keep = store, keep
        self.labels, self.edges, self.rejected = (f"{name}_{x}" for x in ("labels", "edges", "rejected"))
        wanted = {
            self.labels: ("id long, component long", ["id"]),
            self.edges: ("component long, src long, dst long", ["component"]),
            self.rejected: ("src long, dst long", ["src", "dst"]),
        }
        _tables(store, wanted, buckets)

    def _of(self, table: str, keys: DataFrame) -> DataFrame:
        return self.store.read(table, buckets=self.store.touched(table, keys))

    def _edges_of(self, labels: DataFrame) -> DataFrame:
        return self._of(self.edges, labels).join(large(labels), "component", "left_semi")

    @staticmethod
    def _clean(edges: DataFrame | None, like: DataFrame) -> DataFrame:
        if edges is None:
            return like.limit(0)
        return edges.select(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst")).where("src < dst").distinct()

    def update(self, new: DataFrame | None = None, gone: DataFrame | None = None, rejected: DataFrame | None = None) -> int:
        """Takes out edges that are ``gone`` or ``rejected``, then puts in ``new`` ones (all src, dst) that aren't rejected. Returns the version."""
        store, keep = self.store, self.keep
        empty = store.spark.createDataFrame([], "src long, dst long")
        bad = keep(self._clean(rejected, empty))
        out = keep(self._clean(gone, empty).unionByName(bad).distinct())
        put = self._clean(new, empty)
        put = keep(put.join(large(self._of(self.rejected, put).unionByName(bad)), ["src", "dst"], "left_anti"))
        both = put.unionByName(out)
        ends = keep(both.select(F.col("src").alias("id")).unionByName(both.select(F.col("dst").alias("id"))).distinct())
        label = keep(self._of(self.labels, ends).join(large(ends), "id", "left_semi"))
        at = lambda c, name: label.select(F.col("id").alias(c), F.col("component").alias(name))
        # Components that lose an edge are opened: their other edges give new labels.
        asked = keep(out.join(large(at("src", "component")), "src").join(large(at("dst", "_other")), "dst").where("component = _other").select("component", "src", "dst"))
        hit = keep(self._edges_of(asked.select("component").distinct()).join(large(asked), ["component", "src", "dst"], "left_semi"))
        opened = keep(hit.select("component").distinct())
        left = keep(self._edges_of(opened).join(large(hit), ["component", "src", "dst"], "left_anti"))
        again = keep(components(left, keep))
        # Where the ends of new edges are now; a node without a label is its own.
        now = label.join(large(opened), "component", "left_anti").unionByName(again.join(large(ends), "id", "left_semi"))
        now = keep(ends.join(large(now), "id", "left").select("id", F.coalesce("component", "id").alias("component")))
        side = lambda c, name: now.select(F.col("id").alias(c), F.col("component").alias(name))
        put = keep(put.join(large(side("src", "a")), "src").join(large(side("dst", "b")), "dst"))
        joined = keep(components(put.select(F.col("a").alias("src"), F.col("b").alias("dst")), keep).select(F.col("id").alias("was"), F.col("component").alias("to")))
        renamed = keep(joined.where("was <> to"))
        final = lambda df, c: df.join(large(renamed.withColumnRenamed("was", c)), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        # Edges under new labels: of the opened components, of those that are joined to a lower one, and the new ones.
        moved = self._edges_of(renamed.select(F.col("was").alias("component"))).join(large(opened), "component", "left_anti")
        reopened = left.select("src", "dst").join(large(again.withColumnRenamed("id", "src")), "src")
        fresh = put.select("src", "dst", F.col("a").alias("component"))
        rows = keep(final(moved.unionByName(reopened.select(*moved.columns)).unionByName(fresh.select(*moved.columns)), "component").distinct())
        stale = keep(opened.unionByName(renamed.select(F.col("was").alias("component"))).distinct())
        edge_buckets = store.touched(self.edges, stale.unionByName(rows.select("component")))
        edges = store.read(self.edges, buckets=edge_buckets).join(large(stale), "component", "left_anti").unionByName(rows).distinct()
        # Labels of their ends; nodes that lost their last edge have none.
        named = keep(rows.select(F.col("src").alias("id"), "component").unionByName(rows.select(F.col("dst").alias("id"), "component")).distinct())
        left_alone = hit.select(F.col("src").alias("id")).unionByName(hit.select(F.col("dst").alias("id"))).distinct().join(large(named), "id", "left_anti")
        changed = named.select("id").unionByName(left_alone.select("id"))
        label_buckets = store.touched(self.labels, changed)
        labels = store.read(self.labels, buckets=label_buckets).join(large(changed), "id", "left_anti").unionByName(named)
        changes = [store.rewritten(self.edges, edges, edge_buckets), store.rewritten(self.labels, labels, label_buckets)]
        if rejected is not None:
            changes.append(store.merged(self.rejected, bad))
        return store.publish(changes, reads=(self.labels, self.edges, self.rejected))

    def read(self) -> DataFrame:
        """(id, component) of all ends of edges."""
        return self.store.read(self.labels)
