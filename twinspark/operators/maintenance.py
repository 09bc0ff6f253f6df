"""Maintenance of a store as a chain of commits that can be stopped after each and taken up again.

Each step rests on what the steps before it have committed, and its commit notes how
far the chain has come. A run that is cancelled, or lost with its driver, leaves a
store that is whole; the next run, of any process, goes on behind the last step that
was committed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.operators.files import cascade
from twinspark.operators.store import Change, Store

NOTE, STATISTICS = "maintenance", "statistics"
#: Bytes of a file of a compacted table, about.
FILE_BYTES = 128 << 20


def _missing(store: Store, listing: DataFrame) -> dict[str, DataFrame]:
    return {"files": store.read("files").join(listing.select("path").distinct(), "path", "left_semi")}


def _status(store: Store, listing: DataFrame) -> dict[str, DataFrame]:
    return {"vector_index_status": store.read("vector_index_status").join(store.read("files").select("path"), "path", "left_semi")}


def _members(store: Store, listing: DataFrame) -> dict[str, DataFrame]:
    return {"cluster_members": store.read("cluster_members").join(store.read("files").select(F.col("path").alias("file_path")), "file_path", "left_semi")}


def _relations(store: Store, listing: DataFrame) -> dict[str, DataFrame]:
    return {"file_relations": cascade(store.read("files"), store.read("file_relations"))}


def _clusters(store: Store, listing: DataFrame) -> dict[str, DataFrame]:
    return {"clusters": store.read("clusters").join(store.read("cluster_members").select(F.col("cluster_id").alias("id")), "id", "left_semi")}


#: In this order: an owner goes before what it owns, members before empty clusters.
CLEANING = (("files", _missing), ("vector_index_status", _status), ("cluster_members", _members), ("file_relations", _relations), ("clusters", _clusters))


def compacted(store: Store, table: str, file_bytes: int = FILE_BYTES) -> Change | None:
    """The table in as few files as its bytes ask for; None if it is so already. Buckets stay as they are."""
    if not isinstance(store.entry(table), str):
        return None
    files, size = store.files(table)
    parts = max(1, -(-size // file_bytes))
    return store.whole(table, store.read(table).repartition(parts)) if files > parts else None


def statistics(store: Store) -> dict[str, dict[str, int]]:
    """Rows, files and bytes of every table."""
    out = {}
    for table in sorted(store.tables()):
        n, size = store.files(table)
        out[table] = {"rows": store.read(table).count(), "files": n, "bytes": size}
    return out


class Maintenance:
    """Missing files go, then what is left without an owner; then tables are compacted and counted."""

    def __init__(self, store: Store, listing: DataFrame, emit: Callable[[int, str], None] = lambda percent, step: None, file_bytes: int = FILE_BYTES):
        self.store, self.listing, self.emit, self.file_bytes = store, listing, emit, file_bytes
        self.steps = [(f"clean {table}", lambda t=table, f=step: self._clean(t, f)) for table, step in CLEANING]
        self.steps += [(f"compact {table}", lambda t=table: self._compact(t)) for table, _ in CLEANING]
        self.steps.append((STATISTICS, lambda: ([], {STATISTICS: statistics(store)})))

    def _clean(self, table: str, step) -> tuple[list[Change], dict]:
        store = self.store
        if store.entry(table) is None:
            return [], {}
        return [store.whole(table, step(store, self.listing)[table].select(*store.read(table).columns))], {}

    def _compact(self, table: str) -> tuple[list[Change], dict]:
        change = compacted(self.store, table, self.file_bytes)
        return ([change] if change else []), {}

    def run(self, cancelled: Callable[[], bool] = lambda: False) -> bool:
        """Whether the chain has come to its end; ``cancelled`` is asked before each step."""
        store, total = self.store, len(self.steps)
        done = store.note(NOTE, 0) % total
        for k in range(done, total):
            if cancelled():
                return False
            name, step = self.steps[k]
            self.emit(100 * k // total, name)
            changes, notes = step()
            store.publish(changes, reads=store.tables(), notes={**notes, NOTE: k + 1})
        self.emit(100, "")
        return True
