"""Incremental indexing with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspark.operators.store import Store
from twinspark.sources.adapters import last_wins


def upsert_stream(rows: DataFrame, target: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = 16) -> None:
    """Brings a table of the last row of every key up to date with all that the stream has now.

    The table is kept in buckets of its key, and a batch rewrites those of its own keys. The number of a batch is noted in
    its commit, so a batch that is run again after a failure changes nothing. What no version uses any more is deleted.
    """
    store = Store(rows.sparkSession, target)
    if store.entry("rows") is None:
        store.in_buckets("rows", rows.schema, keys, buckets)

    def merge(batch: DataFrame, number: int) -> None:
        if number <= store.note("batch", -1):
            return
        touched = store.touched("rows", batch)
        both = store.read("rows", buckets=touched).unionByName(batch)
        store.publish([store.rewritten("rows", last_wins(both, keys, *order), touched)], notes={"batch": number})
        store.vacuum(keep=2)

    query = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, target: str, schema: str | None = None) -> DataFrame:
    """The table as the last whole batch has left it; before the first one an empty table of ``schema``.

    A folder of numbered tables, one for each batch, is read as well.
    """
    store = Store(spark, target)
    if store.entry("rows") is not None:
        return store.read("rows")
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = new(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(new(target))] if fs.exists(new(target)) else []
    whole = [int(n) for n in names if n.isdigit() and fs.exists(new(f"{target}/{n}/_SUCCESS"))]
    if whole:
        return spark.read.parquet(f"{target}/{max(whole)}")
    if schema is None:
        raise FileNotFoundError(f"no batch is written to {target}")
    return spark.createDataFrame([], schema)


def index_files(store: Store, listing: DataFrame, fingerprint) -> int:
    """One pass over what is new or changed: stale paths are fingerprinted and stored; their number."""
    from twinspark.operators import files

    known = store.read("files")
    todo = files.stale(listing, known)
    n = todo.count()
    if n:
        store.commit(files=files.upsert(known, fingerprint(todo).withColumn("seq", F.lit(0))))
    return n
