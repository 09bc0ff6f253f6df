"""What the operators share: reading, word splitting, folds and materialising."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from twinspark.plans.shared import folder

#: White space that separates words, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Only A-Z change; ``lower`` is used where it does the same."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The maximal runs of other than white space, in order."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(inner) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fold(doc_id: Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == rest, F.lit(False))


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` that gives the memory it no longer needs back to the system, as workers live on after a task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where there is a C library of that name
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidied


#: Tables written by this session, for ``dropped`` and ``release``: the frame and its path by the frame's identity.
_WRITTEN: dict[int, tuple[DataFrame, str]] = {}


#: Removes a query's shuffle files as soon as it has ended; else they stay until the driver's garbage is collected.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts that go to Python at a time, at most.
AT_A_TIME = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on no more than AT_A_TIME rows go to Python at a time, as whole texts may be long: it bounds memory on both sides."""
    if int(spark.conf.get(_ROWS)) > AT_A_TIME:
        spark.conf.set(_ROWS, str(AT_A_TIME))


def settled(df: DataFrame, rows: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written as a table in the shared folder, so that later plans start from files that all executors see.

    ``rows``: how many rows go to Python at a time, where they are large. ``by``: columns that have folders of their own.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/twinspark-{uuid.uuid4().hex}"
    before, at_a_time = spark.conf.get(_CLEAN, "false"), spark.conf.get(_ROWS)
    spark.conf.set(_CLEAN, "true")
    spark.conf.set(_ROWS, str(rows or at_a_time))
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
        spark.conf.set(_ROWS, at_a_time)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(out)] = out, path
    return out


def keyed(docs: DataFrame, *carry: str) -> tuple[DataFrame, DataFrame]:
    """Documents by a key (a long) that is theirs alone and follows their order.

    Returns (key, text) of all different documents and (key, doc_id, text, row)
    of all rows, row being a struct of the carried columns. Where ids are whole
    numbers, neither null nor repeated, they are the keys. Else equal rows are one
    document, and documents are numbered by id (null first), then text.
    """
    rows = docs.select("doc_id", whole(F.col("text")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in carry or ("doc_id",)]).alias("row"))
    odd = rows.groupBy("doc_id").count().where(F.col("doc_id").isNull() | (F.col("count") > 1))
    if isinstance(docs.schema["doc_id"].dataType, IntegralType) and odd.isEmpty():
        keys = rows.select(F.col("doc_id").cast("long").alias("key"), "doc_id", "text", "row")
        return keys.select("key", "text"), keys
    one = rows.select("doc_id", "text").distinct()
    ordered = one.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered = settled(ordered.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"))
    back = ordered.select("key", F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    every = rows.join(back, rows["doc_id"].eqNullSafe(back["_id"]) & (F.xxhash64(rows["text"]) == back["_hash"]))
    return ordered.select("key", "text"), every.select("key", "doc_id", "text", "row")


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def joined(spark: SparkSession, tables: list[DataFrame]) -> DataFrame:
    """All rows of tables that ``settled`` gave and that have the same columns."""
    return spark.read.schema(tables[0].schema).parquet(*[_WRITTEN[id(t)][1] for t in tables])


def dropped(df: DataFrame) -> None:
    """Deletes the table that ``settled`` gave as ``df``; nothing that was built on it may still be unread."""
    path = _WRITTEN.pop(id(df), (None, ""))[1]
    if path:
        _delete(df.sparkSession, path)


def written() -> set[int]:
    """What ``settled`` has written so far, for ``release``."""
    return set(_WRITTEN)


def release(spark: SparkSession, before: set[int] = frozenset(), keep: DataFrame | None = None) -> None:
    """Deletes the tables that ``settled`` has written since ``before``, but for ``keep``; nothing built on them may still be unread."""
    for k in [k for k in _WRITTEN if k not in before and k != id(keep)]:
        _delete(spark, _WRITTEN.pop(k)[1])
