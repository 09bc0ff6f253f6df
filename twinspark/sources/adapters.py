"""Tables of the engine from listings, images and the driver's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinspark import schemas
from twinspark.functions import hashes, paths


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def image_listing(spark: SparkSession, roots: list[str], contents: bool = False) -> DataFrame:
    """Images below the roots, each path once: path, file_size, last_modified and, if asked for, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(roots)
    files = files.where(paths.has_suffix(F.col("path")))
    path = F.regexp_replace("path", "^file:/*", "/")
    cols = [path.alias("path"), F.col("length").alias("file_size"), F.col("modificationTime").cast("double").alias("last_modified")]
    return files.select(*cols, *(["content"] if contents else [])).dropDuplicates(["path"])


def dropped_files(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Of dropped paths those with an image suffix that aren't known; the rest are counted by ``intake_counts``."""
    return listing.where(paths.has_suffix(F.col("path"), paths.DROPPED)).select("path").distinct().join(known.select("path"), "path", "left_anti")


def intake_counts(listing: DataFrame, known: DataFrame) -> DataFrame:
    """added and already present."""
    fit = listing.where(paths.has_suffix(F.col("path"), paths.DROPPED)).select("path").distinct()
    seen = fit.join(known.select("path", F.lit(1).alias("known")).distinct(), "path", "left")
    return seen.agg(F.count_if(F.col("known").isNull()).alias("added"), F.count_if(F.col("known").isNotNull()).alias("duplicates"))


def decoded(images: DataFrame, size: int = 32) -> DataFrame:
    """Grey values of images (path, content) with errors as data; pixels are NULL where decoding fails or no decoder is there."""
    @F.pandas_udf("pixels array<double>, width int, height int, err string")
    def decode(content: pd.Series) -> pd.DataFrame:
        import io

        out = []
        for raw in content:
            try:
                from PIL import Image, ImageFile

                ImageFile.LOAD_TRUNCATED_IMAGES = True
                image = Image.open(io.BytesIO(raw))
                w, h = image.size
                out.append((list(map(float, image.convert("L").resize((size, size)).getdata())), w, h, None))
            except Exception as e:  # noqa: BLE001 - errors are part of the result
                out.append((None, None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["pixels", "width", "height", "err"])

    return images.withColumn("image", decode("content")).select("*", "image.*").drop("image", "content")


def doc_path() -> Column:
    return F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def simhash(docs: DataFrame) -> DataFrame:
    """id, phash: the signs of the summed bits of the md5 of all different tokens of an id's texts; ids without a token are left out.

    A text is hashed where it is read. Only texts of ids that come more than once are exchanged, as their tokens count together.
    """
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    again = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    if not again.isEmpty():
        same = F.col("id").eqNullSafe(F.col("_id"))
        again = again.withColumnRenamed("id", "_id")
        together = rows.join(again, same, "left_semi").groupBy("id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
        rows = rows.join(again, same, "left_anti").unionByName(together)
    return rows.select("id", hashes.token_hash(F.col("text")).alias("phash")).where("phash is not null")


def files(spark: SparkSession, sf_dir: str, hashed: bool = True) -> DataFrame:
    """The documents as files: id, path, file_size, text size as width, 1 as height; phash by simhash."""
    docs = read(spark, sf_dir, "documents")
    base = docs.select(F.col("doc_id").alias("id"), doc_path().alias("path"), F.col("n_chars").alias("file_size"))
    if not hashed:
        return base
    return hashes.with_chunks(base.join(simhash(docs), "id", "left"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the labels say of a document."""
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, F.lit("not_duplicate")).when(F.col("quality") == 1, F.lit("duplicate")).otherwise(F.lit("similar")).alias("relation_type"))


def config(spark: SparkSession, text: DataFrame, column: str = "json") -> DataFrame:
    """device_id and batch_sizes of JSON configurations; unknown engines go, missing sizes get their default."""
    parsed = text.select(F.from_json(column, "device_id string, batch_sizes map<string,int>").alias("c"))
    known = F.map_filter(F.coalesce("c.batch_sizes", F.create_map().cast("map<string,int>")), lambda k, v: k.isin(*schemas.BATCH_SIZES))
    return parsed.select(F.col("c.device_id").alias("device_id"), *[F.coalesce(F.try_element_at(known, F.lit(e)), F.lit(n)).alias(e) for e, n in schemas.BATCH_SIZES.items()])


def config_json(device_id: Column, sizes: Column) -> Column:
    return F.to_json(F.struct(device_id.alias("device_id"), sizes.alias("batch_sizes")))


def clamped(size: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(256), size))


def engine_name(name: Column) -> Column:
    """The short name of an engine; the hash engine unless another is named."""
    low = F.lower(name)
    return F.when(low.contains("mobile"), F.lit("mobilenet")).when(low.contains("blip"), F.lit("blip")).when(low.contains("clip"), F.lit("clip")).otherwise(F.lit("phash"))


def last_wins(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of the rows of a key the last in the given order."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
