"""Path and display functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspark.operators.running import running

IMAGES = r"\.(png|jpe?g|bmp|gif|webp)$"
DROPPED = r"\.(png|jpe?g|bmp|gif|webp|tiff)$"


def basename(p: Column) -> Column:
    return F.element_at(F.split(p, "/"), -1)


def dirname(p: Column) -> Column:
    """All up to the last slash, without slashes at its end unless it has nothing else."""
    head = F.regexp_extract(p, "^(.*/)[^/]*$", 1)
    return F.when(head.rlike("^/*$"), head).otherwise(F.rtrim(head, F.lit("/")))


def extension(p: Column) -> Column:
    """The last dot of the name and what follows, unless the name only begins with dots."""
    return F.regexp_extract(basename(p), r"^\.*[^.].*?(\.[^.]*)$", 1)


def stem(p: Column) -> Column:
    return F.substring(p, F.lit(1), F.length(p) - F.length(extension(p)))


def has_suffix(p: Column, pattern: str = IMAGES) -> Column:
    return F.lower(p).rlike(pattern)


def normpath(p: Column) -> Column:
    """Empty and ``.`` segments go, ``..`` takes the one before it along."""
    absolute = p.startswith("/")
    parts = F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))
    empty = F.array().cast("array<string>")
    climb = lambda acc: (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1), F.lit("")) != "..")
    step = lambda acc, s: (
        F.when(s != "..", F.concat(acc, F.array(s))).when(climb(acc), F.slice(acc, F.lit(1), F.size(acc) - 1)).when(absolute, acc).otherwise(F.concat(acc, F.array(s)))
    )
    joined = F.array_join(F.aggregate(parts, empty, step), "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def in_roots(p: Column, roots: list[str], case_insensitive: bool = False) -> Column:
    """Whether the path is a root or stands below one; with no roots every path is."""
    if not roots:
        return F.lit(True)
    p, roots = (F.lower(p), [r.lower() for r in roots]) if case_insensitive else (p, roots)
    return reduce(lambda a, b: a | b, [(p == r) | p.startswith(r.rstrip("/") + "/") for r in roots])


def segments(p: Column) -> Column:
    return F.filter(F.split(p, r"[\\/]"), lambda s: s != "")


def segment_diff(a: Column, b: Column) -> Column:
    """For each place: both segments (NULL if there is none) and whether they are equal."""
    return F.zip_with(segments(a), segments(b), lambda x, y: F.struct(x.alias("a"), y.alias("b"), x.eqNullSafe(y).alias("same")))


def free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(path, new_path) for every row of wanted (path): a counter is raised until the name is free.

    A name that is free stays. Else the counter of a trailing ``_N`` (or 0) goes up
    to a number that is neither taken nor given to another wanted name before; names
    are served by counter, then path. Instead of a search loop, numbers are ranked
    among the free ones of their stem: a name's rank is that of the first free number
    over its counter, or one over the rank before it, which is a running maximum.
    """
    base = stem(F.col("path"))
    number = F.regexp_extract(base, r"_(\d{1,15})$", 1)
    parts = {"prefix": F.regexp_replace(base, r"_\d{1,15}$", ""), "ext": extension(F.col("path")), "n": F.when(number == "", F.lit(0)).otherwise(number.cast("bigint"))}
    used = taken.select("path").distinct()
    asked = wanted.select("path").withColumns(parts).join(used.withColumn("known", F.lit(True)), "path", "left")
    one = F.lit(1).cast("long")
    asked = running(asked, ["path"], [], turn=(one, "sum", "up"))
    stays = F.col("known").isNull() & (F.col("turn") == 1)
    kept, moved = asked.where(stays).select("path", F.col("path").alias("new_path")), asked.where(~stays)
    of = ["prefix", "ext"]
    named = used.unionByName(kept.select("path")).distinct().withColumns(parts)
    named = named.where((F.col("n") > 0) & (F.col("path") == F.concat("prefix", F.lit("_"), F.col("n").cast("string"), "ext")))
    named = running(named, of, ["n"], place=(one, "sum", "up")).select(*of, "n", (F.col("n") - F.col("place")).alias("free_before"))

    def passed(rows: DataFrame, at: str, marks: DataFrame, mark: str, marks_first: bool, *order: str) -> DataFrame:
        """rows with ``c``, how many marks of their stem lie below ``at`` (or at it, with marks_first), and ``k``, their number by ``at`` and ``order``."""
        marks = marks.select(*of, F.col(mark).alias("x"), F.lit(0 if marks_first else 2).alias("kind"))
        both = rows.withColumns({"x": F.col(at), "kind": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
        mine = F.col("kind") == 1
        counted = running(both, of, ["x", "kind", *order], c=((~mine).cast("long"), "sum", "up"), k=(mine.cast("long"), "sum", "up"))
        return counted.where("kind = 1").drop("x", "kind")

    moved = passed(moved.select("path", "turn", *of, "n"), "n", named, "n", True, "path", "turn")
    moved = running(moved, of, ["k"], first=(F.col("n") - F.col("c") + 1 - F.col("k"), "max", "up"))
    moved = moved.withColumn("rank", F.col("k") + F.col("first")).drop("c", "k")
    moved = passed(moved, "rank", named, "free_before", False)
    return kept.unionByName(moved.select("path", F.concat("prefix", F.lit("_"), (F.col("rank") + F.col("c")).cast("string"), "ext").alias("new_path")))


def pair_title(a: Column, b: Column) -> Column:
    return F.concat_ws(" vs ", basename(a), basename(b))


def resolution(width: Column, height: Column) -> Column:
    return F.format_string("%d x %d", width, height)


def megabytes(size: Column) -> Column:
    return F.format_string("%.2f MB", size / (1024 * 1024))


def distance_text(d: Column) -> Column:
    return F.when(d.isNull(), F.lit("N/A")).otherwise(F.format_string("%.2f", d))


def cluster_title(name: Column, n: Column) -> Column:
    return F.format_string("%s (%d items)", name, n)


def thumbnail_key(p: Column, size: int) -> Column:
    return F.concat(F.md5(p), F.lit(f"_{size}.png"))


def group_key(paths: Column) -> Column:
    """md5 of the sorted paths."""
    return F.md5(F.array_join(F.array_sort(paths), ""))
