"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share of all words by weight, at most ``most`` times
the source's words, with the excess shared again by weight. Every document of a
source should be taken target / source size times: the whole part is taken for
sure, the fractional part is rounded. Two documents with fractional parts meet:
words move at random from one to the other, so that no expectation changes and
the words of both together stay the same, until one part is 0 or 1. The other
goes on to meet the next one. Blocks of documents are folded like this on their
own; each leaves one fractional document, and these meet again in blocks of the
next level of a reduction tree until one is left for each source. A source's
taken words so differ from its target by at most half the size of one document
(the last one is rounded to the nearer side).

Blocks are dealt by a hash, so a hot source is spread over all tasks, and a
block has about ``BLOCK`` documents at any scale. Rows that repeat are numbered,
and the number takes part in that hash, so they are spread as all others. Random
numbers are hashes of the documents' content and this number, so reruns agree.

Defined results: a null text has size 0 and is never taken; a null source is a
source of its own, last in order; repeated rows are rounded each for itself, and
which of them is taken more often doesn't matter; ties in meeting are settled by
content, then number; texts of any length are counted whole; other columns may have
any name; where all sizes are 0 all targets are 0; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinspark.llm.common import let, n_words, settled

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 64


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, n, target of a table (source, size).

    One row for each source is ranked in one task; sources are few, as a source is a corpus, not a document.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank - 1, F.lit(len(weights))) + 1))
    cap = F.col("source_size") * most
    # From the source that its cap stops first on: what the earlier ones leave is shared by those from here on.
    order = W.orderBy(cap / F.col("weight"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).partitionBy())
    level = (total - before).cast("double") / rest
    by = by.withColumn("cap", cap).withColumn("place", F.row_number().over(order)).withColumn("level", level)
    free = F.when(F.col("weight") * F.col("level") <= F.col("cap"), F.struct("place", "level"))
    by = by.withColumn("first", F.min(free).over(W.partitionBy()))
    target = F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("first.level"))
    return by.select("source", "source_size", "n", target.alias("target"))


def _meet(a: Column, b: Column) -> Column:
    """Struct of the two items, ``done`` with an integral part and ``on`` with the other."""
    up = lambda x: x["size"] * (1 - x["part"])
    down = lambda x: x["size"] * x["part"]

    def moved(x: Column, part: Column) -> Column:
        return x.withField("part", part)

    def give(x: Column, y: Column) -> tuple[Column, Column, Column]:
        """Words from y to x: whether x becomes 1 (else y becomes 0), and both parts after it."""
        fills = up(x) <= down(y)
        return fills, F.when(fills, F.lit(1.0)).otherwise(x["part"] + down(y) / x["size"]), F.when(fills, y["part"] - up(x) / y["size"]).otherwise(F.lit(0.0))

    gain, loss = F.least(up(a), down(b)), F.least(down(a), up(b))
    draw = F.pmod(F.xxhash64(a["key"], a["copy"], b["key"], b["copy"], F.lit("meet")), F.lit(1 << 52)).cast("double") / float(1 << 52)
    to_a = draw * (gain + loss) < loss
    a_fills, a_up, b_down = give(a, b)
    b_fills, b_up, a_down = give(b, a)
    a_done = F.when(to_a, a_fills).otherwise(~b_fills)
    a2, b2 = moved(a, F.when(to_a, a_up).otherwise(a_down)), moved(b, F.when(to_a, b_down).otherwise(b_up))
    return let(F.struct(a_done.alias("d"), a2.alias("a"), b2.alias("b")), lambda x: F.struct(F.when(x["d"], x["a"]).otherwise(x["b"]).alias("done"), F.when(x["d"], x["b"]).otherwise(x["a"]).alias("on")))


def _fold(items: Column) -> Column:
    """All items of a block meet one after another: struct of ``done`` items and the one left ``on``."""
    first = F.struct(F.filter(items, lambda x: F.lit(False)).alias("done"), F.get(items, F.lit(0)).alias("on"))
    step = lambda acc, x: let(_meet(acc["on"], x), lambda m: F.struct(F.array_append(acc["done"], m["done"]).alias("done"), m["on"].alias("on")))
    return F.aggregate(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), first, step)


def rounded(items: DataFrame, largest: int) -> DataFrame:
    """(source, item) of all items with integral parts; items: source, n (of the source), item; largest: the largest n."""
    out: list[DataFrame] = []
    width = 1
    while True:
        width *= BLOCK
        blocks = F.ceil(F.col("n") / width)
        block = F.pmod(F.xxhash64(F.col("item.key"), F.col("item.copy"), F.lit(width)), F.greatest(blocks, F.lit(1)))
        level = items.groupBy("source", "n", block.alias("block")).agg(F.sort_array(F.collect_list("item")).alias("items"))
        level = settled(level.select("source", "n", _fold(F.col("items")).alias("f")))
        out.append(level.select("source", F.explode("f.done").alias("item")))
        items = level.select("source", "n", F.col("f.on").alias("item"))
        if width >= largest:
            break
    last = F.col("item.part") >= 0.5  # the one left for each source: to the nearer side
    out.append(items.select("source", F.col("item").withField("part", F.when(last, F.lit(1.0)).otherwise(F.lit(0.0))).alias("item")))
    done = out[0]
    for x in out[1:]:
        done = done.unionByName(x)
    return done


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``copy``: 0, 1, ... for rows with the same key, by the parts of the table that they stand in.

    Only as many rows as one part has are ever numbered by one task.
    """
    part = F.shiftright("rid", 33).alias("part")
    by = rows.groupBy("key", part).agg(F.count(F.lit(1)).alias("n"))
    by = by.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("parts")).where((F.size("parts") > 1) | (F.col("parts")[0]["n"] > 1))
    before = F.transform("parts", lambda p: F.struct(p["part"].alias("part"), F.aggregate(F.filter("parts", lambda q: q["part"] < p["part"]), F.lit(0).cast("long"), lambda s, q: s + q["n"]).alias("before")))
    by = by.select("key", F.inline(before))
    many = rows.select("rid", "key", part).join(by, ["key", "part"])
    many = many.select("rid", (F.col("before") + F.row_number().over(W.partitionBy("key", "part").orderBy("rid")) - 1).alias("copy"))
    return rows.join(many, "rid", "left").withColumn("copy", F.coalesce("copy", F.lit(0).cast("long")))


def plan(rows: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """rid, size, source_size, target, copies of settled rows (rid, key, source, size)."""
    to = targets(rows, weights, most)
    rows = numbered(rows)
    same = rows["source"].eqNullSafe(to["source"])
    want = rows.join(to, same, "left").select(rows["*"], "source_size", "target", "n")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    want = want.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    open_ = (F.col("part") > 0) & (F.col("size") > 0)
    about = ["whole", "source_size", "target"]
    items = want.where(open_).select("source", "n", F.struct("key", "copy", "rid", F.col("size").cast("double").alias("size"), "part", *about).alias("item"))
    largest = to.agg(F.max("n")).first()[0] or 0
    done = rounded(items, largest).select("item.*").select("rid", F.col("size").cast("long").alias("size"), "source_size", "target", (F.col("whole") + F.col("part").cast("long")).alias("copies"))
    rest = want.where(~open_).select("rid", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("whole")).otherwise(F.lit(0)).cast("long").alias("copies"))
    return done.unionByName(rest)


def rows_of(docs: DataFrame, *carry: str) -> DataFrame:
    """Rows with an id of their own, written once so that the id stays."""
    size = n_words(F.col("text"))
    return settled(docs.select(F.monotonically_increasing_id().alias("rid"), F.xxhash64("doc_id", "source", "text").alias("key"), "source", size.alias("size"), *carry))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken (words) and copies for every row."""
    rows = rows_of(docs, "doc_id")
    got = plan(rows.select("rid", "key", "source", "size"), weights, most)
    return got.join(rows.select("rid", "doc_id", "source"), "rid").select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def resample(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows as often as the mix takes them, with their columns as they were."""
    cols = docs.columns
    rows = rows_of(docs, F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"))
    got = plan(rows.select("rid", "key", "source", "size"), weights, most).where("copies > 0").select("rid", "copies")
    taken = rows.select("rid", "row").join(got, "rid").select("row", F.explode(F.sequence(F.lit(1), "copies")))
    return taken.select(*[F.col(f"row.`{c}`") for c in cols])
