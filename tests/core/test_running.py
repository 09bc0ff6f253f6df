import random
import re
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from twinspark.operators.running import numbered, running


@pytest.fixture
def cut(spark):
    """Ranges stay as small as they are dealt."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows(n=400):
    rng = random.Random(2)
    groups = ["hot"] * 6 + [None, "a", "b"]
    return [(rng.choice(groups), k, rng.choice([None, *range(-5, 9)])) for k in rng.sample(range(n), n)]


def plain(table):
    out = set()
    for g, part in groupby(sorted(table, key=lambda r: (r[0] or "", r[1])), key=lambda r: r[0]):
        part = list(part)
        for i, (_, k, v) in enumerate(part):
            up = [x for *_, x in part[: i + 1] if x is not None]
            down = [x for *_, x in part[i:] if x is not None]
            out.add((g, k, v, sum(up), max(up, default=None), min(down, default=None), sum(down), i + 1))
    return out


def test_running_folds_of_cut_groups(spark, cut):
    table = rows()
    df = spark.createDataFrame(table, "g string, k int, v long").repartition(5)
    v = F.col("v")
    got = running(df, ["g"], ["k"], s=(v, "sum", "up"), most=(v, "max", "up"), least=(v, "min", "down"), rest=(v, "sum", "down"), n=(F.lit(1).cast("long"), "sum", "up"))
    assert got.columns == ["g", "k", "v", "s", "most", "least", "rest", "n"]
    assert {tuple(r) for r in got.collect()} == plain(table) and got.count() == len(table)


def test_a_hot_group_is_cut(spark, cut, monkeypatch):
    from twinspark.operators import running as module

    seen = []
    monkeypatch.setattr(module, "kept", lambda df: seen.append(df.cache()) or seen[-1])
    running(spark.range(700).withColumn("g", F.lit(1)), ["g"], ["id"], n=(F.lit(1), "sum", "up")).collect()
    sizes = [r["count"] for r in seen[0].groupBy("_segment").count().collect()]
    assert len(sizes) == 7 and max(sizes) < 250


def test_rows_that_tie_are_numbered_too(spark, cut):
    df = spark.range(300).select((F.col("id") % 3).alias("k"), F.lit("x").alias("number"))
    got = numbered(df, "k").orderBy("number").collect()
    assert [r.number for r in got] == list(range(1, 301)) and [r.k for r in got] == sorted(r.k for r in got)


def test_empty(spark):
    assert numbered(spark.range(0), "id").columns == ["id", "number"] and numbered(spark.range(0), "id").count() == 0


def test_rows_below_are_not_folded_anew_for_every_row(spark, cut):
    """A frame from a row to the end of its group is folded for every row, with the square of the group."""
    rows = spark.range(40).select((F.col("id") % 2).alias("g"), "id")
    got = running(rows, ["g"], ["id"], least=(F.col("id"), "min", "down"), rest=(F.col("id"), "sum", "down"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    frames = set(re.findall(r"specifiedwindowframe\(RowFrame, (\S+), (\S+)\)", plan))
    assert frames and not [f for f in frames if "unboundedfollowing" in f[1] and "unboundedpreceding" not in f[0]]
    assert all(r.least == r.id and r.rest == sum(range(r.id, 40, 2)) for r in got.collect())
