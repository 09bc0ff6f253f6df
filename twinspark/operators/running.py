"""Running sums, least and largest values in the order of a group, without a task for a group.

Rows are dealt to ranges of (group, order), so a large group is cut into segments.
Inside a segment a window does the work; the totals of a group's earlier (or later)
segments are then added. Only groups that are cut have any, and each range cuts
two at most, so the table of these totals has no more than two rows a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinspark.plans.shared import kept

_FOLD = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def running(rows: DataFrame, by: list[str], order: list[str], **what: tuple[Column, str, str]) -> DataFrame:
    """``rows`` with a column for each of ``what``: (value, sum | min | max, up | down).

    ``up`` folds the values of a group from its first row to the row itself, ``down`` from the row to the last one.
    Nulls in ``by`` are a group, nulls in ``order`` come first, nulls among the values don't count (a sum of none is 0,
    a least or largest of none NULL); rows that tie come in any order.
    """
    values = {name: f"_{name}" for name in what}
    rows = rows.withColumns({values[name]: value for name, (value, _, _) in what.items()}).withColumn("_tie", F.monotonically_increasing_id())
    dealt = kept(rows.repartitionByRange(*[F.col(c) for c in (*by, *order, "_tie")]).withColumn("_segment", F.spark_partition_id()))
    inside, group = W.partitionBy("_segment", *by), W.partitionBy(*by)
    # A frame that ends with the group is folded anew for every row, so what goes down goes up in the opposite order.
    turn = {"up": F.asc, "down": F.desc}
    rowwise = {way: inside.orderBy(*[turned(c) for c in (*order, "_tie")]).rowsBetween(W.unboundedPreceding, W.currentRow) for way, turned in turn.items()}
    among = {way: group.orderBy(turned("_segment")).rowsBetween(W.unboundedPreceding, -1) for way, turned in turn.items()}
    totals = dealt.groupBy("_segment", *by).agg(*[_FOLD[kind][0](values[name]).alias(values[name]) for name, (_, kind, _) in what.items()])
    carried = totals.select("_segment", *by, F.count(F.lit(1)).over(group).alias("_cut"), *[_FOLD[kind][0](values[name]).over(among[way]).alias(f"_of_{name}") for name, (_, kind, way) in what.items()])
    carried = F.broadcast(carried.where("_cut > 1").drop("_cut").withColumnsRenamed({c: f"_by_{c}" for c in by}).withColumnRenamed("_segment", "_at"))
    own = dealt.withColumns({values[name]: _FOLD[kind][0](values[name]).over(rowwise[way]) for name, (_, kind, way) in what.items()})
    on = reduce(lambda a, b: a & b, [F.col("_segment") == F.col("_at"), *[own[c].eqNullSafe(F.col(f"_by_{c}")) for c in by]])
    out = own.join(carried, on, "left")
    named = {name: _FOLD[kind][1](F.col(values[name]), F.col(f"_of_{name}")).alias(name) for name, (_, kind, _) in what.items()}
    return out.select(*[c for c in rows.columns if c not in (*values.values(), "_tie", *named)], *named.values())


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Rows with ``number`` 1, 2, ... in the order of ``key``."""
    return running(rows, [], [key], number=(F.lit(1).cast("long"), "sum", "up"))
