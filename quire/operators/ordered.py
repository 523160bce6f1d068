"""Running totals and first/last facts over documents of any length.

A plain window partitioned by document puts a whole document in one task. Here
the order column is a dense integer (a page), so a document is cut into spans
of pages: totals per span, a running total over the spans, and a running total
inside each span. No task sees more than one span, or one row per span.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire import session

SPAN = 4096


def running_before(df: DataFrame, keys: list[str], order: str, value: Column, out: str) -> DataFrame:
    """df with `out`: the sum of `value` over the rows of the same keys strictly before."""
    df = df.withColumn("_span", F.floor(F.col(order) / SPAN)).withColumn("_v", value.cast("long"))
    spans = df.groupBy(*keys, "_span").agg(F.sum("_v").alias("_span_sum"))
    upto = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*keys, "_span", F.coalesce(F.sum("_span_sum").over(upto), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(spans, [*keys, "_span"])
        .withColumn(out, F.col("_base") + F.coalesce(F.sum("_v").over(inside), F.lit(0)))
        .drop("_span", "_v", "_base")
    )


def nearest_known(df: DataFrame, keys: list[str], order: str, value: Column, out: str, ahead: bool) -> DataFrame:
    """df with `out`: the nearest value that is not NULL strictly before (or after)."""
    df = df.withColumn("_span", F.floor(F.col(order) / SPAN)).withColumn("_v", value)
    pick = F.min_by if ahead else F.max_by
    known = df.where(F.col("_v").isNotNull()).groupBy(*keys, "_span").agg(pick("_v", order).alias("_edge"))
    spans = df.select(*keys, "_span").distinct().join(known, [*keys, "_span"], "left")
    first_last = F.first if ahead else F.last
    frame = (1, Window.unboundedFollowing) if ahead else (Window.unboundedPreceding, -1)
    over_spans = Window.partitionBy(*keys).orderBy("_span").rowsBetween(*frame)
    spans = spans.select(*keys, "_span", first_last("_edge", ignorenulls=True).over(over_spans).alias("_far"))
    inside = Window.partitionBy(*keys, "_span").orderBy(order).rowsBetween(*frame)
    return (
        df.join(spans, [*keys, "_span"])
        .withColumn(out, F.coalesce(first_last("_v", ignorenulls=True).over(inside), F.col("_far")))
        .drop("_span", "_v", "_far")
    )


def running(df: DataFrame, group: list[str], order: list, totals: bool = False, **sums: Column) -> DataFrame:
    """df with a column for each of ``sums``: its running total in the group, this row
    included, by an order of any kind; with ``totals`` also ``<name>_all``, the group's.

    Rows are dealt by range of (group, order), so a group of any size is many tasks;
    one row for each group and task is summed up across tasks. ``order`` must tell rows
    apart. A null in the group is a group.
    """
    own = {f"_s_{k}": c.cast("long") for k, c in sums.items()}
    dealt = df.withColumns({**own, **{f"_g{i}": F.col(g) for i, g in enumerate(group)}})
    dealt = session.settle(dealt.repartitionByRange(*group, *order).withColumn("_task", F.spark_partition_id()), "dealt")
    keys = ["_task", *[f"_g{i}" for i in range(len(group))]]
    parts = dealt.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in own])
    whole = Window.partitionBy(*keys[1:])
    upto = whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *[F.col(k).alias(f"{k}_") for k in keys],
        *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{c}_base") for c in own],
        *[F.sum(c).over(whole).alias(f"{c}_all") for c in own],
    )
    here = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.withColumns({f"{c}_in": F.sum(c).over(here) for c in own})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
    out = inside.join(parts, same)
    made = [(F.col(f"_s_{k}_in") + F.col(f"_s_{k}_base")).alias(k) for k in sums]
    made += [F.col(f"_s_{k}_all").alias(f"{k}_all") for k in sums] if totals else []
    return out.select(*df.columns, *made)
