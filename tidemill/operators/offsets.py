"""Running totals over the whole input without a one-task window.

Rows are cut into stretches of consecutive keys; each stretch is summed, the sums are cumulated (again in two levels), and every
row adds its place within its stretch. Only stretch totals ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

STRETCH = 4096


def running_total(rows: DataFrame, order: str, value: Column, by: Sequence[str] = (), name: str = "before", stretch: int = STRETCH) -> DataFrame:
    """All columns and ``name``: the sum of ``value`` over the rows of the group with a smaller ``order`` (a unique whole number)."""
    rows = rows.withColumn("_v", value).withColumn("_s", F.floor(F.col(order) / F.lit(stretch))).withColumn("_u", F.floor(F.col("_s") / F.lit(stretch)))
    by = list(by)
    earlier = lambda *p: Window.partitionBy(*by, *p[:-1]).orderBy(p[-1]).rowsBetween(Window.unboundedPreceding, -1)
    small = rows.groupBy(*by, "_u", "_s").agg(F.sum("_v").alias("_t"))
    large = small.groupBy(*by, "_u").agg(F.sum("_t").alias("_t")).select(*by, "_u", F.coalesce(F.sum("_t").over(earlier("_u")), F.lit(0)).alias("_b2"))
    small = small.select(*by, "_u", "_s", F.coalesce(F.sum("_t").over(earlier("_u", "_s")), F.lit(0)).alias("_b1"))
    if by:
        at = None
        renamed = large.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.col("_u").alias("_u2"), "_b2")
        at = F.col("_u") == F.col("_u2")
        for i, b in enumerate(by):
            at = at & F.col(b).eqNullSafe(F.col(f"_k{i}"))
        small = small.join(renamed, at).select(*by, "_s", (F.col("_b1") + F.col("_b2")).alias("_b"))
    else:
        small = small.join(large, "_u").select("_s", (F.col("_b1") + F.col("_b2")).alias("_b"))
    inside = rows.withColumn("_i", F.coalesce(F.sum("_v").over(earlier("_s", order)), F.lit(0)))
    renamed = small.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.col("_s").alias("_s2"), "_b")
    at = F.col("_s") == F.col("_s2")
    for i, b in enumerate(by):
        at = at & F.col(b).eqNullSafe(F.col(f"_k{i}"))
    joined = inside.join(renamed, at).withColumn(name, F.col("_b") + F.col("_i"))
    return joined.drop("_v", "_s", "_u", "_i", "_s2", "_b", *[f"_k{i}" for i in range(len(by))])


def near_equal_chunks(rows: DataFrame, order: str, n: int) -> DataFrame:
    """All columns and ``chunk``: ``n`` chunks of total // n rows each in the sequence of ``order`` (a unique whole number), the remainder in the last."""
    per = max(rows.count() // n, 1)
    numbered = running_total(rows, order, F.lit(1).cast("bigint"), name="_ix")
    return numbered.withColumn("chunk", F.least(F.floor(F.col("_ix") / per), F.lit(n - 1).cast("bigint"))).drop("_ix")


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """All columns and ``name``: the place of each row (from 0) in the sequence of ``order`` (unique, of any types). Rows are range
    partitioned and sorted once and materialised; a partition's rows are numbered on from the sizes of those before it."""
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % F.lit(1 << 33)))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return placed.join(F.broadcast(starts), F.col("_p") == F.col("_q")).withColumn(name, F.col("_b") + F.col("_i")).drop("_p", "_q", "_i", "_b")


def previous(rows: DataFrame, order: Sequence[str], value: str, by: Sequence[str], name: str, stretch: int = STRETCH) -> DataFrame:
    """All columns and ``name``: ``value`` of the row before in the group's sequence of ``order`` (its first column is a whole number by
    which the sequence is cut into stretches). Within a stretch it is a window; a stretch's first row takes the last value of the stretch
    before, from the small table of stretches."""
    by, first = list(by), order[0]
    cut_rows = rows.withColumn("_s", F.floor(F.col(first) / F.lit(stretch)))
    inside = Window.partitionBy(*by, "_s").orderBy(*order)
    d = cut_rows.withColumn("_v", F.lag(value).over(inside)).withColumn("_head", F.row_number().over(inside) == 1)
    lasts = cut_rows.groupBy(*by, "_s").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    lasts = lasts.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.col("_s").alias("_t"), F.lag("_last").over(Window.partitionBy(*by).orderBy("_s")).alias("_before"))
    at = F.col("_s").eqNullSafe(F.col("_t"))
    for i, b in enumerate(by):
        at = at & F.col(b).eqNullSafe(F.col(f"_k{i}"))
    joined = d.join(lasts, at, "left").withColumn(name, F.when(F.col("_head"), F.col("_before")).otherwise(F.col("_v")))
    return joined.drop("_s", "_v", "_head", "_t", "_before", *[f"_k{i}" for i in range(len(by))])
