"""Order-dependent work without a window over the whole table: rows are dealt by ranges of the order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.staging import materialize


def ranged(df: DataFrame, *order: str, ranges: int | None = None) -> DataFrame:
    """``df`` in ranges of ``order``, written, with the number ``_range`` of each row's range."""
    by = [F.col(c).asc_nulls_first() for c in order]
    dealt = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    return materialize(dealt.withColumn("_range", F.spark_partition_id()), "ranged")


def running_total(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` up to each row (rows of equal ``order`` together) without a window over the whole table.

    Rows are dealt by ranges of ``order``; a range adds the totals of the ranges before it, one row per range.
    """
    rows = ranged(df, order)
    totals = rows.groupBy("_range").agg(F.sum(value).alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy(order))
    joined = rows.withColumn(out, inside).join(totals.select("_range", before.alias("_before")), "_range")
    return joined.withColumn(out, F.col(out) + F.col("_before")).drop("_range", "_before")


def carry_forward(df: DataFrame, part: Sequence[str], order: str, cols: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Last non-null value so far of each column, within ``part`` in ``order``, as a segmented scan over ranges.

    Rows are dealt by ranges of (part, order), so a part of any size spans as many tasks as it needs.  A range
    fills its own rows; the last values of each part in a range (one row per part and range) are carried on to the ranges
    behind it, where only the rows in front of the range's first value take them.
    """
    part, cols = list(part), list(cols)
    rows = ranged(df, *part, order, ranges=ranges)
    inside = Window.partitionBy("_range", *part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in cols})
    last = lambda c: F.max_by(F.struct(c), F.when(F.col(c).isNotNull(), F.struct(order)))
    ends = rows.groupBy("_range", *part).agg(*[last(c).alias(f"_end_{c}") for c in cols])
    behind = Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_range", *part, *[F.last(f"_end_{c}", ignorenulls=True).over(behind).alias(f"_from_{c}") for c in cols])
    some = None
    for c in cols:
        some = F.col(f"_from_{c}").isNotNull() if some is None else some | F.col(f"_from_{c}").isNotNull()
    # A part goes on from one range to the next in the first part of a range only: a row per range at most.
    carried = carried.where(some).withColumnsRenamed({k: f"_on_{k}" for k in part}).withColumnRenamed("_range", "_on_range")
    cond = F.col("_range") == F.col("_on_range")
    for k in part:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    out = filled.join(carried, cond, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_from_{c}.{c}")) for c in cols})
    return out.select(*df.columns)
