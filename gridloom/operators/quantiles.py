"""Exact quantiles by distributed selection: histograms narrow down on the wanted ranks.

The first pass counts values by sign and binary order of magnitude, the next ones cut the bins that hold a wanted
rank into ``BINS`` equal slices of what they span.  A bin whose values are all equal is settled, and once no open bin
holds more than ``FEW`` values these are counted one by one.  What is shuffled is a row per group, bin and task;
no task holds the values of a group, whatever their number or spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.staging import materialize

#: Slices of an open bin, and the most values of a bin that are counted one by one.
BINS, FEW = 4096, 1000


def _magnitude(x: Column) -> Column:
    """A bin that never falls as x grows: sign and binary exponent; infinities and NaN (the largest) have their own."""
    exponent = F.floor(F.log2(F.abs(x))) + 1100
    size = F.when(x.isin(float("inf"), float("-inf")), F.lit(3000)).otherwise(exponent)
    return F.when(F.isnan(x), F.lit(4000)).when(x == 0, F.lit(0)).otherwise(F.signum(x) * size).cast("long")


def beside(df: DataFrame, one: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row per group beside the rows of the group, null keys included; without keys that is a single row."""
    if not keys:
        return df.crossJoin(one)
    named = one.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    cond = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"_on_{k}"))
        cond = test if cond is None else cond & test
    return df.join(named, cond).drop(*[f"_on_{k}" for k in keys])


def _binned(rows: DataFrame, keys: Sequence[str], bin_: Sequence[str | Column]) -> DataFrame:
    return rows.groupBy(*keys, *bin_).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def order_statistics(values: DataFrame, ranks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, rank, x)``: the value of each 0-based rank, for ``values`` (keys, x) and ``ranks`` (keys, rank)."""
    level = _binned(values.withColumn("bin", _magnitude(F.col("x"))), keys, ["bin"]).withColumn("base", F.lit(0).cast("long"))
    # The bins of a group, in order, with the number of values in front of each; at most some thousand rows.
    want, settled = ranks, None
    while True:
        inside = Window.partitionBy(*keys, "base").orderBy("bin")
        before = F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("base")
        bins = level.withColumn("before", before)
        asked = want.groupBy(*keys).agg(F.collect_set("rank").alias("_ranks"))
        held = F.filter("_ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
        hit = materialize(beside(bins.select(*keys, "before", "n", "lo", "hi"), asked, keys).select(*keys, F.explode(held).alias("rank"), "before", "n", "lo", "hi"), "ranks")
        done = hit.where("lo = hi or isnan(lo)").select(*keys, "rank", F.col("lo").alias("x"))
        settled = done if settled is None else settled.unionByName(done)
        open_ = hit.where("lo < hi and not isnan(lo)")
        most = open_.agg(F.max("n").alias("n")).first()["n"]
        if most is None:
            return settled
        # One row per group: its open bins, which do not overlap, at most one per wanted rank.
        held = open_.groupBy(*keys).agg(F.collect_set(F.struct("lo", "hi", "before")).alias("_open"))
        inner = beside(values, held, keys).withColumn("_bin", F.explode(F.filter("_open", lambda b: (F.col("x") >= b["lo"]) & (F.col("x") <= b["hi"]))))
        inner = inner.select(*keys, "x", F.col("_bin.lo").alias("_lo"), F.col("_bin.hi").alias("_hi"), F.col("_bin.before").alias("base"))
        want = open_.select(*keys, "rank")
        if most <= FEW:
            level = inner.groupBy(*keys, "base", "x").agg(F.count(F.lit(1)).alias("n")).select(*keys, "base", F.col("x").alias("bin"), "n", F.col("x").alias("lo"), F.col("x").alias("hi"))
        else:
            # Halves are subtracted so that the widest span stays finite.
            part = (F.col("x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
            level = _binned(inner.withColumn("bin", F.floor(part * BINS)), keys, ["base", "bin"])


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], keys: Sequence[str] = (), out: str = "_q") -> DataFrame:
    """``(keys, out)``: the array of linearly interpolated quantiles per group; null where a group has no value.

    Null values do not count; NaN is the largest value; a null key is a group of its own.
    """
    keys = list(keys)
    values = df.select(*keys, F.col(col).cast("double").alias("x")).where("x is not null")
    sizes = df.groupBy(*keys).agg(F.count(F.col(col)).alias("_n")) if keys else df.agg(F.count(F.col(col)).alias("_n"))
    sizes = materialize(sizes, "sizes")
    places = F.array(*[F.lit(float(p)) for p in probs])
    at = sizes.where("_n > 0").withColumn("_at", F.transform(places, lambda p: p * (F.col("_n") - 1)))
    ranks = at.select(*keys, F.explode(F.array_distinct(F.flatten(F.transform("_at", lambda p: F.array(F.floor(p), F.ceil(p)))))).alias("rank"))
    found = order_statistics(values, ranks, keys)
    by_rank = found.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("rank", "x"))).alias("_x"))
    got = beside(at, by_rank, keys)
    x = lambda r: F.element_at("_x", r.cast("long"))
    between = lambda p: F.when(F.floor(p) == F.ceil(p), x(F.floor(p))).otherwise((F.ceil(p) - p) * x(F.floor(p)) + (p - F.floor(p)) * x(F.ceil(p)))
    got = got.select(*keys, F.transform("_at", between).alias(out))
    none = sizes.where("_n = 0").select(*keys, F.lit(None).cast("array<double>").alias(out))
    return got.unionByName(none)
