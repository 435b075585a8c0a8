"""Sorts, unions, set operations and reshaping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.checks import CheckFailed, fail_if_any


def order_by_list(df: DataFrame, col: str, values: Sequence, *more: Column | str) -> DataFrame:
    """Rows in the order of a value list; values outside it come last."""
    place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(col))
    return df.orderBy(F.when(place > 0, place).asc_nulls_last(), *more)


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def key_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys with the side they are on: left, right or both."""
    x, y = a.select(*keys).distinct().withColumn("_l", F.lit(True)), b.select(*keys).distinct().withColumn("_r", F.lit(True))
    both = x.join(y, list(keys), "full_outer")
    return both.withColumn("side", F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both")).drop("_l", "_r")


def unpivot_years(df: DataFrame, ids: Sequence[str], cols: Sequence[str] | None = None, value: str = "value") -> DataFrame:
    """Year columns to rows with ``observed`` and ``status``."""
    years = list(cols) if cols is not None else [c for c in df.columns if c not in ids]
    out = df.unpivot(list(ids), years, "year", value).withColumn("year", F.regexp_extract("year", r"(\d{4})", 1).cast("int"))
    seen = F.col(value).isNotNull()
    return out.withColumn("observed", seen).withColumn("status", F.when(seen, "observed").otherwise("missing"))


def pivot_strict(df: DataFrame, keys: Sequence[str], group: str, value: str, values: Sequence) -> DataFrame:
    """Long to wide with named columns; a missing or repeated cell raises."""
    out = df.groupBy(*keys).pivot(group, list(values)).agg(F.count(F.lit(1)).alias("n"), F.first(value).alias("v"))
    bad = None
    for v in values:
        test = F.coalesce(F.col(f"`{v}_n`"), F.lit(0)) != 1
        bad = test | F.col(f"`{v}_v`").isNull() if bad is None else bad | test | F.col(f"`{v}_v`").isNull()
    if bad is None:
        raise CheckFailed("no columns to pivot to")
    fail_if_any(out.where(bad).select(*keys), "incomplete or repeated cells")
    return out.select(*keys, *[F.col(f"`{v}_v`").alias(str(v)) for v in values])
