"""Missing values of keyed yearly series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.checks import CheckFailed, assert_unique, compare_keyed

EDGE = ("hold", "exclude", "trend")


def impute_series(
    df: DataFrame,
    entity: Sequence[str],
    year: str = "year",
    value: str = "value",
    blocked: str = "blocked",
    leading: str = "hold",
    trailing: str = "hold",
    trend: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    check: bool = True,
) -> DataFrame:
    """Classify every cell and fill it by its class.

    Inside the observed range values are interpolated linearly in years, never across a blocked cell: a
    blocked row starts a segment and neighbours come from the same segment.  A blocked row's own value is
    masked first.  Edges are held at the entity's first or last observed value, left out, or follow a trend
    (least squares over the observed years, or ``trend``, see :func:`trend_by_group`).  Adds ``position``,
    ``value_filled``, ``strategy``, ``is_observed``, ``is_imputed`` and ``include``.
    """
    if leading not in EDGE or trailing not in EDGE:
        raise CheckFailed(f"edge strategies must be of {EDGE}")
    if check:
        assert_unique(df, [*entity, year], "series")
    v, b = F.col(value), F.coalesce(F.col(blocked), F.lit(False))
    whole = Window.partitionBy(*entity)
    upto = whole.orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({"_b": b, "is_observed": v.isNotNull()})
    seen = F.when(v.isNotNull(), F.col(year))
    out = out.withColumns({"_n": F.count(v).over(whole), "_first": F.min(seen).over(whole), "_last": F.max(seen).over(whole), "_seg": F.sum(F.col("_b").cast("int")).over(upto)})
    out = out.withColumns({
        "_first_v": F.max(F.when(F.col(year) == F.col("_first"), v)).over(whole), "_last_v": F.max(F.when(F.col(year) == F.col("_last"), v)).over(whole),
        "_slope": F.regr_slope(v, F.col(year).cast("double")).over(whole), "_icept": F.regr_intercept(v, F.col(year).cast("double")).over(whole),
    })
    segment = Window.partitionBy(*entity, "_seg").orderBy(year)
    point = F.when(v.isNotNull() & ~F.col("_b"), F.struct(F.col(year).alias("y"), v.alias("v")))
    out = out.withColumns({"_lo": F.last(point, ignorenulls=True).over(segment.rowsBetween(Window.unboundedPreceding, 0)), "_hi": F.first(point, ignorenulls=True).over(segment.rowsBetween(0, Window.unboundedFollowing))})
    out = out.withColumn("_all_blocked", F.min("_b").over(Window.partitionBy(*entity, "_seg")))
    y = F.col(year)
    plain = v.isNull() & ~F.col("_b")
    position = (
        F.when(v.isNotNull(), "observed").when(F.col("_b"), "structural").when(F.col("_n") == 0, "all missing").when(F.col("_n") == 1, "single year")
        .when(y < F.col("_first"), "leading").when(y > F.col("_last"), "trailing").otherwise("intermediate")
    )
    out = out.withColumn("position", position)
    between = F.when(F.col("_lo.y") == F.col("_hi.y"), F.col("_lo.v")).otherwise(
        F.col("_lo.v") + (F.col("_hi.v") - F.col("_lo.v")) * (y - F.col("_lo.y")) / F.nullif(F.col("_hi.y") - F.col("_lo.y"), F.lit(0))
    )
    line = F.col("_icept") + F.col("_slope") * y
    edge = {"hold": (F.col("_first_v"), F.col("_last_v")), "exclude": (F.lit(None).cast("double"),) * 2, "trend": (line, line)}
    masked = F.when(F.col("_b") & ~F.col("_all_blocked"), F.lit(None).cast("double")).otherwise(v)
    filled = (
        F.when(F.col("position") == "leading", edge[leading][0]).when(F.col("position") == "trailing", edge[trailing][1])
        .when(F.col("position") == "intermediate", between).otherwise(F.when(F.col("_n") > 1, masked).otherwise(v))
    )
    out = out.withColumn("value_filled", filled)
    names = {"hold": "hold {} observed", "exclude": "exclude analysis period", "trend": "trend-based extrapolation"}
    strategy = (
        F.when(F.col("position") == "structural", "preserve original NA").when(F.col("position") == "observed", "none")
        .when(F.col("position") == "single year", "exclude single-year series").when(plain & F.col("value_filled").isNull(), "exclude analysis period")
        .when(F.col("position") == "leading", names[leading].format("first")).when(F.col("position") == "trailing", names[trailing].format("last")).otherwise("linear interpolation")
    )
    out = out.withColumns({"strategy": strategy, "is_imputed": F.col("value_filled").isNotNull() & ~F.col("is_observed")})
    use = F.col("position").isin("observed", "intermediate", "leading", "trailing") & (F.col("is_observed") | F.col("value_filled").isNotNull()) & (F.col("_n") > 1)
    out = out.withColumn("include", use).drop("_b", "_n", "_first", "_last", "_seg", "_first_v", "_last_v", "_slope", "_icept", "_lo", "_hi", "_all_blocked")
    if trend is None:
        return out
    return trend_by_group(out, entity, year, value, trend, leading == "trend", trailing == "trend")


def trend_by_group(out: DataFrame, entity: Sequence[str], year: str, value: str, fn: Callable[[pd.Series, list[int]], Sequence[float]], leading: bool, trailing: bool) -> DataFrame:
    """Edge cells by a user function of (observed series by year, target years) per entity (U2).

    The function must return one non-null number per target year.
    """
    edges = [n for n, on in (("leading", leading), ("trailing", trailing)) if on]

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(year)
        seen = pdf[pdf["is_observed"]].set_index(year)[value]
        for name in edges:
            at = pdf["position"] == name
            if at.any():
                got = list(fn(seen, pdf.loc[at, year].astype(int).tolist()))
                if len(got) != at.sum() or any(x is None or pd.isna(x) for x in got):
                    raise ValueError("the trend function must return a number per target year")
                pdf.loc[at, "value_filled"] = got
                pdf.loc[at, "is_imputed"] = True
                pdf.loc[at, "include"] = True
                pdf.loc[at, "strategy"] = "trend-based extrapolation"
        return pdf

    return out.groupBy(*entity).applyInPandas(apply, out.schema)


def impute_scenarios(df: DataFrame, entity: Sequence[str], **kw) -> tuple[DataFrame, DataFrame]:
    """(edges held, edges left out)."""
    return impute_series(df, entity, leading="hold", trailing="hold", **kw), impute_series(df, entity, leading="exclude", trailing="exclude", **kw)


def sensitivity(main: DataFrame, alt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edge cells of both series side by side."""
    a = main.where(F.col("position").isin("leading", "trailing")).select(*keys, "position", F.col("value_filled").alias("main_value"), F.col("strategy").alias("main_strategy"))
    return a.join(alt.select(*keys, F.col("value_filled").alias("alt_value"), F.col("strategy").alias("alt_strategy")), list(keys))


def missing_position(df: DataFrame, entity: Sequence[str], year: str = "year", value: str = "value") -> DataFrame:
    """For missing cells: position, nearest observed year, its distance, direction of carrying and run length."""
    v, y = F.col(value), F.col(year)
    whole = Window.partitionBy(*entity)
    order = whole.orderBy(year)
    seen = F.when(v.isNotNull(), y)
    before, after = F.last(seen, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.first(seen, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    out = df.withColumns({"_p": before, "_q": after})
    position = F.when(F.col("_p").isNull() & F.col("_q").isNull(), "all missing").when(F.col("_p").isNull(), "leading").when(F.col("_q").isNull(), "trailing").otherwise("intermediate")
    back = F.col("_q").isNull() | (F.col("_p").isNotNull() & (y - F.col("_p") <= F.col("_q") - y))
    out = out.withColumns({"position": position, "nearest_year": F.when(back, F.col("_p")).otherwise(F.col("_q"))})
    out = out.withColumns({"distance": F.abs(y - F.col("nearest_year")), "carry": F.when(F.col("nearest_year").isNull(), F.lit(None).cast("string")).when(F.col("nearest_year") < y, "forward").otherwise("backward")})
    run = F.count_if(v.isNull()).over(Window.partitionBy(*entity, "_p", "_q"))
    return out.withColumn("run_length", run).where(v.isNull()).drop("_p", "_q")


def compare_imputed(a: DataFrame, b: DataFrame, keys: Sequence[str], tol: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    return compare_keyed(a, b, keys, "value_filled", tol)
