"""Window operators over keyed panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.staging import discard, materialize
from gridloom.operators.checks import CheckFailed, assert_contiguous, fail_if_any
from gridloom.operators.quantiles import beside, exact_quantiles
from gridloom.operators.rows import forward_fill  # noqa: F401  (W8)


def lags(df: DataFrame, part: Sequence[str], order: str, col: str, ks: Sequence[int], check: bool = True) -> DataFrame:
    """``col_lag1``, ``col_lead2``, ... and the change of the value and of its first lag."""
    if check:
        assert_contiguous(df, part, order)
    w = Window.partitionBy(*part).orderBy(order)
    return df.withColumns({f"{col}_{'lag' if k > 0 else 'lead'}{abs(k)}": F.lag(col, k).over(w) for k in ks})


def yoy(df: DataFrame, part: Sequence[str], order: str, col: str, consecutive: bool = True) -> DataFrame:
    """``col_diff`` and ``col_pct``; null in the first year and, on request, after a gap."""
    w = Window.partitionBy(*part).orderBy(order)
    prev = F.lag(col).over(w)
    if consecutive:
        prev = F.when(F.col(order) - F.lag(order).over(w) == 1, prev)
    return df.withColumns({f"{col}_diff": F.col(col) - prev, f"{col}_pct": F.try_divide(F.col(col) - prev, F.nullif(prev, F.lit(0.0))) * 100})


def rolling(df: DataFrame, part: Sequence[str], order: str, col: str, n: int = 3, out: str | None = None) -> DataFrame:
    """Trailing mean of n rows; null until n values are there."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(-(n - 1), 0)
    return df.withColumn(out or f"{col}_mean{n}", F.when(F.count(col).over(w) == n, F.avg(col).over(w)))


def rank_min(df: DataFrame, part: Sequence[str], col: str, desc: bool = True, out: str = "rank", exclude: Column | None = None) -> DataFrame:
    """Competition rank within the part (nulls and excluded rows unranked) and ``out_score`` = (N - r) / (N - 1) * 100."""
    counts = F.col(col).isNotNull() if exclude is None else F.col(col).isNotNull() & ~exclude
    # Unranked rows form a group of their own, so they do not take places.
    df = df.withColumn("_ranked", counts)
    w = Window.partitionBy(*part, "_ranked").orderBy(F.col(col).desc() if desc else F.col(col).asc())
    n = F.count(F.lit(1)).over(Window.partitionBy(*part, "_ranked"))
    ranked = df.withColumn(out, F.when(F.col("_ranked"), F.rank().over(w)))
    return ranked.withColumn(f"{out}_score", F.when(F.col("_ranked"), F.try_divide((n - F.col(out)) * 100.0, F.nullif(n - 1, F.lit(0))))).drop("_ranked")


def _with_stats(df: DataFrame, part: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Group statistics joined back; the global ones are one row, so no window sees the whole table."""
    if not part:
        return df.crossJoin(df.agg(*aggs))
    return df.join(df.groupBy(*part).agg(*aggs), list(part))


def zscore(df: DataFrame, col: str, part: Sequence[str] = (), on_zero: str = "fail", out: str | None = None) -> DataFrame:
    """(x - mean) / population deviation; no variance raises or gives 0."""
    out = out or f"{col}_z"
    stats = [F.avg(col).alias("_mean"), F.stddev_pop(col).alias("_std")]
    if on_zero == "fail":
        groups = df.groupBy(*part).agg(*stats) if part else df.agg(*stats)
        fail_if_any(groups.where("_std is null or _std = 0"), f"{col} has no variance")
    z = F.when(F.col("_std") == 0, F.when(F.col(col).isNotNull(), F.lit(0.0))).otherwise((F.col(col) - F.col("_mean")) / F.nullif("_std", F.lit(0.0)))
    return _with_stats(df, part, stats).withColumn(out, z).drop("_mean", "_std")


def minmax(df: DataFrame, col: str, part: Sequence[str] = (), out: str | None = None, check: bool = True) -> DataFrame:
    """0 to 100 between the smallest and the largest value; no range raises."""
    stats = [F.min(col).alias("_lo"), F.max(col).alias("_hi")]
    if check:
        groups = df.groupBy(*part).agg(*stats) if part else df.agg(*stats)
        fail_if_any(groups.where("_hi is null or _hi = _lo"), f"{col} has no range")
    score = (F.col(col) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * 100
    return _with_stats(df, part, stats).withColumn(out or f"{col}_score", score).drop("_lo", "_hi")


def share(df: DataFrame, keys: Sequence[str], col: str, out: str = "share", check: bool = True) -> DataFrame:
    """x over the sum of its key; a sum that is not positive raises."""
    total = F.sum(col).over(Window.partitionBy(*keys))
    if check:
        fail_if_any(df.groupBy(*keys).agg(F.sum(col).alias("total")).where("total is null or total <= 0"), "totals are not positive")
    return df.withColumn(out, F.col(col) / F.nullif(total, F.lit(0.0)))


#: Absorbing ends when no mean is above this share of a column's deviation, or raises after so many sweeps.
TOLERANCE, SWEEPS = 1e-11, 2000


def absorb(rows: DataFrame, cols: Sequence[str], sides: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``cols`` without what the effects of ``sides`` explain, by alternating projections.

    Each sweep takes the means of the sides off in turn, as aggregates joined back, and writes the table, until the
    means are within TOLERANCE.  A balanced panel takes one sweep, one with holes some more; the axes may be of any length.
    """
    dev = rows.agg(*[F.stddev_pop(c).alias(c) for c in cols]).first()
    scale = {c: dev[c] or 1.0 for c in cols}
    held = None
    for sweep in range(SWEEPS + 1):
        # The last side has no means left after a sweep; when the first has none either, all is absorbed.
        first = rows.groupBy(*by, sides[0]).agg(*[F.avg(c).alias(c) for c in cols]).agg(*[F.max(F.abs(c)).alias(c) for c in cols]).first()
        if sweep and max((first[c] or 0.0) / scale[c] for c in cols) <= TOLERANCE:
            return rows
        for side in sides:
            means = rows.groupBy(*by, side).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
            rows = beside(rows, means, [*by, side]).withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in cols}).drop(*[f"_m_{c}" for c in cols])
        after = materialize(rows, "absorbed")
        if held is not None:
            discard(held)
        rows = held = after
    raise CheckFailed(f"the effects are not absorbed after {SWEEPS} sweeps")


def two_way_demean(df: DataFrame, region: str, year: str, cols: Sequence[str], check: bool = True) -> DataFrame:
    """What region and year effects leave of x: x - region mean - year mean + grand mean on a balanced panel.

    Without ``check`` a panel with holes is taken too, and its effects are absorbed by alternating projections.
    """
    if not check:
        own = materialize(df.withColumns({f"{c}_resid": F.col(c).cast("double") for c in cols}), "panel")
        return absorb(own, [f"{c}_resid" for c in cols], [region, year])
    c = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(region, year)).alias("k"), F.count_distinct(region).alias("r"), F.count_distinct(year).alias("y"), *[F.count(x).alias(f"n_{x}") for x in cols]).first()
    if not c["n"] == c["k"] == c["r"] * c["y"] or any(c[f"n_{x}"] != c["n"] for x in cols):
        raise CheckFailed("the panel is not balanced")
    # Means are aggregates joined back: no task holds the rows of a year or a region.
    out, names = df, []
    for side, keys in (("g", []), ("r", [region]), ("y", [year])):
        out = beside(out, df.groupBy(*keys).agg(*[F.avg(c).alias(f"_{side}_{c}") for c in cols]), keys)
        names += [f"_{side}_{c}" for c in cols]
    out = out.withColumns({f"{c}_resid": F.col(c) - F.col(f"_r_{c}") - F.col(f"_y_{c}") + F.col(f"_g_{c}") for c in cols})
    return out.drop(*names)


def iqr_flag(df: DataFrame, keys: Sequence[str], col: str, factor: float = 1.5, out: str = "outlier") -> DataFrame:
    """Values beyond ``factor`` interquartile ranges outside the quartiles of their group."""
    joined = beside(df, exact_quantiles(df, col, [0.25, 0.75], keys), keys)
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    return joined.withColumn(out, F.coalesce((F.col(col) < lo - factor * (hi - lo)) | (F.col(col) > hi + factor * (hi - lo)), F.lit(False))).drop("_q")


def qcut(df: DataFrame, col: str, labels: Sequence[str], out: str = "bin") -> DataFrame:
    """Bins by linear quantile edges, closed on the right, the first also on the left."""
    q = len(labels)
    edges = exact_quantiles(df, col, [i / q for i in range(q + 1)])
    x, e = F.col(col), F.col("_q")
    bin_ = F.when(x.isNull(), F.lit(None).cast("string"))
    for i, label in enumerate(labels):
        bin_ = bin_.when(x <= e[i + 1], label)
    return beside(df, edges, []).withColumn(out, bin_).drop("_q")


def time_features(df: DataFrame, part: Sequence[str], ts: str, target: str, lag_ks: Sequence[int] = (1, 7), windows: Sequence[int] = (7,)) -> DataFrame:
    """Lags, statistics of the previous w rows (never the present one), cyclic calendar terms and a weekend flag."""
    w = Window.partitionBy(*part).orderBy(ts)
    cols = {f"{target}_lag{k}": F.lag(target, k).over(w) for k in lag_ks}
    for n in windows:
        frame = w.rowsBetween(-n, -1)
        full = F.count(target).over(frame) == n
        for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max)):
            cols[f"{target}_{name}{n}"] = F.when(full, f(target).over(frame))
    day, month = F.weekday(ts), F.month(ts)
    tau = 6.283185307179586
    cols |= {"dow_sin": F.sin(day * tau / 7), "dow_cos": F.cos(day * tau / 7), "month_sin": F.sin(month * tau / 12), "month_cos": F.cos(month * tau / 12), "is_weekend": (day >= 5).cast("int")}
    return df.withColumns(cols)


def top_n(df: DataFrame, part: Sequence[str], order: Sequence[Column], n: int, out: str = "place") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col(out) <= n)


def fiscal_index(panel: DataFrame, cpi: DataFrame, population: DataFrame, base_year: int, region: str = "region", year: str = "year", budget: str = "budget") -> DataFrame:
    """Real budget, its logs, pooled z, 0-100 score, yearly rank and yearly changes (W17)."""
    from gridloom.operators.index import deflate_budget

    out = deflate_budget(panel, cpi, budget, base_year, year).join(population, [region, year])
    out = out.withColumn("real_per_capita", F.col("real") / F.nullif(F.col("population"), F.lit(0))).withColumn("log_real", F.log1p("real")).withColumn("log_per_capita", F.log1p("real_per_capita"))
    # The statistics below read the panel several times; it is computed once (a row per region and year).
    out = materialize(out, "fiscal-panel")
    out = minmax(zscore(zscore(out, "log_real"), "log_per_capita"), "log_per_capita_z", out="score", check=False)
    out = rank_min(out, [year], "score", desc=True)
    out = yoy(out, [region], year, "real")
    prev = F.lag("log_real").over(Window.partitionBy(region).orderBy(year))
    return out.withColumn("log_real_diff", F.col("log_real") - prev)
