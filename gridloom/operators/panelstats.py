"""Panel statistics from distributed sufficient statistics; only k x k systems leave Spark."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gridloom.functions.staging import materialize
from gridloom.operators.checks import CheckFailed, assert_unique, fail_if_any
from gridloom.operators.graph import connected_components
from gridloom.operators.quantiles import beside
from gridloom.operators.ranges import ranged, running_total
from gridloom.operators.windows import absorb, rank_min, two_way_demean, zscore

# ------------------------------------------------------------------ Student t


def t_cdf(t: float, df: int) -> float:
    """Student t distribution function for a whole number of degrees of freedom (finite series)."""
    theta = math.atan2(t, math.sqrt(df))
    c, s = math.cos(theta), math.sin(theta)
    if df % 2:
        term, total = c, 0.0 if df == 1 else c
        for k in range(3, df - 1, 2):
            term *= c * c * (k - 1) / k
            total += term
        return 0.5 + (theta + s * total) / math.pi
    term, total = 1.0, 1.0
    for k in range(2, df - 1, 2):
        term *= c * c * (k - 1) / k
        total += term
    return 0.5 + s * total / 2


def t_p_value(t: float, df: int) -> float:
    return max(0.0, 2 * (1 - t_cdf(abs(t), df)))


def t_quantile(p: float, df: int) -> float:
    lo, hi = -1.0, 1.0
    while t_cdf(lo, df) > p:
        lo *= 2
    while t_cdf(hi, df) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation by the t transform; null for fewer than three pairs."""

    def one(x: float, k: float) -> float | None:
        if x is None or pd.isna(x) or k < 3:
            return None
        return 0.0 if abs(x) >= 1 else t_p_value(x * math.sqrt((k - 2) / (1 - x * x)), int(k) - 2)

    return pd.Series([one(x, k) for x, k in zip(r, n, strict=True)], dtype="float64")


# ------------------------------------------------------------------ correlation


def _ranked(df: DataFrame, cols: Sequence[str], part: Sequence[str] = ()) -> DataFrame:
    """Average ranks of non-null values.  Ranks are counted per distinct value, so equal values are no group to sort."""
    out = df
    for c in cols:
        counts = out.where(F.col(c).isNotNull()).groupBy(*part, c).agg(F.count(F.lit(1)).alias("_n"))
        if part:
            counts = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*part).orderBy(c)))
        else:
            counts = running_total(counts, c, "_n", "_upto")
        ranks = counts.withColumn(f"_r_{c}", F.col("_upto") - (F.col("_n") - 1) / 2.0).drop("_n", "_upto")
        out = out.join(ranks, [*part, c], "left")
    return out


def corr_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """``(a, b, r, n)`` of every ordered pair, over rows where both are there, in one pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    name = lambda c: c
    if method == "spearman":
        df, name = _ranked(df, cols), lambda c: f"_r_{c}"
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    aggs = []
    for k, (a, b) in enumerate(pairs):
        x, y = (F.when(both(a, b), F.col(name(c)).cast("double")) for c in (a, b))
        aggs += [F.corr(x, y).alias(f"r{k}"), F.count_if(both(a, b)).alias(f"n{k}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), F.col(f"r{k}").alias("r"), F.col(f"n{k}").alias("n")) for k, (a, b) in enumerate(pairs) for p, q in dict.fromkeys([(a, b), (b, a)])])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def within_corr(df: DataFrame, cols: Sequence[str], mode: str = "region", region: str = "region", year: str = "year") -> DataFrame:
    """Correlation after removing region means, or region and year means (mode "two_way")."""
    if mode == "two_way":
        out = two_way_demean(df, region, year, cols).select(*[F.col(f"{c}_resid").alias(c) for c in cols])
    else:
        out = df.select(*[(F.col(c) - F.avg(c).over(Window.partitionBy(region))).alias(c) for c in cols])
    return corr_matrix(out, cols)


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Variance inflation factors and the condition number of the correlation matrix."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    if any(counts[c] for c in cols) or counts["n"] <= len(cols):
        raise CheckFailed("missing values or too few rows")
    r = corr_matrix(df, cols).toPandas().pivot(index="a", columns="b", values="r").loc[list(cols), list(cols)].to_numpy()
    values = np.linalg.eigvalsh(r)
    condition = math.sqrt(values[-1] / values[0]) if values[0] > 0 else math.inf
    rows = [(c, float(v), float(condition)) for c, v in zip(cols, np.diag(np.linalg.inv(r)), strict=True)]
    return df.sparkSession.createDataFrame(rows, "column string, vif double, condition_number double")


def high_corr_pairs(corr: DataFrame, t: float) -> DataFrame:
    return corr.where((F.col("a") < F.col("b")) & (F.abs("r") >= t)).orderBy(F.abs("r").desc(), "a", "b")


def group_corr(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Per group: Pearson and Spearman with p, and the share of opposite signs (zeros left out)."""
    rows = _ranked(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), [x, y], keys)
    moving = (F.col(x) != 0) & (F.col(y) != 0)
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("pearson"), F.corr(f"_r_{x}", f"_r_{y}").alias("spearman"),
        F.try_divide(F.count_if(moving & (F.signum(x) != F.signum(y))), F.nullif(F.count_if(moving), F.lit(0))).alias("opposite_share"),
    )
    return out.withColumn("pearson_p", correlation_p("pearson", F.col("n").cast("double"))).withColumn("spearman_p", correlation_p("spearman", F.col("n").cast("double")))


# ------------------------------------------------------------------ distributions and metrics


def psi(expected: DataFrame, actual: DataFrame, col: str, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Population stability index over equal bins of the joint range; empty bins count as ``floor``."""
    both = expected.select(F.col(col).alias("v"), F.lit(1).alias("e")).unionByName(actual.select(F.col(col).alias("v"), F.lit(0).alias("e"))).where("v is not null")
    edge = both.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) / bins
    bin_ = F.coalesce(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)), F.lit(0)).cast("int")
    counts = both.crossJoin(edge).groupBy(bin_.alias("bin")).agg(F.sum("e").alias("ne"), F.sum(1 - F.col("e")).alias("na"))
    every = expected.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    w = Window.partitionBy()  # one row per bin
    full = every.join(counts, "bin", "left").fillna(0)
    share = lambda c: F.when(F.col(c) == 0, F.lit(floor)).otherwise(F.col(c) / F.sum(c).over(w))
    full = full.withColumns({"pe": share("ne"), "pa": share("na")})
    return full.agg(F.sum((F.col("pa") - F.col("pe")) * F.ln(F.col("pa") / F.col("pe"))).alias("psi"))


def feature_report(train: DataFrame, val: DataFrame, cols: Sequence[str], psi_limit: float = 0.2, corr_limit: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(PSI per feature with a flag, pairs of highly correlated features)."""
    parts = [psi(train, val, c).select(F.lit(c).alias("feature"), "psi", (F.col("psi") > psi_limit).alias("flagged")) for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, high_corr_pairs(corr_matrix(train, cols), corr_limit)


def regression_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    e = F.col(y) - F.col(yhat)
    return df.agg(
        (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.avg(F.abs(e) / F.greatest(F.abs(F.col(y)), F.lit(2.220446049250313e-16))).alias("mape"),
    )


def confusion(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("actual"), F.col(yhat).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    c = confusion(df, y, yhat)
    side = lambda k: c.groupBy(F.col(k).alias("class")).agg(F.sum("n").alias(k))
    hit = c.where("actual = predicted").select(F.col("actual").alias("class"), F.col("n").alias("hit"))
    out = side("actual").join(side("predicted"), "class", "full_outer").join(hit, "class", "left").fillna(0, ["actual", "predicted", "hit"])
    div = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.nullif(b, F.lit(0))), F.lit(0.0))
    out = out.withColumns({"precision": div("hit", "predicted"), "recall": div("hit", "actual")})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))), F.lit(0.0))
    return out.select("class", "precision", "recall", f1.alias("f1"), F.col("actual").alias("support"), "hit")


def classification_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    r = class_report(df, y, yhat)
    n = F.sum("support")
    return r.agg((F.sum("hit") / n).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"))


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the curve of a 0/1 label by the rank sum; ties share their rank."""
    r = _ranked(df, [score])
    pos = F.count_if(F.col(y) == 1)
    neg = F.count_if(F.col(y) == 0)
    return r.agg(((F.sum(F.when(F.col(y) == 1, F.col(f"_r_{score}"))) - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0))).alias("auc"))


def residual_summary(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Mean, population deviation, range, and bias-corrected skewness and excess kurtosis of the residuals."""
    e = df.select((F.col(y) - F.col(yhat)).alias("e"))
    s = e.agg(F.count("e").alias("n"), F.avg("e").alias("mean"), F.stddev_pop("e").alias("std"), F.min("e").alias("min"), F.max("e").alias("max"), F.skewness("e").alias("g1"), F.kurtosis("e").alias("g2"))
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1"))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return s.select("mean", "std", "min", "max", skew.alias("skew"), kurt.alias("kurtosis"))


# ------------------------------------------------------------------ two-way fixed effects


def _checked(df: DataFrame, y: str, xs: Sequence[str], region: str, year: str, by: Sequence[str]) -> None:
    cols = [region, year, y, *xs]
    fail_if_any(df.where(" or ".join(f"`{c}` is null" for c in cols)).select(*cols), "missing values")
    assert_unique(df, [*by, region, year], "panel")


def _prepared(df: DataFrame, y: str, xs: Sequence[str], region: str, year: str, by: Sequence[str]) -> tuple[DataFrame, list[str], list]:
    _checked(df, y, xs, region, year, by)
    years = [r[0] for r in df.select(year).distinct().orderBy(year).collect()]  # a short axis
    rows = df.select(*by, F.col(region).alias("_region"), F.col(year).alias("_year"), F.col(y).cast("double").alias("_y"), *[F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)])
    rows = rows.withColumns({f"_d{i}": (F.col("_year") == F.lit(v)).cast("double") for i, v in enumerate(years)})
    z = [f"_x{i}" for i in range(len(xs))] + [f"_d{i}" for i in range(len(years))]
    w = Window.partitionBy(*by, "_region")
    return rows.withColumns({c: F.col(c) - F.avg(c).over(w) for c in ["_y", *z]}), z, years


def _name(by: Sequence[str], row) -> tuple:
    return tuple(row[b] for b in by)


def _solved(r: dict, a: np.ndarray, zy: np.ndarray, xs: Sequence[str]) -> dict:
    """Model of a Gram matrix; ``r`` has the counts ``n``, ``g`` (regions) and ``t`` (years)."""
    k = len(xs)
    present = [i for i in range(k, len(a)) if a[i, i] > 1e-12]
    use = list(range(k)) + present[1:]  # the first year present is the base
    m = {"n": r["n"], "regions": r["g"], "years": r["t"], "xs": list(xs), "why": None}
    sub = a[np.ix_(use, use)]
    scale = np.sqrt(np.maximum(np.diag(sub), 1e-300))
    if r["g"] < 2 or r["t"] < 2:
        m["why"] = "fewer than two regions or years"
    elif (np.diag(sub)[:k] < 1e-12).any():
        m["why"] = "no variation"
    elif np.linalg.matrix_rank(sub / np.outer(scale, scale), tol=1e-9) < len(use):
        m["why"] = "rank deficient"
    elif r["n"] - r["g"] - len(use) <= 0:
        m["why"] = "no residual degrees of freedom"
    if m["why"] is None:
        inv = np.linalg.inv(sub)
        m |= {"use": use, "inv": inv, "beta": inv @ zy[use], "resid_df": int(r["n"] - r["g"] - len(use))}
    return m


def _clustered(m: dict, s: np.ndarray) -> np.ndarray:
    """Covariance of a model from the summed outer products of its regions' scores."""
    g, n, params = m["regions"], m["n"], m["regions"] + len(m["use"]) + m.get("effects", 0)
    return g / (g - 1) * (n - 1) / (n - params) * m["inv"] @ s[np.ix_(m["use"], m["use"])] @ m["inv"]


def _symmetric(pairs: Sequence[tuple[int, int]], values: Sequence[float], width: int) -> np.ndarray:
    out = np.zeros((width, width))
    for (i, j), v in zip(pairs, values, strict=True):
        out[i, j] = out[j, i] = v
    return out


#: Years up to which their effects are dummy columns of one exact system; the effects of longer axes are absorbed.
LONG_AXIS = 64


def _absorbed_fe(df: DataFrame, y: str, xs: Sequence[str], region: str, year: str, by: Sequence[str]) -> dict[tuple, dict]:
    """:func:`fit_fe` with both effects absorbed: only the systems of the regressors come to the driver."""
    names = [f"_x{i}" for i in range(len(xs))]
    rows = df.select(*by, F.col(region).alias("_region"), F.col(year).alias("_year"), F.col(y).cast("double").alias("_y"), *[F.col(x).cast("double").alias(n) for x, n in zip(xs, names, strict=True)])
    rows = materialize(rows, "panel")
    # Sets of regions and years that no row connects leave one effect of each set undetermined.
    model = F.to_json(F.struct(*[F.col(b).cast("string") for b in by])) if by else F.lit("")
    ends = rows.select(F.concat(model, F.lit("\u0001r"), F.col("_region").cast("string")).alias("src"), F.concat(model, F.lit("\u0001y"), F.col("_year").cast("string")).alias("dst"), *by)
    parts = connected_components(ends, "src", "dst")
    sets = {_name(by, r): r["sets"] for r in ends.join(parts, ends["src"] == parts["node"]).groupBy(*by).agg(F.count_distinct("component").alias("sets")).collect()}
    spread = {_name(by, r): r for r in beside(rows, rows.groupBy(*by, "_region").agg(*[F.avg(c).alias(f"_m{c}") for c in names]), [*by, "_region"]).groupBy(*by).agg(*[F.sum(F.pow(F.col(c) - F.col(f"_m{c}"), 2)).alias(c) for c in names]).collect()}
    free = absorb(rows, ["_y", *names], ["_region", "_year"], by)
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    gram = free.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("_region").alias("g"), F.count_distinct("_year").alias("t"),
        F.array(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).alias("zz"), F.array(*[F.sum(F.col(c) * F.col("_y")) for c in names]).alias("zy"),
    ).collect()
    models = {}
    for r in gram:
        key, a = _name(by, r), _symmetric(pairs, r["zz"], len(xs))
        m = {"n": r["n"], "regions": r["g"], "years": r["t"], "xs": list(xs), "why": None, "use": list(range(len(xs))), "effects": r["t"] - 1}
        within = np.array([spread[key][c] for c in names])
        scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
        if r["g"] < 2 or r["t"] < 2:
            m["why"] = "fewer than two regions or years"
        elif (within < 1e-12).any():
            m["why"] = "no variation"
        elif sets[key] > 1 or (np.diag(a) < 1e-9 * within).any() or np.linalg.matrix_rank(a / np.outer(scale, scale), tol=1e-9) < len(xs):
            m["why"] = "rank deficient"
        elif r["n"] - r["g"] - len(xs) - m["effects"] <= 0:
            m["why"] = "no residual degrees of freedom"
        else:
            inv = np.linalg.inv(a)
            m |= {"inv": inv, "beta": inv @ np.array(r["zy"]), "resid_df": int(r["n"] - r["g"] - len(xs) - m["effects"])}
        models[key] = m
    good = {key: m for key, m in models.items() if m["why"] is None}
    if good:
        kinds = ", ".join(f"`{b}` {dict(df.dtypes)[b]}" for b in by)
        betas = df.sparkSession.createDataFrame([(*key, m["beta"].tolist()) for key, m in good.items()], (kinds + ", " if by else "") + "_beta array<double>")
        e = F.col("_y") - sum((F.col(c) * F.col("_beta")[i] for i, c in list(enumerate(names))[1:]), F.col(names[0]) * F.col("_beta")[0])
        scores = beside(free, betas, by).withColumn("_e", e).groupBy(*by, "_region").agg(*[F.sum(F.col(c) * F.col("_e")).alias(f"_s{i}") for i, c in enumerate(names)])
        for r in scores.groupBy(*by).agg(F.array(*[F.sum(F.col(f"_s{i}") * F.col(f"_s{j}")) for i, j in pairs]).alias("ss")).collect():
            good[_name(by, r)]["cov"] = _clustered(good[_name(by, r)], _symmetric(pairs, r["ss"], len(xs)))
    return models


def fit_fe(df: DataFrame, y: str, xs: Sequence[str], region: str = "region", year: str = "year", by: Sequence[str] = ()) -> dict[tuple, dict]:
    """Least squares with region and year effects and region-clustered covariance, one model per value of ``by``.

    Up to LONG_AXIS years, region means are removed and year dummies are carried as columns: the Gram matrix comes from
    one aggregation over all models, the cluster scores from a second; exact on unbalanced panels.  On longer axes both
    effects are absorbed (:func:`absorb`), which gives the same model within TOLERANCE.
    """
    if df.agg(F.count_distinct(year).alias("n")).first()["n"] > LONG_AXIS:
        _checked(df, y, xs, region, year, by)
        return _absorbed_fe(df, y, xs, region, year, by)
    rows, z, _ = _prepared(df, y, xs, region, year, by)
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    gram = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("_region").alias("g"), F.count_distinct("_year").alias("t"),
        F.array(*[F.sum(F.col(z[i]) * F.col(z[j])) for i, j in pairs]).alias("zz"), F.array(*[F.sum(F.col(c) * F.col("_y")) for c in z]).alias("zy"),
    ).collect()
    models = {_name(by, r): _solved(r.asDict(), _symmetric(pairs, r["zz"], len(z)), np.array(r["zy"]), xs) for r in gram}
    good = {key: m for key, m in models.items() if m["why"] is None}
    if good:
        width = len(z)
        beta_rows = [(*key, [float(m["beta"][m["use"].index(i)]) if i in m["use"] else 0.0 for i in range(width)]) for key, m in good.items()]
        kinds = ", ".join(f"`{b}` {dict(df.dtypes)[b]}" for b in by)
        betas = df.sparkSession.createDataFrame(beta_rows, (kinds + ", " if by else "") + "_beta array<double>")
        fitted = rows.join(F.broadcast(betas), list(by)) if by else rows.crossJoin(betas)  # one row per model
        e = F.col("_y") - sum((F.col(c) * F.col("_beta")[i] for i, c in list(enumerate(z))[1:]), F.col(z[0]) * F.col("_beta")[0])
        fitted = fitted.withColumn("_e", e)
        scores = fitted.groupBy(*by, "_region").agg(*[F.sum(F.col(c) * F.col("_e")).alias(f"_s{i}") for i, c in enumerate(z)])
        outer = scores.groupBy(*by).agg(F.array(*[F.sum(F.col(f"_s{i}") * F.col(f"_s{j}")) for i, j in pairs]).alias("ss")).collect()
        for r in outer:
            good[_name(by, r)]["cov"] = _clustered(good[_name(by, r)], _symmetric(pairs, r["ss"], width))
    return models


FE_SCHEMA = "term string, coef double, se double, t double, p double, ci_low double, ci_high double, n long, n_regions long, n_years long, resid_df long, inference_df long, note string"


def _row(key: tuple, m: dict, term: str, coef: float, var: float | None) -> tuple:
    base = (m["n"], m["regions"], m["years"], m.get("resid_df"), m["regions"] - 1)
    if var is None:
        return (*key, term, coef, None, None, None, None, None, *base, m["why"])
    se = math.sqrt(max(var, 0.0))
    df = m["regions"] - 1
    t = coef / se if se > 0 else None
    q = t_quantile(0.975, df)
    return (*key, term, coef, se, t, t_p_value(t, df) if t is not None else None, coef - q * se, coef + q * se, *base, m["why"])


def two_way_fe(df: DataFrame, y: str, x: str | Sequence[str], controls: Sequence[str] = (), region: str = "region", year: str = "year", by: Sequence[str] = ()) -> DataFrame:
    """Coefficients, clustered errors, t, p, 95 % intervals and counts per model; unusable models carry a note."""
    xs = [x] if isinstance(x, str) else list(x)
    models = fit_fe(df, y, [*xs, *controls], region, year, by)
    rows = []
    for key, m in models.items():
        for i, name in enumerate(xs):
            rows.append(_row(key, m, name, float(m["beta"][i]), float(m["cov"][i, i])) if m["why"] is None else _row(key, m, name, None, None))
    kinds = "".join(f"`{b}` {dict(df.dtypes)[b]}, " for b in by)
    return df.sparkSession.createDataFrame(rows, kinds + FE_SCHEMA)


def fe_grid(df: DataFrame, specs: Sequence[tuple[str, str, str]], flag: str | None = None, by: Sequence[str] = (), **kw) -> DataFrame:
    """Models of (name, outcome, predictor), each on the whole sample and without flagged rows."""
    parts = []
    for name, y, x in specs:
        rows = df.withColumn("variant", F.lit("all"))
        if flag:
            rows = rows.unionByName(df.where(~F.coalesce(F.col(flag), F.lit(False))).withColumn("variant", F.lit("unflagged")))
        rows = rows.where(F.col(y).isNotNull() & F.col(x).isNotNull())
        parts.append(two_way_fe(rows, y, x, by=["variant", *by], **kw).withColumn("model", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bh(df: DataFrame, family: Sequence[str], p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg ``q`` and ``reject`` within a family, equal p sharing theirs; null p are left out.

    Equal p are counted first.  The distinct ones are dealt by ranges of (family, p): a range counts upwards and takes
    the least raw value downwards, each in one pass, and goes on from what the ranges before and behind it hold (a row per
    family and range).  So neither a large family nor a frequent p meets in one task.
    """
    family = list(family)
    # Read twice: p that were added up anew might differ in their last digit.
    df = materialize(df, "p-values")
    sizes = df.where(F.col(p).isNotNull()).groupBy(*family, p).agg(F.count(F.lit(1)).alias("_n"))
    rows = ranged(sizes, *family, p)
    inside = Window.partitionBy("_range", *family)
    over = Window.partitionBy(*family)
    ahead = over.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("_range", *family).agg(F.sum("_n").alias("_t"))
    ends = ends.select("_range", *family, F.coalesce(F.sum("_t").over(ahead), F.lit(0)).alias("_before"), F.sum("_t").over(over).alias("_m"))
    place = F.col("_before") + F.sum("_n").over(inside.orderBy(p).rowsBetween(Window.unboundedPreceding, 0))
    raw = materialize(beside(rows, ends, ["_range", *family]).withColumn("_raw", F.col(p) * F.col("_m") / place), "bh")
    behind = over.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    least = raw.groupBy("_range", *family).agg(F.min("_raw").alias("_least"))
    least = least.select("_range", *family, F.min("_least").over(behind).alias("_later"))
    own = F.min("_raw").over(inside.orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0))
    q = beside(raw, least, ["_range", *family]).withColumn("q", F.least(own, "_later", F.lit(1.0))).select(*family, p, "q")
    cond = df[p] == q[p]
    for k in family:
        cond = cond & df[k].eqNullSafe(q[k])
    out = df.join(q, cond, "left").select(*[df[c] for c in df.columns], q["q"])
    return out.withColumn("reject", F.coalesce(F.col("q") <= alpha, F.lit(False)))


def subgroup_fe(df: DataFrame, y: str, x: str, keys: Sequence[str], family: Sequence[str], **kw) -> DataFrame:
    """Models per subgroup; two regions give the coefficient only; adjusted within the family."""
    models = two_way_fe(df, y, x, by=keys, **kw)
    two = F.col("n_regions") < 3
    models = models.withColumns({c: F.when(two, F.lit(None).cast("double")).otherwise(F.col(c)) for c in ("se", "t", "p", "ci_low", "ci_high")})
    models = models.withColumn("note", F.when(two & F.col("note").isNull(), "too few regions for inference").otherwise(F.col("note")))
    return bh(models, family)


def interaction_fe(df: DataFrame, y: str, x: str, cluster: str, levels: Sequence, region: str = "region", year: str = "year") -> tuple[DataFrame, DataFrame]:
    """(slope per cluster, pairwise differences) from one model with x times each cluster."""
    names = [f"_c{i}" for i in range(len(levels))]
    rows = df.withColumns({n: F.when(F.col(cluster) == v, F.col(x)).otherwise(F.lit(0.0)) for n, v in zip(names, levels, strict=True)})
    m = fit_fe(rows, y, names, region, year)[()]
    if m["why"]:
        raise CheckFailed(f"interactions cannot be fitted: {m['why']}")
    k = len(levels)

    def contrast(term: str, weights: np.ndarray) -> tuple:
        return _row((), m, term, float(weights @ m["beta"][:k]), float(weights @ m["cov"][:k, :k] @ weights))

    eye = np.eye(k)
    slopes = [contrast(str(v), eye[i]) for i, v in enumerate(levels)]
    diffs = [contrast(f"{levels[j]} - {levels[i]}", eye[j] - eye[i]) for i in range(k) for j in range(i + 1, k)]
    make = lambda r: df.sparkSession.createDataFrame(r, FE_SCHEMA)
    return make(slopes), make(diffs)


def region_slopes(df: DataFrame, y: str, x: str, region: str = "region", year: str = "year") -> DataFrame:
    """A slope per region with region and year effects; not identified ones are null with the reason.

    The slopes are eliminated region by region (Schur complement), so only the year system is solved.
    """
    rows, z, years = _prepared(df, y, [x], region, year, [])
    t = len(years)
    d = [f"_d{i}" for i in range(t)]
    parts = rows.groupBy("_region").agg(
        F.sum(F.col("_x0") * F.col("_x0")).alias("xx"), F.sum(F.col("_x0") * F.col("_y")).alias("xy"), F.array(*[F.sum(F.col("_x0") * F.col(c)) for c in d]).alias("xd"), F.count(F.lit(1)).alias("n")
    )
    year_side = rows.agg(F.array(*[F.sum(F.col(a) * F.col(b)) for a in d for b in d]).alias("dd"), F.array(*[F.sum(F.col(c) * F.col("_y")) for c in d]).alias("dy")).first()
    ok = parts.where("xx > 1e-12")
    reduced = ok.agg(F.array(*[F.sum(F.col("xd")[i] * F.col("xd")[j] / F.col("xx")) for i in range(t) for j in range(t)]).alias("c"), F.array(*[F.sum(F.col("xd")[i] * F.col("xy") / F.col("xx")) for i in range(t)]).alias("v")).first()
    a = np.array(year_side["dd"]).reshape(t, t)[1:, 1:] - np.array(reduced["c"]).reshape(t, t)[1:, 1:]
    b = np.array(year_side["dy"])[1:] - np.array(reduced["v"])[1:]
    identified = bool(len(a)) and np.linalg.matrix_rank(a, tol=1e-9 * max(1.0, np.abs(a).max())) == len(a)
    gamma = [0.0, *(np.linalg.solve(a, b).tolist() if identified else [0.0] * (t - 1))]
    fit = sum((F.col("xd")[i] * gamma[i] for i in range(1, t)), F.lit(0.0))
    slope = F.when(F.lit(identified) & (F.col("xx") > 1e-12), (F.col("xy") - fit) / F.nullif("xx", F.lit(0.0)))
    note = F.when(F.lit(not identified), "year effects are not identified").when(F.col("xx") <= 1e-12, "no variation in the region")
    return parts.select(F.col("_region").alias("region"), slope.alias("slope"), "n", note.alias("note"))


def leave_one_out(df: DataFrame, y: str, x: str, region: str = "region", year: str = "year") -> DataFrame:
    """The model without each region in turn, and on the full sample (``omitted`` null).

    Region means do not depend on other regions, so each region has its own Gram matrix: one aggregation sums
    them, a model leaves one out of the total, and its cluster scores come from the same matrices.  What
    reaches the driver is one small matrix per region.
    """
    rows, z, _ = _prepared(df, y, [x], region, year, [])
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    parts = rows.groupBy("_region").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("_year").alias("years"),
        F.array(*[F.sum(F.col(z[i]) * F.col(z[j])) for i, j in pairs]).alias("zz"), F.array(*[F.sum(F.col(c) * F.col("_y")) for c in z]).alias("zy"),
    ).collect()
    grams, zys = np.array([_symmetric(pairs, r["zz"], len(z)) for r in parts]), np.array([r["zy"] for r in parts])
    rows_of, years_of = np.array([r["n"] for r in parts]), [set(r["years"]) for r in parts]
    out = []
    for k in [None, *range(len(parts))]:
        stay = np.array([i for i in range(len(parts)) if i != k], dtype=int)
        counts = {"n": int(rows_of[stay].sum()), "g": len(stay), "t": len(set().union(*(years_of[i] for i in stay)))}
        m = _solved(counts, grams[stay].sum(axis=0), zys[stay].sum(axis=0), [x])
        name = None if k is None else parts[k]["_region"]
        if m["why"] is not None:
            out.append((name, *_row((), m, x, None, None)))
            continue
        beta = np.zeros(len(z))
        beta[m["use"]] = m["beta"]
        scores = zys[stay] - grams[stay] @ beta
        out.append((name, *_row((), m, x, float(m["beta"][0]), float(_clustered(m, scores.T @ scores)[0, 0]))))
    return df.sparkSession.createDataFrame(out, f"omitted {dict(df.dtypes)[region]}, " + FE_SCHEMA)


def compare_models(a: DataFrame, b: DataFrame, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Coefficients of two specifications side by side, with agreement of sign and of significance."""
    x, y = (d.select(*keys, F.col("coef").alias(f"coef_{n}"), F.col("p").alias(f"p_{n}")) for d, n in ((a, "a"), (b, "b")))
    out = x.join(y, list(keys), "full_outer")
    return out.withColumns({"same_sign": F.signum("coef_a") == F.signum("coef_b"), "same_significance": (F.col("p_a") < alpha) == (F.col("p_b") < alpha)})


def alignment_panel(index: DataFrame, outcome: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """(joined panel with yearly ranks, gaps and within-region z, correlation per region)."""
    out = index.select("region", "year", a).join(outcome.select("region", "year", b), ["region", "year"])
    out = rank_min(rank_min(out, ["year"], a, out="rank_a"), ["year"], b, out="rank_b").withColumn("rank_gap", F.col("rank_a") - F.col("rank_b"))
    out = zscore(zscore(out, a, ["region"], on_zero="zero"), b, ["region"], on_zero="zero")
    return out.drop("rank_a_score", "rank_b_score"), group_corr(out.select("region", "year", a, b), ["region"], a, b)


# ------------------------------------------------------------------ clusters


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index from pair counts."""
    c = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    two = lambda n: n * (n - 1) / 2
    cell = c.agg(F.sum(two(F.col("n"))).alias("cell"), F.sum("n").alias("total"))
    side = lambda k: c.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias(f"s_{k}"))
    out = cell.crossJoin(side(a)).crossJoin(side(b))
    expected = F.col(f"s_{a}") * F.col(f"s_{b}") / F.nullif(two(F.col("total")), F.lit(0.0))
    most = (F.col(f"s_{a}") + F.col(f"s_{b}")) / 2
    return out.select(F.coalesce((F.col("cell") - expected) / F.nullif(most - expected, F.lit(0.0)), F.lit(1.0)).alias("ari"))


def distance(cols_a: Sequence[str], cols_b: Sequence[str]) -> Column:
    parts = [(F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in zip(cols_a, cols_b, strict=True)]
    return F.sqrt(sum(parts[1:], parts[0]))
