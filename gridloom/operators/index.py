"""Composite indices: deflation, standardisation, weighting, scenarios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.checks import CheckFailed, assert_domain, assert_single_valued, assert_unique, fail_if_any, grid_gaps, require_columns
from gridloom.operators.windows import rank_min

DIRECTIONS = ("positive", "negative", "center_or_positive")
SCHEMA = ("region", "year", "indicator_id", "category", "subcategory", "direction", "value")


def direction_of(column: str = "direction") -> Column:
    """The direction in small letters; ``+`` and ``-`` stand for positive and negative."""
    text = F.lower(F.trim(column))
    return F.when(text == "+", "positive").when(text == "-", "negative").otherwise(text)


@dataclass
class IndexTables:
    """The four levels of an index, all lazy."""

    indicators: DataFrame
    subcategories: DataFrame
    categories: DataFrame
    final: DataFrame


def prepare_index_input(df: DataFrame, mapping: Mapping[str, str], keep: Sequence[str] = ("is_observed", "is_imputed", "strategy", "position")) -> DataFrame:
    """Any panel in the index schema; provenance columns stay when they are there."""
    out = df.withColumnsRenamed({old: new for new, old in mapping.items()})
    require_columns(out, SCHEMA, "index input")
    return out.select(*SCHEMA, *[c for c in keep if c in out.columns])


def validate_index_input(
    df: DataFrame, centred: Sequence[str] = (), regions: Sequence[str] | None = None, years: Sequence[int] | None = None, indicators: Sequence[str] | None = None, strict_grid: bool = True, national: str = "national", need_national: bool = False
) -> DataFrame:
    """Input rows of an index, or an error.

    Keys are there and unique; values are finite; one direction of DIRECTIONS per indicator, and
    ``center_or_positive`` for the indicators of ``centred`` only.  The expected indicators are all there and
    no others; with ``regions`` and ``years`` every cell of the grid is there (``strict_grid``), and no other
    region or year; with ``need_national`` there are national rows.
    """
    require_columns(df, ("region", "year", "indicator_id", "direction", "value"), "index input")
    direction = direction_of()
    bad = {
        "null keys": F.col("region").isNull() | F.col("year").isNull() | F.col("indicator_id").isNull(),
        "values not finite": ~F.coalesce(F.abs(F.col("value")) < float("inf"), F.lit(False)) | F.isnan("value"),
        "unknown directions": ~F.coalesce(direction.isin(*DIRECTIONS), F.lit(False)),
        "centred directions": (direction == "center_or_positive") & ~F.col("indicator_id").isin(*centred),
    }
    found = df.agg(*[F.count_if(c).alias(n) for n, c in bad.items()], F.count_if(F.col("region") == national).alias("national")).first()
    for name, test in bad.items():
        if found[name]:
            fail_if_any(df.where(test).select("region", "year", "indicator_id", "direction", "value"), name)
    if need_national and not found["national"]:
        raise CheckFailed(f"no rows of {national}")
    assert_unique(df, ["region", "year", "indicator_id"], "index input")
    fail_if_any(df.groupBy("indicator_id").agg(F.count_distinct(direction).alias("n")).where("n <> 1"), "several directions per indicator")
    rows = df.where(F.col("region") != national)
    if indicators is not None:
        have = {r[0] for r in df.select("indicator_id").distinct().collect()}  # one row per indicator
        if have != set(indicators):
            raise CheckFailed(f"indicators missing: {sorted(set(indicators) - have)}, not expected: {sorted(have - set(indicators))}")
    if regions is not None and years is not None:
        ids = sorted(r[0] for r in df.select("indicator_id").distinct().collect())
        gaps = grid_gaps(rows, {"region": list(regions), "year": list(years), "indicator_id": ids})
        fail_if_any(gaps if strict_grid else gaps.where("problem = 'unexpected'"), "cells off the grid")
    return df


def validate_cpi(cpi: DataFrame) -> DataFrame:
    """Unique years, positive values and one base year."""
    assert_unique(cpi, ["year"], "cpi")
    assert_domain(cpi, {"cpi": "positive"})
    if "base" in cpi.columns:
        assert_single_valued(cpi, "base")
    return cpi


def deflate(df: DataFrame, cpi: DataFrame, ids: Sequence[str], base: float = 100.0) -> DataFrame:
    """value * base / CPI for money indicators; keeps ``nominal_value`` and ``price_basis``."""
    money = F.col("indicator_id").isin(*ids)
    fail_if_any(df.where(money).select("year").distinct().join(cpi, "year", "left_anti"), "years without a CPI")
    out = df.join(cpi.select("year", F.col("cpi").alias("cpi_index")), "year", "left").withColumn("nominal_value", F.when(money, F.col("value")))
    out = out.withColumn("value", F.when(money, F.col("value") * base / F.col("cpi_index")).otherwise(F.col("value")))
    return out.withColumn("price_basis", F.when(money, "real").otherwise("not money"))


def deflate_budget(df: DataFrame, cpi: DataFrame, budget: str, base_year: int, year: str = "year") -> DataFrame:
    """``real`` = nominal * CPI(base year) / CPI(year); the base is one row."""
    base = cpi.where(F.col("year") == base_year).select(F.col("cpi").alias("_base"))
    if base.isEmpty():
        raise CheckFailed(f"no CPI for {base_year}")
    out = df.join(cpi.select(F.col("year").alias(year), "cpi"), year, "left").crossJoin(base)
    return out.withColumn("real", F.col(budget) * F.col("_base") / F.col("cpi")).drop("_base")


def rebase_cpi(cpi: DataFrame, year: int, digits: int = 6) -> DataFrame:
    base = cpi.where(F.col("year") == year).select(F.col("cpi").alias("_base"))
    if base.isEmpty():
        raise CheckFailed(f"no CPI for {year}")
    return cpi.crossJoin(base).withColumn("cpi", F.bround(F.col("cpi") / F.col("_base") * 100, digits)).withColumn("base", F.lit(f"{year}=100")).drop("_base")


def standardize(df: DataFrame, method: str = "pooled", national: str = "national", check: bool = True, centred: Sequence[str] = ()) -> DataFrame:
    """Per indicator (pooled) or indicator and year (yearly): z, min-max score, clipped, flipped when negative.

    A pooled indicator without range raises; a yearly group without range scores 50.  National rows stay out.
    Missing and infinite values, repeated keys and unknown directions raise; unchecked, a missing value has no
    score.
    """
    keys = {"pooled": ["indicator_id"], "yearly": ["indicator_id", "year"]}[method]
    rows = df.where(~F.col("region").eqNullSafe(national))
    if check:
        validate_index_input(rows, centred, national=national)
    w = Window.partitionBy(*keys)
    out = rows.withColumns({"group_mean": F.avg("value").over(w), "group_std": F.stddev_pop("value").over(w)})
    out = out.withColumn("zero_variance", F.coalesce(F.col("group_std") == 0, F.lit(True)))
    if method == "pooled" and check:
        fail_if_any(out.where("zero_variance").select("indicator_id").distinct(), "indicators without variance")
    out = out.withColumn("z_score", F.when(F.col("zero_variance"), F.lit(0.0)).otherwise((F.col("value") - F.col("group_mean")) / F.nullif("group_std", F.lit(0.0))))
    out = out.withColumns({"group_min_z": F.min("z_score").over(w), "group_max_z": F.max("z_score").over(w)})
    score = (F.col("z_score") - F.col("group_min_z")) / F.nullif(F.col("group_max_z") - F.col("group_min_z"), F.lit(0.0)) * 100
    # least() and greatest() skip nulls, so a missing value is left out first.
    clipped = F.when(score.isNotNull(), F.greatest(F.least(score, F.lit(100.0)), F.lit(0.0)))
    score = F.when(F.col("value").isNotNull(), F.when(F.col("zero_variance"), F.lit(50.0)).otherwise(clipped))
    out = out.withColumn("score_0_100", score).withColumn("method", F.lit(method))
    return out.withColumn("directional_score", F.when(direction_of() == "negative", 100 - F.col("score_0_100")).otherwise(F.col("score_0_100")))


def validate_weights(weights: DataFrame, tol: float = 1e-9) -> DataFrame:
    assert_unique(weights, ["indicator_id"], "weights")
    assert_domain(weights, {"weight": "non_negative"})
    total = weights.agg(F.sum("weight").alias("t")).first()["t"]
    if total is None or abs(total - 1) > tol:
        raise CheckFailed(f"the weights sum to {total}")
    return weights


def compute_index(scores: DataFrame, weights: DataFrame, score: str = "directional_score", check: bool = True) -> IndexTables:
    """Contribution = score * weight; level score = sum of contributions / sum of weights; final = their sum.

    Every region and year must hold exactly the weighted indicators.  The three levels come from one
    ``GROUPING SETS`` aggregation.
    """
    if check:
        validate_weights(weights)
        n = weights.count()
        have = scores.join(weights.select("indicator_id"), "indicator_id").groupBy("region", "year").agg(F.count_distinct("indicator_id").alias("k"))
        fail_if_any(have.where(F.col("k") != n), "incomplete indicator sets")
    parts = scores.join(weights.select("indicator_id", "weight"), "indicator_id").withColumn("contribution", F.col(score) * F.col("weight"))
    sets = [["region", "year"], ["region", "year", "category"], ["region", "year", "category", "subcategory"]]
    cols = [F.col(c) for c in ("region", "year", "category", "subcategory")]
    levels = parts.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(
        F.sum("contribution").alias("contribution"), F.sum("weight").alias("weight"), F.grouping_id(*cols).alias("level")
    ).withColumn("score", F.col("contribution") / F.nullif("weight", F.lit(0.0)))
    final = rank_min(levels.where("level = 3").select("region", "year", F.col("contribution").alias("index_score")), ["year"], "index_score").drop("rank_score")
    cat = levels.where("level = 1").select("region", "year", "category", "score", "contribution", "weight")
    sub = levels.where("level = 0").select("region", "year", "category", "subcategory", "score", "contribution", "weight")
    return IndexTables(parts, sub, cat, final)


def index_scenarios(df: DataFrame, weights: DataFrame) -> dict[str, IndexTables]:
    return {m: compute_index(standardize(df, m), weights) for m in ("pooled", "yearly")}


def compare_scenarios(a: DataFrame, b: DataFrame) -> DataFrame:
    """Index and rank of two scenarios and their differences."""
    x, y = (t.select("region", "year", F.col("index_score").alias(f"index_{n}"), F.col("rank").alias(f"rank_{n}")) for t, n in ((a, "a"), (b, "b")))
    return x.join(y, ["region", "year"]).withColumns({"index_diff": F.col("index_b") - F.col("index_a"), "rank_diff": F.col("rank_b") - F.col("rank_a")})


def transfer_weight(df: DataFrame, weights: DataFrame, from_id: str, to_id: str, years: Sequence[int]) -> IndexTables:
    """In the given years one indicator's score stands in for another's, at the same weight.

    ``from_id`` is standardised over its other years only; the rows that stand in are flagged ``transferred``.
    """
    moved = F.col("year").isin(*years)
    valid = df.where(~((F.col("indicator_id") == from_id) & moved))
    scores = standardize(valid, "pooled").withColumn("transferred", F.lit(False))
    missing = df.where((F.col("indicator_id") == from_id) & moved).select("region", "year", "indicator_id", "category", "subcategory", "direction")
    donor = scores.where((F.col("indicator_id") == to_id) & moved).select("region", "year", "directional_score")
    stand_in = missing.join(donor, ["region", "year"]).withColumn("transferred", F.lit(True))
    return compute_index(scores.unionByName(stand_in, allowMissingColumns=True), weights)


def scenario_agreement(cmp: DataFrame) -> DataFrame:
    """Per year: Pearson, mean absolute score difference, mean and largest rank gap."""
    return cmp.groupBy("year").agg(
        F.corr("index_a", "index_b").alias("pearson"), F.avg(F.abs("index_diff")).alias("mae"), F.avg(F.abs("rank_diff")).alias("mean_rank_gap"), F.max(F.abs("rank_diff")).alias("max_rank_gap")
    )


def verify_index(bundle: IndexTables, national: str = "national") -> DataFrame:
    """Repeated keys, national rows and scores that are not finite, per table."""
    out = None
    for name, df, keys, score in (
        ("final", bundle.final, ["region", "year"], "index_score"), ("category", bundle.categories, ["region", "year", "category"], "score"),
        ("subcategory", bundle.subcategories, ["region", "year", "category", "subcategory"], "score"), ("indicator", bundle.indicators, ["region", "year", "indicator_id"], "contribution"),
    ):
        s = F.col(score)
        row = df.agg(
            F.lit(name).alias("artifact"), F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) - F.count_distinct(F.struct(*keys))).alias("n_repeated"),
            F.count_if(F.col("region") == national).alias("n_national"), F.count_if(~F.coalesce(F.abs(s) < float("inf"), F.lit(False)) | F.isnan(s)).alias("n_not_finite"),
        )
        out = row if out is None else out.unionByName(row)
    return out.withColumn("passed", (F.col("n_repeated") == 0) & (F.col("n_national") == 0) & (F.col("n_not_finite") == 0))
