"""Aggregations of items and panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import text as X
from gridloom.functions.staging import materialize
from gridloom.operators.checks import assert_group_sets, fail_if_any, grid
from gridloom.operators.joins import fill_keys, join_checked, join_null_safe
from gridloom.operators.quantiles import beside, exact_quantiles
from gridloom.operators.rows import collapse_consistent
from gridloom.operators.windows import minmax, rank_min, zscore


def complete_sum(col: Column | str) -> Column:
    """Sum that is null if any member is null (A5)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def budget_panel(detail: DataFrame, kind: str | None = "current") -> DataFrame:
    """Sum (null if all missing) and counts per region and year, of the rows of one budget kind."""
    rows = detail if kind is None else detail.where(F.col("budget_kind") == kind)
    flag = lambda c, other: F.count_if(F.col(c)) if c in detail.columns else F.count_if(other)
    a = F.col("amount")
    return rows.groupBy("region", "year").agg(
        F.sum(a).alias("budget"), F.count(F.lit(1)).alias("n_items"), F.count(a).alias("n_amounts"), F.count_if(a.isNull()).alias("n_missing"),
        flag("non_numeric", F.lit(False)).alias("n_non_numeric"), F.count_if(a < 0).alias("n_negative"),
    )


def qa_panel(qa: DataFrame, keys: Sequence[str] = ("region", "year")) -> DataFrame:
    n = lambda c, v: F.count_if(F.col(c) == v)
    return qa.groupBy(*keys).agg(
        n("result", "match").alias("n_match"), n("result", "mismatch").alias("n_mismatch"), n("result", "undetermined").alias("n_undetermined"),
        n("tolerance_result", "exceeded").alias("n_exceeded"), F.max("abs_rate").alias("max_abs_rate"),
    )


def subtotal_qa(df: DataFrame, budget: str, keys: Sequence[str] = ("region", "major_head", "medium_head"), tol: float = 0.0, rate_tol: float = 10.0, labels: Sequence[str] = (), label_col: str = "item_name", adjustment: str | None = None, reason: str | None = None, row_type: str = "row_type") -> DataFrame:
    """Leaf sums against stated subtotals per heading.

    A separately labelled subtotal row beats the heading row.  An adjustment needs a reason and is added to
    the stated value before comparing.  Repeated equal subtotals collapse; conflicting ones raise.
    """
    extra = [adjustment, reason] if adjustment else []

    def stated(rows: DataFrame, source: str) -> DataFrame:
        out = collapse_consistent(rows.select(*keys, budget, *extra), keys, [budget, *extra])
        return out.withColumn("subtotal_source", F.lit(source))

    sub = stated(df.where(F.col(row_type) == X.MEDIUM), "heading").withColumn("_p", F.lit(2))
    if labels:
        named = df.where(F.trim(label_col).isin(*labels) & F.col(budget).isNotNull())
        sub = sub.unionByName(stated(named, "label").withColumn("_p", F.lit(1)))
        sub = sub.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_p"))).where("_r = 1").drop("_r")
    sub = sub.drop("_p").withColumnRenamed(budget, "subtotal")
    leaf = df.where(F.col(row_type) == X.LEAF).groupBy(*keys).agg(F.sum(budget).alias("leaf_sum"))
    out = join_null_safe(sub, leaf, keys, "full_outer")
    state = F.when(F.col("join_state") == "left only", "subtotal only").when(F.col("join_state") == "right only", "leaf only").otherwise("both")
    out = out.withColumn("state", state).drop("join_state").withColumn("compared", F.col("subtotal"))
    if adjustment:
        out = out.withColumns({adjustment: F.coalesce(F.col(adjustment), F.lit(0.0)), reason: F.coalesce(F.col(reason), F.lit(""))})
        fail_if_any(out.where((F.col(adjustment) != 0) & (F.trim(reason) == "")), "adjustments need a reason")
        out = out.withColumn("compared", F.col("subtotal") + F.col(adjustment))
    out = out.withColumn("diff", F.col("leaf_sum") - F.col("compared")).withColumn("abs_diff", F.abs("diff"))
    out = out.withColumn("rate", F.bround(F.try_divide(F.col("diff"), F.nullif("compared", F.lit(0.0))) * 100, 2)).withColumn("abs_rate", F.abs("rate"))
    both = F.col("state") == "both"
    out = out.withColumn("tolerance_result", F.when(both & F.col("rate").isNotNull(), F.when(F.col("abs_rate") <= rate_tol, "allowed").otherwise("exceeded")).otherwise("undetermined"))
    decided = both & F.col("compared").isNotNull() & F.col("leaf_sum").isNotNull()
    out = out.withColumn("result", F.when(decided, F.when(F.col("abs_diff") <= tol, "match").otherwise("mismatch")).otherwise("undetermined"))
    return out.withColumn("undetermined_reason", X.undetermined_reason(F.col("state"), F.col("compared"), F.col("leaf_sum")))


def area_panels(labeled: DataFrame, dims: Mapping[str, Sequence], taxonomy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(area panel, subarea panel): both levels in one pass, gaps filled with zeros.

    ``dims`` holds the regions and years; ``taxonomy`` has ``area`` and ``subarea``.
    """
    cols = [F.col(c) for c in ("region", "year", "area", "subarea")]
    sets = [[*cols[:2], cols[2]], [*cols]]
    both = labeled.groupingSets(sets, *cols).agg(F.sum("amount").alias("budget"), F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("amount").isNull()).alias("n_missing"), F.grouping_id(*cols).alias("_g"))
    base = grid(labeled.sparkSession, dims).select(*[F.col(k).cast(labeled.schema[k].dataType) for k in dims])
    zero = ["budget", "n_items", "n_missing"]
    area = fill_keys(both.where("_g = 1").drop("_g", "subarea"), base.crossJoin(taxonomy.select("area").distinct()), zero)
    sub = fill_keys(both.where("_g = 0").drop("_g"), base.crossJoin(taxonomy.select("area", "subarea").distinct()), zero)
    return area, sub


def composition(df: DataFrame, year: str = "year", cat: str = "subarea", parent: str = "area", value: str = "budget") -> DataFrame:
    """Yearly totals per category with the share within the year in percent."""
    out = df.groupBy(year, parent, cat).agg(F.sum(value).alias("total"))
    return out.withColumn("share_pct", F.try_divide(F.col("total"), F.nullif(F.sum("total").over(Window.partitionBy(year)), F.lit(0.0))) * 100)


def label_source_summary(df: DataFrame, keys: Sequence[str] = ("region", "year"), amount: str = "amount") -> DataFrame:
    out = df.groupBy(*keys, "label_source").agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("amount"))
    w = Window.partitionBy(*keys)
    return out.withColumns({"share_n": F.col("n") / F.sum("n").over(w), "share_amount": F.try_divide(F.col("amount"), F.nullif(F.sum("amount").over(w), F.lit(0.0)))})


def consolidation_qa(df: DataFrame, part: str = "region", text: str = "body", area: str = "area", row: str = "src_row") -> DataFrame:
    norm = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    return df.groupBy(part).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(norm != F.coalesce(F.col(text), F.lit(""))).alias("n_normalised"), F.count_if(norm == "").alias("n_blank"),
        F.count_distinct(area).alias("n_areas"), (F.count(row) - F.count_distinct(row)).alias("n_duplicate_rows"),
    )


def weighted_rate(df: DataFrame, num: Column, den: Column, w: str, keys: Sequence[str]) -> DataFrame:
    """100 * weight of the numerator / weight of the denominator."""
    top, below = F.sum(F.when(num & den, F.col(w))), F.sum(F.when(den, F.col(w)))
    return df.groupBy(*keys).agg(F.try_divide(F.coalesce(top, F.lit(0.0)) * 100, F.nullif(below, F.lit(0.0))).alias("rate"))


def weighted_response_mean(df: DataFrame, scores: Mapping[str, float], out: str = "mean_score") -> DataFrame:
    """Sum of share * score / sum of shares, row by row; null if a share is missing."""
    shares = [F.col(c) for c in scores]
    top = sum((F.col(c) * s for c, s in list(scores.items())[1:]), F.col(next(iter(scores))) * next(iter(scores.values())))
    return df.withColumn(out, F.try_divide(top, F.nullif(sum(shares[1:], shares[0]), F.lit(0.0))))


def population(df: DataFrame, ages: Sequence[int], keys: Sequence[str] = ("region",), years: Sequence[str] = ()) -> DataFrame:
    """Sum of single-age rows per key and year, after checking that each key has every age once."""
    rows = df.where(F.col("age").isin(*ages))
    assert_group_sets(rows, keys, "age", ages)
    long = rows.unpivot([*keys, "age"], list(years), "year", "population")
    return long.groupBy(*keys, F.regexp_extract("year", r"(\d{4})", 1).cast("int").alias("year")).agg(complete_sum("population").alias("population"))


def ratio_table(num: DataFrame, den: DataFrame, keys: Sequence[str] = ("region", "year")) -> DataFrame:
    """numerator / denominator * 100 per key with a note where it is undefined."""
    out = join_checked(num, den, keys, "left", "1:1")
    rate = F.try_divide(F.col("numerator"), F.nullif("denominator", F.lit(0.0))) * 100
    note = F.when(~F.col("matched"), "no denominator").when(F.col("denominator") == 0, "zero denominator")
    return out.withColumn("rate", rate).withColumn("note", note).drop("matched")


def rake(before: DataFrame, after: DataFrame, totals: DataFrame, den: DataFrame, keys: Sequence[str] = ("region",), year: str = "year") -> DataFrame:
    """Mean of the counts before and after, scaled to the known total of the year, per denominator in percent."""
    mean = before.select(*keys, F.col("n").alias("_b")).join(after.select(*keys, F.col("n").alias("_a")), list(keys)).withColumn("raw", (F.col("_b") + F.col("_a")) / 2).drop("_a", "_b")
    out = mean.crossJoin(totals.select(year, "total")).withColumn("raked", F.col("raw") * F.col("total") / F.sum("raw").over(Window.partitionBy(year)))
    return out.join(den, [*keys, year], "left").withColumn("rate", F.try_divide(F.col("raked"), F.nullif("denominator", F.lit(0.0))) * 100)


def event_response(df: DataFrame, keys: Sequence[str], dims: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Of the declines (dx < 0), the share followed by dy > 0; again without flagged rows; ranked."""
    ev = df.where("dx < 0")
    clean = ~F.coalesce(F.col("flag"), F.lit(False))
    out = ev.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("dy") > 0).alias("n_response"), F.count_if(clean).alias("n_clean"), F.count_if(clean & (F.col("dy") > 0)).alias("n_clean_response")
    )
    if dims:
        want = grid(df.sparkSession, dims).select(*[F.col(k).cast(df.schema[k].dataType) for k in dims])
        out = fill_keys(out, want, ["n_events", "n_response", "n_clean", "n_clean_response"])
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.nullif(b, F.lit(0))) * 100
    out = out.withColumns({"response_rate": rate("n_response", "n_events"), "clean_rate": rate("n_clean_response", "n_clean")})
    return rank_min(out, [], "response_rate").drop("rank_score")


def cluster_trend(df: DataFrame, categories: int, cluster: str = "cluster", value: str = "value") -> DataFrame:
    """Sums per region and year where all categories are there, then means over regions per cluster and year."""
    whole = df.groupBy(cluster, "region", "year").agg(F.when((F.count_distinct("category") == categories), complete_sum(value)).alias("total"))
    return whole.groupBy(cluster, "year").agg(F.avg("total").alias("mean_total"), F.count("total").alias("n_regions"))


def distribution_summary(df: DataFrame, keys: Sequence[str], value: str = "value", outlier: str | None = None) -> DataFrame:
    """Quartiles per group with the numbers of missing values and outliers."""
    out = df.groupBy(*keys).agg(F.count_if(F.col(value).isNull()).alias("n_missing"), (F.count_if(F.col(outlier)) if outlier else F.lit(0).cast("long")).alias("n_outliers"))
    return beside(out, exact_quantiles(df, value, [0.25, 0.5, 0.75], keys), keys).withColumns({n: F.col("_q")[i] for i, n in enumerate(("q1", "median", "q3"))}).drop("_q")


def standard_median(summary: DataFrame, part: Sequence[str]) -> DataFrame:
    """The median series of each part in its own standard deviations, with the quartiles in these units."""
    w = Window.partitionBy(*part)
    m, s = F.avg("median").over(w), F.nullif(F.stddev_pop("median").over(w), F.lit(0.0))
    return summary.withColumns({f"{c}_std": (F.col(c) - m) / s for c in ("q1", "median", "q3")})


def share_change(shares: DataFrame, y0: int, y1: int, p0: tuple[int, int], p1: tuple[int, int], cat: str = "subarea", value: str = "budget", keys: Sequence[str] = ()) -> DataFrame:
    """Shares in the first and last year and pooled over two periods, their changes in points, and ranks."""
    part = lambda c: F.sum(F.when(c, F.col(value)))
    y = F.col("year")
    aggs = {"start": y == y0, "end": y == y1, "early": y.between(*p0), "late": y.between(*p1)}
    flag = [F.bool_or(F.coalesce(F.col("flag"), F.lit(False))).alias("any_flag")] if "flag" in shares.columns else []
    out = shares.groupBy(*keys, cat).agg(*[part(c).alias(f"_{n}") for n, c in aggs.items()], *flag)
    w = Window.partitionBy(*keys)
    out = out.withColumns({f"share_{n}": F.try_divide(F.col(f"_{n}"), F.nullif(F.sum(f"_{n}").over(w), F.lit(0.0))) * 100 for n in aggs}).drop(*[f"_{n}" for n in aggs])
    out = out.withColumns({"change_year": F.col("share_end") - F.col("share_start"), "change_period": F.col("share_late") - F.col("share_early")})
    out = out.withColumn("_abs", F.abs("change_period"))
    return rank_min(out, keys, "_abs").drop("_abs", "rank_score")


def indicator_region_summary(long: DataFrame, directions: DataFrame, outlier: str | None = None) -> DataFrame:
    """Per indicator and region: values in the first and last year of the widest coverage, change, verdict, rank, counts."""
    cover = long.groupBy("indicator_id", "year").agg(F.count("value").alias("n"))
    best = cover.withColumn("_m", F.max("n").over(Window.partitionBy("indicator_id"))).where("n = _m and n > 0")
    years = best.groupBy("indicator_id").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    j = long.join(years, "indicator_id")
    at = lambda c: F.max(F.when(F.col("year") == F.col(c), F.col("value")))
    span = F.col("year").between(F.col("first_year"), F.col("last_year"))
    flagged = F.when(F.col(outlier), F.col("year")) if outlier else F.lit(None).cast("int")
    out = j.groupBy("indicator_id", "region").agg(
        F.first("first_year").alias("first_year"), F.first("last_year").alias("last_year"), at("first_year").alias("first_value"), at("last_year").alias("last_value"),
        F.count("value").alias("n_observed"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.count_if(span & F.col("value").isNull()).alias("n_missing_in_span"),
        F.array_join(F.array_sort(F.collect_list(flagged)).cast("array<string>"), ", ").alias("outlier_years"),
    ).join(directions, "indicator_id", "left")
    out = out.withColumn("change", F.col("last_value") - F.col("first_value")).withColumn("verdict", X.direction_result(F.col("last_value"), F.col("first_value"), F.col("direction")))
    return rank_min(out, ["indicator_id"], "change").drop("rank_score")


def composite_score(df: DataFrame, value: str = "budget") -> DataFrame:
    """Category sums per region and year, their log, pooled z, 0-100 score and yearly rank."""
    out = df.groupBy("region", "year").agg(F.sum(value).alias("total")).withColumn("log_total", F.log1p("total"))
    out = materialize(out, "composite-panel")  # read by the statistics, computed once
    return rank_min(minmax(zscore(out, "log_total"), "log_total_z", out="score"), ["year"], "score").drop("rank_score")


def panel_summary(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Named aggregates as rows, in one pass."""
    one = df.agg(*[c.cast("string").alias(n) for n, c in checks.items()])
    return one.unpivot([], list(checks), "check", "value")


def ranking_overlap(a: DataFrame, b: DataFrame, group: str, term: str = "term", place: str = "place") -> DataFrame:
    """Per group: common terms, their share of the longer ranking and the Spearman correlation of their ranks."""
    x, y = a.select(group, term, F.col(place).alias("pa")), b.select(group, term, F.col(place).alias("pb"))
    both = x.join(y, [group, term]).withColumns({"ra": F.rank().over(Window.partitionBy(group).orderBy("pa")).cast("double"), "rb": F.rank().over(Window.partitionBy(group).orderBy("pb")).cast("double")})
    sizes = x.groupBy(group).agg(F.count(F.lit(1)).alias("na")).join(y.groupBy(group).agg(F.count(F.lit(1)).alias("nb")), group, "full_outer")
    out = sizes.join(both.groupBy(group).agg(F.count(F.lit(1)).alias("n_common"), F.corr("ra", "rb").alias("spearman")), group, "left")
    out = out.withColumn("n_common", F.coalesce("n_common", F.lit(0).cast("long")))
    return out.withColumn("overlap", F.col("n_common") / F.greatest(F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0)))).drop("na", "nb")


def prediction_qa(df: DataFrame, keys: Sequence[str] = ("year", "region"), label: str = "label", confidence: str = "confidence", low: float = 0.5) -> DataFrame:
    n_low = F.count_if(F.col(confidence) < low)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(label).alias("n_labels"), F.avg(confidence).alias("mean_confidence"), n_low.alias("n_low"), (n_low / F.count(F.lit(1))).alias("share_low")
    )
