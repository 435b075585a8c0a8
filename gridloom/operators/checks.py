"""Data-quality checks.  A check that fails raises with up to ten offending rows; none collects a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHOWN = 10


class CheckFailed(ValueError):
    """A data-quality contract is broken; ``rows`` holds the offending rows that are shown."""

    def __init__(self, message: str, rows: Sequence[dict] = ()):
        super().__init__(message)
        self.rows = list(rows)


def fail_if_any(bad: DataFrame, message: str) -> None:
    """Raise if there is a row, and show the first SHOWN in the order of their columns; they are sorted only then."""
    rows = bad.limit(SHOWN).collect()
    if rows:
        order = [c for c, kind in bad.dtypes if not kind.startswith(("map", "variant"))]
        shown = [r.asDict() for r in (bad.orderBy(*order).limit(SHOWN).collect() if order else rows)]
        raise CheckFailed(f"{message}: {shown}", shown)


def require_columns(df: DataFrame, cols: Sequence[str], label: str = "table") -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise CheckFailed(f"{label} lacks the columns {missing}")
    return df


def require_exact_schema(df: DataFrame, cols: Sequence[str], label: str = "table") -> DataFrame:
    if list(df.columns) != list(cols):
        raise CheckFailed(f"{label} has the columns {df.columns}, expected {list(cols)}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def assert_unique(df: DataFrame, keys: Sequence[str], label: str = "table") -> DataFrame:
    fail_if_any(duplicate_keys(df, keys), f"{label} repeats keys {list(keys)}")
    return df


def grid(spark, dims: Mapping[str, Sequence]) -> DataFrame:
    """Cross product of small dimension lists, unfolded from one row."""
    out = spark.range(0, 1, 1, 1).select(F.lit(True).alias("_grid"))
    for name, values in dims.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.drop("_grid")


def grid_gaps(df: DataFrame, dims: Mapping[str, Sequence]) -> DataFrame:
    """Keys of the grid that are missing, and keys that it does not expect."""
    keys = list(dims)
    want = grid(df.sparkSession, dims).select(*[F.col(k).cast(df.schema[k].dataType) for k in keys])
    have = df.select(*keys).distinct()
    missing = want.join(have, keys, "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(have.join(want, keys, "left_anti").withColumn("problem", F.lit("unexpected")))


def assert_grid(df: DataFrame, dims: Mapping[str, Sequence], label: str = "table") -> DataFrame:
    assert_unique(df, list(dims), label)
    fail_if_any(grid_gaps(df, dims), f"{label} is not the full grid")
    return df


def year_gaps(df: DataFrame, entity: Sequence[str], year: str) -> DataFrame:
    before = F.lag(year).over(Window.partitionBy(*entity).orderBy(year))
    return df.withColumn("previous_year", before).where(F.col(year) - F.col("previous_year") != 1)


def assert_contiguous(df: DataFrame, entity: Sequence[str], year: str) -> DataFrame:
    fail_if_any(year_gaps(df, entity, year).select(*entity, "previous_year", year), "years are not consecutive")
    return df


#: Named rules of assert_domain; a null breaks each of them.
RULES = {
    "finite": lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")),
    "non_negative": lambda c: RULES["finite"](c) & (c >= 0),
    "positive": lambda c: RULES["finite"](c) & (c > 0),
}


def _rule(name: str, rule) -> Column:
    c = F.col(name)
    if isinstance(rule, tuple):
        return RULES["finite"](c) & c.between(*rule)
    return RULES[rule](c)


def domain_violations(df: DataFrame, rules: Mapping[str, object]) -> DataFrame:
    """One row: the number of rows that break each rule."""
    return df.agg(*[F.count_if(~F.coalesce(_rule(c, r), F.lit(False))).alias(c) for c, r in rules.items()])


def assert_domain(df: DataFrame, rules: Mapping[str, object]) -> DataFrame:
    broken = {c: n for c, n in domain_violations(df, rules).first().asDict().items() if n}
    if broken:
        any_bad = reduce(lambda a, b: a | b, [~F.coalesce(_rule(c, rules[c]), F.lit(False)) for c in broken])
        fail_if_any(df.where(any_bad), f"values outside their domain {broken}")
    return df


def assert_single_valued(df: DataFrame, col: str) -> DataFrame:
    n = df.agg((F.count_distinct(col) + F.max(F.col(col).isNull().cast("int"))).alias("n")).first()["n"]
    if n != 1:
        raise CheckFailed(f"{col} holds {n} values, expected one")
    return df


def outside(df: DataFrame, col: str, lookup: DataFrame, lookup_col: str | None = None) -> DataFrame:
    """Distinct values that the lookup does not have."""
    known = lookup.select(F.col(lookup_col or col).alias(col)).distinct()
    return df.select(col).distinct().join(known, col, "left_anti")


def assert_in(df: DataFrame, col: str, lookup: DataFrame, lookup_col: str | None = None) -> DataFrame:
    fail_if_any(outside(df, col, lookup, lookup_col), f"{col} outside its taxonomy")
    return df


def assert_mapping(df: DataFrame, child: str, parent: str, lookup: DataFrame) -> DataFrame:
    pairs = df.select(child, parent).distinct()
    fail_if_any(pairs.join(lookup.select(child, parent).distinct(), [child, parent], "left_anti"), f"{child} does not belong to its {parent}")
    return df


def fd_violations(df: DataFrame, determinant: Sequence[str], dependent: str) -> DataFrame:
    kinds = F.count_distinct(dependent) + F.max(F.col(dependent).isNull().cast("int"))
    return df.groupBy(*determinant).agg(kinds.cast("long").alias("n_values")).where("n_values > 1")


def assert_fd(df: DataFrame, determinant: Sequence[str], dependent: str) -> DataFrame:
    fail_if_any(fd_violations(df, determinant, dependent), f"{dependent} is not constant per {list(determinant)}")
    return df


def group_set_violations(df: DataFrame, keys: Sequence[str], col: str, expected: Sequence) -> DataFrame:
    want = F.array_sort(F.array(*[F.lit(v).cast(df.schema[col].dataType) for v in expected]))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(col)).alias("found")).where(F.col("found") != want)


def assert_group_sets(df: DataFrame, keys: Sequence[str], col: str, expected: Sequence) -> DataFrame:
    fail_if_any(group_set_violations(df, keys, col, expected), f"groups without exactly the expected {col}")
    return df


class Checks:
    """Named checks, expected against actual, as a table of PASS, FAIL and INFO rows."""

    def __init__(self, spark) -> None:
        self.spark, self.rows = spark, []

    def add(self, section: str, name: str, expected, actual, note: str = "", info: bool = False) -> Checks:
        verdict = "INFO" if info else "PASS" if expected == actual else "FAIL"
        self.rows.append((section, name, str(expected), str(actual), verdict, note))
        return self

    def add_counts(self, section: str, df: DataFrame, conditions: Mapping[str, tuple[Column, int]]) -> Checks:
        """Rows meeting each condition against the expected number, all in one pass."""
        got = df.agg(*[F.count_if(c).alias(n) for n, (c, _) in conditions.items()]).first()
        for name, (_, want) in conditions.items():
            self.add(section, name, want, got[name])
        return self

    def to_df(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, "section string, check string, expected string, actual string, verdict string, note string")

    def fail_on_any(self) -> Checks:
        failed = [r[:4] for r in self.rows if r[4] == "FAIL"]
        if failed:
            raise CheckFailed(f"checks failed: {failed[:SHOWN]}")
        return self


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str = "value", tol: float = 1e-6) -> DataFrame:
    """Both totals per key, their difference (snapped to 0 within ``tol``) and a status."""
    a = left.groupBy(*keys).agg(F.sum(value).alias("left_total"), F.lit(True).alias("_l"))
    b = right.groupBy(*keys).agg(F.sum(value).alias("right_total"), F.lit(True).alias("_r"))
    both = a.join(b, list(keys), "full_outer")
    diff = F.col("left_total") - F.col("right_total")
    both = both.withColumn("diff", F.when(F.abs(diff) <= tol, F.lit(0.0)).otherwise(diff))
    status = F.when(F.col("_l").isNull(), "right only").when(F.col("_r").isNull(), "left only").when(F.col("diff") == 0, "equal").otherwise("different")
    return both.withColumn("status", status).drop("_l", "_r")


def assert_reconciled(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str = "value", tol: float = 1e-6) -> None:
    fail_if_any(reconcile(left, right, keys, value, tol).where("status <> 'equal'"), "totals differ")


def compare_keyed(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, tol: float = 1e-9, exceptions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(detail, summary) of two keyed tables; keys in ``exceptions`` are marked and do not count."""
    a = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    both = a.join(b, list(keys), "full_outer").withColumn("abs_diff", F.abs(F.col("left_value") - F.col("right_value")))
    same_null = F.col("left_value").isNull() & F.col("right_value").isNull()
    status = (
        F.when(F.col("_l").isNull(), "right only").when(F.col("_r").isNull(), "left only")
        .when(same_null | F.coalesce(F.col("abs_diff") <= tol, F.lit(False)), "equal").otherwise("mismatch")
    )
    detail = both.withColumn("status", status).drop("_l", "_r")
    if exceptions is not None:
        known = exceptions.select(*keys).distinct().withColumn("_known", F.lit(True))
        detail = detail.join(known, list(keys), "left").withColumn("status", F.when((F.col("status") != "equal") & F.col("_known"), "known exception").otherwise(F.col("status"))).drop("_known")
    n = lambda s: F.count_if(F.col("status") == s).alias(s.replace(" ", "_"))
    where = F.max_by(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), "abs_diff")
    summary = detail.agg(F.count(F.lit(1)).alias("n_keys"), n("equal"), n("mismatch"), n("left only"), n("right only"), n("known exception"), F.max("abs_diff").alias("max_abs_diff"), where.alias("max_at"))
    return detail, summary.withColumn("passed", (F.col("mismatch") + F.col("left_only") + F.col("right_only")) == 0)


def multiset_diff(a: DataFrame, b: DataFrame, cols: Sequence[str], factor: int = 1) -> DataFrame:
    """Rows whose count in ``b`` is not ``factor`` times that in ``a``; nulls equal each other."""
    x = a.groupBy(*cols).agg((F.count(F.lit(1)) * factor).alias("n_left"))
    y = b.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_right"))
    both = x.select(*cols, "n_left", F.lit(0).cast("long").alias("n_right")).unionByName(y.select(*cols, F.lit(0).cast("long").alias("n_left"), "n_right"))
    return both.groupBy(*cols).agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right")).where("n_left <> n_right")


def check_shares(df: DataFrame, keys: Sequence[str], share: str, tol: float = 1e-9) -> DataFrame:
    """Per key: the sum of the shares and whether all are finite, in [0, 1] and sum to 1."""
    s = F.col(share)
    bad = F.count_if(~F.coalesce(RULES["finite"](s) & s.between(-tol, 1 + tol), F.lit(False)))
    return df.groupBy(*keys).agg(F.sum(s).alias("total"), bad.alias("n_bad")).withColumn("passed", (F.col("n_bad") == 0) & (F.abs(F.col("total") - 1) <= tol))


def check_no_crossing(df: DataFrame, mean: str, centre: float, published: str, tol: float = 1e-3) -> DataFrame:
    """Is v = 1 - |m - c| / 2 safe to interpolate: no mean reaches the centre, and v equals the published value."""
    m = F.col(mean)
    v = 1 - F.abs(m - centre) / 2
    out = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(m >= centre).alias("n_above"), F.count_if(m < centre).alias("n_below"),
        F.max(F.abs(v - F.col(published))).alias("max_abs_diff"),
    )
    return out.withColumn("safe", ((F.col("n_above") == 0) | (F.col("n_below") == 0)) & (F.col("max_abs_diff") <= tol))


def verify_imputation(panel: DataFrame, main: DataFrame, alt: DataFrame, keys: Sequence[str], value: str, blocked: str, filled: str = "value_filled", strategy: str = "position") -> DataFrame:
    """Named counts that must all be 0."""
    both = panel.select(*keys, F.col(value).alias("_v"), F.col(blocked).alias("_b")).join(
        main.select(*keys, F.col(filled).alias("_m"), F.col(strategy).alias("_s")), list(keys)
    ).join(alt.select(*keys, F.col(filled).alias("_a")), list(keys))
    edge = F.col("_s").isin("leading", "trailing")
    named = {
        "observed changed": F.col("_v").isNotNull() & ~F.col("_b") & ~F.col("_v").eqNullSafe(F.col("_m")),
        "blocked filled": F.col("_b") & F.col("_m").isNotNull(),
        "edge empty in main": edge & F.col("_m").isNull(),
        "edge filled in alternative": edge & F.col("_a").isNotNull(),
    }
    counts = both.agg(*[F.count_if(c).alias(n) for n, c in named.items()])
    return counts.unpivot([], list(named), "check", "n_bad").withColumn("passed", F.col("n_bad") == 0)


def status_gate(df: DataFrame, col: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per key: rows, rows whose trimmed value is another one, and whether there are rows and none differs."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.trim(col) == value, F.lit(False))).alias("n_other"))
    return out.withColumn("passed", (F.col("n") > 0) & (F.col("n_other") == 0))


def assert_all_equal(df: DataFrame, col: str, value: str) -> DataFrame:
    """Gate: the table is not empty and every trimmed value equals ``value``."""
    got = status_gate(df, col, value).first()
    if not got["passed"]:
        raise CheckFailed(f"{col} must be {value!r} in all rows: {got['n_other']} of {got['n']} differ")
    return df
