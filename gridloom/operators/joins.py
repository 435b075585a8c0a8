"""Joins with contracts, guarded updates, and matching joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import text as X
from gridloom.functions.staging import materialize
from gridloom.operators.checks import CheckFailed, assert_contiguous, assert_unique, fail_if_any, grid, null_safe_on
from gridloom.operators.ranges import carry_forward


def join_checked(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", cardinality: str = "m:1", on_unmatched: str = "keep") -> DataFrame:
    """Equi-join with a cardinality contract (1:1 or m:1) and the column ``matched``.

    ``on_unmatched="fail"`` raises when a left row finds no partner.
    """
    assert_unique(right, on, "right side")
    if cardinality == "1:1":
        assert_unique(left, on, "left side")
    if on_unmatched == "fail":
        fail_if_any(left.select(*on).distinct().join(right, list(on), "left_anti"), "rows without a partner")
    out = left.join(right.withColumn("_hit", F.lit(True)), list(on), how)
    return out.withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit")


def lookup_join(df: DataFrame, dim: DataFrame, on: Sequence[str], value: str, unmapped: str = "fail") -> DataFrame:
    """m:1 dimension lookup; unmapped keys raise or stay null.  Spark broadcasts small dimensions itself."""
    assert_unique(dim, on, "dimension")
    if unmapped == "fail":
        fail_if_any(df.select(*on).distinct().join(dim, list(on), "left_anti"), "unmapped keys")
    return df.join(dim.select(*on, value), list(on), "left")


def attach_labels(detail: DataFrame, labels: DataFrame, keys: Sequence[str] = ("region", "year", "src_row")) -> DataFrame:
    """Labels joined 1:1; a row without a label raises."""
    return join_checked(detail, labels, keys, "inner", "1:1", "fail").drop("matched")


def build_sample(fiscal: DataFrame, outcome: DataFrame, s_lag: DataFrame, f_lag: DataFrame, unit: Sequence[str] = ("region", "subarea"), year: str = "year") -> DataFrame:
    """fiscal with outcome (m:1 by region and year), lagged structure and lagged fiscal (1:1 by unit and year)."""
    out = join_checked(fiscal, outcome, ["region", year], "left", "m:1").drop("matched")
    out = join_checked(out, s_lag, [*unit, year], "left", "1:1").drop("matched")
    return join_checked(out, f_lag, [*unit, year], "left", "1:1").drop("matched")


def offset_join(left: DataFrame, right: DataFrame, on: Sequence[str], year: str = "year", k: int = 1) -> DataFrame:
    """Left at t with right at t + k, as an equi-join."""
    moved = right.withColumn(year, F.col(year) - k)
    return left.join(moved, [*on, year], "inner").withColumn("target_year", F.col(year) + k)


def consecutive_change(df: DataFrame, part: Sequence[str], year: str, value: str, out: str) -> DataFrame:
    """Change from t to t + 1, only where the next year is there; carries flag of both ends if present."""
    w = Window.partitionBy(*part).orderBy(year)
    nxt = F.when(F.lead(year).over(w) == F.col(year) + 1, F.lead(value).over(w))
    res = df.withColumn(out, nxt - F.col(value))
    return res


def change_offset_join(x: DataFrame, y: DataFrame, part: Sequence[str], year: str = "year", value_x: str = "x", value_y: str = "y", k: int = 2) -> DataFrame:
    """Change of x over t..t+1 with that of y over t+k..t+k+1; the flags of all four cells are or-ed."""

    def change(df: DataFrame, value: str, out: str, flag: str, shift: int) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(year)
        has = "flag" in df.columns
        own = F.col("flag") if has else F.lit(False)
        res = consecutive_change(df, part, year, value, out).withColumn(flag, own | F.coalesce(F.lead(own).over(w), F.lit(False)))
        return res.where(F.col(out).isNotNull()).select(*part, (F.col(year) - shift).alias("base_year"), out, flag)

    out = change(x, value_x, "dx", "_fx", 0).join(change(y, value_y, "dy", "_fy", k), [*part, "base_year"])
    return out.withColumn("flag", F.col("_fx") | F.col("_fy")).drop("_fx", "_fy")


def fill_grid(df: DataFrame, dims: Mapping[str, Sequence], zero_cols: Sequence[str]) -> DataFrame:
    """Missing combinations become rows of zeros; keys outside the grid raise first."""
    keys = list(dims)
    want = grid(df.sparkSession, dims).select(*[F.col(k).cast(df.schema[k].dataType) for k in keys])
    fail_if_any(df.select(*keys).distinct().join(want, keys, "left_anti"), "keys outside the grid")
    return fill_keys(df, want, zero_cols)


def fill_keys(df: DataFrame, want: DataFrame, zero_cols: Sequence[str]) -> DataFrame:
    out = want.join(df, want.columns, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in zero_cols})


def expand_rules(rules: DataFrame, regions: DataFrame) -> DataFrame:
    """Rules with array columns to (indicator_id, region, year) cells; a null ``regions`` means all."""
    flat = rules.withColumn("indicator_id", F.explode("indicator_ids")).withColumn("year", F.explode("years"))
    some = flat.where("regions is not null").withColumn("region", F.explode("regions"))
    every = flat.where("regions is null").crossJoin(regions.select("region").distinct())
    return some.unionByName(every).drop("indicator_ids", "regions", "years")


def apply_policy(panel: DataFrame, rules: DataFrame, keys: Sequence[str] = ("indicator_id", "region", "year"), value: str = "value") -> DataFrame:
    """Every missing cell with its one rule; none, several, or a rule on an observed cell raise."""
    cells = expand_rules(rules, panel.select("region"))
    assert_unique(cells, keys, "rules per cell")
    observed = panel.where(F.col(value).isNotNull())
    missing = panel.where(F.col(value).isNull()).select(*keys)
    fail_if_any(cells.join(observed, list(keys), "left_semi").select(*keys), "rules on observed cells")
    fail_if_any(missing.join(cells, list(keys), "left_anti"), "missing cells without a rule")
    return missing.join(cells, list(keys))


def attach_policy(panel: DataFrame, policy: DataFrame, keys: Sequence[str] = ("indicator_id", "region", "year"), value: str = "value", flag: str = "block") -> DataFrame:
    """The block flag on the panel: false where observed; a missing cell without policy raises."""
    out = join_checked(panel, policy.select(*keys, flag), keys, "left", "1:1")
    fail_if_any(out.where(F.col(value).isNull() & ~F.col("matched")).select(*keys), "missing cells without policy")
    return out.withColumn(flag, F.when(F.col(value).isNull(), F.col(flag)).otherwise(F.lit(False))).drop("matched")


def guarded_update(panel: DataFrame, updates: DataFrame, keys: Sequence[str], value: str = "value", tol: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """(updated panel, audit of before and after).

    ``updates`` holds the keys, ``new_value`` and optionally ``kind`` and ``before``.  A target must be null,
    equal within ``tol``, or be a correction (kind "correct") whose ``before`` is the present value.
    """
    upd = updates
    for name, kind in (("kind", "string"), ("before", "double")):
        if name not in upd.columns:
            upd = upd.withColumn(name, F.lit(None).cast(kind))
    assert_unique(upd, keys, "updates")
    hits = upd.select(*keys, "new_value", "kind", "before").join(panel.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("_hit")), list(keys), "left")
    fail_if_any(hits.where("_hit is null"), "updates without a row")
    assert_unique(panel.join(upd, list(keys), "left_semi"), keys, "updated rows")
    old, new = F.col("old_value"), F.col("new_value")
    right = old.isNull() | (F.abs(old - new) <= tol) | ((F.col("kind") == "correct") & (F.abs(old - F.col("before")) <= tol))
    fail_if_any(hits.where(~F.coalesce(right, F.lit(False))), "guard broken")
    out = panel.join(upd.select(*keys, "new_value"), list(keys), "left").withColumn(value, F.coalesce("new_value", value)).drop("new_value")
    return out.select(*panel.columns), hits.select(*keys, "old_value", "new_value", "kind")


def guarded_delete(df: DataFrame, keys_df: DataFrame, keys: Sequence[str], expected: int, state: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, removed); the number removed and the state of the removed rows must be as expected."""
    removed = df.join(keys_df.select(*keys).distinct(), list(keys), "left_semi")
    bad = F.count_if(~F.coalesce(state, F.lit(False))) if state is not None else F.lit(0)
    got = removed.agg(F.count(F.lit(1)).alias("n"), bad.alias("bad")).first()
    if got["n"] != expected or got["bad"]:
        raise CheckFailed(f"{got['n']} rows to remove, expected {expected}; {got['bad']} in another state")
    return df.join(keys_df.select(*keys).distinct(), list(keys), "left_anti"), removed


def apply_corrections(tables: Mapping[str, tuple[DataFrame, int]], rules: DataFrame, keys: Sequence[str], text: str) -> dict[str, DataFrame]:
    """Keyed corrections (``before``, ``after``) on several tables that hold each key so many times.

    All checks run before any table is returned.  A value that is already ``after`` is left, so a second run
    changes nothing.
    """
    assert_unique(rules, keys, "corrections")
    for name, (df, times) in tables.items():
        hits = rules.join(df.select(*keys, F.col(text).alias("_now")), list(keys), "left")
        counted = hits.groupBy(*keys).agg(F.count("_now").alias("n"), F.count_if(~F.coalesce((F.col("_now") == F.col("before")) | (F.col("_now") == F.col("after")), F.lit(False))).alias("bad"))
        fail_if_any(counted.where((F.col("n") != times) | (F.col("bad") > 0)), f"corrections do not fit {name}")
    fix = rules.select(*keys, F.col("after").alias("_after"))
    return {name: df.join(fix, list(keys), "left").withColumn(text, F.coalesce("_after", text)).drop("_after").select(*df.columns) for name, (df, _) in tables.items()}


def anchored_match(left: DataFrame, right: DataFrame, value: str, order: str = "src_row", part: str = "region") -> DataFrame:
    """Match rows of equal value; ambiguous ones must lie between the nearest unique matches of the part.

    Returns (part, left order, right order, how) for rows matched once.  Bounds, and the first right row of the value behind the
    lower one, are carried along ranges of the order, so no pair of equal rows is made: a left row is matched
    if that right row lies in front of the upper bound and the next one of the value does not.
    """
    def once(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(part, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias(name)).where("_n = 1").drop("_n")

    far = 2**62
    a = left.select(part, value, F.col(order).alias("l_row"))
    b = right.select(part, value, F.col(order).cast("long").alias("c_row"))
    unique = materialize(once(left, "l_row").join(once(right, "r_row"), [part, value]).select(part, "l_row", "r_row"), "unique-matches")
    named = a.join(unique, [part, "l_row"], "left").withColumns({"_lo": F.col("r_row").cast("long"), "_hi": F.col("r_row").cast("long"), "_back": -F.col("l_row")})
    # An open row has no bound of its own, so the last one up to it is the last one in front of it.
    bound = carry_forward(carry_forward(named, [part], "l_row", ["_lo"]), [part], "_back", ["_hi"])
    open_rows = bound.where("r_row is null").select(part, value, "l_row", F.coalesce("_lo", F.lit(-far)).alias("_lo"), F.coalesce("_hi", F.lit(far)).alias("_hi"))
    after = F.lead("c_row").over(Window.partitionBy(part, value).orderBy("c_row"))
    at = lambda row, side, following: F.struct((-row).alias("at"), F.lit(side).alias("side"), (-following).alias("next")).alias("_at")
    held = b.select(part, value, "c_row", after.alias("c_next"))
    held = held.select(part, value, at(F.col("c_row"), 1, F.coalesce("c_next", F.lit(far))), F.struct("c_row", "c_next").alias("_c"))
    # Downwards, a row that asks comes in front of the right rows of its own place: these are not behind the bound.
    # Of right rows in one place the one that another of them follows comes last.
    asks = open_rows.withColumn("_at", at(F.col("_lo"), 0, F.lit(0).cast("long")))
    met = carry_forward(asks.unionByName(held, allowMissingColumns=True), [part, value], "_at", ["_c"]).where("l_row is not null")
    found = met.where(f"`{part}` is not null and `{value}` is not null and _c.c_row < _hi and (_c.c_next is null or _c.c_next >= _hi)")
    kind = dict(unique.dtypes)["r_row"]
    return unique.withColumn("how", F.lit("unique")).unionByName(found.select(part, "l_row", F.col("_c.c_row").cast(kind).alias("r_row"), F.lit("anchored").alias("how")))


#: Letters of a gram; shorter aliases are grams themselves.
GRAM = 3


def containment_matches(df: DataFrame, col: str, aliases: DataFrame, truth: str = "region") -> DataFrame:
    """Every (row, alias region) where the text holds the alias, marked false when it is not the true region.

    Each alias waits at the rarest of its grams, by the number of distinct texts that hold it; a text meets the aliases that wait
    at one of its own grams, once each, and is then searched for them.  Grams that no alias has are dropped
    where the texts are read.  An empty alias is in every text and meets them in parts dealt by the text.
    """
    texts = df.select(F.col(col).alias("_text")).where("_text is not null").distinct()
    a = aliases.select("alias", F.col("region").alias("alias_region")).where("alias is not null")
    size = F.least(F.length("_s"), F.lit(GRAM))
    cut = lambda s, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, n)))
    names = a.select(F.col("alias").alias("_s")).distinct().where("_s <> ''")
    wanted = names.select("_s", F.explode(cut(F.col("_s"), size)).alias("_gram"))
    lengths = [F.when(F.length("_text") >= n, cut(F.col("_text"), F.lit(n))).otherwise(F.array().cast("array<string>")) for n in range(1, GRAM + 1)]
    grams = texts.select("_text", F.explode(F.flatten(F.array(*lengths))).alias("_gram")).join(wanted.select("_gram").distinct(), "_gram", "left_semi")
    df_of = grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("_df"))
    at = wanted.join(df_of, "_gram").groupBy("_s").agg(F.min_by("_gram", F.struct("_df", "_gram")).alias("_gram"))
    found = grams.join(at, "_gram").where(F.expr("contains(_text, _s)")).select("_text", F.col("_s").alias("alias"))
    blank = a.where("alias = ''").select("alias").distinct().withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))))
    found = found.unionByName(texts.withColumn("_part", F.pmod(F.xxhash64("_text"), F.lit(32))).join(blank, "_part").select("_text", "alias"))
    hits = df.join(found, F.col(col) == F.col("_text")).drop("_text").join(a, "alias")
    return hits.select(*df.columns, "alias", "alias_region").withColumn("false_match", ~F.col("alias_region").eqNullSafe(F.col(truth)))


#: Up to this length a name may share no pair of letters with one that reaches the threshold of LEAST_SHARE.
SHORT, LEAST_SHARE = 8, 80


def _gram_keys(key: Column, threshold: float) -> Column:
    """Keys of which two names that reach the threshold share one, if the longer has more than SHORT letters.

    Such names of lengths a, b are at most d = (a + b) (1 - threshold) letters inserted or dropped apart, and
    each of these touches two pairs of neighbouring letters.  So of the pairs of the longer one all but 2 d are
    in the other name, and in any common order of the pairs the first 2 d + 1 of both meet.
    """
    size = F.length(key)
    grams = F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substring(key, i, F.lit(2)))
    # Repeated pairs are told apart by their number.
    numbered = F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda h: h == g)).cast("string")))
    longest = size * (200 - threshold) / threshold
    most = F.floor((size + longest) * (100 - threshold) / 100)
    first = F.slice(F.array_sort(F.transform(numbered, lambda g: F.struct(F.xxhash64(g).alias("o"), g.alias("g")))), F.lit(1), (2 * most + 1).cast("int"))
    return F.when(size > 1, F.transform(first, lambda x: x["g"])).otherwise(F.array().cast("array<string>"))


def _apart(a: Column, b: Column, threshold: float) -> Column:
    """Most letters that names of these lengths may be inserted or dropped apart."""
    return F.floor((a + b) * (100 - threshold) / 100 + 1e-9).cast("int")


def _segment_keys(names: DataFrame, on: Sequence[str], threshold: float, limit: int | None) -> DataFrame:
    """``(on, _k, _side, _key)``: names of two sides that reach the threshold share a key (longer one up to ``limit`` letters).

    The longer name is cut into one segment more than there may be edits, as even as can be.  Going from the
    left there is a first segment i whose cut-off part holds just i - 1 edits and that has none itself, so it stands in
    the shorter name, moved by at most i - 1 places, by a number of the parity of i - 1, and with what is left of
    the edits sufficing for the rest.  Each side is dealt by length, segment number and letters.
    """
    size = F.length("_k")
    held = names.where(size <= limit) if limit else names
    pieces = _apart(F.col("_long"), F.col("_long"), threshold) + 1
    start = (F.col("_i") - 1) * F.floor(F.col("_long") / F.col("_n")) + F.greatest(F.lit(0), F.col("_i") - 1 - (F.col("_n") - F.pmod("_long", "_n")))
    width = F.floor(F.col("_long") / F.col("_n")) + (F.col("_i") > F.col("_n") - F.pmod("_long", "_n")).cast("int")
    key = lambda at: F.concat_ws("/", F.col("_long").cast("string"), F.col("_i").cast("string"), F.substring("_k", (at + 1).cast("int"), F.col("_w").cast("int")))

    def cut(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_n", pieces.cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
        return rows.withColumn("_at", start).withColumn("_w", width)

    own = cut(held.withColumn("_long", size)).select(*on, "_k", F.lit("long").alias("_side"), key(F.col("_at")).alias("_key"))
    longest = F.floor(size * (200 - threshold) / threshold + 1e-9).cast("int")
    other = cut(held.withColumn("_long", F.explode(F.sequence(size, F.least(longest, F.lit(limit)) if limit else longest))))
    edits, more = _apart(F.col("_long"), size, threshold), F.col("_long") - size
    moves = F.filter(F.sequence(1 - F.col("_i"), F.col("_i") - 1, F.lit(2)), lambda m: F.abs(more + m) <= edits - (F.col("_i") - 1))
    moves = F.when(F.col("_i") == 1, F.when(more <= edits, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))).otherwise(moves)
    other = other.withColumn("_move", F.explode(moves)).where((F.col("_at") + F.col("_move") >= 0) & (F.col("_at") + F.col("_move") + F.col("_w") <= size))
    return own.unionByName(other.select(*on, "_k", F.lit("short").alias("_side"), key(F.col("_at") + F.col("_move")).alias("_key")).distinct())


def near_duplicates(df: DataFrame, part: Sequence[str], name: str, row_id: str, threshold: float = 90) -> DataFrame:
    """Pairs within a block whose names differ after normalising and whose Indel ratio reaches the threshold (above 50).

    Names are compared once per distinct spelling and only where they share a key: a pair of letters among those that
    cannot all differ, or, for names of up to SHORT letters and for all below a threshold of LEAST_SHARE, a segment.  A length gap
    and the Levenshtein distance (never above the Indel distance) drop pairs before the exact ratio.
    """
    if threshold <= 50:
        raise ValueError("the threshold must be above 50")
    key = X.match_key(F.col(name))
    rows = df.select(*part, F.col(row_id), F.col(name), key.alias("_k"))
    names = rows.select(*part, "_k").where("_k <> ''").distinct()
    met = _segment_keys(names, part, threshold, SHORT if threshold >= LEAST_SHARE else None)
    side = lambda s, k: met.where(F.col("_side") == s).select(*part, "_key", F.col("_k").alias(k))
    both = side("long", "_a").join(side("short", "_b"), [*part, "_key"]).where("_a <> _b").select(*part, F.least("_a", "_b").alias("k1"), F.greatest("_a", "_b").alias("k2"))
    if threshold >= LEAST_SHARE:
        grams = names.withColumn("_key", F.explode(_gram_keys(F.col("_k"), threshold)))
        a, b = grams.withColumnRenamed("_k", "k1"), grams.withColumnRenamed("_k", "k2")
        both = both.unionByName(a.join(b, [*part, "_key"]).where("k1 < k2").select(*part, "k1", "k2"))
    most = _apart(F.length("k1"), F.length("k2"), threshold)
    both = both.where(F.abs(F.length("k1") - F.length("k2")) <= most).distinct().where(F.levenshtein("k1", "k2") <= most)
    both = both.withColumn("similarity", X.indel_ratio("k1", "k2")).where(F.col("similarity") >= threshold)
    left = rows.select(*part, F.col("_k").alias("k1"), F.col(row_id).alias("id1"), F.col(name).alias("name1"))
    right = rows.select(*part, F.col("_k").alias("k2"), F.col(row_id).alias("id2"), F.col(name).alias("name2"))
    return both.join(left, [*part, "k1"]).join(right, [*part, "k2"]).drop("k1", "k2")


def build_review_master(latest: DataFrame, reviews: DataFrame, old: DataFrame, labels: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Latest rows with review data, old text and manual labels; changed reviewed rows are marked to recheck."""
    fail_if_any(reviews.join(latest, list(keys), "left_anti").select(*keys), "reviewed keys are gone")
    out = latest
    for side, name in ((reviews, "reviewed"), (old.select(*keys, F.col(text).alias("old_text")), "known"), (labels, "labelled")):
        out = join_checked(out, side, keys, "left", "1:1").withColumnRenamed("matched", name)
    out = out.withColumn("text_changed", X.changed(F.col("old_text"), F.col(text), ~F.col("known")))
    return out.withColumn("recheck", F.col("reviewed") & F.col("text_changed"))


def transfer_progress(old: DataFrame, new: DataFrame, keys: Sequence[str], cols: Sequence[str] = ("review_label", "status", "note"), exclude_years: Sequence[int] = ()) -> DataFrame:
    """Reviewed cells of the old table into the new one; blanks never overwrite; lost keys raise."""
    blank = {c: F.nullif(F.trim(c), F.lit("")) for c in cols}
    any_set = None
    for c in cols:
        any_set = blank[c].isNotNull() if any_set is None else any_set | blank[c].isNotNull()
    done = old.where(any_set & (~F.col("year").isin(*exclude_years) if exclude_years else F.lit(True)))
    done = done.select(*keys, *[blank[c].alias(f"_{c}") for c in cols])
    assert_unique(done, keys, "progress")
    fail_if_any(done.join(new, list(keys), "left_anti").select(*keys), "reviewed rows are gone")
    out = new.join(done, list(keys), "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in cols}).select(*new.columns)


def change_impact(changes: Sequence[DataFrame], latest: DataFrame, labels: DataFrame, keys: Sequence[str], same: Sequence[str]) -> DataFrame:
    """All change lists with the latest amounts and labels; names and texts must be the latest."""
    from gridloom.operators.reshape import union_all

    rows = union_all(changes)
    now = latest.select(*keys, *[F.col(c).alias(f"_{c}") for c in same], *[c for c in latest.columns if c not in (*keys, *same)])
    out = join_checked(rows, now, keys, "left", "m:1", "fail").drop("matched")
    stale = None
    for c in same:
        test = ~F.col(c).eqNullSafe(F.col(f"_{c}"))
        stale = test if stale is None else stale | test
    fail_if_any(out.where(stale).select(*keys), "changes are not the latest")
    return join_checked(out.drop(*[f"_{c}" for c in same]), labels, keys, "left", "m:1").withColumnRenamed("matched", "labelled")


def context_rows(df: DataFrame, centres: DataFrame, order: str = "src_row", part: Sequence[str] = ("region", "year"), w: int = 3) -> DataFrame:
    """Rows within w places of the given ones; offsets are exploded, so it stays an equi-join."""
    offsets = F.explode(F.sequence(F.lit(-w), F.lit(w)))
    near = centres.select(*part, F.col(order).alias("centre")).withColumn("offset", offsets).withColumn(order, F.col("centre") + F.col("offset"))
    return df.join(near, [*part, order])


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the keys come out once."""
    l, r = left.alias("l"), right.alias("r")
    cond = None
    for k in keys:
        test = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        cond = test if cond is None else cond & test
    out = l.withColumn("_l", F.lit(True)).alias("l").join(r.withColumn("_r", F.lit(True)).alias("r"), cond, how)
    merged = [F.when(F.col("l._l"), F.col(f"l.{k}")).otherwise(F.col(f"r.{k}")).alias(k) if how != "inner" else F.col(f"l.{k}") for k in keys]
    state = F.when(F.col("l._l").isNull(), "right only").when(F.col("r._r").isNull(), "left only").otherwise("both").alias("join_state")
    return out.select(*merged, *[F.col(f"l.{c}") for c in left.columns if c not in keys], *[F.col(f"r.{c}") for c in right.columns if c not in keys], state)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "null_safe_on", "assert_contiguous")]
