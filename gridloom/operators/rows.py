"""Cleaning of hierarchical item rows: types, headings, blocks, duplicates, labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import patterns as P
from gridloom.functions import text as X
from gridloom.functions.staging import materialize
from gridloom.operators.checks import CheckFailed, assert_unique, fail_if_any, require_columns
from gridloom.operators.ranges import carry_forward, ranged


def parse_numeric_strict(df: DataFrame, col: str, allowed: Sequence[str] = ("",)) -> DataFrame:
    """Numbers; allowed tokens give null and any other text raises."""
    text = F.trim(F.col(col).cast("string"))
    number = F.regexp_replace(text, ",", "").try_cast("double")
    fail_if_any(df.where(text.isNotNull() & ~text.isin(*allowed) & number.isNull()).select(col).distinct(), f"{col} holds text")
    return df.withColumn(col, F.when(~text.isin(*allowed), number))


#: Copies of a rule that fixes no field, so that the rows it meets are dealt over as many tasks.
SPREAD = 32


def apply_row_type_rules(df: DataFrame, rules: DataFrame, row_type: str = "row_type") -> DataFrame:
    """Reclassify by rules (priority, year, region, row_lo, row_hi, name, regex, new_type); the last rule that fits wins.

    Null fields of a rule match anything.  Rules are dispatched by the fields that they fix: each such class is
    an equi-join on these fields.  A rule with a range of rows also lies in one or two buckets of 2**level rows, the
    smallest that are as wide as the range, and joins by bucket.  Regular expressions are tested on the rows left; a
    rule that fixes nothing else is tested once per distinct name.
    """
    r = rules.select(*[F.col(c).alias(f"_{c}") for c in ("priority", "year", "region", "row_lo", "row_hi", "name", "regex", "new_type")])
    ends = F.coalesce("_row_lo", "_row_hi").isNotNull()
    # An open end reaches as far as the rows do.
    span = df.agg(F.min("src_row").alias("_least"), F.max("src_row").alias("_most"))
    r = r.crossJoin(span).withColumns({"_lo": F.when(ends, F.coalesce("_row_lo", "_least")), "_hi": F.when(ends, F.coalesce("_row_hi", "_most"))}).where("_lo is null or _lo <= _hi")
    level = F.when(F.col("_lo").isNotNull(), F.length(F.bin(F.col("_hi") - F.col("_lo"))))
    r = r.withColumn("_level", level).withColumn("_fixes", F.concat(*[F.when(F.col(f"_{c}").isNull(), "-").otherwise(c[0]) for c in ("year", "region", "name")], F.when(F.col("_lo").isNull(), "-").otherwise("b")))
    r = materialize(r.drop("_least", "_most"), "row-rules")
    keys = ["region", "year", "src_row"]
    named = df.select(*keys, "item_name", F.trim("item_name").alias("_trimmed"))
    on = {"y": ("year", "_year"), "r": ("region", "_region"), "n": ("_trimmed", "_name"), "b": ("_bucket", "_bucket")}
    hits = None
    # At most 16 classes, each with its own levels.
    for kind in r.groupBy("_fixes").agg(F.collect_set("_level").alias("levels")).orderBy("_fixes").collect():
        held, rows, fixed = r.where(F.col("_fixes") == kind["_fixes"]), named, [c for c in kind["_fixes"] if c != "-"]
        if "b" in fixed:
            at = lambda x, k: F.struct(k.alias("level"), F.floor(x / F.pow(F.lit(2.0), k)).cast("long").alias("at"))
            levels = F.array(*[F.lit(x) for x in sorted(kind["levels"])])
            rows = rows.withColumn("_bucket", F.explode(F.transform(levels, lambda k: at(F.col("src_row"), k))))
            held = held.withColumn("_bucket", F.explode(F.array_distinct(F.array(at(F.col("_lo"), F.col("_level")), at(F.col("_hi"), F.col("_level"))))))
        elif not fixed:  # nothing to join by: names against the rules, dealt over SPREAD parts
            rows = named.select("item_name").distinct().withColumn("_part", F.pmod(F.xxhash64("item_name"), F.lit(SPREAD)))
            held = held.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
        pairs = [on[c] for c in fixed] or [("_part", "_part")]
        held = held.withColumnsRenamed({b: f"{b}_rule" for a, b in pairs if a == b})
        cond = None
        for a, b in pairs:
            test = F.col(a) == F.col(f"{b}_rule" if a == b else b)
            cond = test if cond is None else cond & test
        left = (F.col("_regex").isNull() | F.expr("item_name rlike _regex")) & (F.col("_lo").isNull() | F.col("src_row").between(F.col("_lo"), F.col("_hi")) if "b" in fixed else F.lit(True))
        found = rows.join(held, cond).where(left)
        if not fixed:
            by_name = found.groupBy(F.col("item_name").alias("_of")).agg(F.max_by("_new_type", "_priority").alias("_new_type"), F.max("_priority").alias("_priority"))
            found = named.join(by_name, F.col("item_name").eqNullSafe(F.col("_of")))
        found = found.select(*keys, "_priority", "_new_type")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return df
    best = hits.groupBy(*keys).agg(F.max_by("_new_type", "_priority").alias("_new"))
    return df.join(best, keys, "left").withColumn(row_type, F.coalesce("_new", row_type)).drop("_new")


def backfill_heading(df: DataFrame, pattern: str = P.MEDIUM_WITH_TYPE, major: str = "major_head", medium: str = "medium_head") -> DataFrame:
    """Where the major heading is null, split ``N. topic(type)`` into medium = topic and major = type."""
    hit = F.col(major).isNull() & F.coalesce(F.col(medium).rlike(pattern), F.lit(False))
    new_major, new_medium = (F.when(hit, F.regexp_extract(medium, pattern, g)).otherwise(F.col(c)) for g, c in ((2, major), (1, medium)))
    return df.withColumns({major: new_major, medium: new_medium})


def forward_fill(df: DataFrame, part: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    """Last non-null value so far, in source order (W8)."""
    return carry_forward(df, part, order, cols)


def assign_headings(df: DataFrame, part: Sequence[str], order: str = "src_row", name: str = "item_name", row_type: str = "row_type") -> DataFrame:
    """Names of the subtotal rows carried to the rows below them."""
    out = df.withColumn("major_head", F.when(F.col(row_type) == X.MAJOR, F.col(name))).withColumn("medium_head", F.when(F.col(row_type) == X.MEDIUM, F.col(name)))
    return forward_fill(out, part, order, ["major_head", "medium_head"])


def realign_headings(df: DataFrame, region: str = "region", order: str = "src_row", name: str = "item_name", pattern: str = P.BRACKET_MARK, suffix: str = "사업") -> DataFrame:
    """In regions with bracket markers: the major heading becomes the medium one, the marker the major one."""
    mark = F.when(F.col(name).rlike(pattern), F.concat(X.compact(F.regexp_extract(name, pattern, 1)), F.lit(suffix)))
    out = carry_forward(df.withColumn("_mark", mark), [region], order, ["_mark"])
    # Regions that hold a marker, a row each.
    has = df.where(mark.isNotNull()).select(F.col(region).alias("_in")).distinct().withColumn("_has", F.lit(True))
    out = out.join(has, F.col(region).eqNullSafe(F.col("_in")), "left").withColumn("_has", F.coalesce("_has", F.lit(False)))
    new_medium, new_major = F.when(F.col("_has"), F.col("major_head")).otherwise(F.col("medium_head")), F.when(F.col("_has"), F.col("_mark")).otherwise(F.col("major_head"))
    return out.withColumns({"medium_head": new_medium, "major_head": new_major}).drop("_mark", "_has", "_in")


def normalize_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({"year": F.col("year").cast("long"), "region": F.trim("region"), "src_row": X.source_row_key(F.col("src_row"))})


def map_region(df: DataFrame, col: str, aliases: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``region`` by exact alias (alias, region), else by the longest listed prefix (prefix, region), else null."""
    text = F.trim(col)
    values = df.select(text.alias("_text")).distinct()
    exact = values.join(aliases.select(F.trim("alias").alias("_text"), F.col("region").alias("_exact")), "_text")
    by_prefix = values.join(prefixes.select("prefix", F.col("region").alias("_pre")), F.expr("startswith(_text, prefix)"))
    by_prefix = by_prefix.groupBy("_text").agg(F.max_by("_pre", F.struct(F.length("prefix"), "prefix")).alias("_pre"))
    out = df.withColumn("_text", text).join(exact, "_text", "left").join(by_prefix, "_text", "left")
    return out.withColumn("region", F.coalesce("_exact", "_pre")).drop("_text", "_exact", "_pre")


def merge_continuations(df: DataFrame, links: DataFrame, text: str = "body") -> DataFrame:
    """Append the texts of continuation rows to their target rows (region, year, src_row, target_row), once."""
    keys = ["region", "year"]
    named = df.select(*keys, "src_row", F.col(text).alias("_more"))
    fail_if_any(links.join(named, [*keys, "src_row"], "left_anti"), "continuation rows do not exist")
    fail_if_any(links.join(df.select(*keys, F.col("src_row").alias("target_row")), [*keys, "target_row"], "left_anti"), "target rows do not exist")
    parts = links.join(named, [*keys, "src_row"]).groupBy(*keys, F.col("target_row").alias("src_row"))
    more = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src_row", "_more"))), lambda x: x["_more"]), " ").alias("_more"))
    out = df.join(more, [*keys, "src_row"], "left")
    grown = F.when(F.col("_more").isNull() | F.coalesce(F.endswith(F.col(text), F.col("_more")), F.lit(False)), F.col(text)).otherwise(F.concat_ws(" ", text, "_more"))
    return out.withColumn(text, grown).drop("_more")


def extract_leaves(df: DataFrame, title_rules: Sequence[tuple[str, str]] = (), header_patterns: Sequence[str] = (), type_rules: DataFrame | None = None, amount: str = "budget_cur_raw") -> DataFrame:
    """Leaf rows of a raw sheet with parsed amounts and quality flags."""
    require_columns(df, ["region", "year", "src_row", "item_name", amount])
    out = df.withColumn("item_name", X.rewrite_titles(F.col("item_name"), title_rules)).withColumn("row_type", X.classify_row(F.col("item_name"), header_patterns))
    if type_rules is not None:
        out = apply_row_type_rules(out, type_rules)
    raw, number = F.trim(F.col(amount).cast("string")), X.parse_amount(F.col(amount))
    out = out.withColumn("amount", number).withColumn("amount_missing", raw.isNull() | (raw == ""))
    out = out.withColumn("non_numeric", ~F.col("amount_missing") & F.col("amount").isNull()).withColumn("negative", F.coalesce(F.col("amount") < 0, F.lit(False)))
    return out.where(F.col("row_type") == X.LEAF)


def audit_candidates(df: DataFrame, original: str, new: str, context: str | None = None) -> DataFrame:
    """Rows with a preservation flag, with the joined reasons and the length ratio."""
    flags = X.preservation_flags(F.col(original), F.col(new), F.col(context) if context else None)
    # Behind a generator the flags are made once a row; a filter on the expression itself would make them again.
    out = df.withColumn("flags", F.explode(F.array(flags))).where(F.size("flags") > 0)
    return out.withColumn("reasons", F.array_join("flags", "; ")).withColumn("length_ratio", X.length_ratio(F.col(original), F.col(new)))


def reason_histogram(audited: DataFrame) -> DataFrame:
    return audited.select(F.explode("flags").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def normalize_bullets(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Labels tidied in cells with bullets only; ``n_changed`` counts them, ``lost`` tells changed numbers."""
    out, hits, lost = df, [], []
    for c in cols:
        has = F.coalesce(F.col(c).rlike(P.BULLET), F.lit(False))
        new = F.when(has, X.dedup_label(F.col(c))).otherwise(F.col(c))
        hits.append(has.cast("int"))
        lost.append(has & ((X.extract_numbers(F.col(c)) != X.extract_numbers(new)) | (X.extract_quantities(F.col(c)) != X.extract_quantities(new))))
        out = out.withColumn(f"_{c}", new)
    out = out.withColumn("n_changed", sum(hits[1:], hits[0])).withColumn("lost", F.greatest(*lost) if len(lost) > 1 else lost[0])
    return out.withColumns({c: F.col(f"_{c}") for c in cols}).drop(*[f"_{c}" for c in cols])


def coalesce_text(df: DataFrame, preferred: str, fallback: str) -> tuple[DataFrame, DataFrame]:
    """(table with ``text`` and ``text_source``, counts per source)."""
    norm = lambda c: F.nullif(F.trim(F.regexp_replace(F.col(c), r"\s+", " ")), F.lit(""))
    source = F.when(norm(preferred).isNotNull(), "preferred").when(norm(fallback).isNotNull(), "fallback").otherwise("none")
    out = df.withColumn("text", F.coalesce(norm(preferred), norm(fallback))).withColumn("text_source", source)
    return out, out.groupBy("text_source").agg(F.count(F.lit(1)).alias("n"))


def build_text(df: DataFrame, cols: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """``model_text`` of the squeezed columns; a blank required column or a blank text raises."""
    norm = {c: F.nullif(F.trim(F.regexp_replace(F.col(c), r"\s+", " ")), F.lit("")) for c in cols}
    out = df.withColumn("model_text", F.concat_ws(" ", *norm.values()))
    bad = F.col("model_text") == ""
    for c in required:
        bad = bad | norm[c].isNull()
    fail_if_any(out.where(bad).select(*cols), "blank text")
    return out


def harmonize(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rename whichever alias is there to the common name; none or several is an error."""
    picked = []
    for name, options in aliases.items():
        found = [c for c in options if c in df.columns]
        if len(found) != 1:
            raise CheckFailed(f"{name}: found {found} of {list(options)}")
        picked.append(F.col(found[0]).alias(name))
    taken = {c for options in aliases.values() for c in options}
    return df.select(*picked, *[c for c in df.columns if c not in taken])


def select_label(df: DataFrame, taxonomy: DataFrame, done: Sequence[str] = ("confirmed", "edited")) -> DataFrame:
    """``label`` by precedence reviewed, predicted, unassigned; with its source and parent."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    reviewed = text("status").isin(*done) | (text("status").isNull() & text("note").isNotNull())
    by_review = F.when(F.coalesce(reviewed, F.lit(False)), text("review_label"))
    source = F.when(by_review.isNotNull(), "reviewed").when(text("pred_label").isNotNull(), "predicted").otherwise("unassigned")
    out = df.withColumn("label", F.coalesce(by_review, text("pred_label"))).withColumn("label_source", source)
    return out.join(taxonomy.select(F.col("child").alias("label"), "parent"), "label", "left")


def training_rows(df: DataFrame, years: Sequence[int], statuses: Sequence[str], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(confirmed rows of the years without a note, the confirmed rows left out for one)."""
    chosen = df.where(F.col("year").isin(*years) & F.col("status").isin(*statuses))
    noted = F.coalesce(F.trim("note"), F.lit("")) != ""
    assert_unique(chosen.where(~noted), keys, "training rows")
    return chosen.where(~noted), chosen.where(noted)


def similarity_of_changes(df: DataFrame, before: str, after: str) -> DataFrame:
    """Matching-block ratio of the rows whose text changed (C33)."""
    return df.where(F.coalesce(before, F.lit("")) != F.coalesce(after, F.lit(""))).withColumn("ratio", X.matching_block_ratio(before, after))


def drop_confirmed_duplicates(df: DataFrame, ids: Sequence, id_col: str, ignore: Sequence[str] = ()) -> DataFrame:
    """Remove the listed rows; each must equal another row on all other columns."""
    same = [c for c in df.columns if c != id_col and c not in ignore]
    listed = F.col(id_col).isin(*ids)
    marked = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*same)))
    fail_if_any(marked.where(listed & (F.col("_n") < 2)).select(id_col), "rows are no duplicates")
    return df.where(~listed)


def adjacent_duplicates(df: DataFrame, order: str, part: Sequence[str] = ()) -> DataFrame:
    """Rows equal to the row before them on all columns but the order.

    Without ``part`` the rows are dealt by ranges of the order, and the last row of a range is handed to the
    next one (one row per range), so no task sees the whole table.
    """
    whole = F.struct(*[c for c in df.columns if c != order])
    if part:
        out = df.withColumn("_before", F.lag(whole).over(Window.partitionBy(*part).orderBy(order)))
        return out.where(whole.eqNullSafe(F.col("_before"))).drop("_before")
    rows, inside = ranged(df, order), Window.partitionBy("_range").orderBy(order)
    ends = rows.groupBy("_range").agg(F.max_by(whole, order).alias("_end"))
    ends = ends.select("_range", F.lag("_end").over(Window.orderBy("_range")).alias("_end"))  # one row per range
    out = rows.withColumn("_before", F.lag(whole).over(inside)).withColumn("_first", F.row_number().over(inside) == 1).join(ends, "_range")
    out = out.withColumn("_before", F.when(F.col("_first"), F.col("_end")).otherwise(F.col("_before")))
    return out.where(F.col("_before").isNotNull() & whole.eqNullSafe(F.col("_before"))).select(*df.columns)


def collapse_blocks(df: DataFrame, keys: Sequence[str], order: str, token_col: str, amount_cols: Sequence[str], part: Sequence[str] = (), tokens: Sequence[str] = P.FUNDING_TOKENS, total: str = P.TOTAL_TOKEN) -> DataFrame:
    """One row per block of funding rows.

    Consecutive rows of one key form an island; inside it a repeated token starts a new block.  A block with
    the total token keeps that row, else its amounts are summed (null if all are) and its distinct tokens
    joined with ``+`` into ``funding_detail``.  Other rows pass unchanged.
    """
    token = F.trim(F.col(token_col))
    funding = F.coalesce(token.isin(*tokens), F.lit(False))
    by_part = Window.partitionBy(*part).orderBy(order)
    out = df.withColumn("_pos", F.row_number().over(by_part)).withColumn("_fund", funding)
    by_key = Window.partitionBy(*part, "_fund", *keys).orderBy(order)
    out = out.withColumn("_island", F.col("_pos") - F.row_number().over(by_key))
    rows = out.where("_fund").withColumn("_token", token)
    for c in amount_cols:
        rows = rows.withColumn(c, X.parse_amount(F.col(c).cast("string")))
    island = rows.groupBy(*part, *keys, "_island").agg(F.array_sort(F.collect_list(F.struct("_pos", "_token"))).alias("_rows"))
    # Ordered fold over a short island: block number and tokens seen in the block.
    start = F.struct(F.lit(0).alias("b"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<struct<_pos:int,_b:int>>").alias("out"))

    def step(acc, x):
        again = F.array_contains(acc["seen"], x["_token"])
        b = F.when(again, acc["b"] + 1).otherwise(acc["b"])
        seen = F.when(again, F.array(x["_token"])).otherwise(F.array_append(acc["seen"], x["_token"]))
        return F.struct(b.alias("b"), seen.alias("seen"), F.array_append(acc["out"], F.struct(x["_pos"].alias("_pos"), b.alias("_b"))).alias("out"))

    placed = island.select(*part, *keys, "_island", F.explode(F.aggregate("_rows", start, step)["out"]).alias("_x"))
    same = [r for r in (*part, *keys, "_island")]
    placed = placed.select(*same, F.col("_x._pos").alias("_pos"), F.col("_x._b").alias("_b"))
    on = placed.columns[:-1]
    cond = None
    left, right = rows.alias("l"), placed.alias("r")
    for c in on:
        test = F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        cond = test if cond is None else cond & test
    blocks = left.join(right, cond).select("l.*", "r._b")
    first = lambda c: F.min_by(c, "_pos").alias(c)
    has_total = F.max(F.col("_token") == total)
    of_total = lambda c: F.min_by(F.when(F.col("_token") == total, F.col(c)), F.when(F.col("_token") == total, F.col("_pos")))
    plain = [c for c in df.columns if c not in (*part, *keys, token_col, *amount_cols)]
    aggs = [F.when(has_total, of_total(c)).otherwise(F.min_by(c, "_pos")).alias(c) for c in plain]
    aggs += [F.when(has_total, of_total(c)).otherwise(F.sum(c)).alias(c) for c in amount_cols]
    detail = F.when(has_total, F.lit(total)).otherwise(F.array_join(F.array_sort(F.collect_set("_token")), "+")).alias("funding_detail")
    folded = blocks.groupBy(*part, *keys, "_island", "_b").agg(*aggs, detail, F.lit(total).alias(token_col))
    cols = [*df.columns, "funding_detail"]
    rest = out.where("not _fund").withColumns({c: X.parse_amount(F.col(c).cast("string")) for c in amount_cols}).withColumn("funding_detail", F.lit(None).cast("string"))
    return folded.select(*cols).unionByName(rest.select(*cols))


def duplicate_profile(df: DataFrame, specs: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per named key set: rows, distinct keys and surplus rows."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(F.struct(*cols)).alias(name) for name, cols in specs.items()])
    long = counts.unpivot(["n"], list(specs), "spec", "n_distinct")
    return long.select("spec", F.col("n").alias("n_rows"), "n_distinct", (F.col("n") - F.col("n_distinct")).alias("n_surplus"))


def collapse_consistent(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per key; values that conflict raise.  Nulls do not conflict."""
    out = df.groupBy(*keys).agg(*[F.count_distinct(c).alias(f"_n_{c}") for c in cols], *[F.min(c).alias(c) for c in cols])
    bad = None
    for c in cols:
        bad = F.col(f"_n_{c}") > 1 if bad is None else bad | (F.col(f"_n_{c}") > 1)
    fail_if_any(out.where(bad), "conflicting values per key")
    return out.select(*keys, *cols)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
