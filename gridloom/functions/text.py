"""Scalar text and number expressions.  All are built-in SQL functions, so they stay in generated code."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from gridloom.functions import patterns as P

MAJOR, MEDIUM, HEADER, LEAF = "major_subtotal", "medium_subtotal", "repeat_header", "leaf"


def classify_row(name: Column, header_patterns: Sequence[str] = (), header: str = P.NAME_HEADER) -> Column:
    """Row type by name; a null or blank name is a repeated header.  The order of the tests matters."""
    text = F.trim(name)
    is_header = text.isNull() | (text == "") | (text == header) | text.rlike(P.SIDO_TITLE)
    for pattern in header_patterns:
        is_header = is_header | text.rlike(pattern)
    medium = text.rlike(P.MEDIUM_HEAD) & text.rlike(P.BUDGET_TYPE_SUFFIX)
    return F.when(is_header, HEADER).when(text.rlike(P.MAJOR_HEAD), MAJOR).when(medium, MEDIUM).otherwise(LEAF)


def clean_text(text: Column, strip_bullet: bool = False) -> Column:
    """Without private-use characters, white space squeezed; optionally without one leading bullet."""
    out = F.trim(F.regexp_replace(F.regexp_replace(text, P.PRIVATE_USE, ""), r"\s+", " "))
    return F.trim(F.regexp_replace(out, P.LEADING_BULLET, "")) if strip_bullet else out


def compact(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def normalize_budget_type(text: Column) -> Column:
    return compact(clean_text(text))


def parse_amount(text: Column, zero_tokens: Iterable[str] = ("-",)) -> Column:
    """Number without commas; zero tokens give 0, what does not parse and null give null."""
    bare = F.trim(F.regexp_replace(text, ",", ""))
    # Only plain numbers: a cast would also take suffixes such as the "d" of "1d".
    number = F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare)
    return F.when(bare.isin(*[t.strip() for t in zero_tokens]), F.lit(0.0)).otherwise(number.try_cast("double"))


def budget_change(cur: Column, prev: Column, digits: int = 1) -> Column:
    """struct(change, rate); the rate is in percent, null where the previous value is 0 or one is null."""
    change = cur - prev
    return F.struct(change.alias("change"), F.bround(F.try_divide(change, F.nullif(prev, F.lit(0.0))) * 100, digits).alias("rate"))


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_text(text: Column, form: str = "NFC") -> Column:
    """Unicode form, squeezed spaces, null to empty.  Plain ASCII never reaches Python."""
    udf = {"NFC": _nfc, "NFKC": _nfkc}[form]
    formed = F.when(text.rlike(r"[^\x00-\x7F]"), udf(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)
    return F.coalesce(F.trim(F.regexp_replace(formed, r"\s+", " ")), F.lit(""))


def keyword_key(text: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^0-9a-z가-힣]", "")


def match_key(text: Column) -> Column:
    """Name without white space and some marks; null to empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), P.MATCH_DROPPED, "")


def rewrite_titles(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Apply (pattern, replacement) rules in turn, e.g. ``1. (common) X`` to ``1. X(common)``."""
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def dedup_label(text: Column) -> Column:
    """``(label)`` to ``label :``, bullets to spaces, repeated labels once, spaces squeezed."""
    out = F.regexp_replace(text, rf"\(\s*({'|'.join(P.CONTENT_LABELS)})\s*\)", "$1 : ")
    out = F.regexp_replace(out, P.BULLET, " ")
    for label in P.REPEATED_LABELS:
        out = F.regexp_replace(out, rf"({label}\s*[:：]\s*)+", f"{label} : ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def check_pattern(text: Column, mode: str = "strict") -> Column:
    """match, mismatch or missing."""
    pattern = {"strict": P.STRICT_LABELS, "broad": P.BROAD_LABELS}[mode]
    return F.when(text.isNull(), "missing").when(text.rlike(pattern), "match").otherwise("mismatch")


def split_labeled(text: Column) -> Column:
    """struct(target, content) of the broad pattern, nulls where it does not match."""
    hit = text.rlike(P.BROAD_LABELS)
    part = lambda g: F.when(hit, F.trim(F.regexp_extract(text, P.BROAD_LABELS, g)))
    return F.struct(part(2).alias("target"), part(4).alias("content"))


def _all(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.array().cast("array<string>"))


def extract_numbers(text: Column) -> Column:
    return _all(text, P.NUMBER)


def extract_quantities(text: Column) -> Column:
    return F.transform(_all(text, P.QUANTITY), compact)


def extract_names(text: Column, context: Column | None = None) -> Column:
    """Quoted terms, names with known endings and context terms that occur, each once and in this order."""
    # A text without any of the endings holds no such name, and its long words need not be tried.
    named = F.when(text.rlike(P.NAME_TOKEN[P.NAME_TOKEN.index("(?:") : -1]), _all(text, P.NAME_TOKEN)).otherwise(F.array().cast("array<string>"))
    found = F.concat(_all(text, P.QUOTED), named)
    if context is not None:
        found = F.concat(found, F.filter(F.coalesce(context, F.array().cast("array<string>")), lambda t: (t != "") & F.contains(text, t)))
    return F.array_distinct(found)


def length_ratio(original: Column, new: Column) -> Column:
    """Ratio of the lengths without white space, 4 digits; null where the original has none."""
    return F.bround(F.try_divide(F.length(compact(new)), F.nullif(F.length(compact(original)), F.lit(0))), 4)


def preservation_flags(original: Column, new: Column, context: Column | None = None, lo: float = 0.5, hi: float = 1.5) -> Column:
    """Reasons why a rewritten text may not keep the original's meaning, in a fixed order."""
    if lo <= 0 or hi < lo:
        raise ValueError("the length bounds must satisfy 0 < lo <= hi")
    blank_new = new.isNull() | (F.trim(new) == "")
    names = extract_names(original, context)
    so, sn = compact(original), compact(new)
    both = (F.length(so) > 0) & (F.length(sn) > 0)
    ratio = F.try_divide(F.length(sn), F.nullif(F.length(so), F.lit(0)))
    detail = F.array_compact(
        F.array(
            F.when(extract_numbers(original) != extract_numbers(new), "numbers differ"),
            F.when(extract_quantities(original) != extract_quantities(new), "quantities differ"),
            F.when(F.exists(names, lambda t: ~F.contains(new, t)), "names missing"),
            F.when(both & ~original.rlike(P.SOURCE_LABEL) & new.rlike(P.SOURCE_LABEL), "source label added"),
            F.when(both & ((ratio < lo) | (ratio > hi)), "extreme length ratio"),
        )
    )
    none = F.array().cast("array<string>")
    one = lambda reason: F.when(blank_new, none).otherwise(F.array(F.lit(reason)))
    return F.when(original.isNull(), one("missing original changed")).when(F.trim(original) == "", one("blank original changed")).when(blank_new, F.array(F.lit("blank result"))).otherwise(detail)


def needs_rerun(text: Column) -> Column:
    return F.coalesce(text.rlike(P.PRIVATE_USE) | text.rlike(rf"\(\s*({'|'.join(P.CONTENT_LABELS)})\s*\)"), F.lit(False))


def log_level(value: Column) -> Column:
    """log(1 + x); null where 1 + x is not positive."""
    return F.when(value > -1, F.log1p(value))


def log_effect(coef: Column) -> Column:
    """Relative change that a coefficient on a log level stands for: exp(b) - 1."""
    return F.expm1(coef)


def period_of(year: Column, ranges: Sequence[tuple[int, int, str]], otherwise: str = "out of range") -> Column:
    out = F.lit(otherwise)
    for first, last, name in reversed(ranges):
        out = F.when(year.between(first, last), name).otherwise(out)
    return out


def parse_flag(flag: Column) -> Column:
    """True, 1, y, yes, t / false, 0, n, no, f, empty and null; anything else raises."""
    text = F.lower(F.trim(flag.cast("string")))
    no = text.isNull() | text.isin("false", "0", "0.0", "n", "no", "f", "")
    return F.when(text.isin("true", "1", "1.0", "y", "yes", "t"), F.lit(True)).when(no, F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("not a flag: "), text)).cast("boolean"))


def strip_prefix_label(text: Column, marker: str) -> Column:
    """Text behind the first marker; unchanged where there is none."""
    at = F.instr(text, marker)
    return F.when(at > 0, F.trim(F.substring(text, at + len(marker), F.length(text)))).otherwise(text)


def direction_result(base: Column, ref: Column, direction: Column, target: Column | None = None, tie: float = 1e-12) -> Column:
    """improved, worsened, same or not comparable, by a direction of higher, lower or target."""
    goal = target if target is not None else F.lit(None).cast("double")
    gain = F.when(direction == "higher", base - ref).when(direction == "lower", ref - base).when(direction == "target", F.abs(ref - goal) - F.abs(base - goal))
    return F.when(gain.isNull(), "not comparable").when(F.abs(gain) <= tie, "same").when(gain > 0, "improved").otherwise("worsened")


def changed(prev: Column, cur: Column, is_new: Column) -> Column:
    return ~is_new & (F.coalesce(prev, F.lit("")) != F.coalesce(cur, F.lit("")))


def natural_key(text: Column) -> Column:
    """``2-3. x`` to (2, 3, x)."""
    number = lambda g: F.nullif(F.regexp_extract(text, r"^(\d+)(?:-(\d+))?", g), F.lit("")).cast("int")
    return F.struct(number(1).alias("a"), number(2).alias("b"), F.regexp_replace(text, r"^[\d-]+\.?\s*", "").alias("rest"))


def source_row_key(text: Column) -> Column:
    """``12.0`` and 12 to ``12``."""
    return F.regexp_replace(F.trim(text.cast("string")), r"\.0$", "")


def undetermined_reason(state: Column, subtotal: Column, leaf_sum: Column) -> Column:
    """Why a subtotal check is not decided; null where it is."""
    both = state == "both"
    return (
        F.when(state == "leaf only", "no subtotal row")
        .when(state == "subtotal only", "no leaf rows")
        .when(both & subtotal.isNull() & leaf_sum.isNull(), "both missing")
        .when(both & subtotal.isNull(), "subtotal missing")
        .when(both & leaf_sum.isNull(), "leaf sum missing")
        .when(both & (subtotal == 0), "subtotal is 0, no rate")
    )


@F.pandas_udf(DoubleType())
def matching_block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two texts without white space; use it on rows that changed only."""
    from difflib import SequenceMatcher

    squeeze = lambda x: "".join((x or "").split())
    return pd.Series([SequenceMatcher(None, squeeze(x), squeeze(y), autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 * 2 * (longest common subsequence) / (both lengths), by bit-parallel rows."""

    def ratio(x: str, y: str) -> float:
        if not x and not y:
            return 100.0
        places: dict[str, int] = {}
        for k, c in enumerate(x):
            places[c] = places.get(c, 0) | 1 << k
        # A zero bit says that the common subsequence grows at this place of x.
        whole = (1 << len(x)) - 1
        row = whole
        for c in y:
            hit = row & places.get(c, 0)
            row = ((row + hit) | (row - hit)) & whole
        return 200.0 * (len(x) - row.bit_count()) / (len(x) + len(y))

    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])
