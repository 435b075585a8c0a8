import pytest
from pyspark.sql import functions as F

from gridloom.functions import text as X
from tests.conftest import rows


def one(spark, expr, kinds="a string, b string", *values):
    return spark.createDataFrame([values], kinds).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "kind"),
    [(None, X.HEADER), ("  ", X.HEADER), ("세부사업명", X.HEADER), ("붙임(서울)", X.HEADER), ("Ⅰ. 공통사업", X.MAJOR), ("1. 주거(공통)", X.MEDIUM), ("1. 주거", X.LEAF), ("청년 지원", X.LEAF), ("(단위 : 원)", X.LEAF)],
)
def test_classify_row(spark, name, kind):
    assert one(spark, X.classify_row(F.col("a")), "a string", name) == kind


def test_extra_header_patterns_come_first(spark):
    assert one(spark, X.classify_row(F.col("a"), [r"^\(단위"]), "a string", "(단위 : 원)") == X.HEADER


@pytest.mark.parametrize(("text", "value"), [("1,234", 1234.0), ("-", 0.0), (None, None), ("n/a", None), (" 5.5 ", 5.5), ("1d", None), ("-20", -20.0), ("", None)])
def test_parse_amount(spark, text, value):
    assert one(spark, X.parse_amount(F.col("a")), "a string", text) == value


def test_clean_text(spark):
    assert one(spark, X.clean_text(F.col("a")), "a string", "a  b\n c ") == "a b c"
    assert one(spark, X.clean_text(F.col("a"), strip_bullet=True), "a string", " ○ item - x") == "item - x"
    assert one(spark, X.clean_text(F.col("a")), "a string", None) is None


def test_budget_change(spark):
    x = X.budget_change(F.col("a"), F.col("b"))
    assert tuple(one(spark, x, "a double, b double", 110.0, 100.0)) == (10.0, 10.0)
    assert tuple(one(spark, x, "a double, b double", 110.0, 0.0)) == (110.0, None)
    assert tuple(one(spark, x, "a double, b double", None, 5.0)) == (None, None)


def test_dedup_label_keeps_joining_dots(spark):
    assert one(spark, X.dedup_label(F.col("a")), "a string", "(지원대상) 청년 ○ 교재·교구 ·지원") == "지원대상 : 청년 교재·교구 지원"
    assert one(spark, X.dedup_label(F.col("a")), "a string", "지원대상: 지원대상 : 청년") == "지원대상 : 청년"


def test_label_patterns(spark):
    both = "지원대상: 청년 지원내용: 월세"
    assert one(spark, X.check_pattern(F.col("a")), "a string", both) == "match"
    assert one(spark, X.check_pattern(F.col("a")), "a string", "대상 청년 내용 월세") == "mismatch"
    assert one(spark, X.check_pattern(F.col("a"), "broad"), "a string", "대상 청년 내용 월세") == "match"
    assert one(spark, X.check_pattern(F.col("a")), "a string", None) == "missing"
    assert tuple(one(spark, X.split_labeled(F.col("a")), "a string", both)) == ("청년", "월세")


@pytest.mark.parametrize(
    ("original", "new", "flags"),
    [
        ("월 100만원 지원", "월 100만원을 지원", []),
        ("월 100만원 지원", "월 200만원 지원", ["numbers differ", "quantities differ"]),
        ("서울시청 방문", "방문 안내", ["names missing"]),
        ("abc", "", ["blank result"]),
        (None, "x", ["missing original changed"]),
        ("  ", None, []),
        ("abcdefgh", "ab", ["extreme length ratio"]),
        ("abc def", "원문: abc def", ["source label added"]),
    ],
)
def test_preservation_flags(spark, original, new, flags):
    assert one(spark, X.preservation_flags(F.col("a"), F.col("b")), "a string, b string", original, new) == flags


def test_flags_and_small_helpers(spark):
    assert one(spark, X.parse_flag(F.col("a")), "a string", "Yes") is True
    assert one(spark, X.parse_flag(F.col("a")), "a string", None) is False
    with pytest.raises(Exception, match="not a flag"):
        one(spark, X.parse_flag(F.col("a")), "a string", "maybe")
    assert one(spark, X.strip_prefix_label(F.col("a"), "label:"), "a string", "label: x") == "x"
    assert one(spark, X.strip_prefix_label(F.col("a"), "label:"), "a string", "x") == "x"
    assert tuple(one(spark, X.natural_key(F.col("a")), "a string", "2-3. x")) == (2, 3, "x")
    assert one(spark, X.source_row_key(F.col("a")), "a string", "12.0") == "12"
    assert one(spark, X.normalize_text(F.col("a")), "a string", "é  b") == "é b"
    assert one(spark, X.normalize_text(F.col("a")), "a string", None) == ""
    assert one(spark, X.indel_ratio("a", "b"), "a string, b string", "abcd", "abxd") == 75.0
    assert one(spark, X.matching_block_ratio("a", "b"), "a string, b string", "ab c", "abc") == 1.0


def test_undetermined_reason(spark):
    df = spark.createDataFrame([(1, "both", 0.0, 1.0), (2, "both", None, None), (3, "leaf only", None, 1.0), (4, "both", 2.0, 2.0)], "i int, s string, a double, b double")
    got = rows(df.select("i", X.undetermined_reason(F.col("s"), F.col("a"), F.col("b"))), "i")
    assert [r[1] for r in got] == ["subtotal is 0, no rate", "both missing", "no subtotal row", None]
