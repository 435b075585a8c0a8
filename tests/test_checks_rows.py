import pytest
from pyspark.sql import functions as F

from gridloom.functions import text as X
from gridloom.operators import checks as V
from gridloom.operators import reshape as R
from gridloom.operators import rows as C
from tests.conftest import rows


def test_contracts_raise(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 3, -1.0), ("a", 3, None)], "region string, year int, v double")
    with pytest.raises(V.CheckFailed, match="lacks"):
        V.require_columns(df, ["nope"])
    with pytest.raises(V.CheckFailed, match="repeats"):
        V.assert_unique(df, ["region", "year"])
    with pytest.raises(V.CheckFailed, match="consecutive"):
        V.assert_contiguous(df.distinct(), ["region"], "year")
    with pytest.raises(V.CheckFailed, match="domain"):
        V.assert_domain(df, {"v": "non_negative"})
    with pytest.raises(V.CheckFailed, match="full grid"):
        V.assert_grid(df.where("v = 1"), {"region": ["a", "b"], "year": [1]})
    with pytest.raises(V.CheckFailed, match="constant"):
        V.assert_fd(df, ["region"], "v")
    with pytest.raises(V.CheckFailed, match="must be"):
        V.assert_all_equal(df, "region", "ok")
    V.assert_grid(df.where("v = 1"), {"region": ["a"], "year": [1]})


def test_expectations(spark):
    checks = V.Checks(spark).add("s", "n", 1, 1).add("s", "m", 1, 2).add("s", "note", "", "x", info=True)
    assert [r[4] for r in rows(checks.to_df(), "check")] == ["FAIL", "PASS", "INFO"]
    with pytest.raises(V.CheckFailed):
        checks.fail_on_any()


def test_compare_and_multisets(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.5), (4, 1.0), (3, None)], "k int, v double")
    detail, summary = V.compare_keyed(a, b, ["k"], "v", exceptions=spark.createDataFrame([(4,)], "k int"))
    assert {r["k"]: r["status"] for r in detail.collect()} == {1: "equal", 2: "mismatch", 3: "equal", 4: "known exception"}
    s = summary.first()
    assert (s["mismatch"], s["max_abs_diff"], s["max_at"], s["passed"]) == (1, 0.5, "2", False)
    assert V.multiset_diff(a, a.unionByName(a), ["k", "v"], 2).count() == 0
    assert V.multiset_diff(a, a, ["k", "v"], 2).count() == 3


def test_shares(spark):
    df = spark.createDataFrame([("a", 0.4), ("a", 0.6), ("b", 1.2), ("b", -0.2)], "g string, s double")
    assert rows(V.check_shares(df, ["g"], "s").select("g", "n_bad", "passed"), "g") == [("a", 0, True), ("b", 2, False)]


def test_headings(spark):
    names = ["Ⅰ. 공통사업", "1. 주거(공통)", "월세", "2. 일자리(공통)", "훈련", "Ⅱ. 자체사업", "행사"]
    df = spark.createDataFrame([("r", 2016, i, n) for i, n in enumerate(names)], "region string, year int, src_row long, item_name string")
    out = C.assign_headings(df.withColumn("row_type", X.classify_row(F.col("item_name"))), ["region", "year"])
    got = {r["item_name"]: (r["major_head"], r["medium_head"]) for r in out.collect()}
    assert got["훈련"] == ("Ⅰ. 공통사업", "2. 일자리(공통)") and got["행사"][0] == "Ⅱ. 자체사업"
    filled = C.backfill_heading(spark.createDataFrame([(None, "1. 주거(공통사업)"), ("x", "1. 주거(공통사업)")], "major_head string, medium_head string"))
    assert sorted(map(tuple, filled.collect())) == [("x", "1. 주거(공통사업)"), ("공통사업", "주거")]
    marked = spark.createDataFrame([("d", 1, "[공 통 사 업] (3)", None, None), ("d", 2, "x", "주거", "old"), ("e", 1, "y", "m", "n")], "region string, src_row int, item_name string, major_head string, medium_head string")
    got = rows(C.realign_headings(marked).select("region", "src_row", "major_head", "medium_head"), "region", "src_row")
    assert got == [("d", 1, "공통사업", None), ("d", 2, "공통사업", "주거"), ("e", 1, "m", "n")]


def test_funding_blocks(spark):
    data = [(1, "사업", "계", "10"), (2, "사업", "국비", "4"), (3, "사업", "계", "7"), (4, "사업", "지방비", "7"), (5, "다른", "국비", "1"), (6, "다른", "지방비", "-"), (7, "머리", None, "x"), (8, "다른", "국비", None)]
    df = spark.createDataFrame([("r", *x) for x in data], "region string, src_row int, item_name string, funding string, cur string")
    out = C.collapse_blocks(df, ["item_name"], "src_row", "funding", ["cur"], part=["region"])
    assert rows(out.select("src_row", "cur", "funding_detail"), "src_row") == [(1, 10.0, "계"), (3, 7.0, "계"), (5, 1.0, "국비+지방비"), (7, None, None), (8, None, "국비")]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, x string")
    assert C.drop_confirmed_duplicates(df, [2], "id").count() == 2
    with pytest.raises(V.CheckFailed):
        C.drop_confirmed_duplicates(df, [3], "id")
    assert rows(C.adjacent_duplicates(df, "id").select("id"), "id") == [(2,)]
    with pytest.raises(V.CheckFailed, match="conflicting"):
        C.collapse_consistent(df.withColumn("k", F.lit(1)), ["k"], ["x"])


def test_rules_continuations_regions(spark):
    df = spark.createDataFrame([("r", 2016, 1, "a", "one"), ("r", 2016, 2, "b", "two")], "region string, year int, src_row int, item_name string, body string")
    links = spark.createDataFrame([("r", 2016, 2, 1)], "region string, year int, src_row int, target_row int")
    once = C.merge_continuations(df, links)
    assert rows(once.select("src_row", "body"), "src_row") == [(1, "one two"), (2, "two")]
    assert rows(C.merge_continuations(once, links).select("body"), "body")[0] == ("one two",)
    rules = spark.createDataFrame([(1, None, "r", 1, 1, None, None, "x"), (2, None, None, None, None, None, "^a", "y")], "priority int, year int, region string, row_lo int, row_hi int, name string, regex string, new_type string")
    assert rows(C.apply_row_type_rules(df.withColumn("row_type", F.lit("leaf")), rules).select("src_row", "row_type"), "src_row") == [(1, "y"), (2, "leaf")]
    alias, pre = spark.createDataFrame([("Seoul", "S")], "alias string, region string"), spark.createDataFrame([("Bu", "B"), ("Busan", "BB")], "prefix string, region string")
    got = C.map_region(spark.createDataFrame([("Seoul",), ("Busan 1",), ("Bux",), ("none",), (None,)], "addr string"), "addr", alias, pre)
    assert {r["addr"]: r["region"] for r in got.collect()} == {"Seoul": "S", "Busan 1": "BB", "Bux": "B", "none": None, None: None}


def test_labels_and_texts(spark):
    df = spark.createDataFrame([("p", "r", "confirmed", None), ("p", "r", None, "note"), ("p", "r", None, None), (None, None, None, None)], "pred_label string, review_label string, status string, note string")
    out = C.select_label(df, spark.createDataFrame([("p", "P"), ("r", "R")], "child string, parent string"))
    assert sorted((r["label_source"], r["label"], r["parent"]) for r in out.collect()) == sorted([("reviewed", "r", "R"), ("reviewed", "r", "R"), ("predicted", "p", "P"), ("unassigned", None, None)], key=str)
    with pytest.raises(V.CheckFailed, match="blank"):
        C.build_text(spark.createDataFrame([(" ", "x")], "a string, b string"), ["a", "b"], ["a"])
    with pytest.raises(V.CheckFailed):
        C.harmonize(spark.createDataFrame([(1, 2)], "a int, b int"), {"x": ["a", "b"]})
    with pytest.raises(V.CheckFailed, match="holds text"):
        C.parse_numeric_strict(spark.createDataFrame([("1",), ("x",)], "a string"), "a")


def test_reshape(spark):
    df = spark.createDataFrame([("a", 1.0, None)], "region string, `2019년` double, `2020년` double")
    assert rows(R.unpivot_years(df, ["region"]), "year") == [("a", 2019, 1.0, True, "observed"), ("a", 2020, None, False, "missing")]
    long = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)], "k string, g string, v double")
    with pytest.raises(V.CheckFailed, match="incomplete"):
        R.pivot_strict(long, ["k"], "g", "v", ["x", "y"])
    assert rows(R.pivot_strict(long.where("k = 'a'"), ["k"], "g", "v", ["x", "y"]), "k") == [("a", 1.0, 2.0)]
    assert [r[0] for r in R.order_by_list(long, "g", ["y", "x"], "k").select("g").collect()] == ["y", "x", "x"]


def test_audit_makes_its_flags_once(spark):
    df = spark.range(6).select("id", F.when(F.col("id") % 2 == 0, "10 apples").otherwise("plain").alias("a"), F.lit("9 apples").alias("b"))
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    got = C.reason_histogram(C.audit_candidates(df, "a", "b"))
    assert plan(got) == plan(df.select(X.preservation_flags(F.col("a"), F.col("b")).alias("flags"))) > 0
    assert {r["reason"]: r["n"] for r in got.collect()} == {"numbers differ": 6, "quantities differ": 6}
