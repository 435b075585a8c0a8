import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import aggregates as A
from gridloom.operators import impute as M
from gridloom.operators import index as I
from gridloom.operators import joins as J
from gridloom.operators import panelstats as S
from gridloom.operators import windows as W
from gridloom.operators.checks import CheckFailed
from gridloom.operators.graph import connected_components
from tests.conftest import rows


def series(spark, values, blocked=(), start=2019):
    data = [("i", "r", start + k, v, k in blocked) for k, v in enumerate(values)]
    return spark.createDataFrame(data, "indicator_id string, region string, year int, value double, blocked boolean")


def filled(spark, values, blocked=(), **kw):
    out = M.impute_series(series(spark, values, blocked), ["indicator_id", "region"], **kw)
    return [(r["position"], r["value_filled"]) for r in out.orderBy("year").collect()]


def test_interpolation(spark):
    assert [v for _, v in filled(spark, [1.0, None, None, 4.0])] == [1.0, 2.0, 3.0, 4.0]
    assert filled(spark, [None, 2.0, None, 4.0, None]) == [("leading", 2.0), ("observed", 2.0), ("intermediate", 3.0), ("observed", 4.0), ("trailing", 4.0)]
    assert [v for _, v in filled(spark, [None, 2.0, 4.0, None], leading="exclude", trailing="exclude")] == [None, 2.0, 4.0, None]
    assert [v for _, v in filled(spark, [None, 2.0, 4.0, None], leading="trend", trailing="trend")] == pytest.approx([0.0, 2.0, 4.0, 6.0])


def test_blocked_cells_cut_the_series(spark):
    got = filled(spark, [1.0, None, None, None, 5.0], blocked=[2])
    assert got == [("observed", 1.0), ("intermediate", None), ("structural", None), ("intermediate", None), ("observed", 5.0)]
    assert filled(spark, [None, 3.0, None]) == [("single year", None), ("observed", 3.0), ("single year", None)]
    assert filled(spark, [None, None]) == [("all missing", None)] * 2


def test_user_trend(spark):
    out = M.impute_series(series(spark, [None, 2.0, 4.0]), ["indicator_id", "region"], leading="trend", trend=lambda seen, years: [9.0 for _ in years])
    assert [r["value_filled"] for r in out.orderBy("year").collect()] == [9.0, 2.0, 4.0]


def test_joins(spark):
    l, r = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert rows(J.join_checked(l, r, ["k"]), "k") == [(1, "a", True), (2, None, False)]
    with pytest.raises(CheckFailed, match="partner"):
        J.join_checked(l, r, ["k"], on_unmatched="fail")
    with pytest.raises(CheckFailed, match="right side"):
        J.join_checked(l, r.unionByName(r), ["k"])
    panel = spark.createDataFrame([(1, None), (2, 5.0)], "k int, value double")
    upd = spark.createDataFrame([(1, 3.0)], "k int, new_value double")
    out, audit = J.guarded_update(panel, upd, ["k"])
    assert rows(out, "k") == [(1, 3.0), (2, 5.0)] and audit.count() == 1
    with pytest.raises(CheckFailed, match="guard"):
        J.guarded_update(panel, spark.createDataFrame([(2, 3.0)], "k int, new_value double"), ["k"])
    with pytest.raises(CheckFailed, match="without a row"):
        J.guarded_update(panel, spark.createDataFrame([(9, 3.0)], "k int, new_value double"), ["k"])


def test_corrections_are_idempotent(spark):
    t = spark.createDataFrame([(1, "old"), (2, "x")], "k int, body string")
    rules = spark.createDataFrame([(1, "old", "new")], "k int, before string, after string")
    out = J.apply_corrections({"wide": (t, 1)}, rules, ["k"], "body")["wide"]
    assert rows(out, "k") == [(1, "new"), (2, "x")]
    assert rows(J.apply_corrections({"wide": (out, 1)}, rules, ["k"], "body")["wide"], "k") == rows(out, "k")
    with pytest.raises(CheckFailed):
        J.apply_corrections({"wide": (t.where("k = 2"), 1)}, rules, ["k"], "body")


def test_anchored_match(spark):
    l = spark.createDataFrame([("r", i, v) for i, v in enumerate("abca")], "region string, src_row int, v string")
    r = spark.createDataFrame([("r", 10 + i, v) for i, v in enumerate("abca")], "region string, src_row int, v string")
    got = {x["l_row"]: (x["r_row"], x["how"]) for x in J.anchored_match(l, r, "v").collect()}
    assert got == {0: (10, "anchored"), 1: (11, "unique"), 2: (12, "unique"), 3: (13, "anchored")}


def test_anchored_match_of_frequent_values(spark):
    """One value in nearly all rows: as many pairs as 160 million, of which each bound leaves one, none or several."""
    rng = np.random.default_rng(3)
    v = [f"u{i}" if i % 3 == 1 else "same" if rng.random() < 0.9 else "other" for i in range(20_000)]
    at = (np.arange(20_000) + rng.integers(0, 2, 20_000)).tolist()  # right places, some of them shared
    l = spark.createDataFrame([("r", i, x) for i, x in enumerate(v)] + [("r", 20_000 + i, None) for i in range(3)], "region string, src_row int, v string")
    r = spark.createDataFrame([("r", int(i), x) for i, x in zip(at, v, strict=True)] + [("r", 30_000, None)], "region string, src_row int, v string")
    began = time.perf_counter()
    out = J.anchored_match(l, r, "v")
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Join" in x and "c_row" in x for x in plan)  # no pairs of equal rows that bounds pick from
    got = {x["l_row"]: (x["r_row"], x["how"]) for x in out.collect()}
    assert time.perf_counter() - began < 40
    unique = {i: at[i] for i, x in enumerate(v) if x[0] == "u"}
    want = {i: (k, "unique") for i, k in unique.items()}
    held = {}
    for i, x in zip(at, v, strict=True):
        held.setdefault(x, []).append(i)
    held = {x: np.sort(k) for x, k in held.items()}
    for i, x in enumerate(v):
        if i not in unique:
            lo = next((unique[k] for k in range(i - 1, -1, -1) if k in unique), -(2**62))
            hi = next((unique[k] for k in range(i + 1, len(v)) if k in unique), 2**62)
            some = held[x][np.searchsorted(held[x], lo, "right") : max(np.searchsorted(held[x], lo, "right"), np.searchsorted(held[x], hi, "left"))]
            if len(some) == 1:
                want[i] = (int(some[0]), "anchored")
    assert got == want and len({h for _, h in want.values()}) == 2


def test_progress_and_near_duplicates(spark):
    old = spark.createDataFrame([(2020, 1, "x", "confirmed", None), (2021, 1, " ", None, None)], "year int, k int, review_label string, status string, note string")
    new = spark.createDataFrame([(2020, 1, None, None, "keep"), (2021, 1, "y", None, None)], "year int, k int, review_label string, status string, note string")
    assert rows(J.transfer_progress(old, new, ["year", "k"]), "year") == [(2020, 1, "x", "confirmed", "keep"), (2021, 1, "y", None, None)]
    items = spark.createDataFrame([("a", 1, "청년 월세 지원 사업"), ("a", 2, "청년월세지원사업"), ("a", 3, "청년 월세 지원사엄"), ("b", 4, "청년 월세 지원 사엄")], "p string, id int, name string")
    got = J.near_duplicates(items, ["p"], "name", "id", 80)
    assert {tuple(sorted((r["id1"], r["id2"]))) for r in got.collect()} == {(1, 3), (2, 3)}


def test_subtotals(spark):
    data = [("r", "A", "m1", "medium_subtotal", 10.0, "m1"), ("r", "A", "m1", "leaf", 4.0, "x"), ("r", "A", "m1", "leaf", 6.0, "y"), ("r", "A", "m2", "medium_subtotal", 0.0, "m2"), ("r", "A", "m2", "leaf", 1.0, "z"), ("r", None, "m3", "leaf", None, "w"), ("r", "A", "m1", "other", 11.0, "소계")]
    df = spark.createDataFrame(data, "region string, major_head string, medium_head string, row_type string, b double, item_name string")
    got = {r["medium_head"]: r for r in A.subtotal_qa(df, "b").collect()}
    assert (got["m1"]["result"], got["m1"]["tolerance_result"]) == ("match", "allowed")
    assert (got["m2"]["rate"], got["m2"]["undetermined_reason"]) == (None, "subtotal is 0, no rate")
    assert got["m3"]["undetermined_reason"] == "no subtotal row"
    labelled = {r["medium_head"]: r for r in A.subtotal_qa(df, "b", labels=["소계"]).collect()}
    assert (labelled["m1"]["subtotal"], labelled["m1"]["subtotal_source"], labelled["m1"]["rate"]) == (11.0, "label", -9.09)


def test_windows(spark):
    df = spark.createDataFrame([("a", y, float(v)) for y, v in ((1, 1), (2, 2), (3, 4), (5, 8))], "g string, year int, v double")
    assert [r["v_diff"] for r in W.yoy(df, ["g"], "year", "v").orderBy("year").collect()] == [None, 1.0, 2.0, None]
    assert [r["m"] for r in W.rolling(df, ["g"], "year", "v", 3, "m").orderBy("year").collect()] == [None, None, pytest.approx(7 / 3), pytest.approx(14 / 3)]
    ties = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, None)], "k int, v double")
    assert [r["rank"] for r in W.rank_min(ties, [], "v").orderBy("k").collect()] == [1, 1, 3, None]
    with pytest.raises(CheckFailed, match="variance"):
        W.zscore(ties.where("k < 3"), "v")
    ranks = spark.createDataFrame([(float(i),) for i in range(1, 18)], "r double")
    counts = {r["bin"]: r["count"] for r in W.qcut(ranks, "r", ["low", "mid", "high"]).groupBy("bin").count().collect()}
    assert counts == {"low": 6, "mid": 5, "high": 6}


def index_rows(spark):
    data = [(r, y, i, "c", "s", d, float(v)) for y in (1, 2) for r, v in (("a", 1), ("b", 2), ("c", 4), ("national", 99)) for i, d in (("p", "positive"), ("n", "negative"))]
    return spark.createDataFrame(data, "region string, year int, indicator_id string, category string, subcategory string, direction string, value double")


def test_index(spark):
    w = spark.createDataFrame([("p", 0.5), ("n", 0.5)], "indicator_id string, weight double")
    sc = I.standardize(index_rows(spark))
    got = {(r["region"], r["indicator_id"]): r["directional_score"] for r in sc.where("year = 1").collect()}
    assert got[("c", "p")] == 100.0 and got[("c", "n")] == 0.0 and ("national", "p") not in got
    final = I.compute_index(sc, w).final
    assert {r["index_score"] for r in final.collect()} == {50.0} and {r["rank"] for r in final.collect()} == {1}
    with pytest.raises(CheckFailed, match="sum to"):
        I.compute_index(sc, w.withColumn("weight", F.lit(0.4)))
    with pytest.raises(CheckFailed, match="incomplete"):
        I.compute_index(sc.where("not (region = 'a' and indicator_id = 'p')"), w)
    cpi = spark.createDataFrame([(1, 95.718), (2, 100.0)], "year int, cpi double")
    real = I.deflate(index_rows(spark).withColumn("value", F.lit(95.718)), cpi, ["p"]).where("indicator_id = 'p' and year = 1")
    assert real.first()["value"] == pytest.approx(100.0)
    moved = I.transfer_weight(index_rows(spark).where("region <> 'national'"), w, "n", "p", [2])
    assert moved.indicators.where("transferred").count() == 3


def test_fixed_effects_match_dense_regression(spark):
    rng = np.random.default_rng(4)
    data = []
    for g in range(8):
        for t in range(6):
            if (g, t) in ((0, 0), (3, 5)):
                continue
            x = rng.normal() + g * 0.3
            data.append((f"r{g}", 2000 + t, x, 2.0 * x + g + 0.5 * t + rng.normal() * 0.1))
    df = spark.createDataFrame(data, "region string, year int, x double, y double")
    out = S.two_way_fe(df, "y", "x").first()
    regions, years = sorted({d[0] for d in data}), sorted({d[1] for d in data})
    a = np.array([[d[2]] + [float(d[0] == r) for r in regions] + [float(d[1] == y) for y in years[1:]] for d in data])
    y = np.array([d[3] for d in data])
    inv = np.linalg.inv(a.T @ a)
    beta = inv @ a.T @ y
    e = y - a @ beta
    meat = sum(np.outer(s, s) for s in (a[[i for i, d in enumerate(data) if d[0] == r]].T @ e[[i for i, d in enumerate(data) if d[0] == r]] for r in regions))
    g, n, k = len(regions), len(data), a.shape[1]
    se = np.sqrt((g / (g - 1) * (n - 1) / (n - k) * inv @ meat @ inv)[0, 0])
    assert out["coef"] == pytest.approx(beta[0]) and out["se"] == pytest.approx(se) and abs(out["coef"] - 2) < 0.1
    assert (out["resid_df"], out["inference_df"]) == (n - k, g - 1)
    slopes = S.region_slopes(df, "y", "x")
    assert slopes.count() == 8 and slopes.where("abs(slope - 2) < 1").count() == 8
    loo = S.leave_one_out(df, "y", "x")
    assert loo.count() == 9 and loo.where("omitted is null").first()["coef"] == pytest.approx(beta[0])
    lone = S.two_way_fe(df.withColumn("x", F.lit(1.0)), "y", "x").first()
    assert lone["coef"] is None and lone["note"] == "no variation"


def test_t_distribution():
    assert S.t_cdf(2.228, 10) == pytest.approx(0.975, abs=1e-4)
    assert S.t_cdf(1.0, 1) == pytest.approx(0.75)
    assert S.t_quantile(0.975, 5) == pytest.approx(2.5706, abs=1e-3)


def test_bh_and_psi(spark):
    df = spark.createDataFrame([("f", 0.01), ("f", 0.04), ("f", 0.03), ("f", None)], "fam string, p double")
    assert [round(r["q"], 4) if r["q"] is not None else None for r in S.bh(df, ["fam"]).orderBy(F.col("p").asc_nulls_last()).collect()] == [0.03, 0.04, 0.04, None]
    a = spark.range(1000).select((F.rand(1) + F.rand(2)).alias("v"))
    assert S.psi(a, a, "v").first()["psi"] == pytest.approx(0)
    assert S.psi(a, a.select((F.col("v") + 5).alias("v")), "v").first()["psi"] > 0.2


def test_bh_of_large_families(spark):
    """60,000 different p of one family, with ties, nulls and a null family, in linear work."""
    n = 60_000
    df = spark.range(n).select("id", F.when(F.col("id") % 7 > 0, "f").alias("fam"), F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64((F.col("id") / 2).cast("long")), F.lit(10**9)) / F.lit(1e9)).alias("p"))
    began = time.perf_counter()
    got = S.bh(df, ["fam"]).toPandas()
    assert time.perf_counter() - began < 30 and len(got) == n and (got["q"].isna() == got["p"].isna()).all()
    for _, g in got[got["p"].notna()].groupby("fam", dropna=False):
        g = g.sort_values("p")
        raw = g["p"].to_numpy() * len(g) / np.arange(1, len(g) + 1)
        assert np.allclose(np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1), g["q"].to_numpy(), rtol=1e-12)
        assert (g["reject"] == (g["q"] <= 0.05)).all()


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (8, 7), (7, 9), (1, 1), (None, 2)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert got == {5: 2, 4: 2, 3: 2, 2: 2, 9: 7, 8: 7, 7: 7}
    chain = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r["component"] for r in connected_components(chain).collect()} == {0}
    assert connected_components(e.where("false")).count() == 0


def test_long_axes_are_absorbed_as_a_dense_regression(spark, monkeypatch):
    rng = np.random.default_rng(8)
    regions, years = 6, 2000
    data = []
    for m in (0, 1):
        held = rng.random((regions, years)) < (0.8 if m else 0.6)
        for i, t in zip(*np.nonzero(held), strict=True):
            x, w = rng.normal() + 0.01 * t * (i % 2), rng.normal()
            data.append((m, f"r{i}", int(t), float(x), float(w), float((0.5 + m) * x - 0.2 * w + i + np.sin(t) + 0.3 * rng.normal())))
    df = spark.createDataFrame(data, "model int, region string, year int, x double, w double, y double")
    got = {r["model"]: r for r in S.two_way_fe(df, "y", "x", ["w"], by=["model"]).collect()}
    for m in (0, 1):
        rows = [r for r in data if r[0] == m]
        g, t = np.array([int(r[1][1:]) for r in rows]), np.array([r[2] for r in rows])
        seen = np.unique(t)
        z = np.column_stack([[r[3] for r in rows], [r[4] for r in rows], np.eye(regions)[g], (t[:, None] == seen[None, 1:]).astype(float)])
        y = np.array([r[5] for r in rows])
        beta, *_ = np.linalg.lstsq(z, y, rcond=None)
        e = y - z @ beta
        bread = np.linalg.inv(z.T @ z)
        meat = sum(np.outer(z[g == i].T @ e[g == i], z[g == i].T @ e[g == i]) for i in range(regions))
        n, k = z.shape
        cov = regions / (regions - 1) * (n - 1) / (n - k) * bread @ meat @ bread
        assert got[m]["coef"] == pytest.approx(beta[0], rel=1e-8) and got[m]["se"] == pytest.approx(np.sqrt(cov[0, 0]), rel=1e-7)
        assert got[m]["resid_df"] == n - k and got[m]["n_years"] == len(seen)


def test_absorbing_gives_the_same_models_and_notes_as_dummies(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = [("all", f"r{i}", t, float(rng.normal()), float(rng.normal())) for i in range(5) for t in range(8) if (i + t) % 5]
    data += [("flat", f"r{i}", t, 1.0, float(rng.normal())) for i in range(3) for t in range(4)]
    data += [("apart", f"r{i}", t + 10 * (i % 2), float(rng.normal()), float(rng.normal())) for i in range(4) for t in range(4)]
    data += [("by year", f"r{i}", t, float(t), float(rng.normal())) for i in range(3) for t in range(4)] + [("one", "r", t, float(t), float(t)) for t in range(3)]
    df = spark.createDataFrame(data, "m string, region string, year int, x double, y double")
    want = {r["m"]: r for r in S.two_way_fe(df, "y", "x", by=["m"]).collect()}
    monkeypatch.setattr(S, "LONG_AXIS", 0)
    got = {r["m"]: r for r in S.two_way_fe(df, "y", "x", by=["m"]).collect()}
    assert set(got) == set(want) and want["all"]["note"] is None and want["apart"]["note"] == "rank deficient"
    for m in want:
        for c in want[m].asDict():
            assert got[m][c] == (pytest.approx(want[m][c], rel=1e-8) if isinstance(want[m][c], float) else want[m][c]), (m, c)
