import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import quantiles as Q
from gridloom.operators import windows as W
from gridloom.operators.aggregates import distribution_summary
from gridloom.operators.joins import containment_matches
from gridloom.operators.ranges import carry_forward
from gridloom.operators.rows import apply_row_type_rules, realign_headings


def values():
    rng = random.Random(1)
    out = {"heavy": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(150)], "ties": [float(rng.randint(0, 3)) for _ in range(100)], "one": [7.5], "two": [1.0, 2.0]}
    out |= {"narrow": [1e15 + k % 31 for k in range(120)], "odd": [float("inf"), float("-inf"), 0.0, -0.0, 5e-324, -5e-324, 1.0, float("inf")], "none": [None, None], None: [3.0, 1.0, None]}
    return [(k, v) for k, xs in out.items() for v in xs]


@pytest.mark.parametrize("few", [1, 40])
def test_quantiles_equal_sorting(spark, monkeypatch, few):
    monkeypatch.setattr(Q, "FEW", few)
    data = values()
    df = spark.createDataFrame(data, "k string, x double").repartition(6)
    probs = [0.0, 0.1, 0.25, 0.5, 1 / 3, 0.99, 1.0]
    exact = F.percentile("x", F.array(*[F.lit(p) for p in probs]))
    for keys in (["k"], []):
        some = df if keys else df.where("k <> 'odd'")
        want = {r[0]: r[1] for r in (some.groupBy("k").agg(exact) if keys else some.select(F.lit(0), "x").groupBy("0").agg(exact)).collect()}
        got = {(r["k"] if keys else 0): r["_q"] for r in Q.exact_quantiles(some, "x", probs, keys).collect()}
        assert set(got) == set(want)
        for k in want:
            assert got[k] == pytest.approx(want[k], rel=1e-12, nan_ok=True) if want[k] else got[k] is None
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "x double")
    low, high = Q.exact_quantiles(nan, "x", [0.5, 1.0]).first()["_q"]
    assert low == 2.0 and np.isnan(high)
    assert Q.exact_quantiles(df.where("false"), "x", [0.5]).first()["_q"] is None and Q.exact_quantiles(df.where("false"), "x", [0.5], ["k"]).count() == 0


def test_no_percentile_and_no_gathering(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 1000).cast("double").alias("value"))
    for out in (W.iqr_flag(df, ["k"], "value"), W.qcut(df, "value", ["a", "b", "c"]), distribution_summary(df, ["k"])):
        assert "percentile" not in out._jdf.queryExecution().executedPlan().toString()
    frame = df.toPandas()
    want = frame.groupby("k")["value"].quantile([0.25, 0.5, 0.75]).unstack()
    for r in distribution_summary(df, ["k"]).collect():
        assert [r["q1"], r["median"], r["q3"]] == pytest.approx(want.loc[r["k"]].tolist())
    bins = pd.qcut(frame["value"], 3, labels=["a", "b", "c"]).value_counts().to_dict()
    assert {r["bin"]: r["count"] for r in W.qcut(df, "value", ["a", "b", "c"]).groupBy("bin").count().collect()} == bins


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_carry_crosses_ranges(spark, ranges):
    rng = random.Random(ranges)
    # One part holds nearly all rows, so it spans most ranges; another has no value at all, one is null.
    data = [("hot", i, rng.choice([None] * 30 + ["h"]) and f"h{i}", None if i < 400 else "late" if i == 400 else None) for i in range(2000)]
    data += [("none", i, None, None) for i in range(50)] + [(None, i, "n" if i == 3 else None, None) for i in range(20)] + [("a", 1, "x", "y"), ("a", 2, None, None)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "part string, pos int, a string, b string")
    got = {(r["part"], r["pos"]): (r["a"], r["b"]) for r in carry_forward(df, ["part"], "pos", ["a", "b"], ranges=ranges).collect()}
    last = {}
    for part, pos, a, b in sorted(data, key=lambda r: (r[0] or "", r[1])):
        old = last.get(part, (None, None))
        last[part] = (a or old[0], b or old[1])
        assert got[part, pos] == last[part]
    assert len(got) == len(data)


def test_headings_use_no_window_over_regions(spark):
    df = spark.createDataFrame([("r", i, "[ topic ]" if i == 5 else f"item {i}", "major", "medium") for i in range(40)] + [("s", 1, "x", "M", "m")], "region string, src_row int, item_name string, major_head string, medium_head string")
    out = realign_headings(df, pattern=r"^\[(.*)\]$")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert all("_range" in line.split("[", 1)[1] for line in plan.splitlines() if " Window [" in line)
    got = {(r["region"], r["src_row"]): (r["major_head"], r["medium_head"]) for r in out.collect()}
    assert got["r", 4] == (None, "major") and got["r", 6] == ("topic사업", "major") and got["s", 1] == ("M", "m")


RULES = "priority int, year int, region string, row_lo long, row_hi long, name string, regex string, new_type string"


def test_rules_equal_one_by_one(spark):
    rng = random.Random(9)
    data = [(rng.choice(["r", "s", "t"]), rng.choice([2020, 2021]), i, rng.choice([" one", "two ", "three 7", "four", "five 7", None])) for i in range(700)]
    rules = []
    for p in range(60):
        lo = rng.choice([None, rng.randint(0, 700)])
        hi = rng.choice([None, (lo or 0) + rng.choice([0, 1, 3, 40, 500])])
        rules.append((p, rng.choice([None, 2020, 2021, 1999]), rng.choice([None, "r", "s", "q"]), lo, hi, rng.choice([None, None, "one", "two"]), rng.choice([None, None, "7$", "^f"]), f"t{p}"))
    rules = [r for r in rules if any(x is not None for x in r[1:7])]
    rules += [(100, None, None, None, None, None, "five", "free"), (101, None, None, 20, 10, None, None, "empty range"), (102, None, None, 690, None, None, None, "tail")]

    def fits(row, rule):
        import re

        region, year, at, name = row
        _, y, g, lo, hi, n, rx, _ = rule
        return (y is None or y == year) and (g is None or g == region) and (lo is None or at >= lo) and (hi is None or at <= hi) and (n is None or (name or "").strip() == n) and (rx is None or (name is not None and bool(re.search(rx, name))))

    df = spark.createDataFrame(data, "region string, year int, src_row int, item_name string").withColumn("row_type", F.lit("leaf"))
    out = apply_row_type_rules(df, spark.createDataFrame(rules, RULES))
    got = {(r["region"], r["year"], r["src_row"]): r["row_type"] for r in out.collect()}
    assert len(got) == len(data)
    for row in data:
        hit = [r for r in rules if fits(row, r)]
        assert got[row[:3]] == (max(hit)[-1] if hit else "leaf")
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()
    assert apply_row_type_rules(df, spark.createDataFrame([], RULES)).where("row_type = 'leaf'").count() == len(data)
    every = apply_row_type_rules(df, spark.createDataFrame([(1, None, None, None, None, None, None, "all")], RULES))
    assert every.where("row_type = 'all'").count() == len(data)


def test_containment_equals_every_pair(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", "a"]
    names = sorted({"".join(rng.choice("abcd ") for _ in range(rng.randint(1, 6))) for _ in range(400)}) + ["", "zzz"]
    df = spark.createDataFrame([(i, t, rng.choice(["x", None])) for i, t in enumerate(texts)], "id int, t string, truth string")
    alias = spark.createDataFrame([(n, f"g{i % 5}") for i, n in enumerate(names)] + [("a", "g0"), (None, "g1")], "alias string, region string")
    out = containment_matches(df, "t", alias, "truth")
    got = sorted((r["id"], r["alias"], r["alias_region"]) for r in out.collect())
    pairs = [(n, f"g{i % 5}") for i, n in enumerate(names)] + [("a", "g0")]
    assert got == sorted((i, n, g) for i, t in enumerate(texts) if t is not None for n, g in pairs if n in t)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    many = spark.range(10_000).select(F.concat(F.lit("n"), F.hex(F.xxhash64("id"))).alias("alias"), F.col("id").cast("string").alias("region"))
    big = many.select(F.concat(F.lit("at "), "alias", F.lit(" street")).alias("t"), F.col("region").alias("truth"))
    assert containment_matches(big, "t", many, "truth").where("not false_match").count() == 10_000
