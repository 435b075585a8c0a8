"""Index input, ranges without a global window, near names and models that leave a region out, against plain rules."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import index as I
from gridloom.operators import panelstats as S
from gridloom.operators.checks import CheckFailed, grid
from gridloom.operators.graph import connected_components
from gridloom.operators.joins import near_duplicates
from gridloom.operators.ranges import running_total
from gridloom.operators.rows import adjacent_duplicates
from gridloom.operators.text_groups import representative_texts

KINDS = "region string, year int, indicator_id string, category string, subcategory string, direction string, value double"


def rows_of(**change):
    out = []
    for k, (r, y, i) in enumerate(itertools.product(("a", "b", "c"), (2000, 2001), ("p", "q"))):
        row = {"region": r, "year": y, "indicator_id": i, "category": "A", "subcategory": "s", "direction": "positive" if i == "p" else "-", "value": float(k * k % 7)}
        if k == 0:
            row |= change
        out.append(tuple(row.values()))
    return out


@pytest.mark.parametrize("change", [{"value": None}, {"value": float("nan")}, {"value": float("inf")}, {"direction": "sideways"}, {"direction": None}, {"direction": "center_or_positive"}, {"direction": "negative"}, {"region": None}, {"region": "b"}])
def test_index_input_is_refused(spark, change):
    df = spark.createDataFrame(rows_of(**change), KINDS)
    with pytest.raises(CheckFailed):
        I.standardize(df)


def test_index_input_and_grid(spark):
    df = spark.createDataFrame(rows_of(), KINDS)
    good = I.standardize(df).where("indicator_id = 'q'").agg(F.min("directional_score"), F.max("directional_score")).first()
    assert tuple(good) == (0.0, 100.0)
    want = {"regions": ["a", "b", "c"], "years": [2000, 2001], "indicators": ["p", "q"]}
    assert I.validate_index_input(df, **want) is df
    for change in ({"regions": ["a", "b"]}, {"years": [2000, 2001, 2002]}, {"indicators": ["p"]}, {"need_national": True}):
        with pytest.raises(CheckFailed):
            I.validate_index_input(df, **{**want, **change})
    I.validate_index_input(df, **{**want, "years": [2000, 2001, 2002]}, strict_grid=False)
    # Unchecked, a missing value has no score instead of the best one.
    holes = spark.createDataFrame(rows_of(value=None), KINDS)
    assert I.standardize(holes, check=False).where("value is null").first()["directional_score"] is None


def test_grid_is_one_row_unfolded(spark):
    g = grid(spark, {"region": ["a", "b"], "year": [1, 2, 3]})
    assert g.count() == 6 and "Cartesian" not in g._jdf.queryExecution().executedPlan().toString()


def test_running_total_and_neighbours(spark):
    rng = random.Random(4)
    data = [(i, rng.randint(0, 3), rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(data, "k int, kind int, n int").repartition(7)
    got = {r["k"]: r["upto"] for r in running_total(df, "k", "n", "upto").collect()}
    assert got == dict(zip(range(3000), np.cumsum([n for _, _, n in data]).tolist(), strict=True))
    twins = [r["k"] for r in adjacent_duplicates(df.drop("n"), "k").collect()]
    assert sorted(twins) == [i for i in range(1, 3000) if data[i][1] == data[i - 1][1]]


def indel(x, y):
    row = [0] * (len(y) + 1)
    for c in x:
        before = 0
        for j, e in enumerate(y):
            before, row[j + 1] = row[j + 1], before + 1 if c == e else max(row[j + 1], row[j])
    return 200.0 * row[-1] / (len(x) + len(y))


@pytest.mark.parametrize("threshold", [60, 70, 80, 90, 95])
def test_near_names_equal_all_pairs(spark, threshold):
    rng = random.Random(threshold)
    names = set()
    for size in (2, 3, 4, 6, 8, 9, 12, 20, 30):
        base = [rng.choice("abcdef") for _ in range(size)]
        for edits in (0, 1, 1, 2, 3, 4):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(["", "x", "ab", rng.choice("abcdef")])
            names.add("".join(copy) or "z")
    names = sorted(names)
    df = spark.createDataFrame([("p", i, n) for i, n in enumerate(names)], "part string, id int, name string")
    got = {tuple(sorted((r["id1"], r["id2"]))) for r in near_duplicates(df, ["part"], "name", "id", threshold).collect()}
    want = {(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if indel(names[i], names[j]) >= threshold}
    assert got == want and len(want) >= 5


def test_leave_one_out_equals_fits_without_the_region(spark):
    rng = np.random.default_rng(3)
    data = [(f"r{i}", 2000 + t, float(x), float(0.3 * x + i + t + rng.normal())) for i in range(6) for t in range(5) if (i, t) != (2, 3) for x in [rng.normal()]]
    df = spark.createDataFrame(data, "region string, year int, x double, y double")
    got = {r["omitted"]: r for r in S.leave_one_out(df, "y", "x").collect()}
    for name in [None, *(f"r{i}" for i in range(6))]:
        want = S.two_way_fe(df if name is None else df.where(F.col("region") != name), "y", "x").first()
        for c in ("coef", "se", "n", "n_regions", "resid_df"):
            assert got[name][c] == pytest.approx(want[c], rel=1e-9)


def test_long_chains_are_settled(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "src int, dst int")
    assert {r["component"] for r in connected_components(links).collect()} == {0}
    # Every text is like its neighbours only, so each representative takes one.
    words = [f"w{i}x{i}y" for i in range(40)]
    texts = [(" ".join(words[k : k + 8]), 100 - k) for k in range(30)]
    df = spark.createDataFrame([("", t, n) for t, n in texts], "part string, text string, n int")
    out = representative_texts(df, 0.6).toPandas()
    assert out["rep"].notna().all() and set(out["rep"]) <= set(out["text"])
