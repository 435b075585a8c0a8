import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import learning as L
from gridloom.operators import text_groups as T
from gridloom.operators.checks import CheckFailed
from gridloom.sources import tables as IO
from gridloom.streaming import incremental as E
from tests.conftest import rows


def sk_grams(text, lo, hi):
    out = []
    for w in text.lower().split():
        w = f" {w} "
        for n in range(lo, hi + 1):
            off = 0
            out.append(w[off : off + n])
            while off + n < len(w):
                off += 1
                out.append(w[off : off + n])
            if off == 0:
                break
    return out


@pytest.mark.parametrize("text", ["a", "ab cd", "Hello  World", "", "x yz abcdef"])
def test_char_ngrams(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(T.char_ngrams(F.col("t")).alias("g")).first()["g"]
    assert sorted(got) == sorted(sk_grams(text, 2, 5))


def test_tfidf_and_cosine(spark):
    docs = spark.createDataFrame([(1, "red bolt"), (2, "red bolt"), (3, "blue ring")], "id int, t string")
    w = T.tfidf(docs, "id", T.word_tokens(F.col("t")))
    idf = math.log(4 / 3) + 1
    assert [r["weight"] for r in w.where("doc_id = 1").collect()] == pytest.approx([idf / math.sqrt(2 * idf * idf)] * 2)
    assert rows(T.cosine_pairs(w, 0.9).select("a", "b", F.round("cosine", 6)), "a") == [(1, 2, 1.0)]


def greedy(pairs, items):
    """Sequential rule: by (-n, text); the first not yet taken represents and takes its neighbours."""
    order, rep = sorted(items, key=lambda x: (-x[1], x[0])), {}
    near = lambda a, b: (a, b) in pairs or (b, a) in pairs
    for t, _ in order:
        if t in rep:
            continue
        rep[t] = t
        for u, _ in order:
            if u not in rep and near(t, u):
                rep[u] = t
    return rep


def test_representatives_equal_the_sequential_rule(spark):
    words = ["youth rent support", "youth rent supports", "youth rental support", "farm visit", "farm visits", "city bus pass", "city bus passes now", "library"]
    items = [(w, 1 + (i * 7) % 3) for i, w in enumerate(words)]
    df = spark.createDataFrame([(*x, "") for x in items], "text string, n int, part string")
    keyed = df.withColumn("doc_id", F.struct("part", "text"))
    pairs = {(r["a"]["text"], r["b"]["text"]) for r in T.cosine_pairs(T.tfidf_by_part(keyed, 2, 5), 0.6).collect()}
    got = {r["text"]: r["rep"] for r in T.representative_texts(df, 0.6).collect()}
    assert pairs and got == greedy(pairs, items)


def test_groups_and_links(spark):
    df = spark.createDataFrame([(1, "youth rent support", "cash"), (2, "youth rent supports", "cash"), (3, "library", None), (4, " ", "x")], "id int, name string, body string")
    out = {r["id"]: r for r in T.group_by_representative(df, "id", "name", "body", 0.7, 0.7).collect()}
    assert out[1]["name_group"] == out[2]["name_group"] and out[1]["body_group"] == out[2]["body_group"]
    assert out[3]["mean_similarity"] == -1 and out[4]["name_group"] == "row 4"
    linked = {r["id"]: (r["group_id"], r["group_size"]) for r in T.connected_groups(df.where("id < 4"), "id", "name", 0.7).collect()}
    assert linked == {1: (1, 2), 2: (1, 2), 3: (2, 1)}


def test_classifier_round_trip(spark, tmp_path):
    data = [(i, f"{w} item {i % 5}", y, f"g{i % 4}") for i in range(60) for w, y in [("bolt", "metal") if i % 2 else ("bread", "food")]]
    df = spark.createDataFrame(data, "id int, text string, label string, grp string")
    clf = L.fit_text_classifier(df, "id", "text", "label", max_iter=15)
    got = L.predict_labels(clf, df, "id", "text", taxonomy=spark.createDataFrame([("metal", "hard"), ("food", "soft")], "child string, parent string"))
    assert got.where("pred_label <> label").count() == 0 and got.where("parent is null").count() == 0
    L.save_model(clf, f"file://{tmp_path}/m")
    again = L.load_model(spark, f"file://{tmp_path}/m")
    assert L.predict_labels(again, df, "id", "text").where("pred_label <> label").count() == 0
    folds = L.group_folds(df, "grp", "label", 2)
    assert folds.count() == 4 and folds.groupBy("fold").count().count() == 2
    with pytest.raises(CheckFailed):
        L.group_folds(df, "grp", "label", 9)


def test_classifier_shuffles_no_rows(spark, monkeypatch):
    """Features are made where the rows are, repeated texts are fitted once with the weight of all, and folds come to the rows."""
    whole, seen = L.materialize, {}

    def note(df, label="table", options=None):
        out = whole(df, label, options)
        seen[label] = (df._jdf.queryExecution().executedPlan().toString(), out.count())
        return out

    monkeypatch.setattr(L, "materialize", note)
    data = [(i, [None, "bolt one", "bolt two", "bread one", "bread two", ""][i % 6], ["food", "metal", "metal", "food", "food", "food"][i % 6], i % 4) for i in range(240)]
    df = spark.createDataFrame(data, "id int, text string, label string, grp int")
    clf = L.fit_text_classifier(df, "id", "text", "label", max_iter=20)
    assert seen["train"][1] == 6 and clf.idf.where("gram = ' b'").first()["idf"] == pytest.approx(math.log(241 / 161) + 1)
    got = L.predict_labels(clf, df, "id", "text")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 240 and got.where("pred_label <> label").count() == 0
    L.group_cv(df, "id", "text", "label", "grp", k=2, max_iter=5)
    assert "Exchange hashpartitioning" not in seen["cv"][0] and seen["cv"][0].count("Exchange") == seen["cv"][0].count("BroadcastExchange") and seen["cv"][1] == 240


def test_kmeans_profiles(spark):
    df = spark.createDataFrame([(i, float(i % 2) * 10 + i * 0.01, float(i % 2)) for i in range(20)], "id int, a double, b double")
    out, centres = L.kmeans_profiles(df, "id", ["a", "b"], 2)
    assert {(r["id"] % 2, r["cluster"]) for r in out.collect()} == {(0, 0), (1, 1)}
    assert [r["size"] for r in centres.orderBy("cluster").collect()] == [10, 10]
    assert L.silhouette(out, ["a", "b"]).first()[0] > 0.9


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "seoul_2020.csv").write_bytes("region,year,name\nseoul,2020,지원\n".encode("cp949"))
    df = IO.read_delimited(spark, f"file://{tmp_path}/in/seoul_2020.csv", "region string, year int, name string", "cp949")
    assert rows(df, "year") == [("seoul", 2020, "지원")]
    (tmp_path / "bom.csv").write_bytes("﻿a,b\n1,\n".encode())
    assert rows(IO.read_delimited(spark, f"file://{tmp_path}/bom.csv", encoding="utf-8-sig", all_string=True), "a") == [("1", "")]
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "seoul_2020.csv").write_text("region,year,v\nseoul,2020,1\n")
    want = spark.createDataFrame([("seoul", 2020)], "region string, year int")
    assert IO.read_keyed_files(spark, f"file://{tmp_path}/k", want, "region string, year int, v double", ["seoul", "busan"]).count() == 1
    with pytest.raises(CheckFailed, match="missing"):
        IO.read_keyed_files(spark, f"file://{tmp_path}/k", want.unionByName(spark.createDataFrame([("busan", 2020)], "region string, year int")), "region string, year int, v double", ["seoul", "busan"])
    back = IO.write_verified(df, f"file://{tmp_path}/out")
    assert back.count() == 1
    raw = spark.createDataFrame([("area", "rate", None, "other"), ("area", "2019년", "2020년", "2019년"), ("national", "1.0", "1.1", "9"), ("seoul", "2.0", "", "9")], "a string, b string, c string, d string").coalesce(1)
    regions, national = IO.two_row_header_to_long(raw, "rate")
    assert rows(regions, "year") == [("seoul", 2019, 2.0), ("seoul", 2020, None)] and national.count() == 2
    html = spark.createDataFrame([(1, "<table><tr><th>A</th></tr><tr><td>x &amp; y</td><td><b>z</b></td></tr></table><a href='?page=7'>7</a>")], "page_id int, html string")
    assert rows(IO.html_rows(html), "row_no") == [(1, 0, ["A"]), (1, 1, ["x & y", "z"])]
    assert IO.html_last_page(html).first()["last_page"] == 7


def test_reusable_run(spark, tmp_path):
    path = f"file://{tmp_path}/run"
    assert IO.reusable_run(spark, path, {"a": "1"}, {"k": 1}) is None
    IO.save_run(spark, path, {"a": "1"}, {"k": 1}, score=0.5)
    assert IO.reusable_run(spark, path, {"a": "1"}, {"k": 1})["score"] == 0.5
    assert IO.reusable_run(spark, path, {"a": "2"}, {"k": 1}) is None


def test_incremental_batches_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "a 1"), (2, "b 2"), (3, " ")], "id int, text string")
    empty = spark.createDataFrame([], "id int, source_sha string, refined string, status string, batch long")
    _, fresh, summary = E.incremental_apply(df, empty, lambda s: s, ["id"], "text", 0)
    assert {(r["status"], r["reused"]): r["n"] for r in summary.collect()} == {("success", False): 2, ("missing", False): 1}
    changed = df.withColumn("text", F.when(F.col("id") == 2, "b 3").otherwise(F.col("text")))
    _, _, again = E.incremental_apply(changed, fresh, lambda s: s.str.replace("3", "4"), ["id"], "text", 1)
    assert {(r["status"], r["reused"]): r["n"] for r in again.collect()} == {("success", True): 1, ("violation", False): 1, ("missing", False): 1}
    src, state = f"file://{tmp_path}/src", f"file://{tmp_path}/state"
    for _ in range(2):
        df.write.mode("append").parquet(src)
        E.stream_refine(spark.readStream.schema(df.schema).parquet(src), state, f"file://{tmp_path}/cp", lambda s: s, ["id"], "text").awaitTermination()
    got = E.latest_state(E.StateTable(state, ("id",)).read(df), ["id"])
    assert got.count() == 3 and got.where("status = 'success'").count() == 2


def test_state_follows_the_batch_and_survives_replays(spark, tmp_path):
    table = E.StateTable(f"file://{tmp_path}/state", ("id",), buckets=32, compact_every=4)
    kinds = "id long, text string, source_sha string, refined string, status string, batch long"
    full = lambda lo, hi, b, mark: spark.range(lo, hi).select("id", F.sha2(F.col("id").cast("string"), 256).alias("source_sha"), F.concat(F.lit(mark), F.col("id").cast("string")).alias("refined"), F.lit("success").alias("status"), F.lit(b).cast("long").alias("batch"))
    asked = spark.range(200).select("id", F.lit("t").alias("text"))
    assert table.read(asked).count() == 0 and table.read(asked).columns == [c.split()[0] for c in kinds.split(", ") if not c.startswith("text")]
    want = {}
    for b in range(10):
        lo = 13 * b
        # A batch that died before its commit record leaves files that nobody reads.
        full(0, 200, b, "lost").withColumn("bucket", table.bucket()).write.partitionBy("bucket").parquet(f"{table.path}/data/part=rows-{b}")
        assert {r["id"]: r["refined"] for r in E.latest_state(table.read(asked), ["id"]).collect()} == want
        table.append(full(lo, lo + 40, b, f"b{b} "), b)
        want |= {i: f"b{b} {i}" for i in range(lo, lo + 40)}
        assert {r["id"]: r["refined"] for r in E.latest_state(table.read(asked), ["id"]).collect()} == want
    live = table.commits(spark)
    assert [(r["batch"], r["merged"]) for r in live] == [(7, True), (8, False), (9, False)]
    one = table.read(asked.where("id = 150"))
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", one._jdf.queryExecution().executedPlan().toString())
    scanned = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in one.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert len(scanned) == 1


def test_stream_replays_change_nothing_and_only_the_first_failure_stops(spark, tmp_path):
    src, state = f"file://{tmp_path}/src", f"file://{tmp_path}/state"

    def run(checkpoint, fn):
        E.stream_refine(spark.readStream.schema("id int, text string").parquet(src), state, f"file://{tmp_path}/{checkpoint}", fn, ["id"], "text", buckets=8).awaitTermination()

    spark.createDataFrame([(1, "a  1"), (2, "b  2")], "id int, text string").write.mode("append").parquet(src)
    with pytest.raises(Exception, match="every row"):
        run("failed", lambda s: s.where(s == "never"))
    run("cp", lambda s: s.str.replace("  ", " "))
    table = E.StateTable(state, ("id",), 8)
    asked = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    first = sorted(map(tuple, table.read(asked).collect()))
    assert [r[2] for r in first] == ["a 1", "b 2"]
    run("lost", lambda s: s.str.upper())  # the checkpoint is gone: batch 0 comes again
    assert sorted(map(tuple, table.read(asked).collect())) == first
    spark.createDataFrame([(2, "b  2"), (3, "c  3")], "id int, text string").write.mode("append").parquet(src)
    run("cp", lambda s: s.where(s == "never"))  # a later batch may fail; what is known is used again
    last = {r["id"]: (r["refined"], r["status"]) for r in E.latest_state(table.read(asked), ["id"]).collect()}
    assert last == {1: ("a 1", "success"), 2: ("b 2", "success"), 3: (None, "failed")}


@pytest.mark.parametrize("t,hot", [(0.3, 2000), (0.6, 3), (0.95, 1)])
def test_cosine_pairs_equal_all_dot_products(spark, monkeypatch, t, hot):
    monkeypatch.setattr(T, "HOT", hot)
    monkeypatch.setattr(T, "MERGED", 50)
    rng = np.random.default_rng(int(t * 100))
    words = [f"w{i}" for i in range(60)]
    share = 1 / np.arange(1, 61)
    texts = [" ".join(rng.choice(words, size=int(rng.integers(1, 12)), p=share / share.sum())) for _ in range(220)] + ["w0 w1"] * 9 + ["", "alone"]
    df = spark.createDataFrame([(f"d{i}", x) for i, x in enumerate(texts)], "id string, t string")
    normed = T.tfidf(df, "id", T.word_tokens(F.col("t")))
    dense = np.zeros((len(texts), len(words) + 1))
    place = {w: i for i, w in enumerate([*words, "alone"])}
    for r in normed.collect():
        dense[int(r["doc_id"][1:]), place[r["term"]]] = r["weight"]
    dots = dense @ dense.T
    want = {tuple(sorted((f"d{i}", f"d{j}"))): dots[i, j] for i in range(len(texts)) for j in range(i) if dots[i, j] >= t}
    for w in (normed, T.tfidf(df, "id", T.word_tokens(F.col("t")), normed=False)):
        got = {(r["a"], r["b"]): r["cosine"] for r in T.cosine_pairs(w, t).collect()}
        assert set(got) == set(want) and all(got[p] == pytest.approx(want[p]) for p in want)


def test_cosine_pairs_of_many_blocks_write_only_what_reaches_the_threshold(spark, monkeypatch):
    """All documents share a word: every pair meets in a cell, and no table of met pairs is written."""
    monkeypatch.setattr(T, "HOT", 7)
    whole, written = T.materialize, []

    def count(df, label="table", options=None):
        out = whole(df, label, options)
        written.append((label, out.count()))
        return out

    monkeypatch.setattr(T, "materialize", count)
    texts = [f"same w{i // 2} v{i % 40}" for i in range(240)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    w = T.tfidf(df, "id", T.word_tokens(F.col("t"), 1), normed=False)
    want = sorted((r["a"], r["b"], round(r["cosine"], 9)) for r in T.cosine_pairs(w, 0.4).collect())
    monkeypatch.setattr(T, "SMALL", 1)
    monkeypatch.setattr(T, "GRID", 2)
    monkeypatch.setattr(T, "BLOCK", 150)
    assert sorted((r["a"], r["b"], round(r["cosine"], 9)) for r in T.cosine_pairs(w, 0.4).collect()) == want
    pairs = [n for label, n in written if label == "cosine-pairs"]
    assert len(pairs) == 1 + 3 and pairs[0] == sum(pairs[1:]) == len(want) < 240 * 239 / 4


def test_cosine_pairs_are_not_joined_with_their_names_again(spark):
    """Pairs grow with the square of the documents; they leave their cells whole, whatever the type of an id."""
    texts = [(("p", f"d{i}"), f"same w{i // 2} v{i % 7}") for i in range(60)]
    df = spark.createDataFrame(texts, "id struct<part: string, name: string>, t string")
    out = T.cosine_pairs(T.tfidf(df, "id", T.word_tokens(F.col("t"), 1), normed=False), 0.5)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.collect()
    assert {("d0", "d1"), ("d2", "d3")} <= {(r["a"]["name"], r["b"]["name"]) for r in got} and all(r["a"] < r["b"] for r in got)
    assert out.schema["a"].dataType == df.schema["id"].dataType


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("k", [5, 48, 300])
def test_folded_vectors_bound_the_cosine(k, own):
    """No pair that reaches t is refused, whatever the buckets, and with many buckets few others are verified."""
    rng, t = np.random.default_rng(k), 0.5
    share = 1 / np.arange(1, 301)

    def vectors(n):
        sizes = rng.integers(1, 25, n)
        terms = np.concatenate([np.sort(rng.choice(300, m, replace=False, p=share / share.sum())) for m in sizes])
        w = rng.random(len(terms)) / share[terms] ** 0.3
        return sizes, terms, w / np.sqrt(np.bincount(np.repeat(np.arange(n), sizes), weights=w * w))[np.repeat(np.arange(n), sizes)]

    sides = [vectors(700)] * 2 if own else [vectors(700), vectors(1100)]
    shared = np.intersect1d(sides[0][1], sides[1][1])
    a, b = (T._block(*side, shared) for side in sides)
    bucket = T._buckets(np.bincount(b.at, weights=b.w, minlength=len(shared)), k)
    fa, fb = (T._folded(x, np.arange(len(x.sizes)), bucket, k) for x in (a, b))
    pairs = list(T._through(fa, fb, T._least(t, k), own))
    row, col = (np.concatenate([p[c] for p in pairs]) for c in range(2))
    found = {(x, y): d for p in T._reaching(a, b, len(shared), row, col, t) for x, y, d in zip(*p, strict=True)}
    dense = [np.zeros((len(x.sizes), len(shared))) for x in (a, b)]
    for full, x in zip(dense, (a, b), strict=True):
        full[x.row, x.at] = x.w
    dots = dense[0] @ dense[1].T
    want = {(x, y) for x, y in zip(*np.nonzero(dots >= t), strict=True) if x < y or not own}
    assert set(found) == want and len(want) > 20 and all(d == pytest.approx(dots[p]) for p, d in found.items())
    assert k < 300 or len(row) < 2 * len(want)


def test_tries_of_kmeans_equal_their_own_rounds(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(60, 3)) + c for c in ((0, 0, 0), (4, 0, 1), (0, 5, 2))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>").repartition(3)
    tries = [(k, s) for k in (1, 2, 3, 5) for s in (0, 1, 2)]
    for got in L.lloyd(df, "id", "x", tries):
        import hashlib

        order = sorted(range(len(x)), key=lambda i: (hashlib.md5(f"{got.seed}:{i}".encode()).hexdigest(), i))
        cents = x[order[: got.k]].copy()
        for _ in range(200):
            at = ((x[:, None] - cents[None]) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([x[at == j].mean(axis=0) if (at == j).any() else cents[j] for j in range(got.k)])
            if np.abs(new - cents).max() <= 1e-12:
                break
            cents = new
        assert np.allclose(sorted(map(tuple, cents)), got.centres) and sum(got.sizes) == len(x)
        assert got.wcss == pytest.approx(((x[:, None] - cents[None]) ** 2).sum(axis=2).min(axis=1).sum())
    with pytest.raises(CheckFailed, match="fewer rows"):
        L.lloyd(df.limit(2), "id", "x", [(3, 0)])


def test_the_fit_is_an_optimum_and_an_early_stop_is_not(spark):
    rows = [(i, f"{w} {n}", w) for i, (w, n) in enumerate((w, n) for w in ("iron", "bread", "silk") for n in ("one", "two", "three", "four"))] + [(99, "", "iron")]
    df = spark.createDataFrame(rows, "id int, text string, label string")
    done = L.fit_text_classifier(df, "id", "text", "label", max_iter=500, tol=1e-13)
    early = L.fit_text_classifier(df, "id", "text", "label", max_iter=2)
    a, b = (L.optimality(m, df, "id", "text", "label").first() for m in (done, early))
    assert a["residual"] < 1e-7 < 1e-4 < b["residual"] and a["n_features"] == done.idf.count() == done.idf.select("slot").distinct().count() and a["n_rows"] == 13
    assert done.idf.agg(F.max("slot")).first()[0] == a["n_features"] - 1
