import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from gridloom.llm.mixing import mix_sources, mixed_rows, source_targets
from gridloom.llm.queries import URL_RULES
from gridloom.llm.urlfilter import Bloom, build_cascade, judge_urls
from gridloom.llm.warc import parse_record, read_warc, record_bytes, write_warc

DOCS = "doc_id long, text string, source string, size string"


def docs(spark, n=3000):
    source = F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 3 == 1, F.concat(F.lit("s"), (F.col("id") % 7).cast("string")))
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.col("id") * 37 % 90), lambda i: F.lit("w")), " ")
    return spark.range(n).select(F.col("id").alias("doc_id"), words.alias("text"), source.alias("source"), F.lit("clash").alias("size"))


def filled(sizes, weights):
    """Targets by repeated resharing."""
    total, cap, target, free = sum(sizes), [3 * s for s in sizes], [0.0] * len(sizes), set(range(len(sizes)))
    while True:
        rest = total - sum(cap[i] for i in range(len(sizes)) if i not in free)
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > cap[i]}
        if not over:
            return [share[i] if i in free else cap[i] for i in range(len(sizes))]
        free -= over


def test_targets_equal_resharing(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 40, "e": 3000, None: 7}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    want = filled(list(sizes.values()), [5, 2, 1, 5, 2, 1])
    assert [got[k] for k in sizes] == pytest.approx(want)


def test_mix_comes_near_the_targets(spark):
    out = mix_sources(docs(spark)).toPandas()
    assert len(out) == 3000 and (out["taken"] <= 3 * out["size"]).all() and (out["taken"] % out["size"].clip(lower=1) == 0).all()
    by = out.fillna({"source": "(null)"}).groupby("source").agg({"taken": "sum", "target": "first"})
    assert (abs(by["taken"] - by["target"]) <= 46).all()
    again = mix_sources(docs(spark)).toPandas()
    assert out.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()
    rows = mixed_rows(docs(spark))
    assert rows.columns == ["doc_id", "text", "source", "size"] and rows.count() == out["copies"][out["size"] > 0].sum()


def test_mix_edge_cases(spark):
    none = spark.createDataFrame([], DOCS)
    assert mix_sources(none).count() == 0 and mixed_rows(none).count() == 0
    odd = spark.createDataFrame([(1, None, "a", None), (2, " \t", "a", None), (None, "x y", None, None), (3, "same", "b", None), (3, "same", "b", None), (4, "w " * 50_000, "b", None)], DOCS)
    got = mix_sources(odd).toPandas()
    assert sorted(got["size"]) == [0, 0, 1, 1, 2, 50_000] and got[got["size"] == 0]["taken"].eq(0).all()


def verdict(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, "allow"))


def test_urls_match_the_rules(spark):
    urls = [f"http{s}://{h}{p}" for s in ("", "s") for h in ("com", "Example.COM", "a.example.com", "xcom", "example.net", "b.net", "org", "q.org:80", "é.com") for p in ("", "/", "/en/", "/en/7?x#y", "/en/8", "/de/8x", "/de/", "/es/1#a/b", "?en/", "/en")]
    urls += [None, "", "no scheme", "://", "://com/en/", "x://com", "a://b://com/en/", "h://net\n/de/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(df, URL_RULES).collect()}
    assert got == {i: verdict(u) for i, u in enumerate(urls)}
    assert judge_urls(df.where("false"), URL_RULES).count() == 0
    assert {r["verdict"] for r in judge_urls(df, []).collect()} == {"allow"}


def test_cascade_is_exact_on_its_universe(spark):
    keys = [f"k{i}" for i in range(4000)]
    listed = keys[::3]
    cascade = build_cascade(listed, spark.createDataFrame([(k,) for k in keys], "key string"), 5)
    assert cascade.test(keys).tolist() == [i % 3 == 0 for i in range(4000)]
    assert build_cascade([], spark.createDataFrame([("a",)], "key string"), 5).test(["a"]).tolist() == [False]
    many = Bloom(1000, 3)
    many.add(keys[:1000])
    assert many.test(keys[:1000]).all() and many.test(keys[1000:]).mean() < 0.06


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "", None, "<p>a</p>", "é" * 5000, "x\r\n\r\ny", "<p>a</p>"]
    df = spark.createDataFrame([(i, f"http://h/{i}\nx", h, "clash") for i, h in enumerate(html)] + [(None, None, "z", "c"), (9, "u", "dup", "c"), (9, "u", "dup", "c")], "page_id long, url string, html string, digest string")
    got = read_warc(write_warc(df)).toPandas()
    assert len(got) == 10
    rows = {r["page_id"]: r for r in got.to_dict("records") if r["page_id"] == r["page_id"] and r["page_id"] != 9}
    for i, h in enumerate(html):
        data = (h or "").encode()
        first = min(j for j, g in enumerate(html) if (g or "") == (h or ""))
        assert rows[i]["digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode() and rows[i]["payload_bytes"] == len(data)
        assert rows[i]["record_type"] == ("response" if first == i else "revisit") and (rows[i]["refers_to"] == first if first != i else rows[i]["refers_to"] != rows[i]["refers_to"])
        assert rows[i]["payload"] == (data if first == i else b"")
    assert sorted(got[got["page_id"] == 9]["record_type"]) == ["response", "revisit"]
    assert read_warc(write_warc(df.where("false"))).count() == 0
    assert set(read_warc(write_warc(df, min_bytes=100)).toPandas()["record_type"]) == {"response"}


def test_damaged_record():
    data = record_bytes("response", 1, "u", "d", b"abc", None)
    assert parse_record(data)[1] == b"abc"
    with pytest.raises(ValueError, match="length"):
        parse_record(data[:-1])
