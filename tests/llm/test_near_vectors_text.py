import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions.staging import materialize
from gridloom.llm import vectorgraph
from gridloom.llm.ann import hadamard, nearest, recall_of
from gridloom.llm import jaccard
from gridloom.llm.ann import bucket_of, chain_of, probed, probes_of, signs_of
from gridloom.llm.html import SURE, SURGE, WINDOW, Line, extract_main_text, main_text, page_lines, text_spans
from gridloom.llm.jaccard import common_counts, fragment_keys, jaccard_groups, may_link, parities, shingle_set, size_classes
from gridloom.llm.quality import _pieces, document_grade, fit_ordinal, fit_quality, link_slopes, score_quality
from gridloom.llm.vectorgraph import audit_links, near_vectors


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def texts_with_copies():
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for size in (1, 2, 3, 9, 10, 11, 30, 80, 200, 900):
        base = rng.choice(vocab, size).tolist()
        for edits in (0, 0, 1, 1, 2, 3, max(1, size // 40), max(1, size // 20), max(1, size // 10)):
            copy = list(base)
            for at in rng.integers(0, size, edits):
                copy[at] = str(rng.choice(vocab))
            out.append(" ".join(copy))
    return [*out, None, "", " \t ", "UPPER case Text here now", "upper CASE text here now", "the same words the same words the same words"]


@pytest.mark.parametrize(("n", "t"), [(3, (9, 10)), (5, (8, 10))])
def test_jaccard_equals_brute_force(spark, n, t):
    texts = texts_with_copies()
    sets = [frozenset(shingle_set(x.encode() if x else None, n).tolist()) for x in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and len(sets[i] & sets[j]) * t[1] >= t[0] * len(sets[i] | sets[j])]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, n int")
    got = jaccard_groups(df, n, t).orderBy("doc_id").toPandas()
    assert got["n_shingles"].tolist() == [len(s) for s in sets]
    assert got["component_id"].tolist() == components(len(texts), links)
    assert jaccard_groups(df.where("false"), n, t).count() == 0


def test_sketches_never_refuse_a_link():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 5, 60, 61, 250)]
    sets += [np.union1d(s[: max(1, len(s) - 3)], rng.integers(0, 1 << 63, 2).astype(np.uint64)) for s in sets]
    n, out = np.array([len(s) for s in sets]), np.ones(len(sets), dtype=bool)
    got = may_link([parities(s) for s in sets], n, np.arange(len(sets)), out, (8, 10))
    for i, a in enumerate(sets):
        linked = any(10 * len(np.intersect1d(a, b)) >= 8 * len(np.union1d(a, b)) for j, b in enumerate(sets) if i != j)
        assert got[i] or not linked
    assert not may_link([parities(s) for s in sets], n, np.zeros(len(sets)), out, (8, 10)).any()  # one component has no more to ask


def test_small_blocks_find_the_same(spark, monkeypatch):
    """Groups dealt over many cells, with members outside the leader's component."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "WIDE", 8)
    test_near_copies_of_one_base(spark)


def test_near_copies_of_one_base(spark):
    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for k in range(300):
        copy = list(base)
        for at in rng.integers(0, 120, k % 12):
            copy[at] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(copy))
    sets = [set(shingle_set(x.encode(), 3).tolist()) for x in texts]
    links = [(i, j) for i in range(300) for j in range(i + 1, 300) if 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard_groups(df, 3, (9, 10)).orderBy("doc_id").toPandas()
    assert got["component_id"].tolist() == components(300, links) and len(set(got["component_id"])) > 1


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(0, 2**32), st.sampled_from([(9, 10), (8, 10)]))
def test_similar_sets_share_a_key(size, seed, t):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
    drop = int(len(a) * (1 - t[0] / t[1]))
    b = a[drop:] if drop else a
    p, q = t
    if len(b) * q < p * len(a) or len(b) == len(a):
        return
    bounds = size_classes(10_000, t)

    def keys(x):
        level = next(i for i, (lo, hi) in enumerate(bounds) if lo <= len(x) <= hi)
        parts = [k for j in (level, level + 1) for k in fragment_keys(x, j, bounds[j][1], t)]
        return set(np.concatenate(parts).tolist()) if parts else set()

    assert keys(a) & keys(b)


def test_common_counts():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 200, rng.integers(0, 50))) for _ in range(80)]
    got = common_counts(rows)
    assert all(got[i, j] == len(np.intersect1d(rows[i], rows[j])) for i in range(80) for j in range(80))


VEC = "vec_id long, embedding array<float>, label int"


def vectors(spark, n=600, dim=16):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dim))
    x[n // 2 : n // 2 + 60] = x[0] + rng.normal(size=(60, dim)) * 0.12
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[5] = x[6]
    data = [(i, [float(v) for v in row], i % 3) for i, row in enumerate(x)]
    bad = [(9001, None, 1), (9002, [0.0] * dim, 1), (9003, [float("nan")] + [1.0] * (dim - 1), 1), (9004, [None] + [1.0] * (dim - 1), 1), (9005, [float("inf")] + [1.0] * (dim - 1), 1), (9006, data[0][1], None)]
    return data, spark.createDataFrame(data + bad, VEC)


def test_nearest(spark):
    data, df = vectors(spark)
    out = nearest(df, F.col("vec_id") % 20 == 0).toPandas()
    assert out.groupby("query_id").size().eq(20).all() and set(out["query_id"]) == {*range(0, 600, 20)}
    assert recall_of(nearest(df, F.col("vec_id") % 20 == 0), df, F.col("vec_id") % 20 == 0) >= 0.9
    x = np.array([d[1] for d in data], dtype=np.float32).astype(np.float64)
    for r in out.head(50).itertuples():
        other = data[0][1] if r.vec_id == 9006 else None
        assert r.score == pytest.approx(x[r.query_id] @ (np.array(other) if other else x[r.vec_id]), abs=1e-6) and r.query_id != r.vec_id
    few = nearest(df.where("vec_id < 3 or vec_id > 9000"), F.col("vec_id") % 20 == 0)
    assert few.count() == 3  # the query 0, with 1, 2 and 9006
    assert nearest(df.where("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize("lengths", ["one long", "spread", "few"])
def test_nearest_of_any_length(spark, lengths):
    rng = np.random.default_rng(6)
    n = 30 if lengths == "few" else 3000
    x = rng.normal(size=(100, 64))[rng.integers(0, 100, n)] + rng.normal(size=(n, 64)) * 0.4
    x /= np.linalg.norm(x, axis=1)[:, None]
    if lengths == "one long":
        x[7] *= 20
    elif lengths == "spread":
        x *= np.exp(rng.normal(size=(n, 1)))
    df = spark.createDataFrame([(i, [float(v) for v in row], 1) for i, row in enumerate(x)], VEC)
    asked = F.col("vec_id") % 20 == 0
    out = materialize(nearest(df, asked))
    assert out.count() == 20 * len(range(0, n, 20)) and recall_of(out, df, asked) >= 0.9


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.linalg.norm(hadamard(x), axis=1) == pytest.approx(np.linalg.norm(x, axis=1))


@pytest.mark.parametrize("clustered", [False, True])
def test_near_vectors(spark, clustered, monkeypatch):
    if clustered:  # these bounds are read on the driver
        monkeypatch.setattr(vectorgraph, "SHARD", 100)
        monkeypatch.setattr(vectorgraph, "BLOCK", 40)
    data, df = vectors(spark)
    x = np.array([d[1] for d in data], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([d[2] for d in data])
    hit = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(hit, False)
    got = near_vectors(df).toPandas().set_index("vec_id")
    assert len(got) == 606 and got.loc[range(600), "n_links"].sum() >= 0.98 * hit.sum() and (got.loc[range(600), "n_links"] <= hit.sum(axis=1)).all()
    want = components(600, np.argwhere(np.triu(hit)))
    assert np.mean(got.loc[range(600), "component_id"].to_numpy() == want) > 0.99
    assert got.loc[9001:9006, "n_links"].eq(0).all() and got.loc[9001:9006, "kept"].all()
    assert audit_links(near_vectors(df), df, sample=600) >= 0.98
    assert near_vectors(df.where("false")).count() == 0


def test_dense_group_larger_than_its_shards(spark, monkeypatch):
    for name, size in (("SHARD", 300), ("BLOCK", 200)):
        monkeypatch.setattr(vectorgraph, name, size)
    rng = np.random.default_rng(4)
    x = np.concatenate([np.eye(64)[0] + rng.normal(size=(1500, 64)) * np.sqrt((1 / 0.97 - 1) / 64), rng.normal(size=(300, 64))])
    df = spark.createDataFrame([(i, [float(v) for v in row], 1) for i, row in enumerate(x)], VEC)
    x = x.astype(np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    true = (x @ x.T >= 0.93).sum(axis=1) - 1
    got = near_vectors(df).toPandas().set_index("vec_id").loc[range(1800)]
    assert (got["n_links"] <= true).all() and got["n_links"].sum() >= 0.999 * true.sum()
    assert got.loc[range(1500), "component_id"].eq(0).all() and got["kept"].sum() == 301


def test_many_shards_of_one_label(spark):
    rng = np.random.default_rng(8)
    n = 3000
    x = rng.normal(size=(n, 64))
    x[1::3] = x[::3] + rng.normal(size=(1000, 64)) * 0.25  # near copies, some out of range
    df = spark.createDataFrame([(i, [float(v) for v in row], 1, "clash", 7) for i, row in enumerate(x)], VEC + ", node string, shards int")
    out = materialize(near_vectors(df))
    assert audit_links(out, df, sample=3000) >= 0.99 and out.count() == n
    assert len(vectorgraph.centres_of(x / np.linalg.norm(x, axis=1)[:, None], -(-n * vectorgraph.OVERLAP // vectorgraph.SHARD))) >= 4


def test_columns_of_any_name_are_not_read(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i)], 1, "x", 5, 6) for i in range(40)], VEC + ", row string, band int, _asks int")
    assert nearest(df, F.col("vec_id") % 20 == 0).count() == 40


def test_a_query_looks_at_a_falling_share():
    """Chains grow with the vectors; near vectors share probed buckets, and few others do."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    chain = chain_of(len(x), 64)
    assert len(chain_of(500, 64)) <= len(chain) < len(chain_of(10**9, 64)) and 2 * np.prod([2 * d for d in chain]) > len(x) / 3
    signs = signs_of(4, len(chain), 64, 3)
    q = x[:50] + rng.normal(size=(50, 64)) * 0.03
    seen, found = [], 0
    for s in signs:
        first, rest = bucket_of(x, s, chain)
        asked, numbers = probed(q, s, chain, probes_of(chain, 110))
        for k in range(50):
            hit = np.isin(first * 10**6 + rest, asked[k] * 10**6 + numbers[k])
            seen.append(hit.mean())
            found += hit[k]
    assert np.mean(seen) < 0.05 and found > 150


PAGE = "<html><head><title>T</title><script>var a='<p>';</script></head><body><nav><a href=x>Menu</a></nav><div class='ad'>Buy now please</div>{}<footer>c</footer></body>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain", "plain"), (PAGE.format(""), ""),
        (PAGE.format("<article><h1>Head &amp; more</h1><p><b>One.<br><p>Two\n  words&nbsp;here<p>X</article>"), "Head & more\nOne.\nTwo words here\nX"),
        ("<div id=comments><p>reader says</p></div><p>body text</p><ul><li><a href=1>a</a></li></ul>", "body text"),
        ("<aside>no</aside><main><p>yes</p><form><p>name</p></form></main>", "yes"),
        ("<p>un&lt;closed", "un<closed"), ("<p>a<!-- b --><i>c</i>d</p>", "acd"),
    ],
)
def test_main_text(html, text):
    assert main_text(html) == text


LONG = "A sentence of the text that is long enough to be told from the short blocks around it. " * 3


def test_short_unnamed_blocks_around_the_text():
    menu = "".join(f"<div>Item {i}</div>" for i in range(6))
    html = f"<body>{menu}<h1>Head</h1><p>{LONG}</p><p>Yes.</p><p>No.</p><p>{LONG}</p>{menu}</body>"
    assert main_text(html) == f"Head\n{LONG.strip()}\nYes.\nNo.\n{LONG.strip()}"


@pytest.mark.parametrize(
    "html",
    [
        "<body class='single-post no-sidebar'>{}</body>", "<body class='has-sidebar'>{}</body>", "<article class='post comments-open'>{}</article>", "<div class='site-content with-sidebar'>{}</div>",
        "<main class='main search'>{}</main>", "<article><div class='page-header'>{}</div></article>", "<div class='entry-header'>{}</div>", "<div class='widget'><article>{}</article></div>",
        "<svg/>{}", "<object/>{}", "<iframe src='x'>{}", "<select>{}", "{}<div class='site-footer'>c</div><div class='cookie-banner'>c</div>", "{}<div class=related><article>teaser</article></div>",
    ],
)
def test_names_do_not_drop_the_article(html):
    if "related" in html:
        html = f"<article>{html.replace('<div', '</article><div', 1)}"
    assert main_text(html.format(f"<p>{LONG}</p>")) == LONG.strip()


def kept_by_hand(lines):
    """Numbers of the kept lines, line by line from the definition."""
    n = len(lines)
    sums = [sum(x.count for x in lines[i : i + WINDOW]) for i in range(n)]
    level = min(SURGE * max(sums, default=0), SURE)
    kept = set()
    for i in range(n):
        if sums[i] > level and (i == 0 or sums[i - 1] <= level):  # a surge
            dive = next((j for j in range(i, n) if sums[j] <= level), n)
            text = [k for k in range(i, dive) if lines[k].count and (lines[k].prose or lines[k].count * WINDOW > level)]
            if not text:
                continue
            kept |= set(range(text[0], text[-1] + 1))
            for at, step in ((text[0], -1), (text[-1], 1)):
                way = []
                while 0 <= at + step < n and lines[at + step].article == lines[at].article:
                    at += step
                    x = lines[at]
                    if x.count and not x.prose or not x.count and not x.article:
                        break
                    way.append(at)
                    if x.count:
                        kept |= set(way)
    return [k for k in sorted(kept) if lines[k].count]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 0, 3, 10, 26, 27, 60, 200, 900]), st.sampled_from([0, 0, 0, 1, 1, 2]), st.booleans()), max_size=30))
def test_surges_and_dives_equal_the_rule(lines):
    page = [Line(str(k), n, a, prose) for k, (n, a, prose) in enumerate(lines)]
    spans = text_spans(page)
    assert all(i < j <= k for (i, j), (k, _) in zip(spans, [*spans[1:], (len(page), 0)], strict=False))
    assert [k for i, j in spans for k in range(i, j) if page[k].count] == kept_by_hand(page)


def test_spans_find_the_article_without_its_tag_or_any_name():
    html = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    lost = added = whole = found = 0
    for h in html:
        article = [x.text for x in page_lines(h) if x.article and x.count]
        assert main_text(h) == "\n".join(article) != "\n".join(x.text for x in page_lines(h))
        bare = re.sub(r" (?:class|id|role)=(?:\"[^\"]*\"|'[^']*')", "", h.replace("<article", "<div").replace("</article", "</div"))
        want, got = Counter(article), Counter(main_text(bare, names=False).split("\n"))
        lost, added, whole, found = lost + (want - got).total(), added + (got - want).total(), whole + want.total(), found + got.total()
    assert lost <= 0.03 * whole and added <= 0.03 * found


def test_the_line_block_step_decides():
    menu = "".join(f"<div>Item {i}</div>" for i in range(6))
    assert "Item" not in main_text(f"<body>{menu}<p>{LONG}</p>{menu}</body>")
    # An article that no surge reaches is a teaser; one with text is kept to its short ends.
    page = f"<article><p>Short.</p><p>{LONG}</p><p>End.</p></article><div>far</div><div>away</div><div>off</div><article><p>See also</p></article>"
    assert main_text(page) == f"Short.\n{LONG.strip()}\nEnd."


def test_pages_of_any_kind(spark):
    long = "<article>" + "<p>word word</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, 5), (1, "u", None, 5), (2, None, "", 5), (3, "v", long, 5), (None, "w", f"<p>{LONG}</p>", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = extract_main_text(df).toPandas()
    assert len(got) == 5 and got.columns.tolist() == ["page_id", "url", "text", "n_chars"]
    assert sorted(got["n_chars"]) == [0, 0, 0, len(LONG.strip()), 10 * 20_000 - 1]
    assert extract_main_text(df.where("false")).count() == 0


def rated(spark):
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(200)]
    data = []
    for i in range(600):
        t = rng.choice(words, 60).tolist()
        kind = i % 3
        if kind == 0:
            t[::15] = ["vile"] * len(t[::15])
        elif kind == 1:
            t = [w.upper() + "!!" for w in t]
        data.append((i, " ".join(t), int(kind != 1), int(kind == 0)))
    return spark.createDataFrame(data, "doc_id long, text string, quality int, toxic int")


def test_slopes_of_the_link():
    theta = np.array([-0.4, 0.9])
    for y in (0, 1, 2):
        for x in (-1.5, 0.2, 2.0):
            loss = lambda x, t: -np.log(link_slopes(y, x, t)[0])
            p, by_x, upper, lower = link_slopes(y, x, theta)
            assert by_x == pytest.approx((loss(x + 1e-6, theta) - loss(x - 1e-6, theta)) / 2e-6, abs=1e-5)
            for j, slope in ((y, upper), (y - 1, lower)):
                if 0 <= j < 2:
                    step = np.eye(2)[j] * 1e-6
                    assert slope == pytest.approx((loss(x, theta + step) - loss(x, theta - step)) / 2e-6, abs=1e-5)
    assert sum(link_slopes(y, 0.3, theta)[0] for y in (0, 1, 2)) == pytest.approx(1)


def test_quality_of_repeated_and_clashing_rows(spark):
    df = rated(spark)
    labels = df.select("doc_id", "quality", "toxic")
    twice = labels.unionByName(labels.withColumn("toxic", F.lit(1)))  # the lowest grade counts
    assert not fit_quality(df, twice, document_grade()).weights.any()
    model = fit_quality(df, labels, document_grade())
    out = score_quality(df.withColumn("tail_prob", F.lit("mine")), model)
    assert dict(out.dtypes)["tail_prob"] == "double" and score_quality(df.where("false"), model).count() == 0


def test_quality_on_held_out_rows(spark):
    df = rated(spark)
    model = fit_quality(df, df.where("doc_id < 400").select("doc_id", "quality", "toxic"), document_grade())
    got = score_quality(df.where("doc_id >= 400"), model).toPandas()
    right = (got["tail_prob"] >= 0.5) == ((got["quality"] == 1) & (got["toxic"] == 0))
    assert right.mean() > 0.95 and (np.diff(model.thresholds) > 0).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 40_000)], "doc_id long, text string")
    assert score_quality(odd, model).where("tail_prob is not null").count() == 3
    assert score_quality(odd.where("false"), model).count() == 0
    prior = fit_quality(df, df.where("false").select("doc_id", "quality", "toxic"), document_grade())
    assert score_quality(odd, prior).select("tail_prob").distinct().count() == 1


def test_words_without_spaces_are_read_in_whole():
    rng = np.random.default_rng(8)
    start = "".join(rng.choice(list("abcdefgh"), 40))
    texts = [start + "".join(rng.choice(list("abcdefgh" if i % 2 else "0123AB+/"), 600)) for i in range(200)]
    grades = np.arange(200) % 2
    model = fit_ordinal([x.encode() for x in texts[:140]], grades[:140], 2)
    good = model.tails(model.score([x.encode() for x in texts[140:]]))[:, 0] >= 0.5
    assert (good == (grades[140:] == 1)).mean() > 0.95
    thai = "x" + "\u0e01" * 50
    assert [p.decode() for p in _pieces(thai.encode())] == [thai[:14], *(thai[k : k + 13] for k in (14, 27, 40))]


def test_one_grade_gives_the_prior():
    assert not fit_ordinal([b"a b", b"c d"], np.array([1, 1]), 3).weights.any()


def test_repeated_component_rows_are_not_broadcast(spark):
    """They take thirty times the memory that their file shows, so a threshold on the file's size must not decide."""
    df = spark.createDataFrame(list(enumerate(texts_with_copies())), "doc_id long, text string")
    out = jaccard_groups(df, 3, (9, 10))
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert out.count() == len(texts_with_copies())


def test_common_passages_make_no_candidates(spark, monkeypatch):
    """Texts that share a passage and little else meet in no pair; copies among them are still found."""
    rng = np.random.default_rng(4)
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join([*passage, *(f"u{rng.integers(1 << 40)}" for _ in range(220 + k % 5))]) for k in range(120)]
    texts += [texts[k].rsplit(" ", 3)[0] for k in range(0, 120, 20)]
    counts = {}

    def counted(df, label="table", *options):
        out = materialize(df, label, *options)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard_groups(df, 5, (8, 10)).orderBy("doc_id").toPandas()
    assert got["component_id"].tolist() == [*range(120), *range(0, 120, 20)]
    assert counts["jaccard-stars"] <= 2 * 6


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 400), st.integers(0, 2**32), st.sampled_from([(9, 10), (8, 10)]))
def test_similar_sets_keep_a_key_without_their_frequent_ones(size, seed, t):
    rng = np.random.default_rng(seed)
    p, q = t
    a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
    gone = int(len(a) * (q - p) / (q + p))
    b = np.union1d(rng.permutation(a)[gone:], rng.integers(0, 2**63, int(rng.integers(0, gone + 1))).astype(np.uint64))
    if len(np.intersect1d(a, b)) * q < p * len(np.union1d(a, b)) or len(a) == len(b) and (a == b).all():
        return
    bounds = size_classes(10_000, t)
    often: dict[int, int] = {}

    def kept(x):
        level = next(i for i, (lo, hi) in enumerate(bounds) if lo <= len(x) <= hi)
        out = set()
        for j in (level, level + 1):
            keys, spare = jaccard.keys_and_spare(x, j, bounds[j][1], t)
            assert spare >= 0
            ranked = sorted(keys.tolist(), key=lambda k: (-often.setdefault(k, int(rng.integers(1, 9))), k))
            out |= set(ranked[spare:])
        return out

    assert kept(a) & kept(b)
