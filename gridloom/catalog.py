"""Registered queries of the panel operators on the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import text as X
from gridloom.operators import aggregates as A
from gridloom.operators import checks as V
from gridloom.operators import impute as M
from gridloom.operators import index as I
from gridloom.operators import joins as J
from gridloom.operators import panelstats as S
from gridloom.operators import reshape as R
from gridloom.operators import rows as C
from gridloom.operators import text_groups as T
from gridloom.operators import windows as W
from gridloom.plans import base as B
from gridloom.sources import tables as IO

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rnd(df: DataFrame, digits: int = 4, *cols: str) -> DataFrame:
    """Doubles rounded, so that sums of another order compare equal."""
    which = cols or [c for c, k in df.dtypes if k == "double"]
    return df.withColumns({c: F.round(c, digits) for c in which})


# ---------------------------------------------------------------- sources


@query("select count(*)::bigint n_rows, 'orders' as name, 'input' as role from orders")
def s07_describe_dataset(spark, d):
    return IO.describe_dataset(B.read(spark, d, "orders"), "orders", "input").select("n_rows", "name", "role")


@query(r"""select page_id, (i - 1)::int row_no, m[i] cell from (select page_id, regexp_extract_all(html, '(?is)<li\b[^>]*>\s*<a\b[^>]*>([^<&]*)</a>\s*</li\s*>', 1) m from pages), unnest(range(1, len(m) + 1)) t(i)""")
def s09_html_rows(spark, d):
    rows = IO.html_rows(B.read(spark, d, "pages"), row=r"(?is)<li\b[^>]*>\s*(<a\b[^>]*>[^<&]*</a>)\s*</li\s*>", cell=r"(?is)(<a\b[^>]*>.*?</a>)")
    return rows.select("page_id", "row_no", F.col("cells")[0].alias("cell"))


@query(r"""select page_id, coalesce(list_max(list_transform(regexp_extract_all(url, '[?&]page=(\d+)', 1), lambda x: x::int)), 1)::int last_page from pages""")
def s09_html_last_page(spark, d):
    return IO.html_last_page(B.read(spark, d, "pages"), html="url")


# ---------------------------------------------------------------- checks


@query("select l_orderkey, l_linenumber, count(*) n_rows from lineitem group by all having count(*) > 1")
def v02_duplicate_keys(spark, d):
    return V.duplicate_keys(B.read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("with " + B.DETAIL + """, have as (select distinct region, year, subarea from detail), want as (select n_name region, y::int as year, s subarea from nation, range(1995, 2003) t(y), (select distinct p_type s from part))
select want.*, 'missing' problem from want anti join have using (region, year, subarea) union all select have.*, 'unexpected' from have anti join want using (region, year, subarea)""")
def v03_grid_gaps(spark, d):
    det = B.detail(spark, d)
    regions = [r[0] for r in B.read(spark, d, "nation").select("n_name").collect()]
    subs = [r[0] for r in B.read(spark, d, "part").select("p_type").distinct().collect()]
    return V.grid_gaps(det.select("region", "year", "subarea"), {"region": regions, "year": list(range(1995, 2003)), "subarea": subs}).select("region", "year", "subarea", "problem")


@query("""with y as (select distinct o_custkey, year(o_orderdate)::int as year from orders), l as (select *, lag(year) over (partition by o_custkey order by year) previous_year from y)
select o_custkey, previous_year, year from l where year - previous_year <> 1""")
def v04_year_gaps(spark, d):
    y = B.read(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year")).distinct()
    return V.year_gaps(y, ["o_custkey"], "year").select("o_custkey", "previous_year", "year")


@query("select count(*) filter (not (l_quantity > 0))::bigint l_quantity, count(*) filter (not (l_discount between 0 and 0.05))::bigint l_discount, count(*) filter (not (l_tax >= 0))::bigint l_tax from lineitem")
def v05_domain_violations(spark, d):
    return V.domain_violations(B.read(spark, d, "lineitem"), {"l_quantity": "positive", "l_discount": (0, 0.05), "l_tax": "non_negative"})


@query("select o_custkey, count(distinct o_orderpriority)::bigint n_values from orders group by 1 having count(distinct o_orderpriority) > 1")
def v07_fd_violations(spark, d):
    return V.fd_violations(B.read(spark, d, "orders"), ["o_custkey"], "o_orderpriority")


@query("select c_nationkey, list_sort(list(distinct c_mktsegment))::varchar found from customer group by 1 having list_sort(list(distinct c_mktsegment)) <> ['BUILDING', 'MACHINERY']")
def v08_group_sets(spark, d):
    bad = V.group_set_violations(B.read(spark, d, "customer"), ["c_nationkey"], "c_mktsegment", ["BUILDING", "MACHINERY"])
    return bad.select("c_nationkey", F.concat(F.lit("["), F.array_join("found", ", "), F.lit("]")).alias("found"))


@query("""select 'lineitem' section, n "check", '0' expected, v::varchar actual, case when v = 0 then 'PASS' else 'FAIL' end verdict, '' note from
(select unnest(['null quantity', 'returned']) n, unnest([count(*) filter (l_quantity is null), count(*) filter (l_returnflag = 'R')]) v from lineitem)""")
def v09_expectations(spark, d):
    li = B.read(spark, d, "lineitem")
    return V.Checks(spark).add_counts("lineitem", li, {"null quantity": (F.col("l_quantity").isNull(), 0), "returned": (F.col("l_returnflag") == "R", 0)}).to_df()


@query("""with a as (select o_custkey k, sum(o_totalprice) v from orders where o_orderkey % 10 <> 0 group by 1), b as (select o_custkey k, sum(o_totalprice) v from orders group by 1)
select coalesce(a.k, b.k) o_custkey, round(a.v, 2) left_total, round(b.v, 2) right_total, round(case when abs(a.v - b.v) <= 1e-6 then 0 else a.v - b.v end, 2) diff,
case when a.k is null then 'right only' when b.k is null then 'left only' when abs(a.v - b.v) <= 1e-6 then 'equal' else 'different' end status from a full join b on a.k = b.k""")
def v10_reconcile(spark, d):
    o = B.read(spark, d, "orders")
    return rnd(V.reconcile(o.where("o_orderkey % 10 <> 0"), o, ["o_custkey"], "o_totalprice"), 2)


_V11 = """a as (select c_custkey k, c_acctbal v from customer where c_custkey % 7 <> 0), b as (select c_custkey k, c_acctbal + case when c_custkey % 5 = 0 then 1 else 0 end v from customer where c_custkey % 11 <> 0),
det as (select coalesce(a.k, b.k) c_custkey, abs(a.v - b.v) dd, case when a.k is null then 'right only' when b.k is null then 'left only' when abs(a.v - b.v) <= 1e-9 then 'equal' else 'mismatch' end status from a full join b on a.k = b.k)"""


@query("with " + _V11 + """ select count(*)::bigint n_keys, count(*) filter (status = 'equal')::bigint equal, count(*) filter (status = 'mismatch')::bigint mismatch, count(*) filter (status = 'left only')::bigint left_only,
count(*) filter (status = 'right only')::bigint right_only, round(max(dd), 4) max_abs_diff from det""")
def v11_compare_tables(spark, d):
    c = B.read(spark, d, "customer")
    other = c.where("c_custkey % 11 <> 0").withColumn("c_acctbal", F.col("c_acctbal") + F.when(F.col("c_custkey") % 5 == 0, 1).otherwise(0))
    _, summary = V.compare_keyed(c.where("c_custkey % 7 <> 0"), other, ["c_custkey"], "c_acctbal")
    return rnd(summary.select("n_keys", "equal", "mismatch", "left_only", "right_only", "max_abs_diff"))


@query("""with a as (select l_returnflag f, l_linestatus s, count(*) * 2 n from lineitem group by all), b as (select l_returnflag f, l_linestatus s, count(*) n from (select * from lineitem union all select * from lineitem where l_linenumber <> 1) group by all)
select coalesce(a.f, b.f) l_returnflag, coalesce(a.s, b.s) l_linestatus, coalesce(a.n, 0)::bigint n_left, coalesce(b.n, 0)::bigint n_right from a full join b on a.f = b.f and a.s = b.s where coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def v12_multiset_diff(spark, d):
    li = B.read(spark, d, "lineitem")
    return V.multiset_diff(li, li.unionByName(li.where("l_linenumber <> 1")), ["l_returnflag", "l_linestatus"], factor=2)


@query("with " + B.SUBPANEL + ", sh as (select region, year, budget / sum(budget) over (partition by region, year) s from subpanel) select region, year, round(sum(s), 6) total, count(*) filter (not (s between 0 and 1))::bigint n_bad, abs(sum(s) - 1) <= 1e-9 passed from sh group by all")
def v13_check_shares(spark, d):
    sh = W.share(B.subpanel(spark, d), ["region", "year"], "budget", check=False)
    return rnd(V.check_shares(sh, ["region", "year"], "share"), 6)


@query("""with b as (select p_partkey, 1 + (p_size % 20) / 20.0 m from part), v as (select m, 1 - abs(m - 2.5) / 2 v, round(1 - abs(m - 2.5) / 2, 4) pub from b)
select count(*)::bigint n, count(*) filter (m >= 2.5)::bigint n_above, count(*) filter (m < 2.5)::bigint n_below, round(max(abs(v - pub)), 6) max_abs_diff, true safe from v""")
def v14_no_crossing(spark, d):
    p = B.read(spark, d, "part").select((1 + (F.col("p_size") % 20) / 20.0).alias("m")).withColumn("pub", F.round(1 - F.abs(F.col("m") - 2.5) / 2, 4))
    return rnd(V.check_no_crossing(p, "m", 2.5, "pub"), 6)


# ---------------------------------------------------------------- scalar functions


@query("with " + B.OUTLINE + " select region, src_row, item_name, row_type from outline")
def c01_classify_row(spark, d):
    return B.outline(spark, d).select("region", "src_row", "item_name", X.classify_row(F.col("item_name")).alias("row_type"))


@query("with " + B.OUTLINE + """ select region, src_row, case when src_row % 1000000 between 10 and 40 and row_type = 'leaf' then 'noted' when row_type = 'leaf' and item_name like '%7' then 'seven' else row_type end row_type from outline""")
def c02_row_type_rules(spark, d):
    rules = spark.createDataFrame([(1, None, None, None, None, None, "7$", "seven")], "priority int, year int, region string, row_lo long, row_hi long, name string, regex string, new_type string")
    rows = B.outline(spark, d).withColumn("row_type", X.classify_row(F.col("item_name")))
    low = rows.where("row_type = 'leaf' and src_row % 1000000 between 10 and 40").select(F.lit(2).alias("priority"), "year", "region", F.col("src_row").alias("row_lo"), F.col("src_row").alias("row_hi"), F.col("item_name").alias("name"), F.lit(None).cast("string").alias("regex"), F.lit("noted").alias("new_type"))
    heads = rows.where("row_type <> 'leaf'")
    leaves = C.apply_row_type_rules(rows.where("row_type = 'leaf'"), rules.unionByName(low))
    return leaves.select("region", "src_row", "row_type").unionByName(heads.select("region", "src_row", "row_type"))


@query(r"""select doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) cleaned from documents""")
def c05_clean_text(spark, d):
    return B.read(spark, d, "documents").select("doc_id", X.clean_text(F.col("text")).alias("cleaned"))


@query("with " + B.RAW + " select row_id, case when raw = '-' then 0.0 else try_cast(replace(raw, ',', '') as double) end amount from raw")
def c06_parse_amount(spark, d):
    return B.raw_amounts(spark, d).select("row_id", X.parse_amount(F.col("raw")).alias("amount"))


@query("with " + B.PANEL + """ select region, year, round(budget - p, 4) change, round(case when p <> 0 then (budget - p) / p * 100 end, 1) rate from (select *, lag(budget) over (partition by region order by year) p from panel)""")
def c08_budget_change(spark, d):
    from pyspark.sql import Window

    p = B.panel(spark, d).withColumn("p", F.lag("budget").over(Window.partitionBy("region").orderBy("year")))
    x = X.budget_change(F.col("budget"), F.col("p"))
    return rnd(p.select("region", "year", x["change"].alias("change"), x["rate"].alias("rate")), 4, "change")


@query(r"""select doc_id, md5(regexp_replace(lower(text), '[^0-9a-z가-힣]', '', 'g')) key, md5(trim(regexp_replace(nfc_normalize(text), '[ \t\n\x0B\f\r]+', ' ', 'g'))) composed from documents""")
def c09_keyword_key(spark, d):
    t = F.col("text")
    return B.read(spark, d, "documents").select("doc_id", F.md5(X.keyword_key(t)).alias("key"), F.md5(X.normalize_text(t)).alias("composed"))


@query("""with a as (select n_name alias, r_name region from nation join region on n_regionkey = r_regionkey where n_nationkey % 2 = 0)
select c_custkey, coalesce(a.region, case when starts_with(n_name, 'NATION_1') then 'ONE' when starts_with(n_name, 'NATION') then 'ANY' end) region from customer join nation on c_nationkey = n_nationkey left join a on a.alias = n_name""")
def c11_map_region(spark, d):
    c, n, r = (B.read(spark, d, t) for t in ("customer", "nation", "region"))
    alias = n.where("n_nationkey % 2 = 0").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("alias"), F.col("r_name").alias("region"))
    pre = spark.createDataFrame([("NATION", "ANY"), ("NATION_1", "ONE")], "prefix string, region string")
    return C.map_region(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name"), "n_name", alias, pre).select("c_custkey", "region")


@query("with " + B.RAW + """, x as (select *, case when raw = '-' then 0.0 else try_cast(replace(raw, ',', '') as double) end amount from raw)
select o_orderpriority region, count(*)::bigint n, count(amount)::bigint n_amount, count(*) filter (raw is null)::bigint n_missing, count(*) filter (raw is not null and amount is null)::bigint n_text from x where row_id % 5 <> 0 and row_id % 7 <> 0 group by 1""")
def c14_extract_leaves(spark, d):
    k = F.col("row_id")
    name = F.when(k % 5 == 0, "Ⅰ. part").when(k % 7 == 0, "2. group(공통)").otherwise("some item")
    raw = B.raw_amounts(spark, d).select(F.col("o_orderpriority").alias("region"), "year", k.alias("src_row"), name.alias("item_name"), F.col("raw").alias("budget_cur_raw"))
    leaf = C.extract_leaves(raw)
    return leaf.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.count("amount").alias("n_amount"), F.count_if("amount_missing").alias("n_missing"), F.count_if("non_numeric").alias("n_text"))


@query(r"""select doc_id, len(regexp_extract_all(text, '[0-9]+'))::int n_numbers, coalesce(array_to_string(regexp_extract_all(text, '[0-9]+'), '|'), '') numbers from documents""")
def c18_extract_numbers(spark, d):
    n = X.extract_numbers(F.col("text"))
    return B.read(spark, d, "documents").select("doc_id", F.size(n).alias("n_numbers"), F.array_join(n, "|").alias("numbers"))


@query("with " + B.REWRITTEN + r""" select doc_id, case when trim(cleaned) = '' then 'blank' when regexp_extract_all(original, '[0-9]+') <> regexp_extract_all(cleaned, '[0-9]+') then 'numbers' else 'kept' end verdict from rewritten""")
def c19_preservation(spark, d):
    flagged = B.rewritten(spark, d).select("doc_id", X.preservation_flags(F.col("original"), F.col("cleaned")).alias("flags"))
    verdict = F.when(F.array_contains("flags", "blank result"), "blank").when(F.array_contains("flags", "numbers differ"), "numbers").otherwise("kept")
    return flagged.select("doc_id", verdict.alias("verdict"))


@query("""select p_partkey, case p_size % 8 when 0 then 'missing original changed' when 1 then 'blank original changed' when 2 then 'blank result' when 3 then 'numbers differ; quantities differ'
when 4 then 'names missing' when 5 then 'source label added' when 6 then 'extreme length ratio' else '' end reasons from part""")
def c19_all_reasons(spark, d):
    k, name, tail = F.col("p_size") % 8, F.col("p_name"), F.concat(F.col("p_size").cast("string"), F.lit("명"))
    whole = F.concat(name, F.lit(" 복지센터 "), tail)
    old = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, " ").otherwise(whole)
    new = F.when(k == 2, " ").when(k == 3, F.concat(name, F.lit(" 복지센터 명"))).when(k == 4, F.concat(name, F.lit(" "), tail)).when(k == 5, F.concat(F.lit("원문: "), whole))
    new = new.when(k == 6, F.concat_ws(" ", whole, name, name, name)).otherwise(whole)
    return B.read(spark, d, "part").select("p_partkey", F.array_join(X.preservation_flags(old, new), "; ").alias("reasons"))


@query("""select p_partkey, p_size || '%|' || p_size * 1000 || '원|2~' || p_size || '개소' quantities, p_brand || '|서울특별시|' || replace(p_name, ' ', '') || '복지센터' as "names" from part""")
def c18_quantities_names(spark, d):
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("「"), "p_brand", F.lit("」 "), size, F.lit(" % and "), (F.col("p_size") * 1000).cast("string"), F.lit(" 원, 2 ~ "), size, F.lit(" 개소 서울특별시 "), F.replace("p_name", F.lit(" "), F.lit("")), F.lit("복지센터 plain"))
    brandless = F.regexp_replace(text, "「[^」]*」", "")
    return B.read(spark, d, "part").select("p_partkey", F.array_join(X.extract_quantities(brandless), "|").alias("quantities"), F.array_join(X.extract_names(text), "|").alias("names"))


@query("with " + B.REWRITTEN + r""" select doc_id, round_even(length(regexp_replace(cleaned, '[ \t\n\x0B\f\r]+', '', 'g'))::double / nullif(length(regexp_replace(original, '[ \t\n\x0B\f\r]+', '', 'g')), 0), 4) ratio from rewritten""")
def c37_length_ratio(spark, d):
    return B.rewritten(spark, d).select("doc_id", X.length_ratio(F.col("original"), F.col("cleaned")).alias("ratio"))


@query("""with f as (select case doc_id % 4 when 0 then ['numbers differ', 'quantities differ'] when 1 then ['blank result'] when 2 then ['extreme length ratio'] else [] end flags from documents) select unnest(flags) reason, count(*)::bigint n from f group by 1""")
def c20_reason_histogram(spark, d):
    k, base = F.col("doc_id") % 4, F.concat("source", F.lit(" 7"))
    new = F.when(k == 0, F.col("source")).when(k == 1, "").when(k == 2, F.concat(base, F.lit(" and a long tail of words"))).otherwise(base)
    docs = B.read(spark, d, "documents").select("doc_id", base.alias("old"), new.alias("new"))
    return C.reason_histogram(C.audit_candidates(docs, "old", "new"))


@query()
def c20_audit_candidates(spark, d):
    return C.reason_histogram(C.audit_candidates(B.rewritten(spark, d), "original", "cleaned"))


@query("select o_orderkey, case when year(o_orderdate) between 1995 and 1996 then 'first' when year(o_orderdate) between 1997 and 1999 then 'second' else 'out of range' end period from orders")
def c23_period_of_year(spark, d):
    return B.read(spark, d, "orders").select("o_orderkey", X.period_of(F.year("o_orderdate"), [(1995, 1996, "first"), (1997, 1999, "second")]).alias("period"))


@query("""with t as (select source, lang, case when doc_id % 3 = 0 then ' ' else source end a, case when doc_id % 6 = 0 then null else lang end b from documents)
select source, coalesce(nullif(trim(a), ''), b) as text, case when trim(a) <> '' then 'preferred' when b is not null then 'fallback' else 'none' end text_source, count(*)::bigint n from t group by all""")
def c24_coalesce_text(spark, d):
    docs = B.read(spark, d, "documents").select("source", F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("source")).alias("a"), F.when(F.col("doc_id") % 6 != 0, F.col("lang")).alias("b"))
    out, _ = C.coalesce_text(docs, "a", "b")
    return out.groupBy("source", "text", "text_source").agg(F.count(F.lit(1)).alias("n"))


@query("""select d.doc_id, case when l.quality is not null then 'q' || l.quality else d.source end as label, case when l.quality is not null then 'reviewed' else 'predicted' end label_source from documents d left join labels l using (doc_id)""")
def c28_select_label(spark, d):
    docs = B.read(spark, d, "documents").join(B.read(spark, d, "labels"), "doc_id", "left")
    rows = docs.select("doc_id", F.col("source").alias("pred_label"), F.when(F.col("quality").isNotNull(), F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("review_label"), F.when(F.col("quality").isNotNull(), "confirmed").alias("status"), F.lit(None).cast("string").alias("note"))
    taxonomy = spark.createDataFrame([("q0", "low"), ("q1", "high")], "child string, parent string")
    return C.select_label(rows, taxonomy).select("doc_id", "label", "label_source")


@query("""with p as (select p_partkey, (p_size % 7)::double b, (p_size % 5)::double r, case p_size % 3 when 0 then 'higher' when 1 then 'lower' else 'target' end dir from part),
g as (select *, case dir when 'higher' then b - r when 'lower' then r - b else abs(r - 3) - abs(b - 3) end gain from p) select p_partkey, case when abs(gain) <= 1e-12 then 'same' when gain > 0 then 'improved' else 'worsened' end verdict from g""")
def c31_direction_result(spark, d):
    k = F.col("p_size")
    way = F.when(k % 3 == 0, "higher").when(k % 3 == 1, "lower").otherwise("target")
    return B.read(spark, d, "part").select("p_partkey", X.direction_result((k % 7).cast("double"), (k % 5).cast("double"), way, F.lit(3.0)).alias("verdict"))


@query("select c_custkey, round(ln(1 + abs(c_acctbal)), 6) log_level, round(exp(c_acctbal / 10000) - 1, 6) effect from customer")
def c36_log_transform(spark, d):
    return rnd(B.read(spark, d, "customer").select("c_custkey", X.log_level(F.abs("c_acctbal")).alias("log_level"), X.log_effect(F.col("c_acctbal") / 10000).alias("effect")), 6)


# ---------------------------------------------------------------- duplicates


@query("""with x as (select event_id, event_type, user_id, lag(event_type) over w p, lag(user_id) over w q from events window w as (order by event_id)) select event_id, event_type, user_id from x where event_type = p and user_id = q""")
def d02_adjacent_duplicates(spark, d):
    return C.adjacent_duplicates(B.read(spark, d, "events").select("event_id", "event_type", "user_id"), "event_id")


@query("""with r as (select l_orderkey, l_extendedprice x, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity) pos, 2 + l_orderkey % 2 k from lineitem),
b as (select l_orderkey, (pos - 1) // k blk, case when bool_or(k = 3 and pos % 3 = 0) then max(case when k = 3 and pos % 3 = 0 then x end) else sum(x) end amount,
  case when bool_or(k = 3 and pos % 3 = 0) then '계' when count(*) > 1 then '국비+지방비' else '국비' end detail from r group by all)
select l_orderkey, count(*)::bigint n_blocks, round(sum(amount), 2) amount, count(*) filter (detail = '계')::bigint n_total, count(*) filter (detail = '국비+지방비')::bigint n_both from b group by 1""")
def d03_collapse_blocks(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity")
    rows = B.read(spark, d, "lineitem").withColumn("pos", F.row_number().over(order))
    # Two tokens in turn, or two and the total.
    pos = F.col("pos")
    token = F.when((F.col("l_orderkey") % 2 == 1) & (pos % 3 == 0), "계").when((pos - 1) % (2 + F.col("l_orderkey") % 2) == 0, "국비").otherwise("지방비")
    rows = rows.select("l_orderkey", "pos", F.lit("item").alias("item_name"), token.alias("funding"), F.col("l_extendedprice").alias("amount"))
    out = C.collapse_blocks(rows, ["item_name"], "pos", "funding", ["amount"], part=["l_orderkey"])
    detail = F.col("funding_detail")
    return rnd(out.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("amount").alias("amount"), F.count_if(detail == "계").alias("n_total"), F.count_if(detail == "국비+지방비").alias("n_both")), 2)


@query("""select 'line' spec, count(*)::bigint n_rows, count(distinct (l_orderkey, l_linenumber))::bigint n_distinct, (count(*) - count(distinct (l_orderkey, l_linenumber)))::bigint n_surplus from lineitem
union all select 'part', count(*), count(distinct l_partkey), count(*) - count(distinct l_partkey) from lineitem""")
def d04_duplicate_profile(spark, d):
    return C.duplicate_profile(B.read(spark, d, "lineitem"), {"line": ["l_orderkey", "l_linenumber"], "part": ["l_partkey"]})


@query("select n_regionkey, n_regionkey * 2 as twice from nation group by 1")
def d05_collapse_consistent(spark, d):
    n = B.read(spark, d, "nation").withColumn("twice", F.col("n_regionkey") * 2)
    return C.collapse_consistent(n, ["n_regionkey"], ["twice"])


@query("select o_custkey, min(o_orderkey) o_orderkey from orders group by 1")
def d06_keep_first(spark, d):
    return C.keep_first(B.read(spark, d, "orders"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


# ---------------------------------------------------------------- joins


@query("select c_custkey, c_name, n_name, n_name is not null matched from customer left join (select * from nation where n_nationkey % 4 <> 0) n on c_nationkey = n_nationkey")
def j01_join_checked(spark, d):
    n = B.read(spark, d, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return J.join_checked(B.read(spark, d, "customer"), n, ["c_nationkey"]).select("c_custkey", "c_name", "n_name", "matched")


@query("select s_suppkey, n_name from supplier join nation on s_nationkey = n_nationkey")
def j02_lookup_join(spark, d):
    n = B.read(spark, d, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    return J.lookup_join(B.read(spark, d, "supplier"), n, ["s_nationkey"], "n_name").select("s_suppkey", "n_name")


@query("with " + B.PANEL + " select a.region, a.year, a.budget, b.outcome, b.year target_year from panel a join panel b on a.region = b.region and b.year = a.year + 2")
def j05_offset_join(spark, d):
    p = B.panel(spark, d)
    return J.offset_join(p.select("region", "year", "budget"), p.select("region", "year", "outcome"), ["region"], k=2)


@query("with " + B.PANEL + """, c as (select region, year, lead(year) over w ny, lead(budget) over w - budget dx, lead(outcome) over w - outcome dy from panel window w as (partition by region order by year)),
k as (select * from c where ny = year + 1) select a.region, a.year base_year, round(a.dx, 4) dx, round(b.dy, 6) dy, false flag from k a join k b on a.region = b.region and b.year = a.year + 2""")
def j06_change_offset_join(spark, d):
    p = B.panel(spark, d)
    out = J.change_offset_join(p.select("region", "year", F.col("budget").alias("x")), p.select("region", "year", F.col("outcome").alias("y")), ["region"])
    return rnd(rnd(out, 4, "dx"), 6, "dy").select("region", "base_year", "dx", "dy", "flag")


@query("with " + B.SUBPANEL + """, want as (select n_name region, y::int as year, s subarea from nation, range(1995, 2004) t(y), (select distinct p_type s from part))
select want.*, coalesce(budget, 0) budget from want left join (select region, year, subarea, budget from subpanel) using (region, year, subarea)""")
def j07_grid_fill(spark, d):
    sub = B.subpanel(spark, d).select("region", "year", "subarea", "budget")
    regions = [r[0] for r in B.read(spark, d, "nation").select("n_name").collect()]
    return J.fill_grid(sub, {"region": regions, "year": list(range(1995, 2004)), "subarea": list(B.AREAS)}, ["budget"])


@query("with " + B.INDICATORS + " select indicator_id, region, year, (nk + year) % 7 = 0 block from indicators where value is null")
def j08_apply_policy(spark, d):
    p = B.indicators(spark, d)
    miss = p.where("value is null")
    rules = miss.groupBy("region", "year", ((F.col("nk") + F.col("year")) % 7 == 0).alias("block")).agg(F.collect_set("indicator_id").alias("indicator_ids"))
    rules = rules.select(F.array("region").alias("regions"), F.array("year").alias("years"), "indicator_ids", "block")
    return J.apply_policy(p.select("indicator_id", "region", "year", "value"), rules)


@query("select c_custkey, case when c_custkey % 10 = 0 then 1.5 when c_custkey % 3 = 0 then null else c_acctbal end c_acctbal from customer")
def j10_guarded_update(spark, d):
    c = B.read(spark, d, "customer").select("c_custkey", F.when((F.col("c_custkey") % 10 != 0) & (F.col("c_custkey") % 3 != 0), F.col("c_acctbal")).alias("c_acctbal"))
    return J.guarded_update(c, c.where("c_custkey % 10 = 0").select("c_custkey", F.lit(1.5).alias("new_value")), ["c_custkey"], "c_acctbal")[0]


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_custkey % 5 = 0)")
def j11_guarded_delete(spark, d):
    o, gone = B.read(spark, d, "orders"), B.read(spark, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("o_custkey"))
    n = o.join(gone, "o_custkey", "left_semi").count()
    return J.guarded_delete(o, gone, ["o_custkey"], n)[0].select("o_orderkey", "o_custkey")


@query("select p_partkey, a, not (ends_with(p_name, a)) false_match from part, (values ('ring'), ('red'), ('bolt')) t(a) where contains(p_name, a)")
def j14_containment(spark, d):
    p = B.read(spark, d, "part").withColumn("tail", F.regexp_extract("p_name", r"(\S+)$", 1))
    alias = spark.createDataFrame([("ring",), ("red",), ("bolt",)], "alias string").withColumn("region", F.col("alias"))
    return J.containment_matches(p, "p_name", alias, "tail").select("p_partkey", F.col("alias").alias("a"), "false_match")


@query("""with recursive p as (select p_type, p_partkey, regexp_replace(p_name || ' ' || p_brand, '[\\s,./\\-()]', '', 'g') k from part), u as (select distinct p_type, k from p),
c as (select a.p_type, a.k k1, b.k k2 from u a join u b on a.p_type = b.p_type and a.k < b.k where levenshtein(a.k, b.k) <= floor((length(a.k) + length(b.k)) * 0.06 + 1e-9)),
r as (select p_type, k1, k2, 0 i, list_transform(range(0, length(k2) + 1), lambda j: 0) m from c
      union all select p_type, k1, k2, i + 1, [0] || list_transform(range(1, length(k2) + 1), lambda j: list_max(g[1:j])) from
      (select *, list_transform(range(1, length(k2) + 1), lambda j: greatest(m[j + 1], case when substr(k1, i + 1, 1) = substr(k2, j::int, 1) then m[j] + 1 else 0 end)) g from r where i < length(k1))),
s as (select p_type, k1, k2, 200.0::double * m[-1] / (length(k1) + length(k2)) similarity from r where i = length(k1) and 200.0::double * m[-1] / (length(k1) + length(k2)) >= 94)
select p_type, count(*) n, min(similarity) least from s join p x using (p_type) join p y using (p_type) where x.k = s.k1 and y.k = s.k2 group by 1""")
def j15_near_duplicates(spark, d):
    p = B.read(spark, d, "part").select("p_type", "p_partkey", F.concat("p_name", F.lit(" "), "p_brand").alias("name"))
    out = J.near_duplicates(p, ["p_type"], "name", "p_partkey", 94)
    return out.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("least"))


@query("""with c as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) k from orders), z as (select o_custkey, k from c where o_orderkey % 50 = 0)
select c.o_custkey, c.o_orderkey, z.k centre, (c.k - z.k)::int as "offset" from c join z on c.o_custkey = z.o_custkey and abs(c.k - z.k) <= 2""")
def j19_context_rows(spark, d):
    from pyspark.sql import Window

    c = B.read(spark, d, "orders").withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long"))
    return J.context_rows(c.select("o_custkey", "o_orderkey", "k"), c.where("o_orderkey % 50 = 0"), "k", ["o_custkey"], 2).select("o_custkey", "o_orderkey", "centre", "offset")


@query("""with a as (select case when l_linenumber = 3 then null else l_linenumber end k, count(*) n from lineitem group by 1), b as (select case when l_linenumber % 3 = 0 then null else l_linenumber end k, sum(l_quantity) q from lineitem group by 1)
select coalesce(a.k, b.k)::int k, a.n::bigint n, b.q, case when a.n is null then 'right only' when b.q is null then 'left only' else 'both' end join_state from a full join b on a.k is not distinct from b.k""")
def j20_null_safe_join(spark, d):
    li = B.read(spark, d, "lineitem")
    a = li.groupBy(F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = li.groupBy(F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber")).alias("k")).agg(F.sum("l_quantity").alias("q"))
    return J.join_null_safe(a, b, ["k"], "full_outer")


# ---------------------------------------------------------------- aggregates


@query("with " + B.DETAIL + " select region, year, round(sum(amount), 4) budget, count(*)::bigint n_items, count(amount)::bigint n_amounts, 0::bigint n_missing, 0::bigint n_non_numeric, 0::bigint n_negative from detail group by all")
def a01_budget_panel(spark, d):
    return rnd(A.budget_panel(B.detail(spark, d)), 4)


@query("with " + B.OUTLINE + """, x as (select o.*, case when row_type = 'leaf' then (src_row // 1000000)::bigint else null end nk from outline o),
leaf as (select region, nk, sum(budget) leaf_sum from x where row_type = 'leaf' group by all), sub as (select region, src_row // 1000000 nk, item_name medium_head, budget subtotal from x where row_type = 'medium_subtotal')
select s.region, medium_head, round(subtotal, 2) subtotal, round(leaf_sum, 2) leaf_sum, round(leaf_sum - subtotal, 2) diff, case when abs(leaf_sum - subtotal) <= 0.5 then 'match' else 'mismatch' end result from sub s join leaf l using (region, nk)""")
def a03_subtotal_qa(spark, d):
    rows = B.outline(spark, d).withColumn("row_type", X.classify_row(F.col("item_name")))
    rows = C.assign_headings(rows, ["region", "year"])
    qa = A.subtotal_qa(rows, "budget", tol=0.5)
    return rnd(qa.select("region", "medium_head", "subtotal", "leaf_sum", "diff", "result"), 2)


@query("with " + B.DETAIL + """, want as (select n_name region, y::int as year, s.area from nation, range(1995, 2003) t(y), (select distinct area from detail) s) select want.*, round(coalesce(budget, 0), 4) budget from want left join (select region, year, area, sum(amount) budget from detail group by all) using (region, year, area)""")
def a04_area_panels(spark, d):
    regions = [r[0] for r in B.read(spark, d, "nation").select("n_name").collect()]
    taxonomy = spark.createDataFrame([(v, k) for k, v in B.AREAS.items()], "area string, subarea string")
    area, _ = A.area_panels(B.detail(spark, d), {"region": regions, "year": list(range(1995, 2003))}, taxonomy)
    return rnd(area.select("region", "year", "area", "budget"), 4)


@query("with " + B.INDICATORS + " select region, year, round(case when count(value) = count(*) then sum(value) end, 6) total from indicators group by all")
def a05_complete_sum(spark, d):
    return rnd(B.indicators(spark, d).groupBy("region", "year").agg(A.complete_sum("value").alias("total")), 6)


@query("with " + B.SUBPANEL + " select year, area, subarea, round(sum(budget), 4) total, round(sum(budget) / sum(sum(budget)) over (partition by year) * 100, 4) share_pct from subpanel group by year, area, subarea")
def a06_composition(spark, d):
    return rnd(A.composition(B.subpanel(spark, d)), 4)


@query("with " + B.DETAIL + " select region, year, l_returnflag label_source, count(*)::bigint n, round(sum(amount), 4) amount, round(count(*) / sum(count(*)) over (partition by region, year), 6) share_n, round(sum(amount) / sum(sum(amount)) over (partition by region, year), 6) share_amount from detail group by region, year, l_returnflag")
def a07_label_source_summary(spark, d):
    return rnd(rnd(A.label_source_summary(B.detail(spark, d).withColumnRenamed("l_returnflag", "label_source")), 4, "amount"), 6, "share_n", "share_amount")


@query("select event_type, round(100 * coalesce(sum(case when value > 50 then value end), 0) / sum(case when user_id % 2 = 0 then value end), 4) rate from events where user_id % 2 = 0 group by 1")
def a09_weighted_rate(spark, d):
    return rnd(A.weighted_rate(B.read(spark, d, "events"), F.col("value") > 50, F.col("user_id") % 2 == 0, "value", ["event_type"]))


@query("""with b as (select c_nationkey region, count(*) filter (c_custkey % 2 = 0) n from customer group by 1), a as (select c_nationkey region, count(*) n from customer group by 1)
select a.region, round((a.n + b.n) / 2.0, 4) raw, round((a.n + b.n) / 2.0 * 1000 / sum((a.n + b.n) / 2.0) over (), 4) raked, round((a.n + b.n) / 2.0 * 1000 / sum((a.n + b.n) / 2.0) over () / a.n * 100, 4) rate from a join b using (region)""")
def a13_raking(spark, d):
    c = B.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("region"))
    before, after = c.agg(F.count_if(F.col("c_custkey") % 2 == 0).alias("n")), c.agg(F.count(F.lit(1)).alias("n"))
    totals = spark.createDataFrame([(2000, 1000.0)], "year int, total double")
    den = after.select("region", F.lit(2000).alias("year"), F.col("n").alias("denominator"))
    return rnd(A.rake(before, after, totals, den).select("region", "raw", "raked", "rate"))


@query("with " + B.PANEL + """, c as (select region, year, lead(year) over w ny, lead(budget) over w - budget dx, lead(outcome) over w - outcome dy from panel window w as (partition by region order by year)),
k as (select * from c where ny = year + 1), e as (select a.region, a.dx, b.dy from k a join k b on a.region = b.region and b.year = a.year + 2 where a.dx < 0)
select region, count(*)::bigint n_events, count(*) filter (dy > 0)::bigint n_response, round(count(*) filter (dy > 0) * 100.0 / count(*), 4) response_rate from e group by 1""")
def a14_event_response(spark, d):
    p = B.panel(spark, d)
    out = J.change_offset_join(p.select("region", "year", F.col("budget").alias("x")), p.select("region", "year", F.col("outcome").alias("y")), ["region"])
    return rnd(A.event_response(out, ["region"]).select("region", "n_events", "n_response", "response_rate"))


@query("with " + B.SUBPANEL + """, w as (select right(region, 1)::int % 3 cluster, region, year, case when count(distinct subarea) = 6 then sum(budget) end total from subpanel group by all) select cluster::int cluster, year, round(avg(total), 3) mean_total, count(total)::bigint n_regions from w group by all""")
def a15_cluster_trend(spark, d):
    sub = B.subpanel(spark, d).withColumn("cluster", F.right(F.col("region"), F.lit(1)).cast("int") % 3).withColumnRenamed("subarea", "category")
    return rnd(A.cluster_trend(sub, 6, value="budget"), 3)


@query("with " + B.SUBPANEL + """, h as (select *, case when region not like '%3' then budget end b, region like '%1' odd from subpanel)
select subarea, year, round(quantile_cont(b, 0.25), 3) q1, round(quantile_cont(b, 0.5), 3) median, round(quantile_cont(b, 0.75), 3) q3, count(*) filter (b is null)::bigint n_missing, count(*) filter (odd)::bigint n_outliers from h group by all""")
def a16_distribution_summary(spark, d):
    sub = B.subpanel(spark, d).withColumn("odd", F.col("region").endswith("1")).withColumn("budget", F.when(~F.col("region").endswith("3"), F.col("budget")))
    return rnd(A.distribution_summary(sub, ["subarea", "year"], "budget", outlier="odd"), 3)


def _psi_sql(col: str, expected: str) -> str:
    return f"""(with v as (select {col}::double v, ({expected})::int e from lineitem), r as (select min(v) lo, max(v) hi from v), b as (select least(floor((v - lo) / ((hi - lo) / 10)), 9)::int bin, e from v, r),
c as (select i bin, coalesce(sum(e), 0) ne, coalesce(sum(1 - e), 0) na from range(10) t(i) left join b on b.bin = i group by 1), p as (select case when ne = 0 then 1e-4 else ne / sum(ne) over () end pe, case when na = 0 then 1e-4 else na / sum(na) over () end pa from c)
select '{col}' feature, round(sum((pa - pe) * ln(pa / pe)), 6) psi, sum((pa - pe) * ln(pa / pe)) > 0.2 flagged from p)"""


@query("""with v as (select value v, (day(ts) <= 15)::int e from events), r as (select min(v) lo, max(v) hi from v), b as (select least(floor((v - lo) / ((hi - lo) / 10)), 9)::int bin, e from v, r),
c as (select i bin, coalesce(sum(e), 0) ne, coalesce(sum(1 - e), 0) na from range(10) t(i) left join b on b.bin = i group by 1), p as (select case when ne = 0 then 1e-4 else ne / sum(ne) over () end pe, case when na = 0 then 1e-4 else na / sum(na) over () end pa from c)
select round(sum((pa - pe) * ln(pa / pe)), 6) psi from p""")
def a17_psi(spark, d):
    e = B.read(spark, d, "events")
    return rnd(S.psi(e.where(F.dayofmonth("ts") <= 15), e.where(F.dayofmonth("ts") > 15), "value"), 6)


@query("""select a, b, round(r, 6) r, n from (select unnest([{'a': 'l_quantity', 'b': 'l_extendedprice', 'r': corr(l_quantity, l_extendedprice), 'n': count(*)}, {'a': 'l_extendedprice', 'b': 'l_quantity', 'r': corr(l_quantity, l_extendedprice), 'n': count(*)},
{'a': 'l_quantity', 'b': 'l_quantity', 'r': 1.0, 'n': count(*)}, {'a': 'l_extendedprice', 'b': 'l_extendedprice', 'r': 1.0, 'n': count(*)}], recursive := true) from lineitem)""")
def a19_correlation(spark, d):
    return rnd(S.corr_matrix(B.read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]), 6)


@query("""with r as (select *, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 a, rank() over (order by l_discount) + (count(*) over (partition by l_discount) - 1) / 2.0 b from lineitem) select round(corr(a, b), 6) r from r""")
def a19_spearman(spark, d):
    return rnd(S.corr_matrix(B.read(spark, d, "lineitem"), ["l_quantity", "l_discount"], "spearman").where("a = 'l_quantity' and b = 'l_discount'").select("r"), 6)


@query("with " + B.PANEL + ", w as (select budget - avg(budget) over (partition by region) x, outcome - avg(outcome) over (partition by region) y from panel) select round(corr(x, y), 6) r from w")
def a20_within_correlation(spark, d):
    return rnd(S.within_corr(B.panel(spark, d), ["budget", "outcome"]).where("a = 'budget' and b = 'outcome'").select("r"), 6)


@query("with " + B.PANEL + " select round(1 / (1 - power(corr(budget, outcome), 2)), 6) vif, c as \"column\" from panel, (values ('budget'), ('outcome')) t(c) group by c")
def a21_vif(spark, d):
    return rnd(S.vif(B.panel(spark, d), ["budget", "outcome"]).select("column", "vif"), 6)


@query("with " + B.PANEL + " select region, count(*)::bigint n, round(corr(budget, outcome), 6) pearson from panel group by 1")
def a23_grouped_correlation(spark, d):
    return rnd(S.group_corr(B.panel(spark, d), ["region"], "budget", "outcome").select("region", "n", "pearson"), 6)


@query("""with e as (select l_extendedprice y, l_quantity * 1000 p from lineitem) select round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) r2, round(sqrt(avg((y - p) * (y - p))), 3) rmse, round(avg(abs(y - p)), 3) mae, round(avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)), 6) mape from e""")
def a24_regression_metrics(spark, d):
    li = B.read(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 1000)
    return rnd(rnd(S.regression_metrics(li, "l_extendedprice", "p"), 3, "rmse", "mae"), 6, "r2", "mape")


@query("""with x as (select l_returnflag y, case when l_quantity > 40 then 'A' when l_quantity > 20 then 'N' else 'R' end p from lineitem), c as (select k, (select count(*) from x where y = k) a, (select count(*) from x where p = k) b, (select count(*) from x where y = k and p = k) h from (select distinct y k from x)),
f as (select *, coalesce(2.0 * h / nullif(a + b, 0), 0) f1 from c) select round(sum(h) / sum(a), 6) accuracy, round(avg(f1), 6) macro_f1, round(sum(f1 * a) / sum(a), 6) weighted_f1 from f""")
def a25_classification_metrics(spark, d):
    q = F.col("l_quantity")
    li = B.read(spark, d, "lineitem").withColumn("p", F.when(q > 40, "A").when(q > 20, "N").otherwise("R"))
    return rnd(S.classification_metrics(li, "l_returnflag", "p"), 6)


@query("""with e as (select l_extendedprice - l_quantity * 1000 e from lineitem) select round(avg(e), 3) mean, round(stddev_pop(e), 3) std, round(min(e), 2) min, round(max(e), 2) max, round(skewness(e), 5) skew, round(kurtosis(e), 5) kurtosis from e""")
def a26_residual_summary(spark, d):
    li = B.read(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 1000)
    return rnd(rnd(rnd(S.residual_summary(li, "l_extendedprice", "p"), 5, "skew", "kurtosis"), 3, "mean", "std"), 2, "min", "max")


@query("select lang, source, count(*)::bigint n_rows, count(distinct n_chars)::bigint n_labels, round(avg(n_chars), 3) mean_confidence, count(*) filter (n_chars < 1000)::bigint n_low, round(count(*) filter (n_chars < 1000) / count(*), 6) share_low from documents group by all")
def a27_prediction_qa(spark, d):
    # Sums of whole numbers do not depend on the order.
    return rnd(rnd(A.prediction_qa(B.read(spark, d, "documents"), ["lang", "source"], "n_chars", "n_chars", low=1000), 3, "mean_confidence"), 6, "share_low")


_WORDS = r"""tok as (select p_type g, p_partkey id, unnest(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: length(w) >= 2)) term from part), tf as (select g, id, term, count(*) tf from tok group by all),
dfs as (select term, count(*) df from tf group by 1), raw as (select tf.*, tf.tf * (ln((1 + (select count(*) from part)) / (1 + df)::double) + 1) raw from tf join dfs using (term)), w as (select *, raw / sqrt(sum(raw * raw) over (partition by id)) wt from raw),
s as (select g, term, sum(wt) s, count(*) f from w group by all), k as (select p_type g, count(*) n from part group by 1)"""


@query("with " + _WORDS + " select * from (select g p_type, term, f::bigint doc_freq, round(s / n, 6) score, row_number() over (partition by g order by round(s / n, 9) desc, term)::int place from s join k using (g)) where place <= 5")
def a28_group_keywords(spark, d):
    p = B.read(spark, d, "part")
    return rnd(T.group_keywords(p, "p_type", "p_partkey", T.word_tokens(F.col("p_name")), n=5), 6).select("p_type", "term", "doc_freq", "score", "place")


@query("with " + B.SUBPANEL + """, s as (select subarea, sum(case when year = 1995 then budget end) a, sum(case when year = 2000 then budget end) b, sum(case when year between 1995 and 1997 then budget end) e, sum(case when year between 1998 and 2000 then budget end) l from subpanel group by 1),
x as (select subarea, a / sum(a) over () * 100 a, b / sum(b) over () * 100 b, e / sum(e) over () * 100 e, l / sum(l) over () * 100 l from s) select subarea, round(b - a, 4) change_year, round(l - e, 4) change_period, rank() over (order by abs(l - e) desc)::int as rank from x""")
def a30_share_change(spark, d):
    return rnd(A.share_change(B.subpanel(spark, d), 1995, 2000, (1995, 1997), (1998, 2000)).select("subarea", "change_year", "change_period", "rank"))


@query("with " + B.INDICATORS + """, cov as (select indicator_id, year, count(value) n from indicators group by all), best as (select indicator_id, min(year) f, max(year) l from (select *, max(n) over (partition by indicator_id) m from cov) where n = m group by 1),
x as (select i.indicator_id, i.region, max(case when year = f then value end) fv, max(case when year = l then value end) lv, count(value)::bigint n_observed from indicators i join best using (indicator_id) group by all)
select indicator_id, region, round(fv, 4) first_value, round(lv, 4) last_value, n_observed, round(lv - fv, 4) change from x""")
def a31_region_summary(spark, d):
    long = B.indicators(spark, d).select("indicator_id", "region", "year", "value")
    dirs = B.indicators(spark, d).select("indicator_id", F.when(F.col("direction") == "positive", "higher").otherwise("lower").alias("direction")).distinct()
    return rnd(A.indicator_region_summary(long, dirs).select("indicator_id", "region", "first_value", "last_value", "n_observed", "change").withColumns({"first_value": F.round("first_value", 4), "last_value": F.round("last_value", 4)}), 4, "change")


@query("with " + B.SUBPANEL + """, t as (select region, year, sum(budget) total from subpanel group by all), l as (select *, ln(1 + total) x from t), z as (select *, (x - avg(x) over ()) / stddev_pop(x) over () z from l), s as (select *, (z - min(z) over ()) / (max(z) over () - min(z) over ()) * 100 score from z)
select region, year, round(score, 4) score, rank() over (partition by year order by score desc)::int as rank from s""")
def a32_composite_score(spark, d):
    return rnd(A.composite_score(B.subpanel(spark, d)).select("region", "year", "score", "rank"))


# ---------------------------------------------------------------- windows


@query("with " + B.PANEL + " select region, year, lag(budget) over w budget_lag1, lag(budget, 2) over w budget_lag2, lead(budget) over w budget_lead1 from panel window w as (partition by region order by year)")
def w01_lag_lead(spark, d):
    return W.lags(B.panel(spark, d), ["region"], "year", "budget", [1, 2, -1], check=False).select("region", "year", "budget_lag1", "budget_lag2", "budget_lead1")


@query("with " + B.PANEL + " select region, year, round(budget - lag(budget) over w, 4) budget_diff, round((budget - lag(budget) over w) / lag(budget) over w * 100, 4) budget_pct from panel window w as (partition by region order by year)")
def w02_yoy(spark, d):
    return rnd(rnd(W.yoy(B.panel(spark, d), ["region"], "year", "budget", consecutive=False).select("region", "year", "budget_diff", "budget_pct"), 4, "budget_diff"), 4, "budget_pct")


@query("with " + B.PANEL + " select region, year, round(case when count(budget) over w = 3 then avg(budget) over w end, 2) m from panel window w as (partition by region order by year rows between 2 preceding and current row)")
def w03_rolling_mean(spark, d):
    return rnd(W.rolling(B.panel(spark, d), ["region"], "year", "budget", 3, "m").select("region", "year", "m"), 2)


@query("with " + B.PANEL + " select region, year, rank() over (partition by year order by budget desc)::int as rank, round((count(*) over (partition by year) - rank() over (partition by year order by budget desc)) * 100.0 / (count(*) over (partition by year) - 1), 4) rank_score from panel")
def w04_rank_min(spark, d):
    return rnd(W.rank_min(B.panel(spark, d), ["year"], "budget").select("region", "year", "rank", "rank_score"))


@query("with " + B.PANEL + " select region, year, round((budget - avg(budget) over ()) / stddev_pop(budget) over (), 6) z from panel")
def w05_zscore(spark, d):
    return rnd(W.zscore(B.panel(spark, d), "budget", out="z").select("region", "year", "z"), 6)


@query("with " + B.SUBPANEL + " select region, year, subarea, round((budget - min(budget) over w) / (max(budget) over w - min(budget) over w) * 100, 5) score from subpanel window w as (partition by subarea)")
def w06_minmax(spark, d):
    return rnd(W.minmax(B.subpanel(spark, d), "budget", ["subarea"], "score").select("region", "year", "subarea", "score"), 5)


@query("with " + B.SUBPANEL + " select region, year, subarea, round(budget / sum(budget) over (partition by region, year), 6) share from subpanel")
def w07_share(spark, d):
    return rnd(W.share(B.subpanel(spark, d), ["region", "year"], "budget").select("region", "year", "subarea", "share"), 6)


@query("with " + B.OUTLINE + " select region, src_row, last_value(case when row_type = 'medium_subtotal' then item_name end ignore nulls) over (partition by region order by src_row) medium_head from outline")
def w08_forward_fill(spark, d):
    rows = B.outline(spark, d).withColumn("row_type", X.classify_row(F.col("item_name")))
    return C.assign_headings(rows, ["region", "year"]).select("region", "src_row", "medium_head")


_IMPUTE = """, s0 as (select *, count(value) over e n, min(case when value is not null then year end) over e f, max(case when value is not null then year end) over e l, sum(blocked::int) over (partition by indicator_id, region order by year) seg from indicators window e as (partition by indicator_id, region)),
s1 as (select *, last_value(case when value is not null and not blocked then year end ignore nulls) over lo ly, last_value(case when value is not null and not blocked then value end ignore nulls) over lo lv,
  first_value(case when value is not null and not blocked then year end ignore nulls) over hi hy, first_value(case when value is not null and not blocked then value end ignore nulls) over hi hv,
  max(case when year = f then value end) over (partition by indicator_id, region) fv, max(case when year = l then value end) over (partition by indicator_id, region) tv from s0
  window lo as (partition by indicator_id, region, seg order by year rows between unbounded preceding and current row), hi as (partition by indicator_id, region, seg order by year rows between current row and unbounded following)),
s2 as (select *, case when value is not null then 'observed' when blocked then 'structural' when n = 0 then 'all missing' when n = 1 then 'single year' when year < f then 'leading' when year > l then 'trailing' else 'intermediate' end position from s1)"""


@query("with " + B.INDICATORS + _IMPUTE + """ select indicator_id, region, year, position, round(case position when 'leading' then fv when 'trailing' then tv when 'intermediate' then lv + (hv - lv) * (year - ly) / nullif(hy - ly, 0) when 'observed' then value end, 7) value_filled from s2""")
def w09_impute_series(spark, d):
    out = M.impute_series(B.indicators(spark, d), ["indicator_id", "region"])
    return rnd(out.select("indicator_id", "region", "year", "position", "value_filled"), 7)


@query("with " + B.INDICATORS + _IMPUTE + " select indicator_id, region, year, position, round(case position when 'leading' then fv else tv end, 6) main_value, null::double alt_value from s2 where position in ('leading', 'trailing')")
def w10_scenarios(spark, d):
    main, alt = M.impute_scenarios(B.indicators(spark, d), ["indicator_id", "region"])
    return rnd(M.sensitivity(main, alt, ["indicator_id", "region", "year"]).select("indicator_id", "region", "year", "position", "main_value", "alt_value"), 6)


@query("with " + B.INDICATORS + """, p as (select *, last_value(case when value is not null then year end ignore nulls) over (partition by indicator_id, region order by year) p, first_value(case when value is not null then year end ignore nulls) over (partition by indicator_id, region order by year rows between current row and unbounded following) q from indicators),
x as (select *, count(*) filter (value is null) over (partition by indicator_id, region, p, q) run_length from p)
select indicator_id, region, year, case when p is null and q is null then 'all missing' when p is null then 'leading' when q is null then 'trailing' else 'intermediate' end position,
case when q is null or (p is not null and year - p <= q - year) then p else q end nearest_year, run_length::bigint run_length from x where value is null""")
def w11_missing_position(spark, d):
    return M.missing_position(B.indicators(spark, d), ["indicator_id", "region"]).select("indicator_id", "region", "year", "position", "nearest_year", "run_length")


@query("with " + B.INDICATORS + " select indicator_id, region, year, round(full_value - avg(full_value) over (partition by region) - avg(full_value) over (partition by year) + avg(full_value) over (), 3) resid from indicators where indicator_id = 'BUILDING'")
def w12_two_way_demean(spark, d):
    out = W.two_way_demean(B.indicators(spark, d).where("indicator_id = 'BUILDING'"), "region", "year", ["full_value"], check=False)
    return rnd(out.select("indicator_id", "region", "year", F.col("full_value_resid").alias("resid")), 3)


@query("with q as (select event_type, quantile_cont(value, 0.25) a, quantile_cont(value, 0.75) b from events group by 1) select event_id, event_type, value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a) outlier from events join q using (event_type)")
def w13_iqr_outlier(spark, d):
    return W.iqr_flag(B.read(spark, d, "events"), ["event_type"], "value").select("event_id", "event_type", "outlier")


@query("with e as (select quantile_cont(c_acctbal, 1 / 3.0::double) a, quantile_cont(c_acctbal, 2 / 3.0::double) b from customer) select c_custkey, case when c_acctbal <= a then 'low' when c_acctbal <= b then 'mid' else 'high' end bin from customer, e")
def w14_tercile(spark, d):
    return W.qcut(B.read(spark, d, "customer"), "c_acctbal", ["low", "mid", "high"]).select("c_custkey", "bin")


@query("""with s as (select event_type, ts::date d, sum(value) v from events group by all) select event_type, d::varchar d, round(lag(v) over w, 3) lag1, round(case when count(v) over f = 7 then avg(v) over f end, 3) mean7, round(case when count(v) over f = 7 then stddev_samp(v) over f end, 3) std7, (isodow(d) >= 6)::int is_weekend
from s window w as (partition by event_type order by d), f as (partition by event_type order by d rows between 7 preceding and 1 preceding)""")
def w15_time_features(spark, d):
    s = B.read(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.sum("value").alias("v"))
    out = W.time_features(s, ["event_type"], "d", "v")
    return rnd(out.select("event_type", F.col("d").cast("string").alias("d"), F.col("v_lag1").alias("lag1"), F.col("v_mean7").alias("mean7"), F.col("v_std7").alias("std7"), "is_weekend"), 3)


@query("select * from (select o_orderpriority, o_orderkey, o_totalprice, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey)::int place from orders) where place <= 3")
def w16_top_n(spark, d):
    return W.top_n(B.read(spark, d, "orders"), ["o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_orderpriority", "o_orderkey", "o_totalprice", "place")


@query("with " + B.PANEL + ", " + B.CPI + ", " + B.POPULATION + """, r as (select p.region, p.year, budget * 100.0 / cpi as real, budget * 100.0 / cpi / population pc from panel p join cpi c on p.year = c.year join population o on p.region = o.region),
l as (select *, ln(1 + real) lr, ln(1 + pc) lp from r), z as (select *, (lr - avg(lr) over ()) / stddev_pop(lr) over () zr, (lp - avg(lp) over ()) / stddev_pop(lp) over () zp from l), s as (select *, (zp - min(zp) over ()) / (max(zp) over () - min(zp) over ()) * 100 score from z)
select region, year, round(real, 2) as real, round(zr, 6) log_real_z, round(zp, 6) log_per_capita_z, round(score, 4) score, rank() over (partition by year order by score desc)::int as rank, round((real - lag(real) over w) / lag(real) over w * 100, 4) real_pct from s window w as (partition by region order by year)""")
def w17_fiscal_index(spark, d):
    pop = B.panel(spark, d).select("region", "year").join(B.population(spark, d), "region")
    out = W.fiscal_index(B.panel(spark, d).select("region", "year", "budget"), B.cpi(spark), pop, B.BASE_YEAR)
    out = out.select("region", "year", "real", "log_real_z", "log_per_capita_z", "score", "rank", "real_pct")
    return rnd(rnd(rnd(out, 6, "log_real_z", "log_per_capita_z"), 4, "score", "real_pct"), 2, "real")


# ---------------------------------------------------------------- sets and reshaping


@query("select o_custkey, case when o_custkey % 2 = 0 and o_custkey % 3 = 0 then 'both' when o_custkey % 2 = 0 then 'left' else 'right' end side from (select distinct o_custkey from orders where o_custkey % 2 = 0 or o_custkey % 3 = 0)")
def x04_key_diff(spark, d):
    o = B.read(spark, d, "orders")
    return R.key_diff(o.where("o_custkey % 2 = 0"), o.where("o_custkey % 3 = 0"), ["o_custkey"])


@query("with " + B.SUBPANEL + " select region, year::int as year, subarea, budget from subpanel")
def r01_unpivot(spark, d):
    wide = B.subpanel(spark, d).groupBy("region", "subarea").pivot("year", B.YEARS).agg(F.first("budget"))
    return R.unpivot_years(wide, ["region", "subarea"], value="budget").where("observed").select("region", "year", "subarea", "budget")


@query("with " + B.SUBPANEL + " select region, year, sum(case subarea when 'PROMO' then budget end) \"PROMO\", sum(case subarea when 'SMALL' then budget end) \"SMALL\" from subpanel where year between 1996 and 2000 group by all having count(*) filter (subarea in ('PROMO', 'SMALL')) = 2")
def r02_pivot_strict(spark, d):
    sub = B.subpanel(spark, d).where("year between 1996 and 2000 and subarea in ('PROMO', 'SMALL')")
    whole = sub.groupBy("region", "year").agg(F.count(F.lit(1)).alias("k")).where("k = 2")
    return R.pivot_strict(sub.join(whole, ["region", "year"], "left_semi"), ["region", "year"], "subarea", "budget", ["PROMO", "SMALL"])


# ---------------------------------------------------------------- index


@query("with " + B.INDICATORS + ", " + B.CPI + " select indicator_id, region, i.year, round(case when indicator_id in ('BUILDING', 'MACHINERY') then full_value * 100 / cpi else full_value end, 6) as value from indicators i join cpi c on i.year = c.year")
def i02_deflate(spark, d):
    out = I.deflate(B.indicators(spark, d).select("indicator_id", "region", "year", F.col("full_value").alias("value")), B.cpi(spark), ["BUILDING", "MACHINERY"])
    return rnd(out.select("indicator_id", "region", "year", "value"), 6)


@query("with " + B.CPI + """, y as (select year(o_orderdate)::int as year, count(*) n from orders group by 1) select c.year::int as year, round_even(cpi / (select cpi from cpi where year = 2000) * 100, 6) cpi, n::bigint n_orders from cpi c join y on c.year = y.year""")
def i03_rebase_cpi(spark, d):
    y = B.read(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n_orders"))
    return I.rebase_cpi(B.cpi(spark), 2000).join(y, "year").select("year", "cpi", "n_orders")


_STD = """, st as (select *, (v - avg(v) over w) / stddev_pop(v) over w z from (select *, full_value v from indicators) window w as (partition by indicator_id{y})),
sc as (select *, case when direction = 'negative' then 100 - s else s end ds from (select *, coalesce((z - min(z) over w) / nullif(max(z) over w - min(z) over w, 0) * 100, 50) s from st window w as (partition by indicator_id{y})))"""


def _scores(spark, d, method):
    return I.standardize(B.indicators(spark, d).drop("value").withColumnRenamed("full_value", "value"), method)


@query("with " + B.INDICATORS + _STD.format(y="") + " select indicator_id, region, year, round(z, 5) z_score, round(ds, 4) directional_score from sc")
def i04_standardize(spark, d):
    return rnd(rnd(_scores(spark, d, "pooled").select("indicator_id", "region", "year", "z_score", "directional_score"), 5, "z_score"), 4, "directional_score")


_FULL = ", ok as (select region, year from indicators group by all having count(*) = 5)"


@query("with " + B.INDICATORS + ", " + B.WEIGHTS + _STD.format(y="") + _FULL + ", f as (select region, year, sum(ds * weight) x from sc join weights using (indicator_id) join ok using (region, year) group by all) select region, year, round(x, 4) index_score, rank() over (partition by year order by round(x, 9) desc)::int as rank from f")
def i05_weighted_index(spark, d):
    sc = _scores(spark, d, "pooled")
    ok = sc.groupBy("region", "year").agg(F.count(F.lit(1)).alias("k")).where("k = 5")
    return rnd(I.compute_index(sc.join(ok, ["region", "year"], "left_semi"), B.weights(spark)).final)


@query("with " + B.INDICATORS + ", " + B.WEIGHTS + _STD.format(y="") + _FULL + " select region, year, category, round(sum(ds * weight) / sum(weight), 4) score from sc join weights using (indicator_id) join ok using (region, year) group by all")
def i05_category_scores(spark, d):
    sc = _scores(spark, d, "pooled")
    ok = sc.groupBy("region", "year").agg(F.count(F.lit(1)).alias("k")).where("k = 5")
    return rnd(I.compute_index(sc.join(ok, ["region", "year"], "left_semi"), B.weights(spark)).categories.select("region", "year", "category", "score"))


# ---------------------------------------------------------------- text


@query("with " + _WORDS + " select id p_partkey, term, round(wt, 6) weight from w")
def t02_tfidf(spark, d):
    w = T.tfidf(B.read(spark, d, "part"), "p_partkey", T.word_tokens(F.col("p_name")))
    return rnd(w.select(F.col("doc_id").alias("p_partkey"), "term", "weight"), 6)


@query("""with recursive n as (select p_name t, count(*) c from part group by 1), tok as (select t, unnest(list_filter(regexp_split_to_array(lower(t), '[^a-z0-9]+'), lambda w: length(w) >= 2)) term from n), tf as (select t, term, count(*) tf from tok group by all), dfs as (select term, count(*) df from tf group by 1),
raw as (select tf.*, tf.tf * (ln((1 + (select count(*) from n)) / (1 + df)::double) + 1) raw from tf join dfs using (term)), w as (select *, raw / sqrt(sum(raw * raw) over (partition by t)) wt from raw)
select a.t a, b.t b, round(sum(a.wt * b.wt), 5) cosine from w a join w b on a.term = b.term and a.t < b.t group by all having sum(a.wt * b.wt) >= 0.6""")
def t03_cosine_pairs(spark, d):
    names = B.read(spark, d, "part").select(F.col("p_name").alias("doc_id")).distinct()
    return rnd(T.cosine_pairs(T.tfidf(names, "doc_id", T.word_tokens(F.col("doc_id")), normed=False), 0.6), 5)


@query(r"""with s as (select distinct trim(x) t from (select unnest(regexp_split_to_array(text, '[.,\n] ?')) x from documents) where length(trim(x)) between 12 and 40),
p as (select t, ' ' || unnest(list_filter(regexp_split_to_array(lower(t), '\s+'), lambda x: x <> '')) || ' ' p from s), tok as (select t, unnest(case when length(p) <= 3 then [p] else list_transform(range(1, length(p) - 1), lambda i: substr(p, i::int, 3)) end) term from p),
tf as (select t, term, count(*) tf from tok group by all), dfs as (select term, count(*) df from tf group by 1), raw as (select tf.*, tf.tf * (ln((1 + (select count(*) from s)) / (1 + df)::double) + 1) raw from tf join dfs using (term)),
w as (select *, raw / sqrt(sum(raw * raw) over (partition by t)) wt from raw) select a.t a, b.t b, round(sum(a.wt * b.wt), 5) cosine from w a join w b on a.term = b.term and a.t < b.t group by all having sum(a.wt * b.wt) >= 0.5""")
def t03_sentence_pairs(spark, d):
    cut = B.read(spark, d, "documents").select(F.explode(F.split("text", r"[.,\n] ?")).alias("x")).select(F.trim("x").alias("doc_id"))
    names = cut.where("length(doc_id) between 12 and 40").distinct()
    return rnd(T.cosine_pairs(T.tfidf(names, "doc_id", T.char_ngrams(F.col("doc_id"), 3, 3), normed=False), 0.5), 5)


def _representatives_sql(t: float) -> str:
    """The sequential rule: in the order of size and name, a name is a representative unless an earlier one takes it."""
    return f"""with recursive names as (select p_name t, count(*) n from part group by 1), o as (select t, n, row_number() over (order by n desc, t) i from names),
words as (select i, ' ' || unnest(regexp_split_to_array(lower(t), '\\s+')) || ' ' w from o), grams as (select words.i, substr(w, b.i::int, n::int) g from words, range(2, 6) a(n), unnest(range(1, length(w) - n + 2)) b(i) where n <= length(w)),
tf as (select i, g, count(*) tf from grams group by all), dfs as (select g, count(*) df from tf group by 1), raw as (select tf.*, tf.tf * (ln((1 + (select count(*) from o)) / (1 + df)::double) + 1) raw from tf join dfs using (g)),
w as (select *, raw / sqrt(sum(raw * raw) over (partition by i)) wt from raw), c as (select a.i i, b.i j, sum(a.wt * b.wt) s from w a join w b on a.g = b.g and a.i <> b.i group by all having sum(a.wt * b.wt) >= {t}), near as (select i, list(j) js from c group by i),
r as (select 0::bigint i, []::bigint[] reps union all select r.i + 1, case when len(list_intersect(reps, coalesce(js, []::bigint[]))) = 0 then list_append(reps, r.i + 1) else reps end from r left join near on near.i = r.i + 1 where r.i < (select count(*) from o)),
f as (select o.*, case when list_contains(reps, o.i) then o.i else (select min(j) from c where c.i = o.i and list_contains(last.reps, j)) end k from o, (select reps from r order by i desc limit 1) last)
select f.t "text", x.t rep, round(case when f.i = f.k then 1.0::double else c.s end, 6) similarity from f join o x on x.i = f.k left join c on c.i = f.i and c.j = f.k"""


def _representatives(spark, d, t: float):
    names = B.read(spark, d, "part").groupBy(F.col("p_name").alias("text")).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(""))
    return T.representative_texts(names, t).select("text", "rep", F.round("similarity", 6).alias("similarity"))


@query(_representatives_sql(0.6))
def t04_representatives(spark, d):
    return _representatives(spark, d, 0.6)


@query(_representatives_sql(0.3))
def t04_wide_groups(spark, d):
    """At a threshold that names of one common word reach, so that representatives do take others."""
    return _representatives(spark, d, 0.3)


# ---------------------------------------------------------------- panel statistics


@query("with recursive " + B.PANEL + """, p as (select region, dense_rank() over (order by year) - 1 t, ln(1 + budget) - avg(ln(1 + budget)) over (partition by region) x, outcome - avg(outcome) over (partition by region) y from panel),
g as (select region, sum(x * x) xx, sum(x * y) xy, count(*) n from p group by region), c as (select count(*) r, max(n) t from g),
a as (select s.t i, u.t j, (case when s.t = u.t then any_value(r) else 0 end) - any_value(c.r)::double / any_value(c.t) - sum(s.x * u.x / xx) v from p s join p u using (region) join g using (region), c where s.t > 0 and u.t > 0 group by s.t, u.t
      union all select p.t, any_value(c.t), sum(p.y - p.x * xy / xx) from p join g using (region), c where p.t > 0 group by p.t),
m as (select 0 k, list(v order by i) m, any_value(w) w from (select i, list(v order by j) v, count(*) w from a group by i)
      union all select k + 1, list_transform(m, lambda e, i: list_transform(range(1, w + 1), lambda j: case when i = k + 1 then e[j] / m[k + 1][k + 1] else e[j] - e[k + 1] * m[k + 1][j] / m[k + 1][k + 1] end)), w from m where k + 1 < w),
f as (select region, sum(p.x * m.m[p.t][m.w]) s from p, m where m.k + 1 = m.w and p.t > 0 group by region)
select region, round((xy - s) / xx, 7) slope, n, null::varchar note from g join f using (region)""")
def m07_region_slopes(spark, d):
    return rnd(S.region_slopes(B.panel(spark, d).withColumn("x", F.log1p("budget")), "outcome", "x"), 7, "slope")


@query("""with p as (select p_type f, (p_size / 51.0) p, p_partkey from part), r as (select *, row_number() over (partition by f order by p, p_partkey) i, count(*) over (partition by f) m from p),
q as (select *, min(p * m / i) over (partition by f order by p, p_partkey rows between current row and unbounded following) q from r) select f p_type, p_partkey, round(least(min(q) over (partition by f, p), 1), 6) q from q""")
def m08_bh_adjust(spark, d):
    p = B.read(spark, d, "part").select("p_type", "p_partkey", (F.col("p_size") / 51.0).alias("p"))
    return rnd(S.bh(p, ["p_type"]).select("p_type", "p_partkey", "q"), 6)


@query("""with c as (select p_type a, p_size % 4 b, count(*) n from part group by all), s as (select sum(n * (n - 1) / 2.0) cell, sum(n) t from c), x as (select sum(n * (n - 1) / 2.0) sa from (select sum(n) n from c group by a)), y as (select sum(n * (n - 1) / 2.0) sb from (select sum(n) n from c group by b))
select round((cell - sa * sb / (t * (t - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2.0)), 6) ari from s, x, y""")
def m11_adjusted_rand(spark, d):
    return rnd(S.adjusted_rand(B.read(spark, d, "part").withColumn("b", F.col("p_size") % 4), "p_type", "b"), 6)


def _kmeans_sql(areas, ks: tuple[int, int], seeds: int) -> str:
    """CTEs ``z`` (region, x) of standardised profiles and ``best`` (k, region, cluster, d, wcss): Lloyd rounds of every try, more than they need."""
    dims = len(areas)
    listed = ", ".join(f"coalesce(avg(budget) filter (subarea = '{a}'), 0.0)" for a in areas)
    z = ", ".join(f"(f[{i + 1}] - avg(f[{i + 1}]) over ()) / stddev_pop(f[{i + 1}]) over ()" for i in range(dims))
    near = f"list_min(list_transform(range(1, k + 1), lambda j: {{'d': list_sum(list_transform(range(1, {dims} + 1), lambda m: (x[m] - c[j][m]) * (x[m] - c[j][m]))), 'j': j}}))"
    mean = "[" + ", ".join(f"avg(x[{i + 1}])" for i in range(dims)) + "]"
    return (
        B.SUBPANEL + f""", w as (select region, [{listed}] f from subpanel group by region), z as (select region, [{z}] x from w),
tries as (select k::int k, s::int seed from range({ks[0]}, {ks[1] + 1}) a(k), range({seeds}) b(s) where k > 1 or s = 0),
drawn as (select k, seed, x, row_number() over (partition by k, seed order by md5(seed || ':' || region), region) rn from tries, z),
r as (select k, seed, 0 i, list(x order by rn) c from drawn where rn <= k group by all
      union all select k, seed, i + 1, list_transform(range(1, k + 1), lambda j: coalesce(ms[list_position(js, j)], c[j])) from
      (select k, seed, i, any_value(c) c, list(j order by j) js, list(mean order by j) ms from
       (select k, seed, i, any_value(c) c, n.j j, {mean} mean from (select r.*, z.x, {near} n from r, z where i < 40) group by k, seed, i, n.j) group by k, seed, i)),
p as (select k, seed, region, c, {near} n from r, z where i = 40), q as (select *, sum(n.d) over (partition by k, seed) wcss from p),
o as (select *, row_number() over (partition by k order by round(wcss, 7), seed) rn from (select distinct k, seed, wcss from q)),
best as (select q.k, q.region, q.n.d d, q.wcss, len(list_filter(q.c, lambda e: e < q.c[q.n.j]))::int "cluster" from q join o on o.rn = 1 and o.k = q.k and o.seed = q.seed)"""
    )


@query("with recursive " + _kmeans_sql(list(B.AREAS), (3, 3), 10) + ' select region, "cluster" from best')
def m10_kmeans_profiles(spark, d):
    from gridloom.operators.learning import kmeans_profiles

    wide = B.subpanel(spark, d).groupBy("region").pivot("subarea", list(B.AREAS)).agg(F.avg("budget"))
    return kmeans_profiles(wide.fillna(0.0), "region", list(B.AREAS), 3)[0].select("region", "cluster")


@query(r"""select conv_id, turn, case when turn % 3 = 0 then text else regexp_replace(text, '\s+', ' ', 'g') end refined, 'success' status, turn % 3 = 0 reused from conversations""")
def e01_incremental(spark, d):
    """White space is squeezed in every turn but those with a stored result of the same text; results of older texts are not reused."""
    from gridloom.streaming.incremental import incremental_apply, source_hash

    rows = B.read(spark, d, "conversations").select("conv_id", "turn", "text")
    kept = rows.where("turn % 3 = 0").withColumn("before", F.col("text"))
    stale = rows.where("turn % 3 = 1").withColumn("before", F.concat("text", F.lit(" (old)")))
    state = kept.unionByName(stale).select("conv_id", "turn", source_hash("before").alias("source_sha"), F.col("before").alias("refined"), F.lit("success").alias("status"), F.lit(0).cast("long").alias("batch"))
    result, _, _ = incremental_apply(rows, state, lambda s: s.str.replace(r"\s+", " ", regex=True), ["conv_id", "turn"], "text", 1)
    return result.select("conv_id", "turn", "refined", "status", "reused")


def _labelled_parts(spark, d):
    return B.read(spark, d, "part").select("p_partkey", "p_name", "p_type", F.regexp_extract("p_name", r"(\S+)$", 1).alias("label"))


@query(r"""select p_partkey, regexp_extract(p_name, '(\S+)$', 1) as label, regexp_extract(p_name, '(\S+)$', 1) pred_label, false low_confidence from part where p_partkey % 2 = 1""")
def t06_text_classifier(spark, d):
    """Held-out rows: the label is the last word of the name, so a fit on the other half must find all of them."""
    from gridloom.operators.learning import fit_text_classifier, predict_labels

    p = _labelled_parts(spark, d)
    clf = fit_text_classifier(p.where("p_partkey % 2 = 0"), "p_partkey", "p_name", "label", max_iter=10)
    return predict_labels(clf, p.where("p_partkey % 2 = 1"), "p_partkey", "p_name").select("p_partkey", "label", "pred_label", "low_confidence")


@query(r"""with words as (select p_partkey, ' ' || unnest(regexp_split_to_array(lower(p_name), '\s+')) || ' ' w from part), grams as (select p_partkey, substr(w, i::int, n::int) g from words, range(2, 6) a(n), unnest(range(1, length(w) - n + 2)) b(i) where n <= length(w)),
f as (select g from grams group by g having count(distinct p_partkey) >= 2) select (select count(*) from part)::bigint n_rows, (select count(distinct regexp_extract(p_name, '(\S+)$', 1)) from part)::int n_classes, (select count(*) from f)::bigint n_features, true optimal""")
def t06_optimum(spark, d):
    """The gradient of the penalised likelihood vanishes at the fit."""
    from gridloom.operators.learning import fit_text_classifier, optimality

    p = _labelled_parts(spark, d)
    clf = fit_text_classifier(p, "p_partkey", "p_name", "label", max_iter=300, tol=1e-12)
    return optimality(clf, p, "p_partkey", "p_name", "label").select("n_rows", "n_classes", "n_features", (F.col("residual") < 1e-7).alias("optimal"))


# ---------------------------------------------------------------- the rest of the inventory


@query("select o_orderpriority from orders group by 1 having bool_or(o_orderpriority not in ('1-URGENT', '2-HIGH'))")
def v06_outside_taxonomy(spark, d):
    known = spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "level string")
    return V.outside(B.read(spark, d, "orders"), "o_orderpriority", known, "level")


@query("with " + B.INDICATORS + _IMPUTE + """, b as (select *, (nk + year) % 4 = 0 spoilt from s2)
select c "check", n::bigint n_bad, n = 0 passed from (select unnest(['observed changed', 'blocked filled', 'edge empty in main', 'edge filled in alternative']) c, unnest([count(*) filter (spoilt and value is not null),
count(*) filter (spoilt and blocked), 0, count(*) filter (spoilt and position in ('leading', 'trailing'))]) n from b)""")
def v15_verify_imputation(spark, d):
    """Both scenarios with one filled value in four spoilt, so that each kind of fault is found or known to be absent."""
    ind = B.indicators(spark, d)
    main, alt = M.impute_scenarios(ind, ["indicator_id", "region"])
    spoilt = (F.col("nk") + F.col("year")) % 4 == 0
    main, alt = (t.withColumn("value_filled", F.when(spoilt, F.coalesce("value_filled", F.lit(0.0)) + 1).otherwise(F.col("value_filled"))) for t in (main, alt))
    return V.verify_imputation(ind, main, alt, ["indicator_id", "region", "year"], "value", "blocked")


@query("select o_orderpriority, count(*)::bigint n, count(*) filter (trim(o_orderstatus) <> 'F')::bigint n_other, count(*) filter (trim(o_orderstatus) <> 'F') = 0 passed from orders group by 1")
def v17_status_gate(spark, d):
    return V.status_gate(B.read(spark, d, "orders"), "o_orderstatus", "F", ["o_orderpriority"])


@query("with " + B.OUTLINE + r""" select region, src_row, nullif(regexp_extract(item_name, '^\d+[-\d]*\.\s*(.+?)\s*\((공통)\)$', 2), '') major_head, case when regexp_matches(item_name, '^\d+[-\d]*\.\s*(.+?)\s*\((공통)\)$') then regexp_extract(item_name, '^\d+[-\d]*\.\s*(.+?)\s*\((공통)\)$', 1) else item_name end medium_head from outline""")
def c03_backfill_heading(spark, d):
    rows = B.outline(spark, d).select("region", "src_row", F.lit(None).cast("string").alias("major_head"), F.col("item_name").alias("medium_head"))
    return C.backfill_heading(rows, r"^\d+[-\d]*\.\s*(.+?)\s*\((공통)\)$")


@query("""with m as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_quantity = 1 then '공통사업' end mark from lineitem),
f as (select *, max(mark is not null) over (partition by l_orderkey) has, last_value(mark ignore nulls) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows unbounded preceding) n from m)
select l_orderkey, count(*)::bigint n_rows, count(*) filter (has and n is not null)::bigint n_marked from f group by 1""")
def c04_realign_headings(spark, d):
    from pyspark.sql import Window

    li = B.read(spark, d, "lineitem").withColumn("src_row", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    rows = li.select(F.col("l_orderkey").alias("region"), "src_row", F.when(F.col("l_quantity") == 1, "[공 통 사 업] x").otherwise("item").alias("item_name"), F.lit("none").alias("major_head"), F.lit("m").alias("medium_head"))
    out = C.realign_headings(rows)
    return out.groupBy(F.col("region").alias("l_orderkey")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("major_head") == "공통사업").alias("n_marked"))


@query("with " + B.RAW + " select row_id, try_cast(case when raw in ('-', 'n/a') then null else replace(raw, ',', '') end as double) amount from raw")
def c07_parse_numeric_strict(spark, d):
    raw = B.raw_amounts(spark, d).select("row_id", F.col("raw").alias("amount"))
    return C.parse_numeric_strict(raw, "amount", ("-", "n/a"))


@query("select year(o_orderdate)::bigint as year, trim(o_orderpriority) region, o_orderkey::varchar src_row from orders")
def c10_normalize_keys(spark, d):
    o = B.read(spark, d, "orders").select(F.year("o_orderdate").cast("string").alias("year"), F.concat(F.lit(" "), "o_orderpriority").alias("region"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")).alias("src_row"))
    return C.normalize_keys(o)


@query("select p_partkey, regexp_replace(p_name, '^(red|hot) (.+)$', '\\2(\\1)') title from part")
def c12_rewrite_titles(spark, d):
    return B.read(spark, d, "part").select("p_partkey", X.rewrite_titles(F.col("p_name"), [(r"^(red|hot) (.+)$", "$2($1)")]).alias("title"))


@query("""with c as (select c_nationkey region, c_custkey src_row, c_name body, lead(c_custkey) over (partition by c_nationkey order by c_custkey) nxt, lead(c_name) over (partition by c_nationkey order by c_custkey) more from customer)
select region, src_row, case when src_row % 10 = 0 and nxt is not null then body || ' ' || more else body end body from c""")
def c13_merge_continuations(spark, d):
    from pyspark.sql import Window

    c = B.read(spark, d, "customer").select(F.col("c_nationkey").alias("region"), F.lit(1).alias("year"), F.col("c_custkey").alias("src_row"), F.col("c_name").alias("body"))
    nxt = c.withColumn("more", F.lead("src_row").over(Window.partitionBy("region").orderBy("src_row"))).where("src_row % 10 = 0 and more is not null")
    links = nxt.select("region", "year", F.col("more").alias("src_row"), F.col("src_row").alias("target_row"))
    return C.merge_continuations(c, links).select("region", "src_row", "body")


@query("""select p_partkey, '지원대상 : ' || p_name || ' 지원내용 : ' || p_brand body, 'match' pattern, p_name target, p_brand content from part""")
def c15_to_c17_labels(spark, d):
    raw = F.concat(F.lit("(지원대상) "), "p_name", F.lit(" ○ (지원내용) "), "p_brand")
    tidy = X.dedup_label(raw)
    part = X.split_labeled(tidy)
    return B.read(spark, d, "part").select("p_partkey", tidy.alias("body"), X.check_pattern(tidy).alias("pattern"), part["target"].alias("target"), part["content"].alias("content"))


@query("select p_type, count(*)::bigint n, sum((p_size % 3 = 0)::int)::bigint n_changed, false lost from part group by 1")
def c21_normalize_bullets(spark, d):
    p = B.read(spark, d, "part").withColumn("body", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("○ "), "p_name", F.lit(" "), F.col("p_size").cast("string"))).otherwise(F.col("p_name")))
    out = C.normalize_bullets(p, ["body"])
    return out.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.sum("n_changed").alias("n_changed"), F.bool_or("lost").alias("lost"))


@query("select p_partkey, p_size % 4 = 0 rerun, p_size % 2 = 0 flag, case when p_size % 5 = 0 then 'tail' else p_name end stripped from part")
def c22_c27_c30_helpers(spark, d):
    s = F.col("p_size")
    text = F.when(s % 4 == 0, F.concat("p_name", F.lit(" (대상) x"))).otherwise(F.col("p_name"))
    flag = F.when(s % 2 == 0, "Yes").otherwise("0")
    label = F.when(s % 5 == 0, F.lit("head: tail")).otherwise(F.col("p_name"))
    return B.read(spark, d, "part").select("p_partkey", X.needs_rerun(text).alias("rerun"), X.parse_flag(flag).alias("flag"), X.strip_prefix_label(label, "head:").alias("stripped"))


@query("select p_partkey, p_name || ' ' || p_brand model_text from part")
def c25_build_text(spark, d):
    return C.build_text(B.read(spark, d, "part"), ["p_name", "p_brand"], ["p_name"]).select("p_partkey", "model_text")


@query("select n_name region, n_nationkey code from nation")
def c26_harmonize(spark, d):
    return C.harmonize(B.read(spark, d, "nation"), {"region": ["name", "n_name"], "code": ["n_nationkey", "id"]}).select("region", "code")


@query("select d.doc_id, l.quality label from documents d join labels l using (doc_id) where l.toxic = 0")
def c29_training_rows(spark, d):
    rows = B.read(spark, d, "documents").join(B.read(spark, d, "labels"), "doc_id").select("doc_id", F.lit(2020).alias("year"), F.lit("confirmed").alias("status"), F.when(F.col("toxic") == 1, "toxic").alias("note"), F.col("quality").alias("label"))
    return C.training_rows(rows, [2020], ["confirmed"], ["doc_id"])[0].select("doc_id", "label")


@query("select o_orderkey, o_orderstatus <> case when o_orderkey % 9 = 0 then 'X' else o_orderstatus end changed from orders")
def c32_changed_flags(spark, d):
    cur = F.when(F.col("o_orderkey") % 9 == 0, "X").otherwise(F.col("o_orderstatus"))
    return B.read(spark, d, "orders").select("o_orderkey", X.changed(F.col("o_orderstatus"), cur, F.lit(False)).alias("changed"))


@query("""with c as (select p_partkey, length(replace(p_name, ' ', '')) a, length(replace(replace(p_name, 'ring', 'rings'), ' ', '')) b from part) select p_partkey, round(2.0 * a / (a + b), 6) ratio from c where a <> b""")
def c33_similarity_ratio(spark, d):
    p = B.read(spark, d, "part").select("p_partkey", "p_name", F.regexp_replace("p_name", "ring", "rings").alias("after"))
    return rnd(C.similarity_of_changes(p, "p_name", "after").select("p_partkey", "ratio"), 6)


@query("select p_partkey, p_size::int a, case when p_size % 2 = 0 then (p_size % 7)::int else -1 end b, p_name rest from part")
def c34_natural_sort_key(spark, d):
    second = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("-"), (F.col("p_size") % 7).cast("string"))).otherwise("")
    key = X.natural_key(F.concat(F.col("p_size").cast("string"), second, F.lit(". "), "p_name"))
    return B.read(spark, d, "part").select("p_partkey", key["a"].alias("a"), F.coalesce(key["b"], F.lit(-1)).alias("b"), key["rest"].alias("rest"))


@query("""select p_partkey, case p_size % 7 when 0 then 'no subtotal row' when 1 then 'no leaf rows' when 2 then 'both missing' when 3 then 'subtotal missing' when 4 then 'leaf sum missing' when 5 then 'subtotal is 0, no rate' end reason from part""")
def c35_undetermined_reason(spark, d):
    k, one = F.col("p_size") % 7, F.col("p_size").cast("double")
    state = F.when(k == 0, "leaf only").when(k == 1, "subtotal only").otherwise("both")
    subtotal, leaves = F.when(k == 5, 0.0).when(~k.isin(2, 3), one), F.when(~k.isin(2, 4), one)
    return B.read(spark, d, "part").select("p_partkey", X.undetermined_reason(state, subtotal, leaves).alias("reason"))


@query("select o_orderkey, o_custkey from orders where o_orderkey % 100 <> 1")
def d01_confirmed_duplicates(spark, d):
    o = B.read(spark, d, "orders").select("o_orderkey", "o_custkey")
    twice = o.withColumn("copy", F.lit(0)).unionByName(o.where("o_orderkey % 100 = 1").withColumn("copy", F.lit(1)))
    marked = twice.withColumn("drop_me", F.col("o_orderkey") % 100 == 1)
    # Both rows of a pair are listed, so only rows without a twin stay.
    return C.drop_confirmed_duplicates(marked, [True], "drop_me", ignore=["copy"]).select("o_orderkey", "o_custkey")


@query("select d.doc_id, d.source, l.quality from documents d join labels l using (doc_id)")
def j03_attach_labels(spark, d):
    lab = B.read(spark, d, "labels").select("doc_id", "quality")
    docs = B.read(spark, d, "documents").select("doc_id", "source").join(lab.select("doc_id"), "doc_id", "left_semi")
    return J.attach_labels(docs, lab, ["doc_id"])


@query("with " + B.SUBPANEL + ", p as (select region, year, round(avg(l_discount), 8) outcome from detail group by all) select s.region, s.year, s.subarea, s.budget, p.outcome, a.budget s_lag, b.budget f_lag from subpanel s join p using (region, year) left join subpanel a on a.region = s.region and a.subarea = s.subarea and a.year = s.year - 1 left join subpanel b on b.region = s.region and b.subarea = s.subarea and b.year = s.year - 2")
def j04_regression_sample(spark, d):
    sub = B.subpanel(spark, d).drop("area")
    lag = lambda k, n: sub.select("region", "subarea", (F.col("year") + k).alias("year"), F.col("budget").alias(n))
    return J.build_sample(sub, B.panel(spark, d).select("region", "year", "outcome"), lag(1, "s_lag"), lag(2, "f_lag"))


@query("with " + B.INDICATORS + " select indicator_id, region, year, value is null and (nk + year) % 7 = 0 block from indicators")
def j09_attach_policy(spark, d):
    p = B.indicators(spark, d)
    policy = p.where("value is null").select("indicator_id", "region", "year", ((F.col("nk") + F.col("year")) % 7 == 0).alias("block"))
    return J.attach_policy(p.select("indicator_id", "region", "year", "value"), policy).select("indicator_id", "region", "year", "block")


@query("select c_custkey, case when c_custkey % 20 = 0 then 'FIXED' else c_name end c_name from customer")
def j12_text_corrections(spark, d):
    c = B.read(spark, d, "customer").select("c_custkey", "c_name")
    rules = c.where("c_custkey % 20 = 0").select("c_custkey", F.col("c_name").alias("before"), F.lit("FIXED").alias("after"))
    return J.apply_corrections({"wide": (c, 1)}, rules, ["c_custkey"], "c_name")["wide"]


@query("""with c as (select c_nationkey region, c_custkey k, case when c_custkey % 3 = 0 then c_name else c_mktsegment end v from customer), u as (select *, count(*) over (partition by region, v) = 1 one from c),
g as (select *, sum(one::int) over (partition by region order by k) grp from u), a as (select *, count(*) over (partition by region, grp, v, one) n from g)
select region, k l_row, k + 7 r_row, case when one then 'unique' else 'anchored' end how from a where one or n = 1""")
def j13_anchored_match(spark, d):
    v = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.col("c_mktsegment"))
    c = B.read(spark, d, "customer").select(F.col("c_nationkey").alias("region"), F.col("c_custkey").alias("src_row"), v.alias("v"))
    return J.anchored_match(c, c.withColumn("src_row", F.col("src_row") + 7), "v")


@query("select d.doc_id, l.quality is not null reviewed, d.doc_id % 4 = 0 text_changed, l.quality is not null and d.doc_id % 4 = 0 recheck from documents d left join labels l using (doc_id)")
def j16_review_master(spark, d):
    docs = B.read(spark, d, "documents").select("doc_id", F.col("source").alias("body"))
    lab = B.read(spark, d, "labels")
    old = docs.withColumn("body", F.when(F.col("doc_id") % 4 == 0, "other").otherwise(F.col("body")))
    out = J.build_review_master(docs, lab.select("doc_id", F.lit("done").alias("review")), old, lab.select("doc_id", "quality"), ["doc_id"], "body")
    return out.select("doc_id", "reviewed", "text_changed", "recheck")


@query("select o_orderkey, 2020 as year, case when o_orderkey % 3 = 0 then o_orderpriority end review_label from orders")
def j17_transfer_progress(spark, d):
    o = B.read(spark, d, "orders").select("o_orderkey", F.lit(2020).alias("year"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(" ").alias("review_label"))
    new = o.withColumn("review_label", F.lit(None).cast("string"))
    return J.transfer_progress(o, new, ["o_orderkey", "year"], cols=["review_label"])


@query("select o_orderkey, o_totalprice amount, o_orderkey % 2 = 0 labelled from orders where o_orderkey % 10 in (3, 4)")
def j18_change_impact(spark, d):
    o = B.read(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("amount"))
    ch = [o.where(f"o_orderkey % 10 = {k}").select("o_orderkey", "o_orderstatus") for k in (3, 4)]
    labels = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("x").alias("label"))
    return J.change_impact(ch, o, labels, ["o_orderkey"], ["o_orderstatus"]).select("o_orderkey", "amount", "labelled")


@query("select o_orderpriority region, count(*) filter (o_orderstatus = 'F')::bigint n_match, count(*) filter (o_orderstatus = 'O')::bigint n_mismatch, max(o_totalprice) max_abs_rate from orders group by 1")
def a02_qa_panel(spark, d):
    s = F.col("o_orderstatus")
    qa = B.read(spark, d, "orders").select(F.col("o_orderpriority").alias("region"), F.when(s == "F", "match").when(s == "O", "mismatch").otherwise("undetermined").alias("result"), F.lit("allowed").alias("tolerance_result"), F.col("o_totalprice").alias("abs_rate"))
    return A.qa_panel(qa, ["region"]).select("region", "n_match", "n_mismatch", "max_abs_rate")


@query("""select c_mktsegment region, count(*)::bigint n_rows, count(distinct c_nationkey)::bigint n_areas, count(*) filter (c_custkey % 5 = 0)::bigint n_blank, count(*) filter (c_custkey % 3 = 0 and c_custkey % 5 <> 0 or c_custkey % 10 = 0)::bigint n_normalised,
(count(*) - count(distinct c_custkey // 40))::bigint n_duplicate_rows from customer group by 1""")
def a08_consolidation_qa(spark, d):
    k = F.col("c_custkey")
    body = F.when(k % 10 == 0, "  ").when(k % 5 == 0, "").when(k % 3 == 0, F.concat("c_name", F.lit(" \t x"))).otherwise(F.col("c_name"))
    c = B.read(spark, d, "customer").select(F.col("c_mktsegment").alias("region"), body.alias("body"), F.col("c_nationkey").alias("area"), F.floor(k / 40).alias("src_row"))
    return A.consolidation_qa(c).select("region", "n_rows", "n_areas", "n_blank", "n_normalised", "n_duplicate_rows")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_discount * 1 + l_tax * 5) / nullif(l_discount + l_tax, 0), 6) mean_score from lineitem")
def a10_response_mean(spark, d):
    out = A.weighted_response_mean(B.read(spark, d, "lineitem"), {"l_discount": 1.0, "l_tax": 5.0})
    return rnd(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "mean_score"), 6)


@query("""with g as (select p_type region, p_size age, count(*) n from part where p_size between 1 and 3 group by all), ok as (select region from g group by 1 having count(*) = 3) select region, 2020 as year, sum(n)::bigint population from g join ok using (region) group by 1""")
def a11_population(spark, d):
    g = B.read(spark, d, "part").where("p_size between 1 and 3").groupBy(F.col("p_type").alias("region"), F.col("p_size").alias("age")).agg(F.count(F.lit(1)).alias("2020년"))
    ok = g.groupBy("region").agg(F.count(F.lit(1)).alias("k")).where("k = 3")
    return A.population(g.join(ok, "region", "left_semi"), [1, 2, 3], years=["2020년"])


@query("with " + B.PANEL + " select region, year, round(n / nullif(case when year = 1999 then 0 else 50 end, 0) * 100.0, 4) rate, case when year = 1999 then 'zero denominator' end note from panel")
def a12_ratio_table(spark, d):
    p = B.panel(spark, d)
    den = p.select("region", "year", F.when(F.col("year") == 1999, 0.0).otherwise(50.0).alias("denominator"))
    return rnd(A.ratio_table(p.select("region", "year", F.col("n").cast("double").alias("numerator")), den).select("region", "year", "rate", "note"))


@query(_psi_sql("l_quantity", "l_quantity > 20") + " union all " + _psi_sql("l_discount", "l_quantity > 20"))
def a18_feature_report(spark, d):
    li = B.read(spark, d, "lineitem")
    return rnd(S.feature_report(li.where("l_quantity > 20"), li.where("not (l_quantity > 20)"), ["l_quantity", "l_discount"])[0].select("feature", "psi", "flagged"), 6)


@query("select 'l_extendedprice' a, 'l_quantity' b from lineitem having corr(l_extendedprice, l_quantity) >= 0.5")
def a22_high_corr_pairs(spark, d):
    return S.high_corr_pairs(S.corr_matrix(B.read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]), 0.5).select("a", "b")


@query("with " + _WORDS + """, r as (select *, row_number() over (partition by g order by round(s / n, 9) desc, term) p from s join k using (g)), f as (select *, row_number() over (partition by g order by f desc, term) p2 from s)
select r.g p_type, count(*)::bigint n_common, round(count(*) / 5.0, 6) overlap from r join f on r.g = f.g and r.term = f.term where p <= 5 and p2 <= 5 group by 1""")
def a29_ranking_overlap(spark, d):
    p = B.read(spark, d, "part")
    a = T.group_keywords(p, "p_type", "p_partkey", T.word_tokens(F.col("p_name")), n=1000)
    by_freq = W.top_n(a, ["p_type"], [F.col("doc_freq").desc(), F.col("term")], 5, "rank2").select("p_type", "term", F.col("rank2").alias("place"))
    return rnd(A.ranking_overlap(a.where("place <= 5").select("p_type", "term", "place"), by_freq, "p_type").select("p_type", "n_common", "overlap"), 6)


@query("""select c "check", v as value from (select unnest(['rows', 'max_quantity']) c, unnest([count(*)::varchar, max(l_quantity)::varchar]) v from lineitem)""")
def a33_panel_summary(spark, d):
    return A.panel_summary(B.read(spark, d, "lineitem"), {"rows": F.count(F.lit(1)), "max_quantity": F.max("l_quantity")})


@query("select n_nationkey, n_name, row_number() over (order by case n_regionkey when 3 then 1 when 1 then 2 else 3 end, n_nationkey)::int place from nation")
def x01_ordered_output(spark, d):
    from pyspark.sql import Window

    key = F.array_position(F.array(F.lit(3), F.lit(1)), F.col("n_regionkey"))
    order = Window.orderBy(F.when(key > 0, key).asc_nulls_last(), "n_nationkey")
    return R.order_by_list(B.read(spark, d, "nation"), "n_regionkey", [3, 1], "n_nationkey").select("n_nationkey", "n_name", F.row_number().over(order).alias("place"))


@query("select 'c' side, c_name as name, c_acctbal, null::varchar extra from customer union all select 's', s_name, s_acctbal, 'x' from supplier")
def x03_union_tables(spark, d):
    c = B.read(spark, d, "customer").select(F.lit("c").alias("side"), F.col("c_name").alias("name"), "c_acctbal")
    s = B.read(spark, d, "supplier").select(F.lit("s").alias("side"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("c_acctbal"), F.lit("x").alias("extra"))
    return R.union_all([c, s])


@query("with " + B.INDICATORS + " select region, year, indicator_id, category, subcategory, direction, value from indicators")
def i01_prepare_panel(spark, d):
    return I.prepare_index_input(B.indicators(spark, d).withColumnRenamed("indicator_id", "code"), {"indicator_id": "code"})


@query("with recursive " + _kmeans_sql(list(B.AREAS)[:3], (1, 3), 10) + """, e as (select a.k, a.region, a."cluster" own, b."cluster" other, avg(list_sum(list_transform(range(1, 4), lambda m: (x.x[m] - y.x[m]) * (x.x[m] - y.x[m])))) far
from best a join best b on a.k = b.k and a.region <> b.region join z x on x.region = a.region join z y on y.region = b.region group by all),
s as (select k, region, own, max(far) filter (own = other) a, min(far) filter (own <> other) b from e group by all),
t as (select k, avg(case when a is null then 0.0 else (b - a) / greatest(a, b) end) silhouette from s where k > 1 group by k), c as (select k, min(n) smallest from (select k, "cluster", count(*) n from best group by all) group by k)
select k, round(any_value(wcss), 6) wcss, round(any_value(silhouette), 6) silhouette, any_value(smallest)::bigint smallest from best left join t using (k) join c using (k) group by k""")
def m12_elbow(spark, d):
    from gridloom.operators.learning import elbow

    wide = B.subpanel(spark, d).groupBy("region").pivot("subarea", list(B.AREAS)).agg(F.avg("budget"))
    return rnd(elbow(wide.fillna(0.0), "region", list(B.AREAS)[:3], 3), 6, "wcss", "silhouette")


@query(r"""select p_partkey, p_type, regexp_extract(p_name, '(\S+)$', 1) as label, regexp_extract(p_name, '(\S+)$', 1) pred_label from part""")
def t07_grouped_cv(spark, d):
    """Out-of-fold labels: the label is the last word of the name, so every fold must find those of the types it has not seen."""
    from gridloom.operators.learning import group_cv

    return group_cv(_labelled_parts(spark, d), "p_partkey", "p_name", "label", "p_type", k=2, max_iter=5)[0].select("p_partkey", "p_type", "label", "pred_label")


@query(r"""select 'p_name' best, 1.0::double accuracy, 1.0::double macro_f1""")
def t07_best_variant(spark, d):
    """Of two texts the one that holds the label wins, by macro F1, weighted F1, then name."""
    from gridloom.operators.learning import choose_best, group_cv

    p = _labelled_parts(spark, d).withColumn("first_word", F.regexp_extract("p_name", r"^(\S+)", 1))
    found = {c: group_cv(p, "p_partkey", c, "label", "p_type", k=2, max_iter=5)[1] for c in ("first_word", "p_name")}
    best = choose_best(found)
    return found[best].select(F.lit(best).alias("best"), "accuracy", "macro_f1")


@query("select d.doc_id src_row, d.source || ' ' || d.lang model_text from documents d where doc_id not in (select doc_id from labels)")
def t12_prediction_targets(spark, d):
    from gridloom.operators.learning import prediction_targets

    rows = B.read(spark, d, "documents").select(F.col("doc_id").alias("src_row"), F.lit(2020).alias("year"), "source", "lang")
    done = B.read(spark, d, "labels").select(F.col("doc_id").alias("src_row"), F.lit(2020).alias("year"))
    return prediction_targets(rows, [2020], done, ["source", "lang"], keys=("year", "src_row")).select("src_row", "model_text")


@query("with " + B.INDICATORS + """, e as (select *, min(year) filter (value is not null) over w lo, max(year) filter (value is not null) over w hi, arg_max(value, year) filter (value is not null) over w newest from indicators window w as (partition by indicator_id, region))
select indicator_id, region, year, case when year < lo then 'leading' else 'trailing' end position, round(newest, 4) value_filled from e where value is null and not blocked and lo < hi and (year < lo or year > hi)""")
def u02_grouped_trend(spark, d):
    def last(seen, years):
        return [float(seen.iloc[-1])] * len(years)

    out = M.impute_series(B.indicators(spark, d), ["indicator_id", "region"], leading="trend", trailing="trend", trend=last)
    return rnd(out.where("position in ('leading', 'trailing')").select("indicator_id", "region", "year", "position", "value_filled"))


from gridloom import catalog_models, catalog_stores  # noqa: E402,F401  (they register their queries)
