"""Panels and item tables derived from the star-schema tables, in Spark and in SQL.

``detail`` is the item table (region, year, subarea, area, amount), ``indicators`` the nation x year x
segment panel with holes, and so on.  Each has a SQL text of the same rows, used by the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.staging import materialize

AREAS = {"STANDARD": "CORE", "ECONOMY": "CORE", "MEDIUM": "MID", "LARGE": "MID", "PROMO": "OTHER", "SMALL": "OTHER"}
YEARS = list(range(1995, 2002))
BASE_YEAR = 1998


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _once(df: DataFrame, label: str) -> DataFrame:
    """A panel of few rows as one written file."""
    return materialize(df.coalesce(1), label)


def area_of(subarea):
    pairs = [F.lit(x) for kv in AREAS.items() for x in kv]
    return F.create_map(*pairs)[subarea]


def detail(spark: SparkSession, d: str) -> DataFrame:
    li, o, c, n, p = (read(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "part"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(p, li.l_partkey == p.p_partkey)
    return j.select(
        F.col("n_name").alias("region"), F.year("o_orderdate").alias("year"), F.col("p_name").alias("item_name"), F.col("p_type").alias("subarea"), area_of(F.col("p_type")).alias("area"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", F.lit("current").alias("budget_kind"),
    )


_AREA_SQL = "case p_type " + " ".join(f"when '{k}' then '{v}'" for k, v in AREAS.items()) + " end"
DETAIL = f"""detail as (select n_name region, year(o_orderdate)::int as year, p_name item_name, p_type subarea, {_AREA_SQL} area, l_extendedprice * (1 - l_discount) amount,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_returnflag
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join part on l_partkey = p_partkey)"""


def subpanel(spark: SparkSession, d: str) -> DataFrame:
    """region, year, area, subarea, budget; written once, as checks and results read it several times."""
    return _once(detail(spark, d).groupBy("region", "year", "area", "subarea").agg(F.round(F.sum("amount"), 4).alias("budget")), "subpanel")


SUBPANEL = DETAIL + ", subpanel as (select region, year, area, subarea, round(sum(amount), 4) budget from detail group by all)"


def panel(spark: SparkSession, d: str) -> DataFrame:
    """region, year, budget, outcome (mean discount), n."""
    return _once(detail(spark, d).groupBy("region", "year").agg(F.round(F.sum("amount"), 4).alias("budget"), F.round(F.avg("l_discount"), 8).alias("outcome"), F.count(F.lit(1)).alias("n")), "panel")


PANEL = DETAIL + ", panel as (select region, year, round(sum(amount), 4) budget, round(avg(l_discount), 8) outcome, count(*) n from detail group by all)"


def cpi(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(y, round(100 * 1.02 ** (y - BASE_YEAR), 6), "1998=100") for y in YEARS], "year int, cpi double, base string")


CPI = "cpi(year, cpi) as (values " + ", ".join(f"({y}, {round(100 * 1.02 ** (y - BASE_YEAR), 6)}::double)" for y in YEARS) + ")"


def population(spark: SparkSession, d: str) -> DataFrame:
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("region")).agg((F.count(F.lit(1)) * 1000).alias("population"))


POPULATION = "population as (select n_name region, count(*) * 1000 population from customer join nation on c_nationkey = n_nationkey group by 1)"


def indicators(spark: SparkSession, d: str) -> DataFrame:
    """indicator_id (segment), region, year, value with holes, blocked; category, subcategory, direction."""
    o, c, n = (read(spark, d, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    seg = F.array_position(F.array(*[F.lit(x) for x in SEGMENTS]), F.col("indicator_id")).cast("int")
    g = j.groupBy(F.col("c_mktsegment").alias("indicator_id"), F.col("n_name").alias("region"), F.col("n_nationkey").alias("nk"), F.year("o_orderdate").alias("year")).agg(F.round(F.avg("o_totalprice"), 8).alias("full_value"))
    g = g.withColumn("seg", seg)
    g = g.withColumn("value", F.when((F.col("nk") * 7 + F.col("year") * 3 + F.col("seg")) % 5 != 0, F.col("full_value")))
    g = g.withColumn("blocked", F.col("value").isNull() & ((F.col("nk") + F.col("year")) % 7 == 0))
    g = g.withColumns({
        "category": F.when(F.col("seg") <= 2, "A").otherwise("B"), "subcategory": F.concat(F.lit("s"), ((F.col("seg") + 1) / 2).cast("int").cast("string")),
        "direction": F.when(F.col("seg") % 2 == 0, "negative").otherwise("positive"),
    })
    return _once(g, "indicators")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
INDICATORS = """ind0 as (select c_mktsegment indicator_id, n_name region, n_nationkey nk, year(o_orderdate)::int as year, round(avg(o_totalprice), 8) full_value,
  case c_mktsegment when 'AUTOMOBILE' then 1 when 'BUILDING' then 2 when 'FURNITURE' then 3 when 'HOUSEHOLD' then 4 else 5 end seg
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all),
indicators as (select *, case when (nk * 7 + year * 3 + seg) % 5 <> 0 then full_value end as value,
  ((nk * 7 + year * 3 + seg) % 5 = 0 and (nk + year) % 7 = 0) blocked, case when seg <= 2 then 'A' else 'B' end category,
  's' || floor((seg + 1) / 2)::int::varchar subcategory, case when seg % 2 = 0 then 'negative' else 'positive' end direction from ind0)"""


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, w) for s, w in zip(SEGMENTS, (0.3, 0.2, 0.2, 0.2, 0.1), strict=True)], "indicator_id string, weight double")


WEIGHTS = "weights(indicator_id, weight) as (values ('AUTOMOBILE', 0.3::double), ('BUILDING', 0.2::double), ('FURNITURE', 0.2::double), ('HOUSEHOLD', 0.2::double), ('MACHINERY', 0.1::double))"


def outline(spark: SparkSession, d: str) -> DataFrame:
    """Customers flattened under their nation and region headings: region, year, src_row, item_name, budget."""
    c, n, r = (read(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    leaf = j.select(F.col("r_name").alias("region"), (F.col("n_nationkey") * 1_000_000 + F.col("c_custkey") + 10).cast("long").alias("src_row"), F.col("c_name").alias("item_name"), F.col("c_acctbal").alias("budget"))
    head = j.groupBy("r_name", "n_nationkey", "n_name").agg(F.round(F.sum("c_acctbal") + F.when(F.col("n_nationkey") % 3 == 0, 5.0).otherwise(0.0), 2).alias("budget"))
    head = head.select(F.col("r_name").alias("region"), (F.col("n_nationkey") * 1_000_000 + 2).cast("long").alias("src_row"), F.concat(F.col("n_nationkey").cast("string"), F.lit(". "), F.col("n_name"), F.lit("(공통)")).alias("item_name"), "budget")
    top = head.groupBy("region").agg((F.min("src_row") - 1).alias("src_row")).select("region", "src_row", F.concat(F.lit("Ⅰ. "), F.col("region")).alias("item_name"), F.lit(None).cast("double").alias("budget"))
    return leaf.unionByName(head).unionByName(top).withColumn("year", F.lit(1998))


OUTLINE = """base as (select r_name region, n_nationkey, n_name, c_custkey, c_name, c_acctbal from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
head as (select region, n_nationkey * 1000000 + 2 src_row, n_nationkey::varchar || '. ' || n_name || '(공통)' item_name, round(sum(c_acctbal) + case when n_nationkey % 3 = 0 then 5.0 else 0.0 end, 2) budget from base group by region, n_nationkey, n_name),
outline as (select region, n_nationkey * 1000000 + c_custkey + 10 src_row, c_name item_name, c_acctbal budget, 'leaf' row_type from base
  union all select *, 'medium_subtotal' from head union all select region, min(src_row) - 1, 'Ⅰ. ' || region, null, 'major_subtotal' from head group by region)"""


def raw_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their price as text: with commas, or a dash, or words."""
    o = read(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 11 == 0, "-").when(F.col("o_orderkey") % 13 == 0, "n/a").when(F.col("o_orderkey") % 17 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.floor(F.col("o_totalprice") / 1000).cast("long").cast("string"), F.lit(","), F.lpad((F.floor("o_totalprice") % 1000).cast("string"), 3, "0"))
    )
    return o.select(F.col("o_orderkey").alias("row_id"), text.alias("raw"), "o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("year"), "o_totalprice", "o_custkey")


RAW = """raw as (select o_orderkey row_id, case when o_orderkey % 11 = 0 then '-' when o_orderkey % 13 = 0 then 'n/a' when o_orderkey % 17 = 0 then null
  else floor(o_totalprice / 1000)::bigint::varchar || ',' || lpad((floor(o_totalprice)::bigint % 1000)::varchar, 3, '0') end raw, o_orderpriority, o_orderstatus, year(o_orderdate)::int as year, o_totalprice, o_custkey from orders)"""


def rewritten(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a deterministic edit: digits dropped, shortened, blanked or kept."""
    t = F.col("text")
    k = F.col("doc_id") % 5
    new = F.when(k == 0, F.regexp_replace(t, r"\d", "")).when(k == 1, F.substring(t, 1, 40)).when(k == 2, F.lit(" ")).when(k == 3, F.concat(t, F.lit(" "), t)).otherwise(t)
    return read(spark, d, "documents").select("doc_id", "lang", "source", t.alias("original"), new.alias("cleaned"))


REWRITTEN = r"""rewritten as (select doc_id, lang, source, text original, case doc_id % 5 when 0 then regexp_replace(text, '[0-9]', '', 'g') when 1 then substr(text, 1, 40) when 2 then ' ' when 3 then text || ' ' || text else text end cleaned from documents)"""
