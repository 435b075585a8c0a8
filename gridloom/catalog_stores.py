"""Registered queries of readers, stores, saved models and gates: each writes a given table out and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.catalog import query, rnd
from gridloom.functions.staging import materialize, new_path
from gridloom.operators import checks as V
from gridloom.operators import index as I
from gridloom.plans import base as B
from gridloom.sources import tables as IO


def _rename(spark: SparkSession, folder: str, column: str, suffix: str) -> None:
    """Name the one file of every ``column=value`` folder after the value, in ``folder`` itself."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    for entry in fs.listStatus(root):  # one folder per value
        name = entry.getPath().getName()
        if entry.isDirectory() and name.startswith(f"{column}="):
            part = next(x.getPath() for x in fs.listStatus(entry.getPath()) if x.getPath().getName().startswith("part-"))
            fs.rename(part, jvm.org.apache.hadoop.fs.Path(f"{folder}/{name[len(column) + 1 :]}{suffix}"))
            fs.delete(entry.getPath(), True)


@query("select c_custkey, c_name, case when c_custkey % 4 = 0 then '' else c_mktsegment || ', \"' || c_nationkey || '\"' end label from customer")
def s01_read_delimited(spark, d):
    path = new_path(spark, "csv")
    label = F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.concat("c_mktsegment", F.lit(', "'), F.col("c_nationkey").cast("string"), F.lit('"')))
    rows = B.read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name", label.alias("label"))
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return IO.read_delimited(spark, path, all_string=True).withColumn("c_custkey", F.col("c_custkey").cast("long"))


def _keyed(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """A file per segment and year, named after both, with its orders' numbers."""
    path = new_path(spark, "keyed")
    o, c = B.read(spark, d, "orders"), B.read(spark, d, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("region"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last_key"))
    rows = materialize(rows, "keyed-rows")
    rows.withColumn("name", F.concat_ws("_", "region", "year")).repartition("name").write.partitionBy("name").option("header", True).csv(path)
    _rename(spark, path, "name", ".csv")
    return path, rows


_KEYED = "select c_mktsegment region, year(o_orderdate)::int as year, count(*)::bigint n, max(o_orderkey) last_key from orders join customer on o_custkey = c_custkey group by all"


@query(_KEYED)
def s02_read_keyed_files(spark, d):
    path, rows = _keyed(spark, d)
    return IO.read_keyed_files(spark, path, rows.select("region", "year"), "region string, year int, n long, last_key long", B.SEGMENTS).select("region", "year", "n", "last_key")


@query(f"select region file_region, year file_year, n from ({_KEYED})")
def s03_key_from_filename(spark, d):
    path, _ = _keyed(spark, d)
    raw = spark.read.option("header", True).schema("region string, year int, n long, last_key long").csv(path)
    return IO.with_file_keys(raw, regions=B.SEGMENTS).select("file_region", "file_year", "n")


def _sheet(spark: SparkSession, heads: list[list[str]], body: DataFrame) -> DataFrame:
    """A headerless sheet of texts, written and read back in file order."""
    path = new_path(spark, "sheet")
    cols = [f"c{i}" for i in range(len(heads[0]))]
    kinds = ", ".join(f"{c} string" for c in cols)
    top = spark.createDataFrame([(k, *row) for k, row in enumerate(heads)], "k int, " + kinds)
    rows = body.toDF(*cols).select(F.lit(len(heads)).alias("k"), *[F.col(c).cast("string").alias(c) for c in cols])
    top.unionByName(rows).coalesce(1).sortWithinPartitions("k", "c0").select(*cols).write.csv(path)  # a sheet is one file
    return spark.read.schema(kinds).csv(path)


_BY_YEAR = "orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"


@query(f"select n_name region, year(o_orderdate)::int as year, count(*)::double as value from {_BY_YEAR} where year(o_orderdate) between 1995 and 1997 group by all")
def s04_two_row_header(spark, d):
    o, c, n = (B.read(spark, d, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    wide = j.withColumn("y", F.year("o_orderdate")).groupBy("n_name").pivot("y", [1995, 1996, 1997]).agg(F.count(F.lit(1)))
    other = j.groupBy("n_name").agg(F.max("o_orderkey").alias("top"))
    body = wide.join(other, "n_name").select("n_name", "top", "1995", "1996", F.format_number("1997", 0).alias("1997"))
    sheet = _sheet(spark, [["region", "other", "orders", "", ""], ["region", "1995", "1995", "1996", "1997"]], body)
    regions, _ = IO.two_row_header_to_long(sheet, "orders")
    return regions.where("value is not null")


@query(f"select n_name region, year(o_orderdate)::int as year, c_mktsegment category, count(*)::double as value from {_BY_YEAR} where year(o_orderdate) in (1995, 1996) and c_mktsegment in ('BUILDING', 'MACHINERY') group by all")
def s05_block_matrix(spark, d):
    o, c, n = (B.read(spark, d, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    cells = [(y, s) for y in (1995, 1996) for s in ("BUILDING", "HOUSEHOLD", "MACHINERY")]
    body = j.groupBy("n_name").agg(*[F.count_if((F.year("o_orderdate") == y) & (F.col("c_mktsegment") == s)).alias(f"{y}{s}") for y, s in cells])
    heads = [["region", *(str(y) if s == "BUILDING" else "" for y, s in cells)], ["region", *(s for _, s in cells)]]
    return IO.composite_header_to_long(_sheet(spark, heads, body), ["BUILDING", "MACHINERY"]).where("value > 0")


@query("select n_nationkey code, n_name alias, n_regionkey::double weight from nation")
def s06_rule_tables(spark, d):
    records = [{"code": r["n_nationkey"], "alias": r["n_name"], "weight": float(r["n_regionkey"])} for r in B.read(spark, d, "nation").collect()]  # a rule list
    return IO.rules_to_df(spark, records, "code long, alias string, weight double", ["code"], ["weight"])


@query("select o_orderkey, o_custkey, o_totalprice from orders")
def s08_write_and_verify(spark, d):
    return IO.write_verified(B.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), new_path(spark, "verified"))


@query("select unnest(['same', 'other input', 'other settings']) run, unnest([true, false, false]) reused, unnest([n, -1, -1])::bigint n_rows from (select count(*) n from orders)")
def s10_reuse_if_unchanged(spark, d):
    path = new_path(spark, "run")
    one = IO.fingerprint(B.read(spark, d, "orders")).first()
    other = IO.fingerprint(B.read(spark, d, "customer")).first()["fingerprint"]
    IO.save_run(spark, path, {"orders": one["fingerprint"]}, {"seed": 1}, n_rows=one["n_rows"])
    runs = {"same": ({"orders": one["fingerprint"]}, {"seed": 1}), "other input": ({"orders": other}, {"seed": 1}), "other settings": ({"orders": one["fingerprint"]}, {"seed": 2})}
    got = {name: IO.reusable_run(spark, path, *args) for name, args in runs.items()}
    return spark.createDataFrame([(name, r is not None, r["n_rows"] if r else -1) for name, r in got.items()], "run string, reused boolean, n_rows long")


@query("select unnest(['whole', 'lacking']) as name, unnest([true, false]) passed, unnest([n, -1])::bigint n_rows from (select count(*) n from supplier)")
def v01_require_columns(spark, d):
    s = B.read(spark, d, "supplier")
    out = []
    for name, cols in (("whole", ["s_suppkey", "s_name"]), ("lacking", ["s_suppkey", "s_rank"])):
        try:
            out.append((name, True, V.require_columns(s, cols).count()))
        except V.CheckFailed:
            out.append((name, False, -1))
    return spark.createDataFrame(out, "name string, passed boolean, n_rows long")


@query("select o_custkey, count(*)::bigint n_rows from orders group by 1 having count(*) > 1 order by 1 limit 10")
def x02_sample_limit(spark, d):
    """Rows that a failed check shows: the first ten, however many there are."""
    try:
        V.assert_unique(B.read(spark, d, "orders"), ["o_custkey"], "orders")
        shown = []
    except V.CheckFailed as e:
        shown = [(r["o_custkey"], r["n_rows"]) for r in e.rows]
    return spark.createDataFrame(shown, "o_custkey long, n_rows long")


@query("with " + B.INDICATORS + """, b as (select *, region like '%3' hit from indicators where value is not null), s as (select least(10, count(*) filter (hit)) k, least(10, count(distinct indicator_id) filter (hit)) i from b)
select unnest(['none', 'null keys', 'not finite', 'unknown direction', 'repeated', 'two directions']) fault, unnest([false, true, true, true, true, true]) refused, unnest([0, k, k, k, k, i])::bigint n_shown from s""")
def i01_index_refusals(spark, d):
    """What the input check of an index says to rows that are spoilt in one way each."""
    base = B.indicators(spark, d).where("value is not null").select("region", "year", "indicator_id", "direction", "value")
    hit = F.col("region").endswith("3")
    other = F.when(F.col("direction") == "positive", "negative").otherwise("positive")
    spoilt = {
        "none": base, "null keys": base.withColumn("region", F.when(~hit, F.col("region"))), "not finite": base.withColumn("value", F.when(hit, float("inf")).otherwise(F.col("value"))),
        "unknown direction": base.withColumn("direction", F.when(hit, "sideways").otherwise(F.col("direction"))), "repeated": base.unionByName(base.where(hit)),
        "two directions": base.withColumn("direction", F.when(hit, other).otherwise(F.col("direction"))),
    }
    out = []
    for fault, rows in spoilt.items():
        try:
            I.validate_index_input(rows)
            out.append((fault, False, 0))
        except V.CheckFailed as e:
            out.append((fault, True, len(e.rows)))
    return spark.createDataFrame(out, "fault string, refused boolean, n_shown long")


@query("select p_partkey, upper(p_name) upper_name from part")
def u01_scalar_udf(spark, d):
    from gridloom.streaming.incremental import scalar_udf

    return B.read(spark, d, "part").select("p_partkey", scalar_udf(lambda s: s.str.upper())(F.col("p_name")).alias("upper_name"))


_LAST = r"regexp_extract(p_name, '(\S+)$', 1)"


def _classifier(spark: SparkSession, d: str):
    from gridloom.operators.learning import fit_text_classifier

    p = B.read(spark, d, "part").select("p_partkey", "p_name", F.regexp_extract("p_name", r"(\S+)$", 1).alias("label"))
    return fit_text_classifier(p, "p_partkey", "p_name", "label", max_iter=10), p


@query(f"select p_partkey, {_LAST} pred_label from part")
def t08_predict_labels(spark, d):
    """The label is the last word of the name, which a fitted classifier has to find in every row."""
    from gridloom.operators.learning import predict_labels

    clf, p = _classifier(spark, d)
    return predict_labels(clf, p, "p_partkey", "p_name").select("p_partkey", "pred_label")


@query(f"select p_partkey, {_LAST} pred_label from part")
def t09_model_store(spark, d):
    from gridloom.operators.learning import load_model, predict_labels, save_model

    clf, p = _classifier(spark, d)
    path = new_path(spark, "model")
    save_model(clf, path)
    return predict_labels(load_model(spark, path), p, "p_partkey", "p_name").select("p_partkey", "pred_label")


@query("""with r as (select p_size > 25 y, ('0x' || substr(md5('0:' || p_partkey::varchar), 1, 8))::bigint % 3 fold from part where p_size not between 21 and 30),
f as (select a.fold, (select count(*) filter (b.y) > count(*) filter (not b.y) from r b where b.fold <> a.fold) guess from (select distinct fold from r) a),
g as (select avg((y = guess)::int) share from r join f using (fold) group by fold)
select unnest(['fits', 'stays at one class']) model, round(unnest([1.0::double, avg(share)]), 9) mean_accuracy, round(unnest([0.0::double, stddev_pop(share)]), 9) std_accuracy from g""")
def t11_compare_models(spark, d):
    """A model that can tell large parts by their size, and one whose penalty leaves it no slope and so the larger class of its folds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from gridloom.operators.learning import compare_models

    part = B.read(spark, d, "part").where("p_size not between 21 and 30")
    rows = part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), (F.col("p_size") > 25).cast("double").alias("label"))
    rows = VectorAssembler(inputCols=["p_size"], outputCol="features").transform(rows)
    make = lambda **kw: LogisticRegression(featuresCol="features", labelCol="label", maxIter=200, **kw)
    return rnd(compare_models({"fits": make(), "stays at one class": make(regParam=1e6)}, rows, "label", "p_partkey"), 9)
