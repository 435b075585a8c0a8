"""Registered queries of indices, fixed effects and text features, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.catalog import _FULL, _STD, _scores, query, rnd
from gridloom.operators import index as I
from gridloom.operators import panelstats as S
from gridloom.operators import text_groups as T
from gridloom.plans import base as B

# ---------------------------------------------------------------- indices


def _index_sql(name: str, yearly: str) -> str:
    """CTE ``name`` with region, year, index_score and rank of a scenario over the whole indicators table."""
    std = _STD.format(y=yearly).replace(", st as", f", st_{name} as").replace("from st ", f"from st_{name} ").replace("sc as", f"sc_{name} as")
    return std + f""", x_{name} as (select region, year, sum(ds * weight) x from sc_{name} join weights using (indicator_id) group by all),
{name} as (select region, year, x index_score, rank() over (partition by year order by round(x, 9) desc)::int as rank from x_{name})"""


_BOTH = "with " + B.INDICATORS + ", " + B.WEIGHTS + _index_sql("a", "") + _index_sql("b", ", year")


def _scenarios(spark, d) -> DataFrame:
    a, b = (I.compute_index(_scores(spark, d, m), B.weights(spark), check=False).final for m in ("pooled", "yearly"))
    return I.compare_scenarios(a, b)


@query(_BOTH + """ select year, round(corr(a.index_score, b.index_score), 6) pearson, round(avg(abs(b.index_score - a.index_score)), 5) mae, round(avg(abs(b.rank - a.rank)), 5) mean_rank_gap, max(abs(b.rank - a.rank))::int max_rank_gap from a join b using (region, year) group by 1""")
def i06_scenarios(spark, d):
    return rnd(rnd(I.scenario_agreement(_scenarios(spark, d)), 6, "pearson"), 5, "mae", "mean_rank_gap")


@query(_BOTH + " select region, year, round(a.index_score, 4) index_a, a.rank rank_a, round(b.index_score, 4) index_b, b.rank rank_b, b.rank - a.rank rank_diff from a join b using (region, year)")
def i08_yearly_agreement(spark, d):
    return rnd(_scenarios(spark, d).select("region", "year", "index_a", "rank_a", "index_b", "rank_b", "rank_diff"))


@query("with " + B.INDICATORS + ", " + B.WEIGHTS + _FULL + """, rows_ as (select i.*, full_value v from indicators i join ok using (region, year)), valid as (select * from rows_ where not (indicator_id = 'BUILDING' and year = 1996)),
st as (select *, (v - avg(v) over w) / stddev_pop(v) over w z from valid window w as (partition by indicator_id)),
sc as (select *, case when direction = 'negative' then 100 - s else s end ds from (select *, (z - min(z) over w) / (max(z) over w - min(z) over w) * 100 s from st window w as (partition by indicator_id))),
every as (select region, year, indicator_id, ds from sc union all select region, year, 'BUILDING', ds from sc where indicator_id = 'FURNITURE' and year = 1996),
f as (select region, year, sum(ds * weight) x from every join weights using (indicator_id) group by all)
select region, year, round(x, 4) index_score, rank() over (partition by year order by round(x, 9) desc)::int as rank from f""")
def i07_weight_transfer(spark, d):
    rows = B.indicators(spark, d).select("region", "year", "indicator_id", "category", "subcategory", "direction", F.col("full_value").alias("value"))
    ok = rows.groupBy("region", "year").agg(F.count(F.lit(1)).alias("k")).where("k = 5")
    return rnd(I.transfer_weight(rows.join(ok, ["region", "year"], "left_semi"), B.weights(spark), "BUILDING", "FURNITURE", [1996]).final)


@query("with " + B.INDICATORS + """, c as (select count(*) n, count(*) filter (region like '%2') spoilt, count(distinct (region, year)) ry, count(distinct (region, year)) filter (region like '%2') ry_bad,
count(distinct (region, year, category)) cat, count(distinct (region, year, category)) filter (region like '%2') cat_bad, count(distinct (region, year, subcategory)) sub, count(distinct (region, year, subcategory)) filter (region like '%2') sub_bad from indicators)
select unnest(['final', 'category', 'subcategory', 'indicator']) artifact, unnest([ry, cat, sub, n + spoilt])::bigint n_rows, unnest([0, 0, 0, spoilt])::bigint n_repeated, unnest([ry_bad, cat_bad, sub_bad, 2 * spoilt])::bigint n_not_finite, unnest([ry_bad = 0, cat_bad = 0, sub_bad = 0, spoilt = 0]) passed from c""")
def v16_verify_index(spark, d):
    """A bundle in which some regions have infinite scores and repeated indicator rows."""
    good = I.compute_index(_scores(spark, d, "pooled"), B.weights(spark), check=False)
    bad = F.col("region").endswith("2")
    spoil = lambda t, c: t.withColumn(c, F.when(bad, F.lit(float("inf"))).otherwise(F.col(c)))
    rows = spoil(good.indicators, "contribution")
    out = I.verify_index(I.IndexTables(rows.unionByName(rows.where(bad)), spoil(good.subcategories, "score"), spoil(good.categories, "score"), spoil(good.final, "index_score")))
    return out.select("artifact", "n_rows", "n_repeated", "n_not_finite", "passed")


# ---------------------------------------------------------------- fixed effects
#
# On a balanced panel both effects are removed by subtracting the two means, and one regressor's clustered
# error needs its own residual only.


def _fe(rows: str, by: str = "") -> str:
    """CTE ``fe`` of one regressor ``x`` on ``y`` over the CTE ``rows`` (region, year, x, y and the keys ``by``)."""
    keys, comma = (by, ", ") if by else ("", "")
    part = f"partition by {keys}" if by else ""
    on = f" using ({keys})" if by else " on true"
    more = f", {keys}" if by else ""
    return f"""dm as (select region, year{more}, x - avg(x) over (partition by region{more}) - avg(x) over (partition by year{more}) + avg(x) over ({part}) xd,
  y - avg(y) over (partition by region{more}) - avg(y) over (partition by year{more}) + avg(y) over ({part}) yd from {rows}),
be as (select {keys}{comma}sum(xd * yd) / sum(xd * xd) coef, sum(xd * xd) sxx, count(*) n, count(distinct region) g, count(distinct year) t from dm{' group by ' + keys if by else ''}),
sr as (select {keys}{comma}region, sum(xd * (yd - coef * xd)) s from dm join be{on} group by {keys}{comma}region),
mt as (select {keys}{comma}sum(s * s) meat from sr{' group by ' + keys if by else ''}),
fe as (select {keys}{comma}coef, sqrt(g / (g - 1.0) * (n - 1.0) / (n - (g + t)) * meat / (sxx * sxx)) se, n::bigint n, g::bigint n_regions, t::bigint n_years, (n - g - t)::bigint resid_df, (g - 1)::bigint inference_df from be join mt{on})"""


_PX = "with " + B.PANEL + ", p as (select region, year, ln(1 + budget) x, outcome y from panel), "
_COUNTS = ("n", "n_regions", "n_years", "resid_df", "inference_df")


@query(_PX + _fe("p") + " select 'log_budget' term, round(coef, 9) coef, round(se, 9) se, round(coef / se, 6) t, n, n_regions, n_years, resid_df, inference_df from fe")
def m01_two_way_fe(spark, d):
    out = S.two_way_fe(B.panel(spark, d).withColumn("log_budget", F.log1p("budget")), "outcome", "log_budget")
    return rnd(rnd(out.select("term", "coef", "se", "t", *_COUNTS), 9, "coef", "se"), 6, "t")


@query(_PX + _fe("p") + """, q as (select *, case inference_df when 24 then 2.0638985616280205::double end q from fe)
select 'x' term, round(coef - q * se, 8) ci_low, round(coef + q * se, 8) ci_high, case when abs(coef / se) > 2.0638985616280205 then true else false end significant from q""")
def m02_fe_summary(spark, d):
    """Interval and significance at 5 %; the SQL knows the t quantile of 25 regions only."""
    out = S.two_way_fe(B.panel(spark, d).withColumn("x", F.log1p("budget")), "outcome", "x")
    return rnd(out.select("term", "ci_low", "ci_high", (F.col("p") < 0.05).alias("significant")), 8)


_SUB = "with " + B.SUBPANEL + ", o as (select region, year, round(avg(l_discount), 8) y from detail group by all), s as (select s.region, s.year, s.subarea, ln(1 + budget) x, y, right(s.region, 1)::int % 3 \"cluster\" from subpanel s join o using (region, year)), "


def _sub(spark, d) -> DataFrame:
    return B.subpanel(spark, d).join(B.panel(spark, d).select("region", "year", "outcome"), ["region", "year"]).withColumn("x", F.log1p("budget")).withColumn("cluster", F.right(F.col("region"), F.lit(1)).cast("int") % 3)


@query(_SUB + "v as (select *, 'all' variant from s union all select *, 'unflagged' from s where year <> 2001), " + _fe("v", "variant, subarea") + " select 'level' model, variant, subarea, round(coef, 8) coef, round(se, 8) se, n, n_regions, n_years from fe")
def m03_fe_grid(spark, d):
    out = S.fe_grid(_sub(spark, d).withColumn("flag", F.col("year") == 2001), [("level", "outcome", "x")], flag="flag", by=["subarea"])
    return rnd(out.select("model", "variant", "subarea", "coef", "se", "n", "n_regions", "n_years"), 8)


@query(_SUB + _fe("s", '"cluster", subarea') + ' select "cluster", subarea, round(coef, 8) coef, round(se, 8) se, n, n_regions from fe')
def m05_subgroup_fe(spark, d):
    return rnd(S.subgroup_fe(_sub(spark, d), "outcome", "x", ["cluster", "subarea"], ["cluster"]).select("cluster", "subarea", "coef", "se", "n", "n_regions"), 8)


def _three(rows: str, xs: tuple[str, str, str], terms: dict[str, tuple[int, int, int]]) -> str:
    """CTE ``t3`` (term, coef, se) of combinations of three regressors: Cramer's rule on the demeaned sums, errors from the scores of the regions."""
    cols = [*xs, "y"]
    dm = ", ".join(f"{c} - avg({c}) over (partition by region) - avg({c}) over (partition by year) + avg({c}) over () d{i}" for i, c in enumerate(cols))
    sums = ", ".join(f"sum(d{i} * d{j}) s{i}{j}" for i in range(3) for j in range(4))
    minor = lambda i, j: f"(s{(i + 1) % 3}{(j + 1) % 3} * s{(i + 2) % 3}{(j + 2) % 3} - s{(i + 1) % 3}{(j + 2) % 3} * s{(i + 2) % 3}{(j + 1) % 3})"
    det = " + ".join(f"s0{j} * {minor(0, j)}" for j in range(3))
    inv = ", ".join(f"{minor(j, i)} / ({det}) i{i}{j}" for i in range(3) for j in range(3))
    beta = ", ".join(" + ".join(f"i{i}{j} * s{j}3" for j in range(3)) + f" b{i}" for i in range(3))
    score = ", ".join(f"sum(d{i} * (d3 - b0 * d0 - b1 * d1 - b2 * d2)) g{i}" for i in range(3))
    wanted = ", ".join(f"('{t}', {w[0]}, {w[1]}, {w[2]})" for t, w in terms.items())
    side = " + ".join("(" + " + ".join(f"i{i}{j} * w{j}" for j in range(3)) + f") * g{i}" for i in range(3))
    return f"""d3 as (select region, year, {dm} from {rows}), s3 as (select {sums}, count(*) n, count(distinct region) g, count(distinct year) t from d3), v3 as (select *, {inv} from s3), b3 as (select *, {beta} from v3),
g3 as (select region, {score} from d3, b3 group by region), w3(term, w0, w1, w2) as (values {wanted}),
t3 as (select term, w0 * b0 + w1 * b1 + w2 * b2 coef, sqrt(g / (g - 1.0) * (n - 1.0) / (n - (g + t + 2)) * (select sum(pow({side}, 2)) from g3)) se from b3, w3)"""


@query("with " + B.SUBPANEL + """, o as (select region, year, round(avg(l_discount), 8) y from detail group by all), w as (select region, year, ln(1 + sum(budget) filter (area = 'CORE')) x0, ln(1 + sum(budget) filter (area = 'MID')) x1, ln(1 + sum(budget) filter (area = 'OTHER')) x2 from subpanel group by all),
r as (select * from w join o using (region, year) where x0 is not null and x1 is not null and x2 is not null), """ + _three("r", ("x0", "x1", "x2"), {"CORE": (1, 0, 0), "MID": (0, 1, 0), "OTHER": (0, 0, 1)}) + " select term, round(coef, 8) coef, round(se, 8) se, round(coef / se, 6) t from t3")
def m04_mutual_controls(spark, d):
    wide = B.subpanel(spark, d).groupBy("region", "year").pivot("area", ["CORE", "MID", "OTHER"]).agg(F.log1p(F.sum("budget"))).dropna()
    out = S.two_way_fe(wide.join(B.panel(spark, d).select("region", "year", "outcome"), ["region", "year"]), "outcome", ["CORE", "MID", "OTHER"])
    return rnd(rnd(out.select("term", "coef", "se", "t"), 8, "coef", "se"), 6, "t")


@query("with " + B.PANEL + """, r as (select region, year, outcome y, case when right(region, 1)::int % 3 = 0 then ln(1 + budget) else 0 end x0, case when right(region, 1)::int % 3 = 1 then ln(1 + budget) else 0 end x1,
case when right(region, 1)::int % 3 = 2 then ln(1 + budget) else 0 end x2 from panel), """ + _three("r", ("x0", "x1", "x2"), {"0": (1, 0, 0), "1": (0, 1, 0), "2": (0, 0, 1), "1 - 0": (-1, 1, 0), "2 - 0": (-1, 0, 1), "2 - 1": (0, -1, 1)}) + " select term, round(coef, 7) coef, round(se, 7) se from t3")
def m06_interactions(spark, d):
    p = B.panel(spark, d).withColumn("x", F.log1p("budget")).withColumn("cluster", F.right(F.col("region"), F.lit(1)).cast("int") % 3)
    slopes, diffs = S.interaction_fe(p, "outcome", "x", "cluster", [0, 1, 2])
    return rnd(slopes.unionByName(diffs).select("term", "coef", "se"), 7)


@query(_PX + "names as (select distinct region omitted from p union all select '(none)'), v as (select p.*, omitted from p join names on region <> omitted), " + _fe("v", "omitted") + " select nullif(omitted, '(none)') omitted, round(coef, 9) coef, round(se, 9) se, n, n_regions, resid_df from fe")
def m09_leave_one_out(spark, d):
    out = S.leave_one_out(B.panel(spark, d).withColumn("x", F.log1p("budget")), "outcome", "x")
    return rnd(out.select("omitted", "coef", "se", "n", "n_regions", "resid_df"), 9)


@query("with " + B.PANEL + ", g as (select region, year, outcome y, ln(1 + budget / n) x1, ln(1 + budget) x2, right(region, 1)::int % 2 g from panel), both_ as (select region, year, y, x1 x, g, 1 k from g union all select region, year, y, x2, g, 2 from g), " + _fe("both_", "g, k").replace("count(distinct region) g,", "count(distinct region) gg,").replace("g / (g - 1.0)", "gg / (gg - 1.0)").replace("n - (g + t)", "n - (gg + t)").replace("g::bigint n_regions", "gg::bigint n_regions").replace("(n - g - t)", "(n - gg - t)").replace("(g - 1)::bigint", "(gg - 1)::bigint") + " select a.g, round(a.coef, 8) coef_a, round(b.coef, 8) coef_b, sign(a.coef) = sign(b.coef) same_sign from fe a join fe b on a.g = b.g and a.k = 1 and b.k = 2")
def m13_denominator_sensitivity(spark, d):
    p = B.panel(spark, d).withColumn("g", F.right(F.col("region"), F.lit(1)).cast("int") % 2).withColumn("x1", F.log1p(F.col("budget") / F.col("n"))).withColumn("x2", F.log1p("budget"))
    a, b = (S.two_way_fe(p, "outcome", x, by=["g"]) for x in ("x1", "x2"))
    return rnd(S.compare_models(a, b, ["g"]).select("g", "coef_a", "coef_b", "same_sign"), 8)


@query("with " + B.PANEL + """, r as (select *, rank() over (partition by year order by budget desc)::int rank_a, rank() over (partition by year order by outcome desc)::int rank_b from panel)
select region, year, rank_a, rank_b, rank_a - rank_b rank_gap, round(coalesce((budget - avg(budget) over w) / nullif(stddev_pop(budget) over w, 0), 0), 5) budget_z, round(coalesce((outcome - avg(outcome) over w) / nullif(stddev_pop(outcome) over w, 0), 0), 5) outcome_z from r window w as (partition by region)""")
def m14_alignment_panel(spark, d):
    p = B.panel(spark, d)
    out = S.alignment_panel(p.select("region", "year", "budget"), p.select("region", "year", "outcome"), "budget", "outcome")[0]
    return rnd(out.select("region", "year", "rank_a", "rank_b", "rank_gap", "budget_z", "outcome_z"), 5)


# ---------------------------------------------------------------- text features

_GRAMS = """words as (select {key}, unnest(list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda w: w <> '')) w from {table}),
padded as (select {key}, ' ' || w || ' ' w from words), grams as (select {key}, substr(w, i::int, n::int) g from padded, range(2, 6) a(n), unnest(range(1, length(w) - n + 2)) b(i) where n <= length(w))"""


@query("with " + _GRAMS.format(key="p_type", text="p_name", table="part") + " select p_type, g, count(*)::bigint n from grams group by all")
def t01_char_ngrams(spark, d):
    return B.read(spark, d, "part").select("p_type", F.explode(T.char_ngrams(F.col("p_name"))).alias("g")).groupBy("p_type", "g").agg(F.count(F.lit(1)).alias("n"))


@query("with recursive names as (select p_name, min(p_partkey) id from part group by 1), " + _GRAMS.format(key="id", text="p_name", table="names") + """, tf as (select id, g, count(*) tf from grams group by all), dfs as (select g, count(*) df from tf group by 1),
raw as (select tf.id, tf.g, tf.tf * (ln((1 + (select count(*) from names)) / (1 + df)::double) + 1) raw from tf join dfs using (g)), w as (select *, raw / sqrt(sum(raw * raw) over (partition by id)) wt from raw),
cos as (select a.id x, b.id y, sum(a.wt * b.wt) c from w a join w b on a.g = b.g and a.id <> b.id group by all having sum(a.wt * b.wt) >= 0.6),
near as (select x, y from (select *, row_number() over (partition by x order by round(c, 12) desc, y) k from cos) where k = 1), links as (select x, y from near union select y, x from near),
reach(x, y) as (select id, id from names union select r.x, l.y from reach r join links l on l.x = r.y), root as (select x id, min(y) component from reach group by 1)
select id, p_name, component, count(*) over (partition by component)::bigint group_size from root join names using (id)""")
def t05_connected_groups(spark, d):
    names = B.read(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    return T.connected_groups(names, "id", "p_name", 0.6).select("id", "p_name", "component", "group_size")


@query("select c_custkey, round((c_acctbal - avg(c_acctbal) over ()) / stddev_samp(c_acctbal) over (), 6) scaled from customer")
def t10_preprocess(spark, d):
    from pyspark.ml.functions import vector_to_array

    from gridloom.operators.learning import preprocessor

    c = B.read(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    out = preprocessor(["c_acctbal"], ["c_mktsegment"]).fit(c).transform(c)
    return rnd(out.select("c_custkey", vector_to_array("features")[0].alias("scaled")), 6)
