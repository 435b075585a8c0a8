"""Mixing sources to target weights by Pareto order sampling.

Only DataFrame functions are used.  Source targets come from a capped water fill over one row per
source.  Within a source, a document's expected number of copies depends on its length class; the whole
copies are certain, and the fractional rest is the inclusion probability of a Pareto order sample
(random odds divided by inclusion odds, smallest first), cut where the words still wanted are reached.

The order is never sorted as one group: each source's ranks are first counted in histogram cells, the
cut cell is found from these counts, and only rows of that cell are ordered.  A source that holds a third
of all rows is therefore spread over all tasks.

Defined cases: a null text has size 0 and takes nothing; a null source is a source of its own, ordered
last; repeated rows are separate rows that tie and are taken like any others; an empty table gives an
empty result; columns of the input other than the three named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.staging import materialize, numbered

WORD = r"[^\x20\x09-\x0D]+"
CELLS = 4096
MAX_COPIES = 3


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-white characters; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = MAX_COPIES) -> DataFrame:
    """``(source, source_size, weight, target)``: capped shares of the total size.

    A source's weight is taken in turn from ``weights`` by its rank in code point order, null last.
    The fill level is the smallest ``(total - capped sizes before) / (weights from here)`` in the order
    of cap by weight, which equals resharing the excess until no target is above its cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    behind = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    level = F.greatest(total - before, F.lit(0.0)) / behind
    per = per.withColumn("level", level)
    # The first source whose own limit is not reached sets the level for itself and all behind it.
    free = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    per = per.withColumn("first", F.first(free, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.coalesce(F.least(F.col("first") * F.col("weight"), F.col("limit")), F.col("limit"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def length_class(size: Column) -> Column:
    """Class of a document by the number of binary digits of its size."""
    return F.length(F.bin(size))


def class_copies(classes: DataFrame, targets: DataFrame, cap: float = MAX_COPIES) -> DataFrame:
    """Expected copies of each (source, length class): ``min(cap, level * preference)``.

    The preference of a class is ``1 + class / 8``: longer documents are somewhat likelier.  One row per
    source and class (64 classes at most), so the window sees at most 64 rows per source.
    """
    pref = 1 + F.col("class") / 8
    named = targets.withColumnRenamed("source", "s")
    both = classes.join(named, F.col("source").eqNullSafe(F.col("s"))).select("source", "class", "class_size", "source_size", "target", pref.alias("pref"))
    order = Window.partitionBy("source").orderBy(F.col("class").desc())
    full = F.coalesce(F.sum(F.col("class_size") * cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(F.col("class_size") * F.col("pref")).over(order.rowsBetween(0, Window.unboundedFollowing))
    level = F.when(rest > 0, F.greatest(F.col("target") - full, F.lit(0.0)) / rest).otherwise(F.lit(0.0))
    both = both.withColumn("level", level)
    free = F.when(F.col("level") * F.col("pref") <= cap, F.col("level"))
    both = both.withColumn("first", F.first(free, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    copies = F.coalesce(F.least(F.col("first") * F.col("pref"), F.lit(float(cap))), F.lit(float(cap)))
    return both.select("source", "class", "source_size", "target", copies.alias("copies"))


def unit_draw(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) fixed by the id and the seed (the first 12 hex digits of an MD5)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def _measured(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """The rows of ``docs``, each as one struct, with the columns that a decision needs."""
    rows = docs.select(F.struct(*docs.columns).alias("_m_doc"), F.col(source).alias("_m_source"), word_count(F.col(text)).alias("_m_size"), unit_draw(F.col(doc_id), seed).alias("_m_u"), F.col(doc_id).alias("_m_id"))
    return numbered(rows, "_m_row").withColumn("_m_class", length_class(F.col("_m_size")))


def _drawn(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their source's target, whole copies, odds and histogram cell (null: nothing to draw)."""
    out = rows.join(plan, F.col("_m_source").eqNullSafe(F.col("_p_source")) & (F.col("_m_class") == F.col("_p_class"))).drop("_p_source", "_p_class")
    whole = F.floor("_p_copies").cast("long")
    part = F.col("_p_copies") - whole
    odds = (F.col("_m_u") / (1 - F.col("_m_u"))) / (part / (1 - part))
    out = out.withColumn("_m_whole", whole).withColumn("_m_odds", F.when((part > 0) & (F.col("_m_size") > 0), odds))
    return out.withColumn("_m_cell", F.floor(F.col("_m_odds") / (1 + F.col("_m_odds")) * CELLS).cast("int"))


def _decided(docs: DataFrame, doc_id: str, text: str, source: str, weights: tuple[float, ...], seed: int, slim: bool) -> DataFrame:
    rows = _measured(docs, doc_id, text, source, seed)
    need = ["_m_row", "_m_source", "_m_size", "_m_class", "_m_u", "_m_id"]
    sizes = materialize(rows.select(*need), "mix-sizes")
    classes = sizes.groupBy(F.col("_m_source").alias("source"), F.col("_m_class").alias("class")).agg(F.sum("_m_size").alias("class_size"))
    targets = source_targets(classes.select("source", F.col("class_size").alias("size")), weights)
    plan = materialize(class_copies(classes, targets), "mix-plan").toDF("_p_source", "_p_class", "_p_source_size", "_p_target", "_p_copies")

    drawn = _drawn(sizes, plan)
    sums = drawn.groupBy("_m_source", "_m_cell").agg(
        F.sum(F.when(F.col("_m_cell").isNotNull(), F.col("_m_size"))).alias("words"),
        F.sum(F.col("_m_whole") * F.col("_m_size")).alias("sure"),
        F.max("_p_target").alias("target"),
    )
    by_source = Window.partitionBy("_m_source")
    upto = by_source.orderBy(F.col("_m_cell").asc_nulls_first())
    sums = sums.withColumn("wanted", F.col("target") - F.sum("sure").over(by_source))
    sums = sums.withColumn("upto", F.coalesce(F.sum("words").over(upto), F.lit(0))).withColumn("before", F.col("upto") - F.coalesce("words", F.lit(0)))
    cut = sums.where("_m_cell is not null and upto > wanted").groupBy(F.col("_m_source").alias("_c_source")).agg(
        F.min("_m_cell").alias("_c_cell"), F.min("before").alias("_c_before"), F.max("wanted").alias("_c_wanted")
    )
    cut = materialize(cut, "mix-cut")

    # Only rows of a source's cut cell are ordered.
    inside = drawn.join(cut, F.col("_m_source").eqNullSafe(F.col("_c_source")) & (F.col("_m_cell") == F.col("_c_cell")))
    order = Window.partitionBy("_m_source").orderBy("_m_odds", "_m_id", "_m_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = F.col("_c_before") + F.sum("_m_size").over(order)
    inside = inside.withColumn("_i_take", reached - F.col("_m_size") / 2 <= F.col("_c_wanted"))
    inside = materialize(inside.select(F.col("_m_row").alias("_i_row"), "_i_take"), "mix-inside")

    out = _drawn(sizes if slim else rows, plan).join(cut, F.col("_m_source").eqNullSafe(F.col("_c_source")), "left")
    out = out.join(inside, F.col("_m_row") == F.col("_i_row"), "left")
    lower = F.col("_m_cell").isNotNull() & (F.col("_c_cell").isNull() | (F.col("_m_cell") < F.col("_c_cell")))
    extra = F.when(F.coalesce(F.col("_i_take"), lower), 1).otherwise(0)
    return out.withColumn("_m_copies", (F.col("_m_whole") + extra).cast("long"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), seed: int = 7) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, source, copies)`` for every row of ``docs``.

    ``copies`` is the number of whole copies, ``taken`` the words in them.  A source's words taken differ
    from its target by half a document at most, unless no free document is left.
    """
    out = _decided(docs, doc_id, text, source, weights, seed, slim=True)
    return out.select(
        F.col("_m_id").alias("doc_id"),
        F.col("_m_size").alias("size"),
        F.col("_p_source_size").alias("source_size"),
        F.col("_p_target").alias("target"),
        (F.col("_m_copies") * F.col("_m_size")).alias("taken"),
        F.col("_m_source").alias("source"),
        F.col("_m_copies").alias("copies"),
    )


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), seed: int = 7) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, in the columns of ``docs``.

    Rows of no words are never taken.  Texts are not shuffled: plan and cut are joined to the scanned rows.
    """
    out = _decided(docs, doc_id, text, source, weights, seed, slim=False)
    copies = F.when(F.col("_m_size") > 0, F.col("_m_copies")).otherwise(0)
    out = out.withColumn("_m_n", copies).where("_m_n > 0").withColumn("_m_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m_n"))))
    return out.select("_m_doc.*")
