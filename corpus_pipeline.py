"""Corpus pipeline: quality, near duplicates, mix, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that the stage before kept, and returns the
columns of documents; the last returns the packed pieces.  ``run`` writes every stage as Parquet and reads
it again for the next.

Defined cases, in every stage: a null text counts as an empty one; very long texts are used whole; rows that
repeat are rows of their own (of which near duplicates keep one); other columns, whatever their names, pass
unchanged in all stages but packing, whose rows are pieces; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.staging import materialize, numbered
from gridloom.llm.jaccard import jaccard_groups
from gridloom.llm.mixing import mixed_rows
from gridloom.llm.packing import pack_documents
from gridloom.llm.quality import KEEP_TAIL, document_grade, fit_quality, score_quality
from gridloom.llm.queries import table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade reaches the threshold.

    A null, empty or wordless text is graded by its bias alone.
    """
    model = fit_quality(docs, table(spark, sf_dir, "labels"), document_grade())
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    return score_quality(rows, model).where(F.col("tail_prob") >= KEEP_TAIL).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of five-word Jaccard 0.8 or more; null, empty and wordless ones all stay.

    The first row of a group in the order of the table stays, also where ids repeat.
    """
    rows = numbered(docs.select(F.struct(*docs.columns).alias("doc"), "text"), "row")
    groups = jaccard_groups(rows.select(F.col("row").alias("doc_id"), "text"), n=5, t=(8, 10))
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("row"))
    return rows.join(materialize(gone, "near-gone"), "row", "left_anti").select("doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them.

    Null and empty texts hold no words and are not taken; a null source is one of its own; ties of the draw go
    to the smaller id.
    """
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens.

    A null or empty text is one piece that holds the end id.
    """
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mix", mix), ("packing", packing)]

#: SQL cannot express the fitted classifier or the tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
