"""Incremental text refinement with a state table, in batches or from a stream (E1, U1)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import text as X
from gridloom.functions.staging import materialize
from gridloom.operators.checks import CheckFailed


def scalar_udf(fn: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """A user text function (Series to Series of the same length) as a column function."""

    def checked(values: pd.Series) -> pd.Series:
        out = fn(values)
        if len(out) != len(values):
            raise ValueError("the function must keep the number of values")
        return out

    checked.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(checked, "string")


def source_hash(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def latest_state(state: DataFrame, identity: Sequence[str]) -> DataFrame:
    """The last stored result per row; of several of one batch, that of the largest source hash."""
    w = Window.partitionBy(*identity).orderBy(F.col("batch").desc(), F.col("source_sha").desc(), F.col("refined").desc())
    return state.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def split_reusable(df: DataFrame, state: DataFrame, identity: Sequence[str], text: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a stored result of the same source text that needs no rerun, rows to process)."""
    rows = df.withColumn("source_sha", source_hash(text))
    good = latest_state(state, identity).where((F.col("status") == "success") & ~X.needs_rerun(F.col("refined")))
    good = good.select(*identity, "source_sha", "refined", "status")
    return rows.join(good, [*identity, "source_sha"]), rows.join(good, [*identity, "source_sha"], "left_anti")


def refine(rows: DataFrame, fn: Callable[[pd.Series], pd.Series], text: str) -> DataFrame:
    """``refined`` and ``status`` (success, missing, violation, failed) of rows to process."""
    out = rows.withColumn("refined", scalar_udf(fn)(F.col(text)))
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    flags = X.preservation_flags(F.col(text), F.col("refined"))
    status = F.when(blank, "missing").when(F.col("refined").isNull(), "failed").when(F.size(flags) > 0, "violation").otherwise("success")
    return out.withColumn("status", status)


def incremental_apply(df: DataFrame, state: DataFrame, fn: Callable[[pd.Series], pd.Series], identity: Sequence[str], text: str, batch: int, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(result, state rows to append, summary).  A ``strict`` batch in which every processed row fails raises."""
    reused, todo = split_reusable(df, state, identity, text)
    done = materialize(refine(todo, fn, text), "refined")
    counts = {r["status"]: r["count"] for r in done.groupBy("status").count().collect()}  # four states
    if strict and set(counts) == {"failed"}:
        raise CheckFailed("every row of the batch failed")
    result = reused.withColumn("reused", F.lit(True)).unionByName(done.withColumn("reused", F.lit(False)))
    fresh = done.select(*identity, "source_sha", "refined", "status", F.lit(batch).cast("long").alias("batch"))
    summary = result.groupBy("status", "reused").agg(F.count(F.lit(1)).alias("n"))
    return result, fresh, summary


@dataclass(frozen=True)
class StateTable:
    """Results per row identity, in buckets of its hash, one folder per batch, merged every ``compact_every`` batches.

    A batch counts once its commit record is there.  Its folder is written anew when it is replayed before that, and a
    replay after it changes nothing.  A reader takes the last merged table and the batches since, and of them
    only the buckets that its rows fall into, so what is read follows the batch and not the history.
    """

    path: str
    identity: tuple[str, ...]
    buckets: int = 256
    compact_every: int = 16

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.identity), F.lit(self.buckets)).cast("int")

    def commits(self, spark: SparkSession) -> list[Row]:
        """Commit records ``(batch, folder, merged)`` since the last merged table, itself included; one row per batch."""
        try:
            rows = spark.read.schema("batch long, folder string, merged boolean").parquet(f"{self.path}/commits/*").collect()
        except AnalysisException as e:  # no batch yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        last = max((r["batch"] for r in rows if r["merged"]), default=None)
        return sorted((r for r in rows if last is None or r["batch"] > last or (r["batch"] == last and r["merged"])), key=lambda r: (r["batch"], r["merged"]))

    def _folders(self, spark: SparkSession, schema: str, commits: Sequence[Row]) -> DataFrame:
        if not commits:
            return spark.createDataFrame([], f"{schema}, bucket int")
        found = spark.read.schema(f"{schema}, part string, bucket int").option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{r['folder']}" for r in commits])
        return found.drop("part")

    def read(self, rows: DataFrame) -> DataFrame:
        """The stored results that the identities of ``rows`` may have."""
        spark, kinds = rows.sparkSession, dict(rows.dtypes)
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in self.identity) + ", source_sha string, refined string, status string, batch long"
        hit = [r[0] for r in rows.select(self.bucket()).distinct().collect()]  # at most a row per bucket
        return self._folders(spark, schema, self.commits(spark)).where(F.col("bucket").isin(hit)).drop("bucket")

    def _write(self, rows: DataFrame, folder: str, batch: int, merged: bool) -> None:
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        record = rows.sparkSession.createDataFrame([(batch, folder, merged)], "batch long, folder string, merged boolean")
        record.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{folder}")

    def append(self, fresh: DataFrame, batch: int) -> None:
        """The results of a batch and its commit record; then a merge, if one is due.

        An empty batch is committed too.  Files that a merge replaced are left for readers that are under way, until the next one.
        """
        spark = fresh.sparkSession
        self._write(fresh, f"part=rows-{batch}", batch, False)
        live = self.commits(spark)
        if sum(not r["merged"] for r in live) >= self.compact_every:
            schema = ", ".join(f"`{c}` {k}" for c, k in fresh.dtypes)
            whole = self._folders(spark, schema, live).drop("bucket")
            self._write(latest_state(whole, self.identity), f"part=merged-{batch}", batch, True)


def stream_refine(stream: DataFrame, state_path: str, checkpoint: str, fn: Callable[[pd.Series], pd.Series], identity: Sequence[str], text: str, buckets: int = 256, compact_every: int = 16):
    """The same merge per micro-batch of a stream, against a :class:`StateTable`.

    Only a stream whose first batch fails wholly stops; later failures are stored and tried again with their rows.
    """
    table = StateTable(state_path, tuple(identity), buckets, compact_every)

    def merge(rows: DataFrame, batch: int) -> None:
        done = [r["batch"] for r in table.commits(rows.sparkSession)]
        if done and batch <= max(done):
            return  # a replay of a batch that was committed
        rows = materialize(rows, "batch")
        _, fresh, _ = incremental_apply(rows, table.read(rows), fn, identity, text, batch, strict=not done)
        table.append(fresh, batch)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
