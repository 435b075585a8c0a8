"""Intermediate tables in the folder that the cluster shares.

Long plans are cut by writing a table and reading it back.  The folder is the one named in
``spark.checkpoint.dir``, or the checkpoint folder of the context; only a local master without either (unit
tests, notebooks) gets a temporary one.  A written table survives lost executors, which a local checkpoint
does not.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Spark's own setting: the shuffle files of a query are removed once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="gridloom-")
    return _OWN[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/gridloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table", options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet (``options`` for the writer) into the shared folder and return the table read back.

    The shuffles of the plan have done their work then, and Spark removes their files.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").options(**(options or {})).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def numbered(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a number per row that is the same in every plan made from the result.

    The rows of a table scan keep their places whenever they are read.  Those of any other plan may not
    (a shuffle that is computed again brings them in another order), so such a plan is written first.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {re.sub(r"^[\s:+-]*", "", line).split(" ")[0].split("[")[0] for line in plan.splitlines()}
    if not nodes <= {"Relation", "LocalRelation", "Project", "Filter"}:
        df = materialize(df, "numbered")
    return df.withColumn(column, F.monotonically_increasing_id())


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_gridloom_path", None)
        if path:
            spark = df.sparkSession
            jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
