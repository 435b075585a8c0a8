"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.staging import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Smallest reachable node for every node that has an edge: ``(node, component)``.

    Each round hooks a node onto its smallest neighbour, shortens the hooks to roots by pointer jumping
    and contracts the edges onto the roots, so the edge table shrinks until none is left.  All steps are
    aggregations and equi-joins; nothing is collected.  Null ends and loops are ignored; an empty edge
    table gives an empty result.
    """
    a, b = F.col(src), F.col(dst)
    live = materialize(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct(),
        "cc-edges",
    )
    labels = None
    while not live.isEmpty():  # every node with a smaller neighbour goes in a round
        hook = materialize(live.groupBy("hi").agg(F.min("lo").alias("up")).withColumnRenamed("hi", "node"), "cc-hook")
        while True:
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = materialize(
                hook.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")),
                "cc-jump",
            )
            moved = not jumped.where("moved").isEmpty()
            discard(hook)
            hook = jumped.select("node", "up")
            hook._gridloom_path = jumped._gridloom_path
            if not moved:
                break
        if labels is None:
            roots = live.select(F.col("lo").alias("node")).distinct().join(hook, "node", "left_anti").select("node", F.col("node").alias("component"))
            fresh = materialize(hook.withColumnRenamed("up", "component").unionByName(roots), "cc-labels")
        else:
            step = hook.select(F.col("node").alias("component"), F.col("up").alias("top"))
            fresh = materialize(labels.join(step, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "cc-labels")
            discard(labels)
        labels = fresh
        hi = hook.select(F.col("node").alias("hi"), F.col("up").alias("hi2"))
        lo = hook.select(F.col("node").alias("lo"), F.col("up").alias("lo2"))
        ends = live.join(hi, "hi", "left").join(lo, "lo", "left").select(F.coalesce("hi2", "hi").alias("x"), F.coalesce("lo2", "lo").alias("y"))
        after = materialize(ends.where("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "cc-edges")
        discard(live)
        discard(hook)
        live = after
    if labels is None:
        return live.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return labels
