"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors are compared within their label.  Equal vectors are one node with a multiplicity.  Every label is
clustered into shards of about ``SHARD`` nodes (centres fitted on a bounded sample); only a label that is no
larger than one shard is one.  Queries of that sample are compared with all nodes of the
label, and centres that part a pair within the range are merged into one shard until no such pair is parted:
a dense region, whatever its size, is one shard.  Every node joins its ``OVERLAP`` nearest shards; a
shard with many nodes is dealt over blocks so that each two of them meet, and cells of two blocks at most do
the work, so no task holds an unbounded group.  In every cell the nodes' candidate neighbours are thinned by robust pruning; the
adjacency lists of all cells are united per node; then each node searches the united graph of its cell: a
greedy beam search from the cell's medoid (and the node itself), widened to every node within the range
until no unexpanded node in range is left (a node with so many in range that their lists exceed the cell
reads the whole cell instead).  All links are verified by the exact cosine.

A pair that several cells see is counted in one of them only (the smallest shard that both are in), so link
counts need no table of pairs: a cell returns counts and a spanning forest.

``audit_links`` measures recall against brute force.  Defined cases: vectors that are null, empty, zero or
hold a null or non-finite component, and rows without a label, link with nothing and are their own
component; repeated rows link with each other; a cosine that equals the range links; an empty table gives an
empty result; columns other than the three named ones, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.staging import materialize
from gridloom.llm.vectors import block, usable
from gridloom.operators.graph import connected_components

RANGE = 0.93
#: A shard up to twice this size is one cell; a larger one is dealt over blocks of it, two to a cell.
BLOCK = 4096
#: Nodes of a shard, about.
SHARD = 512
#: Nearest clusters that a node joins, the most vectors per label that centres are fitted on, and the fewest of
#: these for a centre: beyond SHARD * SAMPLE / (OVERLAP * FEWEST) nodes of one label, shards grow with it.
OVERLAP, SAMPLE, FEWEST = 3, 20_000, 4
#: Nodes of a large label's sample whose pairs the merging of its centres goes by.
AUDITED = 2_000
CANDIDATES, DEGREE, ALPHA, BEAM, FAR = 40, 20, 1.2, 24, 8
SALTS = 32


def centres_of(sample: np.ndarray, k: int, rounds: int = 4, seed: int = 1) -> np.ndarray:
    """Spherical k-means on a sample of unit vectors."""
    c = sample[np.random.default_rng(seed).permutation(len(sample))[:k]]
    for _ in range(rounds):
        near = (sample @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1)
        c = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-12)[:, None], c)
    return c


def robust_prune(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Adjacency lists (padded with -1): of near and some far candidates, those no kept one dominates.

    A candidate v of node p is dropped once a kept candidate c has ALPHA * dist(c, v) <= dist(p, v).
    """
    n = len(x)
    out = np.full((n, DEGREE), -1, dtype=np.int64)
    if n < 2:
        return out
    near = min(CANDIDATES, n - 1)
    for i in range(0, n, 256):
        p = np.arange(i, min(n, i + 256))
        sims = x[p] @ x.T
        sims[np.arange(len(p)), p] = -np.inf
        cand = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        cand = np.concatenate([cand, rng.integers(0, n, size=(len(p), FAR))], axis=1)
        far_self = cand == p[:, None]
        dist = np.sqrt(np.maximum(0.0, 2 - 2 * np.take_along_axis(sims, cand, axis=1)))
        dist[far_self] = np.inf
        order = np.argsort(dist, axis=1)
        cand, dist = np.take_along_axis(cand, order, axis=1), np.take_along_axis(dist, order, axis=1)
        between = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("pid,pjd->pij", x[cand], x[cand])))
        alive = np.isfinite(dist)
        rows = np.arange(len(p))
        for slot in range(DEGREE):
            first = alive.argmax(axis=1)
            has = alive[rows, first]
            if not has.any():
                break
            out[p[has], slot] = cand[has, first[has]]
            alive &= ~((ALPHA * between[rows, first] <= dist) & has[:, None])
            alive[rows, first] = False
    return out


def range_search(x: np.ndarray, adjacency: np.ndarray, reach: float) -> np.ndarray:
    """hit[q, v]: node v found within the range of node q, by search from the medoid and from q itself."""
    n = len(x)
    hit = np.zeros((n, n), dtype=bool)
    medoid = int((x @ x.mean(axis=0)).argmax())
    safe = np.where(adjacency < 0, 0, adjacency)
    for i in range(0, n, 256):
        q = np.arange(i, min(n, i + 256))
        m, rows = len(q), np.arange(len(q))
        seen = np.zeros((m, n), dtype=bool)
        done = np.zeros((m, n), dtype=bool)
        seen[:, medoid] = True
        seen[rows, q] = True
        beam = np.stack([np.full(m, medoid), q], axis=1)
        sims = np.stack([x[q] @ x[medoid], np.ones(m)], axis=1)
        sims[q == medoid, 0] = -np.inf
        for _ in range(4 * BEAM):  # greedy: expand the best node of each beam that is not expanded
            open_sims = np.where(done[rows[:, None], beam], -np.inf, sims)
            best = open_sims.argmax(axis=1)
            go = np.isfinite(open_sims[rows, best])
            if not go.any():
                break
            node = beam[rows, best]
            done[rows[go], node[go]] = True
            nbr = safe[node]
            fresh = (adjacency[node] >= 0) & go[:, None] & ~seen[rows[:, None], nbr]
            seen[np.repeat(rows, nbr.shape[1])[fresh.ravel()], nbr[fresh]] = True
            got = np.where(fresh, np.einsum("qd,qrd->qr", x[q], x[nbr]), -np.inf)
            beam, sims = np.concatenate([beam, nbr], axis=1), np.concatenate([sims, got], axis=1)
            if beam.shape[1] > BEAM:
                top = np.argpartition(-sims, BEAM - 1, axis=1)[:, :BEAM]
                beam, sims = np.take_along_axis(beam, top, axis=1), np.take_along_axis(sims, top, axis=1)
        inside = (sims >= reach) & np.isfinite(sims)
        here = np.zeros((m, n), dtype=bool)
        here[np.nonzero(inside)[0], beam[inside]] = True
        front = here & ~(done & here)
        front |= here  # nodes in range are expanded anew: their neighbours may have left the beam
        tried = np.zeros((m, n), dtype=bool)
        while True:  # widen: every node in range is expanded once
            # Reading the lists of so many nodes costs more than all nodes of the cell, which is exact.
            dense = np.flatnonzero((here.sum(axis=1) * safe.shape[1] > n) & (front & ~tried).any(axis=1))
            if len(dense):
                here[dense] = x[q[dense]] @ x.T >= reach
                front[dense] = False
            a, v = np.nonzero(front & ~tried)
            if not len(a):
                break
            a, v = a[:50_000], v[:50_000]
            tried[a, v] = True
            w, ok = safe[v], adjacency[v] >= 0
            b = np.repeat(a, w.shape[1])[ok.ravel()]
            w = w[ok]
            pair = np.unique(b * n + w)
            b, w = pair // n, pair % n
            new = ~here[b, w]
            b, w = b[new], w[new]
            near = np.einsum("id,id->i", x[q[b]], x[w]) >= reach
            here[b[near], w[near]] = True
            front[b[near], w[near]] = True
        here[rows, q] = False
        hit[q] = here
    return hit | hit.T


def _forest(hit: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each node."""
    label = np.full(len(hit), -1, dtype=np.int64)
    for root in range(len(hit)):
        if label[root] >= 0:
            continue
        label[root], front = root, np.array([root])
        while len(front):
            reached = np.zeros(len(hit), dtype=bool)
            for k in range(0, len(front), 1024):
                reached |= hit[front[k : k + 1024]].any(axis=0)
            front = np.flatnonzero(reached & (label < 0))
            label[front] = root
    return label


def _owned(hit: np.ndarray, blk: np.ndarray, shards: list[list[int]], shard: int, i: int, j: int) -> None:
    """Leave only the pairs that this cell owns: its shard is the smallest of both, its blocks are theirs."""
    if i != j:
        for one in (i, j):
            at = np.flatnonzero(blk == one)
            hit[np.ix_(at, at)] = False
    members: dict[int, list[int]] = {}
    for k, row in enumerate(shards):
        for other in row:
            if other < shard:
                members.setdefault(other, []).append(k)
    for at in members.values():
        hit[np.ix_(at, at)] = False


def nearest_shards(x: np.ndarray, centres: np.ndarray, merged: np.ndarray) -> np.ndarray:
    """The OVERLAP nearest shards of each row, ascending; a shard is as near as its nearest centre."""
    order = np.argsort(merged, kind="stable")
    names, starts = np.unique(merged[order], return_index=True)
    sims = np.maximum.reduceat((x @ centres.T)[:, order], starts, axis=1)
    if len(names) <= OVERLAP:
        return np.tile(names, (len(x), 1))
    return np.sort(names[np.argpartition(-sims, OVERLAP - 1, axis=1)[:, :OVERLAP]], axis=1)


def _parted(x: np.ndarray, asked: np.ndarray, centres: np.ndarray, merged: np.ndarray, reach: float) -> np.ndarray:
    """Pairs of shards (nearest to either end) of pairs within the range that share no shard."""
    mine, theirs = nearest_shards(x, centres, merged), nearest_shards(asked, centres, merged)
    near, near_q = merged[(x @ centres.T).argmax(axis=1)], merged[(asked @ centres.T).argmax(axis=1)]
    out = [np.zeros((0, 2), dtype=np.int64)]
    for k in range(0, len(asked), 256):
        a, b = np.nonzero((asked[k : k + 256] @ x.T >= reach) & (near_q[k : k + 256, None] != near[None, :]))
        apart = ~(theirs[k + a][:, :, None] == mine[b][:, None, :]).any(axis=(1, 2))
        out.append(np.unique(np.stack([near_q[k + a[apart]], near[b[apart]]], axis=1), axis=0))
    return np.unique(np.concatenate(out), axis=0)


def _merged(nodes: DataFrame, centres: dict[int, np.ndarray], asked: dict[int, np.ndarray], reach: float) -> dict[int, np.ndarray]:
    """The shard of every centre: centres merged until no audited pair within the range is parted."""
    merged = {label: np.arange(len(c)) for label, c in centres.items()}
    left = set(centres)
    while left:
        sent = nodes.sparkSession.sparkContext.broadcast({label: (centres[label], asked[label], merged[label]) for label in left})

        def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for label, (c, q, m) in sent.value.items():
                    part = batch.filter(pa.array(batch["label"].to_numpy() == label))
                    for k in range(0, part.num_rows, 4096):
                        x = block(part["embedding"].slice(k, 4096))
                        pairs = _parted(x / np.linalg.norm(x, axis=1)[:, None], q, c, m, reach)
                        if len(pairs):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), label, dtype=np.int32)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["label", "a", "b"])

        found = nodes.select("label", "embedding").mapInArrow(audit, "label int, a long, b long").distinct().collect()  # pairs of shards
        for r in found:
            m = merged[r["label"]]
            a, b = m[r["a"]], m[r["b"]]
            m[m == max(a, b)] = min(a, b)
        left = {r["label"] for r in found}
    return merged


def _cells(nodes: DataFrame, reach: float) -> DataFrame:
    """Nodes dealt to cells, with ``shards`` (all shards of the node) and ``blk`` (its block in this one)."""
    spark = nodes.sparkSession
    sizes = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD).collect()  # one row per label
    centres: dict[int, np.ndarray] = {}
    asked: dict[int, np.ndarray] = {}
    for r in sizes:
        share = min(1.0, SAMPLE / r["n"])
        got = nodes.where((F.col("label") == r["label"]) & (F.pmod(F.col("node"), F.lit(1_000_000)) < int(1_000_000 * share))).select("embedding").limit(2 * SAMPLE).toPandas()
        x = np.stack(got["embedding"].map(lambda v: np.asarray(v, dtype=np.float64)))
        x /= np.linalg.norm(x, axis=1)[:, None]
        asked[r["label"]] = x[np.random.default_rng(7).permutation(len(x))[:AUDITED]]
        centres[r["label"]] = centres_of(x, min(max(OVERLAP + 1, len(x) // FEWEST), max(OVERLAP + 1, -(-r["n"] * OVERLAP // SHARD))))
    merged = _merged(nodes, centres, asked, reach)
    sent = spark.sparkContext.broadcast({label: (c, merged[label]) for label, c in centres.items()})  # SAMPLE / FEWEST centres per label at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, labels = block(batch["embedding"]), batch["label"].to_numpy()
            shards: list[np.ndarray] = [np.zeros(1, dtype=np.int32)] * len(x)
            for label, (c, m) in sent.value.items():
                at = np.flatnonzero(labels == label)
                if len(at):
                    for k, row in zip(at, nearest_shards(x[at], c, m), strict=True):
                        shards[k] = row.astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards, pa.list_(pa.int32()))], names=[*batch.schema.names, "shards"])

    kinds = ", ".join(f"{c} {k}" for c, k in nodes.dtypes)
    placed = materialize(nodes.mapInArrow(assign, f"{kinds}, shards array<int>"), "vg-placed").withColumn("shard", F.explode("shards"))
    blocks = placed.groupBy("label", "shard").agg(F.when(F.count(F.lit(1)) <= 2 * BLOCK, 1).otherwise(F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int").alias("blocks"))
    placed = placed.join(materialize(blocks, "vg-blocks"), ["label", "shard"]).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Block b takes part in the cells (b, j >= b) and (i < b, b).
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.withColumn("i", F.least("blk", "o")).withColumn("j", F.greatest("blk", "o")).drop("o", "blocks")


def near_vectors(vectors: DataFrame, reach: float = RANGE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).cast("int").alias("label"))
    good = usable(F.col("embedding")) & F.col("label").isNotNull()
    rows = rows.withColumn("node", F.when(good, F.xxhash64("label", "embedding")))
    groups = rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    nodes = materialize(groups, "vg-nodes")
    cells = materialize(_cells(nodes.select("node", "copies", "label", "embedding"), reach), "vg-cells")
    keys = ["label", "shard", "i", "j"]

    def graph(t: pa.Table) -> pa.Table:
        x, ids = block(t["embedding"]), t["node"].to_numpy()
        x = x / np.linalg.norm(x, axis=1)[:, None]
        near = robust_prune(x, np.random.default_rng(11))
        lists = [ids[r[r >= 0]] for r in near]
        return pa.table({"node": pa.array(ids), "near": pa.array(lists, pa.list_(pa.int64()))})

    # Each node's lists of all its cells, united.
    united = cells.groupBy(*keys).applyInArrow(graph, "node long, near array<long>")
    united = materialize(united.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "vg-graph")

    def search(t: pa.Table) -> pa.Table:
        x, ids = block(t["embedding"]), t["node"].to_numpy()
        x = x / np.linalg.norm(x, axis=1)[:, None]
        by_id = np.argsort(ids)
        near = t["near"].to_pylist()
        width = max(1, max(map(len, near)))
        adjacency = np.full((len(ids), width), -1, dtype=np.int64)
        for k, row in enumerate(near):
            at = np.searchsorted(ids, np.asarray(row, dtype=np.int64), sorter=by_id)
            at = by_id[np.minimum(at, len(ids) - 1)]
            at = at[ids[at] == np.asarray(row, dtype=np.int64)]
            adjacency[k, : len(at)] = at
        hit = range_search(x, adjacency, reach)
        shard, i, j = (t[c][0].as_py() for c in ("shard", "i", "j"))
        _owned(hit, t["blk"].to_numpy(), t["shards"].to_pylist(), shard, i, j)
        copies = t["copies"].to_numpy().astype(np.float64)
        counts = np.concatenate([hit[k : k + 512] @ copies for k in range(0, len(ids), 512)]).astype(np.int64)
        some = np.flatnonzero(counts)
        return pa.table({"node": pa.array(ids[some]), "part": pa.array(counts[some]), "root": pa.array(ids[_forest(hit)][some])})

    found = cells.join(united, "node").groupBy(*keys).applyInArrow(search, "node long, part long, root long")
    found = materialize(found, "vg-found")
    links = found.groupBy("node").agg(F.sum("part").alias("others"))
    comp = connected_components(found, "node", "root")
    named = nodes.select("node", "least", "copies").join(links, "node", "left").join(comp, "node", "left")
    # Single vectors without a link need no lookup.
    named = named.where("copies > 1 or component is not null")
    named = materialize(named.select("node", "least", "copies", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("component", "node").alias("c")), "vg-named")
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    lookup = named.join(least, "c").select("node", "copies", "others", "component_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lookup = materialize(lookup, "vg-lookup")
    out = rows.select("vec_id", "node", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt")).join(lookup, ["node", "salt"], "left")
    n_links = F.coalesce(F.col("copies") - 1 + F.col("others"), F.lit(0)).cast("long")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def audit_links(result: DataFrame, vectors: DataFrame, reach: float = RANGE, sample: int = 500) -> float:
    """Share of the true links of a sample of vectors (smallest id hashes) that ``result`` counts."""
    rows = vectors.where(usable(F.col("embedding")) & F.col("label").isNotNull()).select("vec_id", "embedding", "label")
    asked = rows.orderBy(F.xxhash64("vec_id")).limit(sample).toPandas()
    q = np.stack(asked["embedding"].map(lambda v: np.asarray(v, dtype=np.float64)))
    q, ids, labels = q / np.linalg.norm(q, axis=1)[:, None], asked["vec_id"].to_numpy(), asked["label"].to_numpy()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.num_rows:
                x = block(batch.column(1))
                near = (q @ (x / np.linalg.norm(x, axis=1)[:, None]).T >= reach) & (labels[:, None] == batch.column(2).to_numpy()[None, :]) & (ids[:, None] != batch.column(0).to_numpy()[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near.sum(axis=1).astype(np.int64))], names=["vec_id", "true_links"])

    truth = rows.mapInArrow(count, "vec_id long, true_links long").groupBy("vec_id").agg(F.sum("true_links").alias("true_links"))
    both = truth.join(result.select("vec_id", "n_links"), "vec_id").agg(F.sum(F.least("true_links", "n_links")).alias("got"), F.sum("true_links").alias("all")).first()
    return 1.0 if not both["all"] else both["got"] / both["all"]
