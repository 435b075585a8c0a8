"""Approximate nearest neighbours by cross-polytope hashing.

Each of ``tables`` hash functions is a chain of pseudo-rotations (three rounds of random signs and a fast Hadamard
transform each); a vector's bucket is its nearest signed axis after every rotation of the chain.  The chain is as
long as the number of vectors asks for (about three to a bucket; the last rotation may use part of the axes), so
a query looks at a share of the vectors that falls as they grow.  A query probes the buckets whose axes have the
largest sums of its rotated coordinates; the vectors found there are ranked by the exact inner product of the
original vectors.  A query that finds fewer than ``k`` vectors, or than there are, is compared with all of them.

Candidates are parted into ranges of length, each a factor ``STEP`` wide, in which the largest inner product
is the smallest angle or close to it; a query looks into every range.  Ranges of few vectors are scanned whole.

Buckets are joined in cells of bounded size, by the axis of the first rotation: a cell with many vectors is dealt
over several, and each returns at most ``k`` neighbours per query, so no group is unbounded and nothing is
capped.  ``recall_of`` compares a sample of queries with brute force over all rows.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part, as
queries or candidates; ties go to the smaller id; repeated ids and repeated vectors are distinct rows; with fewer
than k other vectors all are returned; an empty table gives an empty result; columns other than the two named
ones, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.staging import materialize
from gridloom.llm.vectors import block, usable

K = 20
TABLES = 16
#: Axes of a rotation that a query combines, and probes a table at MANY buckets; they grow with the power of them.
AXES, PROBES, MANY, POWER = 16, 110, 16_384, 0.45
#: Vectors of a cell, about; and queries of a cell.
CELL = 8192
#: Width of a range of lengths, and the range that is scanned whole.
STEP, WHOLE = 1.2, 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, width = x.shape
    half = 1
    while half < width:
        y = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


def chain_of(n: int, width: int) -> list[int]:
    """Axes (of 2 x that many signed ones) used after each rotation of a chain for ``n`` vectors."""
    chain, buckets = [width], 2 * width
    while 2 * buckets <= n / 3:
        axes = width
        while axes * 2 * buckets > n / 3 and axes > 1:
            axes //= 2
        chain.append(axes)
        buckets *= 2 * axes
    return chain


def probes_of(chain: list[int], probes: int) -> int:
    return max(1, round(probes * (np.prod([2.0 * d for d in chain]) / MANY) ** POWER))


def signs_of(tables: int, rotations: int, width: int, seed: int) -> np.ndarray:
    """Random signs: tables x rotations x 3 rounds x padded width."""
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, rotations, 3, width))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    for row in signs:
        x = hadamard(x * row)
    return x


def _signed(rotated: np.ndarray, axes: int) -> np.ndarray:
    return np.concatenate([rotated[:, :axes], -rotated[:, :axes]], axis=1)


def bucket_of(x: np.ndarray, signs: np.ndarray, chain: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(first axis, number made of the others) of each row's bucket."""
    first, rest = None, np.zeros(len(x), dtype=np.int64)
    for axes, rounds in zip(chain, signs, strict=False):
        x = rotate(x, rounds)
        near = _signed(x, axes).argmax(axis=1)
        first, rest = (near, rest) if first is None else (first, rest * (2 * axes) + near)
    return first, rest


def _best(scores: np.ndarray, count: int) -> np.ndarray:
    count = min(count, scores.shape[1])
    return np.argpartition(-scores, count - 1, axis=1)[:, :count]


def probed(x: np.ndarray, signs: np.ndarray, chain: list[int], probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(first axis, number of the others) of the buckets that each row probes: those of the largest coordinate sums."""
    first = rest = sums = None
    for axes, rounds in zip(chain, signs, strict=False):
        x = rotate(x, rounds)
        signed = _signed(x, axes)
        near = _best(signed, AXES if len(chain) > 1 else probes)
        value = np.take_along_axis(signed, near, axis=1)
        if first is None:
            first, rest, sums = near, np.zeros_like(near), value
            continue
        every = (sums[:, :, None] + value[:, None, :]).reshape(len(x), -1)
        pick = _best(every, probes)
        old, new = pick // near.shape[1], pick % near.shape[1]
        sums = np.take_along_axis(every, pick, axis=1)
        rest = np.take_along_axis(rest, old, axis=1) * (2 * axes) + np.take_along_axis(near, new, axis=1)
        first = np.take_along_axis(first, old, axis=1)
    return first, rest


def _unit(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    x = block(column)
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1)[:, None]
    return out


def _placed(rows: DataFrame, chains: dict[int, list[int]], signs: np.ndarray) -> DataFrame:
    """Candidates of every table, with ``bucket`` (first axis) and ``rest``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, bands = _unit(batch["embedding"], signs.shape[3]), batch["band"].to_numpy()
            for t, s in enumerate(signs):
                first, rest = np.zeros(len(unit), dtype=np.int32), np.zeros(len(unit), dtype=np.int64)
                for band in np.unique(bands):
                    at = np.flatnonzero(bands == band)
                    first[at], rest[at] = bucket_of(unit[at], s, chains[band])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), t, dtype=np.int32)), pa.array(first), pa.array(rest), *batch.columns], names=["tab", "bucket", "rest", *batch.schema.names])

    kinds = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
    return rows.mapInArrow(work, f"tab int, bucket int, rest long, {kinds}")


def _asking(rows: DataFrame, chains: list[list[int]], signs: np.ndarray, probes: int) -> DataFrame:
    """A row per query, chain, table and first axis probed, with the numbers ``rests`` probed there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                unit = _unit(part["embedding"], signs.shape[3])
                for number, chain in enumerate(chains):
                    for t, s in enumerate(signs):
                        first, rest = probed(unit, s, chain, probes_of(chain, probes))
                        at = np.repeat(np.arange(len(unit)), first.shape[1])
                        order = np.lexsort((first.ravel(), at))
                        at, first, rest = at[order], first.ravel()[order], rest.ravel()[order]
                        starts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (first[1:] != first[:-1])]))
                        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)).astype(np.int32)), pa.array(rest.astype(np.int64)))
                        taken = part.take(pa.array(at[starts]))
                        fixed = [pa.array(np.full(len(starts), v, dtype=np.int32)) for v in (t, number)]
                        yield pa.RecordBatch.from_arrays([fixed[0], pa.array(first[starts].astype(np.int32)), fixed[1], lists, *taken.columns], names=["tab", "bucket", "chain", "rests", *part.schema.names])

    kinds = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
    return rows.mapInArrow(work, f"tab int, bucket int, chain int, rests array<long>, {kinds}")


def _usable_rows(vectors: DataFrame) -> DataFrame:
    good = vectors.where(usable(F.col("embedding")))
    return good.withColumn("vec_id", F.col("vec_id").cast("long")).withColumn("row", F.monotonically_increasing_id())


def top_k(q_id: np.ndarray, q_row: np.ndarray, q: np.ndarray, x_id: np.ndarray, x_row: np.ndarray, x: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """Per block of queries: (query row, query id, candidate row, candidate id, score) of the k best."""
    out = []
    for i in range(0, len(q), 512):
        scores = q[i : i + 512] @ x.T
        scores[q_row[i : i + 512, None] == x_row[None, :]] = -np.inf
        m = min(k + 1, scores.shape[1])
        edge = np.partition(scores, scores.shape[1] - m, axis=1)[:, scores.shape[1] - m]
        a, b = np.nonzero((scores >= edge[:, None]) & np.isfinite(scores))
        # Exactly the k best, ties to the smaller id.
        order = np.lexsort((x_row[b], x_id[b], -scores[a, b], a))
        a, b = a[order], b[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        a, b = a[rank < k], b[rank < k]
        out.append((q_row[i + a], q_id[i + a], x_row[b], x_id[b], np.einsum("ij,ij->i", q[i + a], x[b])))
    return out


def top_k_of_pairs(q_id: np.ndarray, q_row: np.ndarray, q: np.ndarray, rests: pa.ChunkedArray, x_id: np.ndarray, x_row: np.ndarray, x: np.ndarray, rest: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """The same as :func:`top_k` over the candidates in the buckets that each query probes."""
    order = np.argsort(rest, kind="stable")
    lists = rests.combine_chunks()
    offsets = np.asarray(lists.offsets)
    wanted, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), np.diff(offsets))
    lo, hi = np.searchsorted(rest[order], wanted, side="left"), np.searchsorted(rest[order], wanted, side="right")
    some = hi > lo
    lo, size, owner = lo[some], (hi - lo)[some], owner[some]
    ends = np.cumsum(size)
    out, begin = [], 0
    while begin < len(size):
        # Whole queries, about two million pairs at once.
        stop = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + 2_000_000))
        stop = int(np.searchsorted(owner, owner[min(stop, len(owner) - 1)], side="right"))
        n = size[begin:stop]
        b = order[np.repeat(lo[begin:stop] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        a = np.repeat(owner[begin:stop], n)
        other = q_row[a] != x_row[b]
        a, b = a[other], b[other]
        score = np.concatenate([np.einsum("ij,ij->i", q[a[i : i + 50_000]], x[b[i : i + 50_000]]) for i in range(0, len(a), 50_000)] or [np.zeros(0)])
        best = np.lexsort((x_row[b], x_id[b], -score, a))
        a, b, score = a[best], b[best], score[best]
        keep = np.arange(len(a)) - np.searchsorted(a, a) < k
        out.append((q_row[a[keep]], q_id[a[keep]], x_row[b[keep]], x_id[b[keep]], score[keep]))
        begin = stop
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = K, tables: int = TABLES, probes: int = PROBES, seed: int = 3, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k candidates of largest inner product found per query."""
    rows = _usable_rows(vectors.select(is_query.alias("_asks"), F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding")))
    rows = materialize(rows.withColumn("norm", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))), "ann-rows")
    facts = rows.select(F.max(F.size("embedding")).alias("dim"), F.max("norm").alias("longest"), F.count(F.lit(1)).alias("n")).first()
    if facts["dim"] is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = 1 << max(0, (facts["dim"] - 1).bit_length())
    band = F.floor(F.log(F.lit(facts["longest"]) / F.col("norm")) / float(np.log(STEP)) + 1e-6).cast("int")
    rows = rows.withColumn("band", F.greatest(band, F.lit(0)))
    asked = rows.where("_asks").select("row", "vec_id", "embedding")
    rows = rows.select("row", "vec_id", "embedding", "band")
    # One row per range: some hundreds at most, as lengths are floats.
    sizes = {r["band"]: r["n"] for r in rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}
    chains = {b: chain_of(n, width) for b, n in sizes.items() if n > WHOLE}
    whole = rows.where(~F.col("band").isin(list(chains))).withColumn("band", F.lit(-1))
    whole_of = lambda t: t.select(F.lit(-1).alias("tab"), F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("rest"), "row", "vec_id", "embedding", F.lit(-1).alias("band"))
    ask_all = lambda t: t.select(F.lit(-1).alias("tab"), F.lit(0).alias("bucket"), F.lit(-1).alias("chain"), F.array(F.lit(0).cast("long")).alias("rests"), "row", "vec_id", "embedding")
    found, asks, kinds = whole_of(whole), ask_all(asked), [(-1, -1)]
    if chains:
        distinct = [list(c) for c in sorted({tuple(c) for c in chains.values()})]
        kinds += [(b, distinct.index(c)) for b, c in chains.items()]
        signs = signs_of(tables, max(map(len, distinct)), width, seed)
        found = found.unionByName(_placed(rows.where(F.col("band").isin(list(chains))), chains, signs))
        asks = asks.unionByName(_asking(asked, distinct, signs, probes))
    best = materialize(_ranked(_matched(asks, found, kinds, k), k), "ann-best")
    had = best.groupBy("query_row").agg(F.count(F.lit(1)).alias("had"))
    short = asked.join(had, F.col("row") == F.col("query_row"), "left").where(F.coalesce("had", F.lit(0)) < min(k, facts["n"] - 1)).select(*asked.columns)
    short = materialize(short, "ann-short")
    if not short.isEmpty():
        again = _ranked(_matched(ask_all(short), whole_of(rows), [(-1, -1)], k), k)
        best = best.join(short.select(F.col("row").alias("query_row")), "query_row", "left_anti").unionByName(again)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    hits = hits.groupBy("query_row", "query_id", "row", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _matched(asks: DataFrame, found: DataFrame, kinds: list[tuple[int, int]], k: int) -> DataFrame:
    """The k best of every cell for its queries; ``kinds`` pairs each range of lengths with its chain."""
    out = "query_row long, query_id long, row long, vec_id long, score double"
    chain = F.broadcast(asks.sparkSession.createDataFrame(kinds, "band int, chain int"))  # one row per range
    found = found.join(chain, "band")
    # Cells: at most ranges x tables x 2 x width first axes are counted; large ones are dealt over several cells.
    counts = materialize(found.groupBy("band", "chain", "tab", "bucket").agg(F.count(F.lit(1)).alias("nx")), "ann-counts")
    counts_q = materialize(asks.groupBy("chain", "tab", "bucket").agg(F.count(F.lit(1)).alias("nq")), "ann-counts-q")
    at = ["chain", "tab", "bucket"]
    grid = counts.join(counts_q, at).select("band", *at, F.ceil(F.col("nx") / CELL).cast("int").alias("cx"), F.ceil(F.col("nq") / CELL).cast("int").alias("cq"))
    grid = F.broadcast(grid)  # one row per first axis: ranges x tables x 2 x width at most
    found = found.join(grid, ["band", *at]).withColumn("i", F.pmod(F.xxhash64("row"), F.col("cx")).cast("int"))
    found = found.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("cq") - 1)))
    asks = asks.join(grid, at).withColumn("j", F.pmod(F.xxhash64("row"), F.col("cq")).cast("int"))
    asks = asks.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("cx") - 1)))
    cell = ["band", "tab", "bucket", "i", "j"]
    # Both sides come from one table: names of their own keep the cogroup's columns apart.
    asks = asks.select(*[F.col(c).alias(c) for c in (*cell, "rests", "row", "vec_id", "embedding")])
    found = found.select(*[F.col(c).alias(c) for c in (*cell, "rest", "row", "vec_id", "embedding")])

    def rank(q: pa.Table, x: pa.Table) -> pa.Table:
        names = ["query_row", "query_id", "row", "vec_id", "score"]
        empty = pa.table({n: pa.array([], pa.float64() if n == "score" else pa.int64()) for n in names})
        if not q.num_rows or not x.num_rows:
            return empty
        ints = lambda t, n: t[n].to_numpy()
        # A null id counts as the largest in ties.
        ids = lambda t: t["vec_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
        asking, having = (ids(q), ints(q, "row"), block(q["embedding"])), (ids(x), ints(x, "row"), block(x["embedding"]))
        parts = top_k(*asking, *having, k) if q["tab"][0].as_py() < 0 else top_k_of_pairs(*asking, q["rests"], *having, ints(x, "rest"), k)
        return pa.table({n: np.concatenate([p[i] for p in parts]) for i, n in enumerate(names)}) if parts else empty

    return asks.groupBy(*cell).cogroup(found.groupBy(*cell)).applyInArrow(rank, out)


def recall_of(result: DataFrame, vectors: DataFrame, is_query: Column, k: int = K, sample: int = 200, vec_id: str = "vec_id", embedding: str = "embedding") -> float:
    """Share of the true k nearest of ``sample`` queries (smallest id hashes) that ``result`` holds."""
    rows = _usable_rows(vectors.select(is_query.alias("_asks"), F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding")))
    rows = materialize(rows.select("row", "vec_id", "embedding", "_asks"), "ann-audited")
    asked = rows.where("_asks").orderBy(F.xxhash64("vec_id")).limit(sample).toPandas()
    if not len(asked):
        return 1.0
    q, ids, q_row = np.stack(asked["embedding"].map(np.asarray)), asked["vec_id"].to_numpy(), asked["row"].to_numpy()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.num_rows:
                for part in top_k(ids, q_row, q, batch["vec_id"].to_numpy(), batch["row"].to_numpy(), block(batch["embedding"]), k):
                    yield pa.RecordBatch.from_arrays([pa.array(part[1]), pa.array(part[3]), pa.array(part[4])], names=["query_id", "vec_id", "score"])

    truth = rows.mapInArrow(best, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    truth = truth.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    got = truth.join(result.select("query_id", "vec_id", F.lit(1).alias("hit")).distinct(), ["query_id", "vec_id"], "left")
    return float(got.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0])
