"""Packing documents into sequences by Karmarkar-Karp multiway differencing.

A document longer than a window gives whole windows first; its rest, cut into pieces of at most
``piece`` tokens, is packed with the rests of other documents.  Rests are dealt into groups of bounded size
by a hash of their place in the table.  In a group, every piece starts as a partial partition of ``k``
windows (itself and k - 1 empty ones).  The two partial partitions of the widest spread are merged, the
fullest windows of one with the emptiest of the other, until one partition is left.  Where its fullest
window exceeds the capacity, k rises and the differencing is run anew.

Defined cases: a null text is empty and gives one piece that holds the end id; repeated rows are packed
like any others; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.staging import materialize
from gridloom.llm.tokens import TOGETHER, encoder

WINDOW = 2048
PIECE = 512
#: Pieces of a group, about.
GROUP = 1536
PIECES = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def differencing(sizes: np.ndarray, k: int) -> list[np.ndarray]:
    """Karmarkar-Karp: indices of ``sizes`` in ``k`` windows of nearly equal sums.

    A partial partition keeps only its non-empty windows, in descending order of their sums; its spread is
    the fullest window less the emptiest (0 while a window is empty).  A window is a number: below n a
    single piece, from n on the union of two windows.
    """
    n = len(sizes)
    if k <= 1:
        return [np.arange(n)]
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {i: (sizes[i : i + 1].astype(np.int64), np.array([i])) for i in range(n)}
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    unions: list[tuple[np.ndarray, np.ndarray]] = []
    fresh, windows = n, n
    while len(heap) > 1:
        (_, i), (_, j) = heapq.heappop(heap), heapq.heappop(heap)
        (a, wa), (b, wb) = parts.pop(i), parts.pop(j)
        both = len(a) + len(b) - k
        if both <= 0:
            sums, wins = np.concatenate([a, b]), np.concatenate([wa, wb])
        else:
            # The last ``both`` windows of a (its emptiest) meet the last of b in reverse order.
            keep_a, keep_b = len(a) - both, len(b) - both
            sums = np.concatenate([a[:keep_a], b[:keep_b], a[keep_a:] + b[keep_b:][::-1]])
            wins = np.concatenate([wa[:keep_a], wb[:keep_b], np.arange(windows, windows + both)])
            unions.append((wa[keep_a:], wb[keep_b:][::-1]))
            windows += both
        order = np.argsort(-sums, kind="stable")
        sums, wins = sums[order], wins[order]
        parts[fresh] = (sums, wins)
        heapq.heappush(heap, (-int(sums[0] - (sums[-1] if len(sums) == k else 0)), fresh))
        fresh += 1
    # From the last unions back to the pieces, every piece learns its window.
    owner = np.full(windows, -1)
    last = parts[heap[0][1]][1]
    owner[last] = np.arange(len(last))
    top = windows
    for left, right in reversed(unions):
        at = owner[top - len(left) : top]
        owner[left], owner[right] = at, at
        top -= len(left)
    order = np.argsort(owner[:n], kind="stable")
    return np.split(order, np.searchsorted(owner[:n][order], np.arange(1, len(last))))


def windows_of(sizes: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """Partition into windows of at most ``window``; the count rises until the fullest one fits."""
    if not len(sizes):
        return []
    k = max(1, -(-int(sizes.sum()) // window))
    while True:
        wins = differencing(sizes, k)
        fullest = max(int(sizes[w].sum()) for w in wins)
        if fullest <= window:
            return wins
        k += max(1, k * (fullest - window) // (2 * window))


def cut_document(ids: bytes, window: int = WINDOW, piece: int = PIECE) -> list[tuple[int, int, int]]:
    """(start, length, crc) of a document's whole windows and of the pieces of its rest."""
    n, cuts, at = len(ids) // 4, [], 0
    while n - at >= window:
        cuts.append((at, window))
        at += window
    if n > at:
        parts = -(-(n - at) // piece)
        edges = [at + (n - at) * i // parts for i in range(parts + 1)]
        cuts += [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return [(a, m, zlib.crc32(ids[4 * a : 4 * (a + m)])) for a, m in cuts]


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 1, drops_space: bool = False, window: int = WINDOW, piece: int = PIECE, group: int = GROUP, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` per piece."""
    end = struct.pack("<I", end_id)
    schema = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, drops_space)
        for batch in (b.slice(k, TOGETHER) for b in batches for k in range(0, b.num_rows, TOGETHER)):
            out: list[tuple] = []
            row_no, doc_no, texts = (batch.column(i).to_pylist() for i in range(3))
            for row, d, ids in zip(row_no, doc_no, enc.encode_all(texts, end), strict=True):
                out += [(row, d, a, m, c, len(ids) // 4) for a, m, c in cut_document(ids, window, piece)]
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], schema=schema)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = materialize(rows.mapInArrow(cut, PIECES), "pack-pieces")
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("row", "start"), F.lit(groups)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "row", "start"], kind="stable").reset_index(drop=True)
        sizes = pdf["length"].to_numpy()
        whole, part = np.flatnonzero(sizes >= window), np.flatnonzero(sizes < window)
        seq, off = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
        seq[whole] = np.arange(len(whole))
        for n, win in enumerate(windows_of(sizes[part], window)):
            at = part[np.sort(win)]
            seq[at] = len(whole) + n
            off[at] = np.cumsum(sizes[at]) - sizes[at]
        pdf["sequence_id"] = int(pdf["grp"].iloc[0]) << 32 | seq
        pdf["offset"] = off
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("grp").applyInPandas(pack, out)
