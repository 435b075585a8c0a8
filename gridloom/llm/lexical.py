"""Ranked lexical search by presence masks.

A first pass over the documents keeps, per document, its length and the counts of the terms that the items ask
for; the statistics of the corpus come from that table.  The second pass reads the table only.  Each block of
documents becomes a bitmap per term, and for an item the bits of its terms are laid side by side, so that every
document has a mask of matched terms and documents of one mask form a group.  The most a group can score is
the sum, over the terms of its mask, of the largest share of that term in the block.  Groups are evaluated from
the highest such sum down, with exact scores of their documents, until the item's k-th best score is above all that
is left; the k best go on from block to block of a task, so later blocks stop sooner.  A task returns k rows per
item at most, and a ranked window, which Spark cuts before its shuffle, merges them.

Items are taken in blocks of about ``ITEM_TERMS`` terms, each with two such passes, so what a task is sent is bounded
while their number is free; a single item beyond that is a block of its own.

Defined cases: terms are maximal runs of characters other than ASCII ones that are no letters or digits, with A to Z
lower-cased; null, empty and termless documents are no candidates and count nowhere; very long texts are read
whole; every row of the items is an item of its own; repeated documents are ranked as rows of their own; equal scores go
by ascending id, null ids last; items without terms or matches give no rows; empty tables give an empty
result; columns other than the named ones, whatever their names, are not read.  Scores are 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.staging import materialize, numbered

#: Term occurrences of the items of a block, and documents of a bitmap block.
ITEM_TERMS, DOCS = 200_000, 4096
_LAST = np.iinfo(np.int64).max

#: Separators become blanks and A to Z small letters; all other bytes stay (UTF-8 holds no ASCII byte inside a letter).
_FOLD = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _counts(docs: DataFrame, vocab: dict[bytes, int]) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of the documents that hold a term; only asked terms are listed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, ends, terms, tfs = [], [], [0], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if not (found := terms_of(text)):
                    continue
                held = Counter(filter(vocab.__contains__, found))
                ids.append(k)
                sizes.append(len(found))
                terms.extend([vocab[t] for t in held])
                tfs.extend(held.values())
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            cols = [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(work, "doc_id long, n long, terms array<int>, tfs array<long>")


class Best:
    """The k best (score, id) of an item so far, best first."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """What a document has to reach: the k-th best score, or 1."""
        return int(self.score[-1]) if len(self.score) >= self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = score >= self.least()
        score, ids, null = (np.concatenate([a, b[good]]) for a, b in ((self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.id, self.null = score[order], ids[order], null[order]


def masks_of(lists: list[np.ndarray], n: int) -> np.ndarray:
    """Per document, a mask with bit i where list i holds it; one column per 64 lists."""
    out = np.zeros((n, (len(lists) + 63) // 64), dtype=np.uint64)
    for i, docs in enumerate(lists):
        out[docs, i // 64] |= np.uint64(1 << (i % 64))
    return out


def search_block(lists: list[np.ndarray], shares: list[np.ndarray], ids: np.ndarray, null: np.ndarray, best: Best) -> int:
    """Add the block's documents that may be among the best of an item; the number of documents that were scored.

    ``lists[i]`` holds, in ascending order, the documents of the item's term i and ``shares[i]`` what it adds to the score of each.
    """
    tops = np.array([s.max() for s in shares], dtype=np.int64)
    masks = masks_of(lists, len(ids))
    groups, of = np.unique(masks[:, 0], return_inverse=True) if masks.shape[1] == 1 else np.unique(masks, axis=0, return_inverse=True)
    groups, of = groups.reshape(len(groups), -1), of.ravel()
    most = np.zeros(len(groups), dtype=np.int64)
    for i, top in enumerate(tops):
        most += np.where(groups[:, i // 64] >> np.uint64(i % 64) & np.uint64(1), top, 0)
    ranked = np.argsort(-most, kind="stable")
    members = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=len(groups)))
    at, scored, step = 0, 0, best.k
    while at < len(ranked) and most[ranked[at]] >= best.least():
        chosen: list[np.ndarray] = []
        size = 0
        while at < len(ranked) and size < step and most[ranked[at]] >= best.least():
            g = ranked[at]
            rows = members[(ends[g - 1] if g else 0) : ends[g]]
            chosen.append(rows)
            size += len(rows)
            at += 1
        docs = np.sort(np.concatenate(chosen))
        score = np.zeros(len(docs), dtype=np.int64)
        for held, share in zip(lists, shares, strict=True):
            place = np.minimum(np.searchsorted(held, docs), len(held) - 1)
            score += np.where(held[place] == docs, share[place], 0)
        best.add(score, ids[docs], null[docs])
        scored += len(docs)
        step *= 2
    return scored


def _block_search(counts: DataFrame, items: list[tuple[int, dict[int, int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``(item, doc_id, score)``: the k best documents of every task per item."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), DOCS):
                yield batch.slice(at, DOCS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: Best(k) for item, _ in items}
        for piece in pieces(batches):
            null = np.asarray(piece.column(0).is_null())
            ids = piece.column(0).fill_null(_LAST).to_numpy()
            per = piece.column(2).value_lengths().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(piece)), per)
            term, tf = piece.column(2).flatten().to_numpy(), piece.column(3).flatten().to_numpy()
            m = 100 - 75 + (75 * piece.column(1).to_numpy() * n_docs) // n_terms
            share = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
            order = np.argsort(term, kind="stable")  # documents stay ascending inside a term
            term, doc, share = term[order], doc[order], share[order]
            known, first = np.unique(term, return_index=True)
            lo, hi = dict(zip(known.tolist(), first.tolist(), strict=True)), dict(zip(known.tolist(), [*first[1:].tolist(), len(term)], strict=True))
            for item, asked in items:
                # Terms without weight add nothing to any score.
                here = [(slice(lo[t], hi[t]), times) for t, times in asked.items() if t in lo and weights[t] > 0]
                if here:
                    search_block([doc[s] for s, _ in here], [share[s] * times for s, times in here], ids, null, best[item])
        for item, b in best.items():
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(b.score), pa.int64()), pa.array(b.id, mask=b.null), pa.array(b.score)], names=["item", "doc_id", "score"])

    return counts.select("doc_id", "n", "terms", "tfs").mapInArrow(work, "item long, doc_id long, score long")


def _item_blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """``(item, item_id, text, block)`` and the number of blocks, by the lengths of the texts: about ITEM_TERMS terms each."""
    rows = numbered(items, "item")
    # A term takes two characters at least with its separator.
    n = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(n / 2 / ITEM_TERMS))
    return rows.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)) if blocks > 1 else F.lit(0).cast("long")), blocks


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k documents of the highest scores above 0 for every row of ``items``."""
    spark = docs.sparkSession
    pairs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked, blocks = _item_blocks(items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")))
    found = None
    for b in range(blocks):
        rows = [(r["item"], Counter(terms_of(r["text"]))) for r in asked.where(F.col("block") == b).select("item", "text").collect()]
        vocab = {t: i for i, t in enumerate(sorted({t for _, c in rows for t in c}))}
        if not vocab:
            continue
        counts = materialize(_counts(pairs, vocab), "term-counts")
        whole = counts.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = np.zeros(len(vocab), dtype=np.int64)
        for r in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():  # a row per term of the block
            df[r["term"]] = r["df"]
        n = whole["docs"]
        if not n:
            continue
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
        local = _block_search(counts, [(item, {vocab[t]: x for t, x in c.items()}) for item, c in rows], weights, n, whole["terms"], k)
        found = local if found is None else found.unionByName(local)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
