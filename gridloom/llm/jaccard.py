"""N-gram Jaccard join by vertical partitioning.

A document's set holds the 64-bit hashes of its distinct word n-grams; the hash order is the global n-gram
order.  The order is cut into fragments, and two sets are compared fragment by fragment.

Candidates.  Two sets with Jaccard >= t and sizes a, b differ in at most D = (1-t)/(1+t) (a+b) n-grams.  If
the order is cut into more than D fragments, at least one fragment is untouched, that is, equal in both
sets.  Sizes fall into classes whose bounds grow by 3/2, so partners are in the same or in adjacent
classes; each class has its own number of fragments, and a set emits one key per non-empty fragment for its
own class and, if it can have partners there, for the next.  Equal empty fragments say nothing, so a set
with too many empty ones is cut anew under another hash seed (and at last emits its empty fragments too).
No pair is lost.  There are a quarter more fragments than that, so of m non-empty ones at least m - D are
untouched, and a set can do without the m - D - 1 of its keys that most sets hold: every set orders keys alike, so
both sets of a pair keep the rarest key that they share.  A line that many texts hold therefore makes no candidates
of texts that share little else.  Keys are dealt once, those that more than one set holds are kept with their
frequency, and what is left of them is reduced to the leader of each.

Sketches.  A set carries the parities of its hashes over two to four bits per n-gram.  The parities of two
sets differ in at most as many bits as the sets in n-grams, so a pair whose parities differ in more than D
bits is refused before any set is read.  No link is lost by that either.

Verification.  For the pairs left, the partial overlaps of the fragments are counted separately and summed
per pair.

Groups.  Equal sets are one node.  Within the sets that share a key, each is compared with one leader, not
with each other, and the links are contracted to components.  Where some sets of a leader are in other
components than the leader, the parities tell which of them may link across components; only those are
compared by their differences from the leader: for sets A, B and a leader L,
A xor B = (A xor L) xor (B xor L), and these differences are short for near copies.  Both steps work in
cells of bounded blocks, which return members or a spanning forest of the links, never the pairs.  So no
pair is written out for a group, and no link that joins two components is lost.

Defined cases: a null or wordless text has the empty set and links with nothing; fewer words than n give the
whole sequence as one shingle; very long texts are one set like others; repeated rows have equal sets and one
component; ties do not arise (the leader of a key is its smallest set hash); an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.staging import discard, materialize, numbered
from gridloom.llm.caches import hold
from gridloom.operators.graph import connected_components

#: Cuts of the global order for counting overlaps.
OVERLAP_CUTS = 8
#: Hash seeds tried for sets with empty fragments.
SEEDS = 4
#: Sets of a block that are compared, and of one whose parities are; a cell holds two at most.
BLOCK, WIDE = 1024, 512
#: Parity bits worked on at once in a cell.
STRIPE = 4096
SALTS = 32
#: One fragment more for so many that may differ: with fewer, many sets have too many empty ones and are cut anew.
SPARE = 4
#: Bits of a key; keys that meet by chance cost a comparison of sketches.
KEY = np.uint64((1 << 48) - 1)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        x = x + _M1
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
        return x ^ (x >> np.uint64(31))


#: Words that a Python worker remembers the hash of, and texts of one batch that it returns.
CACHED_WORDS, TEXTS = 150_000, 500


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most TEXTS rows."""
    for batch in batches:
        for k in range(0, batch.num_rows, TEXTS):
            yield batch.slice(k, TEXTS)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHED_WORDS:
            self[word] = got
        return got


_HASHES = _WordHashes()


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text, A-Z lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hold(_HASHES)
    ids = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    m = max(1, len(ids) - n + 1)
    out = np.full(m, len(ids) if len(ids) < n else n, dtype=np.uint64)
    for k in range(min(n, len(ids))):
        out = mix64(out ^ ids[k : k + m])
    return np.unique(out)


def size_classes(limit: int, t: tuple[int, int]) -> list[tuple[int, int]]:
    """(first size, last size) of the classes up to ``limit``; ``t`` is the threshold as a fraction."""
    p, q = t
    up, down = (3, 2) if 3 * p >= 2 * q else (q, p)
    out, first = [], 1
    while first <= limit:
        last = first * up // down
        out.append((first, last))
        first = last + 1
    return out


def parities(hashes: np.ndarray) -> np.ndarray:
    """Parity of the hashes that end in each bit pattern, as 64-bit words.

    The width is a power of two; the sketch of half the width is the exclusive or of its halves.
    """
    width = 64
    while width < 2 * len(hashes):
        width *= 2
    count = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").view(np.int64)


def fragments_of(last: int, t: tuple[int, int]) -> tuple[int, int]:
    """(largest difference D, number of fragments) of the class that ends at ``last``."""
    p, q = t
    most = 2 * last * (q - p) // (q + p)
    return most, most + 1 + (0 if most < 3 else 1 + most // SPARE)


def fragment_keys(hashes: np.ndarray, level: int, last: int, t: tuple[int, int]) -> list[np.ndarray]:
    """Keys of the non-empty fragments of a set at a class."""
    most, k = fragments_of(last, t)
    if most == 0:  # only equal sets can link
        return []
    out = []
    for seed in range(SEEDS):
        order = hashes if seed == 0 else np.sort(mix64(hashes ^ np.uint64(seed * 7919)))
        frag = ((order >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], frag[1:] != frag[:-1]]))
        content = np.add.reduceat(mix64(order), starts)
        with np.errstate(over="ignore"):
            place = mix64(frag[starts] + np.uint64(level << 40) + np.uint64(seed << 56))
            out.append(mix64(content ^ place))
        if len(starts) > most:
            return out
    empty = np.setdiff1d(np.arange(k, dtype=np.uint64), frag)
    out.append(mix64(mix64(empty + np.uint64(level << 40)) + np.uint64(0xE)))
    return out


def keys_and_spare(hashes: np.ndarray, level: int, last: int, t: tuple[int, int]) -> tuple[np.ndarray, int]:
    """Keys of a set at a class, and how many of them, the most frequent ones, it can do without."""
    parts = fragment_keys(hashes, level, last, t)
    if not parts:
        return np.zeros(0, dtype=np.int64), 0
    keys = np.unique(np.concatenate(parts) & KEY).view(np.int64)
    return keys, len(keys) - fragments_of(last, t)[0] - 1 if len(parts) == 1 else 0


def _sets(rows: DataFrame, n: int, t: tuple[int, int]) -> DataFrame:
    """``(doc_id, row, n, sig, keys, spare, up_keys, up_spare, sketch)``, ``up`` for the next class.

    Within a task, only the first of equal sets carries its keys.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int32()), ("sig", pa.int64()), ("keys", pa.list_(pa.int64())), ("spare", pa.int32()), ("up_keys", pa.list_(pa.int64())), ("up_spare", pa.int32()), ("sketch", pa.list_(pa.int64()))])
    p, q = t
    bounds = size_classes(1 << 40, t)
    firsts = np.array([a for a, _ in bounds])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _slices(batches):
            sizes, sigs, own, up, sketches = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                hashes = shingle_set(text, n)
                sig = xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)
                sizes.append(len(hashes))
                sigs.append(sig)
                if len(hashes) == 0 or sig in seen:
                    own.append((None, None))
                    up.append((None, None))
                    sketches.append(None)
                    continue
                seen.add(sig)
                level = int(np.searchsorted(firsts, len(hashes), side="right")) - 1
                own.append(keys_and_spare(hashes, level, bounds[level][1], t))
                reaches = len(hashes) * q >= p * bounds[level + 1][0]
                up.append(keys_and_spare(hashes, level + 1, bounds[level + 1][1], t) if reaches else (None, None))
                sketches.append(parities(hashes))
            dealt = [x for side in (own, up) for x in (pa.array([k for k, _ in side], pa.list_(pa.int64())), pa.array([m for _, m in side], pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(sigs, pa.int64()), *dealt, pa.array(sketches, pa.list_(pa.int64()))], schema=schema)

    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "row", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(work, "doc_id long, row long, n int, sig long, keys array<long>, spare int, up_keys array<long>, up_spare int, sketch array<long>")


def _stars(whole: DataFrame) -> DataFrame:
    """``(a, b, nb)``: the leader of every key that sets keep, with the other sets that keep it.

    All keys are dealt once; a set has hundreds of them, so one that a third of all sets hold is no large part.
    """
    own = whole.select(F.explode("keys").alias("key"), "sig", "n", "spare", F.lit(False).alias("up"))
    up = whole.select(F.explode("up_keys").alias("key"), "sig", "n", F.col("up_spare").alias("spare"), F.lit(True).alias("up"))
    key = Window.partitionBy("key")
    shared = own.unionByName(up).repartition("key").withColumns({"many": F.count(F.lit(1)).over(key), "least": F.min("sig").over(key), "most": F.max("sig").over(key)})
    shared = materialize(shared.where("least <> most").drop("least", "most"), "jaccard-shared")
    # Equal sets of other tasks have the same keys and so the same ranks.
    by_set = Window.partitionBy("sig", "up").orderBy(F.desc("many"), "key")
    kept = shared.withColumn("at", F.dense_rank().over(by_set)).where("at > spare").select("key", "sig", "n")
    kept = materialize(kept, "jaccard-kept")
    leaders = kept.groupBy("key").agg(F.min("sig").alias("a"), F.max("sig").alias("tail")).where("a <> tail").select("key", "a")
    stars = materialize(kept.join(leaders, "key").where("sig <> a").select("a", F.col("sig").alias("b"), F.col("n").alias("nb")).distinct(), "jaccard-stars")
    discard(shared, kept)
    return stars


def _parts(texts: DataFrame, n: int) -> DataFrame:
    """``(sig, cut, hashes)``: the sets of the given ``(sig, text)`` rows, cut along the global order."""
    schema = pa.schema([("sig", pa.int64()), ("cut", pa.int32()), ("hashes", pa.list_(pa.int64()))])
    edges = np.array([(i << 64) // OVERLAP_CUTS for i in range(1, OVERLAP_CUTS)], dtype=np.uint64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sigs, cuts, hashes = [], [], []
            for sig, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = shingle_set(text, n)
                if xxhash.xxh3_64_intdigest(whole.tobytes()) - (1 << 63) != sig:
                    raise ValueError("rows changed places between two reads; give a table, not a plan")
                for cut, part in enumerate(np.split(whole, np.searchsorted(whole, edges))):
                    sigs.append(sig)
                    cuts.append(cut)
                    hashes.append(part.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(cuts, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))], schema=schema)

    return texts.select("sig", F.col("text").cast("binary").alias("text")).mapInArrow(work, "sig long, cut int, hashes array<long>")


def _paired(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs ``(a, b, ...)`` with the fragments ``ha`` and ``hb`` of both sets, a row per cut."""
    left = parts.select(F.col("sig").alias("a"), "cut", F.col("hashes").alias("ha"))
    right = parts.select(F.col("sig").alias("b"), "cut", F.col("hashes").alias("hb"))
    return pairs.join(right, "b").join(left, ["a", "cut"])


def _verified(pairs: DataFrame, parts: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Of ``(a, b, na, nb)``, the pairs that link: partial overlaps per fragment, summed per pair."""
    p, q = t
    both = _paired(pairs, parts).select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("part"))
    sums = both.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("common"))
    return sums.where(F.col("common") * q >= p * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def common_counts(rows: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections of sorted sets."""
    m = len(rows)
    out = np.zeros((m, m), dtype=np.float32)
    owner = np.repeat(np.arange(m), [len(r) for r in rows])
    values = np.concatenate(rows) if m else np.zeros(0, dtype=np.int64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.concatenate([starts, [len(values)]]))
    for size in range(2, 17):  # rare values: their pairs one by one
        at = starts[counts == size]
        if len(at):
            members = owner[at[:, None] + np.arange(size)[None, :]]
            for x in range(size):
                for y in range(size):
                    np.add.at(out, (members[:, x], members[:, y]), 1)
    often = np.flatnonzero(counts > 16)  # common values: as columns of a matrix
    for i in range(0, len(often), 2048):
        dense = np.zeros((m, min(2048, len(often) - i)), dtype=np.float32)
        for col, k in enumerate(often[i : i + 2048]):
            dense[owner[starts[k] : starts[k] + counts[k]], col] = 1
        out += dense @ dense.T
    return out.astype(np.int64)


def _differing_bits(x: Column, y: Column) -> Column:
    """Bits in which two sketches differ, at the smaller width (widths differ by a factor of two at most)."""
    half = lambda s: F.zip_with(F.slice(s, F.lit(1), (F.size(s) / 2).cast("int")), F.slice(s, (F.size(s) / 2 + 1).cast("int"), (F.size(s) / 2).cast("int")), lambda u, v: u.bitwiseXOR(v))
    x, y = F.when(F.size(x) > F.size(y), half(x)).otherwise(x), F.when(F.size(y) > F.size(x), half(y)).otherwise(y)
    return F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda total, k: total + k)


def _not_refused(stars: DataFrame, sketches: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Of the pairs ``(a, b)``, those whose sizes and sketches allow a link, with the sizes."""
    p, q = t
    fits = F.least("na", "nb") * q >= F.greatest("na", "nb") * p
    left, right = (sketches.select(F.col("sig").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
    both = stars.select("a", "b").join(right, "b").join(left, "a").where(fits)
    return both.where(_differing_bits(F.col("sa"), F.col("sb")) * (p + q) <= (q - p) * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb")


def may_link(sketches: list[np.ndarray], n: np.ndarray, comp: np.ndarray, out: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """Mask of the sets that may link with one of another component; one of the two is in ``out``."""
    p, q = t
    words = min(len(s) for s in sketches)
    while any(len(s) > words for s in sketches):
        sketches = [s if len(s) == words else s[: len(s) // 2] ^ s[len(s) // 2 :] for s in sketches]
    packed = np.stack(sketches).view(np.uint8)
    asked = np.flatnonzero(out)
    apart = np.zeros((len(asked), len(n)), dtype=np.float32)
    for k in range(0, packed.shape[1], STRIPE // 8):
        signs = np.unpackbits(packed[:, k : k + STRIPE // 8], axis=1).astype(np.float32) * 2 - 1
        apart += (signs.shape[1] - signs[asked] @ signs.T) / 2
    total = n[asked][:, None] + n[None, :]
    small, large = np.minimum(n[asked][:, None], n[None, :]), np.maximum(n[asked][:, None], n[None, :])
    hit = (apart * (p + q) <= (q - p) * total + 0.5) & (small * q >= large * p) & (comp[asked][:, None] != comp[None, :])
    found = hit.any(axis=0)
    found[asked] |= hit.any(axis=1)
    return found


def _open_members(stars: DataFrame, links: DataFrame, sketches: DataFrame, t: tuple[int, int]) -> DataFrame:
    """``(a, b, nb)``: sets of a leader that may link with another set of it across components.

    Sets in the leader's component (``main``) meet only those outside of it: main sets are dealt over blocks and
    stay single unless there are many outside.
    """
    comp = materialize(connected_components(links, "a", "b"), "jaccard-comp")
    named = stars.join(comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
    named = named.join(comp.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    named = named.select("a", "b", "nb", F.coalesce("cb", "b").alias("c"), (F.coalesce("cb", "b") == F.coalesce("ca", "a")).alias("main"))
    named = materialize(named, "jaccard-members")
    outside = F.count(F.when(~F.col("main"), 1))
    sizes = named.groupBy("a").agg(F.count(F.lit(1)).alias("k"), outside.alias("o")).where("o > 0 and k > 1")
    blocks = lambda x: F.ceil(x / WIDE).cast("int")
    small = F.col("k") <= 2 * WIDE
    sizes = sizes.select("a", F.when(small, 1).otherwise(blocks(F.col("o"))).alias("os"), F.when(small, 0).otherwise(blocks(F.col("k") - F.col("o"))).alias("ms"))
    dealt = named.join(materialize(sizes, "jaccard-spread"), "a")
    # Outside blocks 0 .. os-1, main blocks os .. os+ms-1; cells (i, j) with i an outside block and j >= i.
    place = F.pmod(F.xxhash64("b"), F.when(F.col("main") & (F.col("ms") > 0), F.col("ms")).otherwise(F.col("os"))).cast("int")
    blk = place + F.when(F.col("main") & (F.col("ms") > 0), F.col("os")).otherwise(0)
    last = F.when(F.col("blk") < F.col("os"), F.col("os") + F.col("ms")).otherwise(F.col("os")) - 1
    dealt = dealt.withColumn("blk", blk).withColumn("x", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.select("a", F.least("blk", "x").alias("i"), F.greatest("blk", "x").alias("j"), "b", "nb", "c", (~F.col("main")).alias("out"))
    dealt = dealt.join(sketches.select(F.col("sig").alias("b"), "sketch"), "b")

    def ask(rows: pa.Table) -> pa.Table:
        sketch = [np.asarray(x, dtype=np.int64) for x in rows["sketch"].to_pylist()]
        found = may_link(sketch, rows["nb"].to_numpy().astype(np.int64), rows["c"].to_numpy(), rows["out"].to_numpy(zero_copy_only=False), t)
        return rows.select(["a", "b", "nb"]).filter(pa.array(found))

    return dealt.groupBy("a", "i", "j").applyInArrow(ask, "a long, b long, nb int").distinct()


def _compared(stars: DataFrame, parts: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Links ``(a, b)`` among the sets of each leader, from their differences to it; a forest per cell."""
    p, q = t
    gone = F.concat(F.array_except("ha", "hb"), F.array_except("hb", "ha"))
    deltas = _paired(stars, parts).select("a", "b", "nb", gone.alias("part")).groupBy("a", "b", "nb").agg(F.flatten(F.collect_list("part")).alias("delta"))
    deltas = materialize(deltas, "jaccard-deltas")
    sizes = deltas.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = deltas.join(materialize(sizes, "jaccard-sizes"), "a").withColumn("blk", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("a", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "b", "nb", "delta")

    def compare(rows: pa.Table) -> pa.Table:
        ids, n = rows["b"].to_numpy(), rows["nb"].to_numpy().astype(np.int64)
        sets = [np.asarray(x, dtype=np.int64) for x in rows["delta"].to_pylist()]
        size = np.array([len(x) for x in sets])
        apart = size[:, None] + size[None, :] - 2 * common_counts(sets)
        total = n[:, None] + n[None, :]
        common = (total - apart) // 2
        hit = common * q >= p * (total - common)
        label = np.arange(len(ids))
        while True:
            low = np.where(hit, label[None, :], len(ids)).min(axis=1)
            low = np.minimum(low, label)
            low = low[low]
            if (low == label).all():
                break
            label = low
        some = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": pa.array(ids[label[some]]), "b": pa.array(ids[some])})

    return dealt.groupBy("a", "i", "j").applyInArrow(compare, "a long, b long")


def jaccard_groups(docs: DataFrame, n: int, t: tuple[int, int]) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs`` (columns ``doc_id``, ``text``).

    ``t`` is the threshold as a fraction (9, 10); the component is the smallest doc_id reachable by links.
    """
    rows = numbered(docs.select("doc_id", "text"), "row")
    whole = materialize(_sets(rows, n, t), "jaccard-sets", {"parquet.writer.version": "PARQUET_2_0"})  # packs sorted keys
    stars = _stars(whole)
    sets = materialize(whole.select("doc_id", "row", "n", "sig", "sketch"), "jaccard-ids")
    discard(whole)

    held = stars.select(F.col("a").alias("sig")).unionByName(stars.select(F.col("b").alias("sig"))).distinct()
    sketches = sets.where("sketch is not null").join(held, "sig", "left_semi").groupBy("sig").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sketches = materialize(sketches, "jaccard-sketches")

    def parts_of(wanted: DataFrame) -> DataFrame:
        """One text of every wanted set, cut along the order."""
        reps = sets.where("sketch is not null").join(wanted.distinct(), "sig", "left_semi").groupBy("sig").agg(F.min("row").alias("row"))
        return materialize(_parts(rows.join(materialize(reps, "jaccard-reps"), "row").select("sig", "text"), n), "jaccard-parts")

    ends = lambda pairs: pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig")))
    near = materialize(_not_refused(stars, sketches, t), "jaccard-near")
    parts = parts_of(ends(near))
    links = materialize(_verified(near, parts, t), "jaccard-links")
    discard(parts, near)
    # Leaders with sets outside their component.
    members = materialize(_open_members(stars, links, sketches, t), "jaccard-open")
    if not members.isEmpty():
        parts = parts_of(ends(members))
        links = materialize(links.unionByName(_compared(members, parts, t)), "jaccard-links")
        discard(parts)
    discard(sketches, stars, members)

    # Smallest doc_id of every component, brought back to the rows over SALTS keys.
    comp = materialize(connected_components(links, "a", "b").withColumnRenamed("node", "sig"), "jaccard-comp")
    slim = sets.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    named = slim.join(comp, "sig", "left").withColumn("c", F.coalesce("component", "sig"))
    named = materialize(named.where("rows > 1 or component is not null").select("sig", "least", "c"), "jaccard-named")
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    lookup = named.join(least, "c").select("sig", "component_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = sets.select("doc_id", "n", "sig", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    # The repeated rows pack to a thirtieth of what they take in memory, so the size of their file must not call for a broadcast.
    out = out.join(materialize(lookup, "jaccard-lookup").hint("merge"), ["sig", "salt"], "left")
    alone = F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), alone.alias("component_id"))
