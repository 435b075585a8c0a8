"""Quality grades by ordinal regression on hashed text.

Grades are ordered (here 0 toxic, 1 poor, 2 good).  One weight vector over hashed features is shared by all
grades and ordered thresholds cut its score: P(grade <= j) = sigmoid(threshold_j - score), the cumulative
link.  The expected grade and the tail probability P(grade >= g) follow.

Features of a text: its distinct words, the shapes of its words (letters, capitals, digits, marks) by share,
and how much of it repeats.  Every text is read in whole; a word of more than ``PIECE`` bytes (scripts without
spaces, encoded data) counts as consecutive pieces.

The model is fitted on a bounded sample of rated rows (``max_rated``, those of the smallest id hashes);
scoring covers all rows.  Defined cases: a null or empty text has only the bias feature and is scored like
any other; rated rows without a grade are not used; with fewer than two grades every row gets the prior; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.caches import hold

DIMS = 1 << 18
#: Most rated rows that the model is fitted on.
MAX_RATED = 10_000
KEEP_TAIL = 0.5
#: Scales of the feature families: word present, share of a shape, share of a word start.
BARE, SHAPE, START = 0.1, 8.0, 8.0
#: Most bytes of a word that is not cut.
PIECE = 40
#: Words that a Python worker remembers, about.
CACHED_WORDS = 300_000
#: A slot counts from this number of rated texts on.
MIN_TEXTS = 12

_EDGE = re.compile(rb"^[^0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff]+$")
_SHAPES = ((re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0"))


def _slot(name: bytes) -> int:
    return xxhash.xxh3_64_intdigest(name) % (DIMS - 1) + 1


class _Words(dict):
    """Word -> row of ``slots``: the bare word, its shape, its first three and its first five letters."""

    def __init__(self):
        super().__init__()
        self.slots = np.zeros((0, 4), dtype=np.int64)

    def clear(self) -> None:
        super().clear()
        self.slots = np.zeros((0, 4), dtype=np.int64)

    def __missing__(self, word: bytes) -> int:
        shape = word
        for pattern, letter in _SHAPES:
            shape = pattern.sub(letter, shape)
        bare = _EDGE.sub(b"", word).lower()
        letters = bare.decode(errors="replace")
        row = len(self)
        if row == len(self.slots):
            self.slots = np.concatenate([self.slots, np.zeros((max(row, 1024), 4), dtype=np.int64)])
        self.slots[row] = (_slot(b"w:" + bare), _slot(b"s:" + shape), _slot(b"3:" + letters[:3].encode()), _slot(b"5:" + letters[:5].encode()))
        self[word] = row
        return row


_WORDS = _Words()


def _pieces(word: bytes) -> Iterator[bytes]:
    """The word in pieces of at most PIECE bytes, cut between characters."""
    at = 0
    while len(word) - at > PIECE:
        end = at + PIECE
        while end > at + PIECE - 4 and word[end] & 0xC0 == 0x80:
            end -= 1
        yield word[at:end]
        at = end
    yield word[at:]


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text; slot 0 is the bias."""
    words = text.split()
    if not words:
        return np.zeros(1, dtype=np.int64), np.ones(1)
    if max(map(len, words)) > PIECE:
        words = [piece for word in words for piece in _pieces(word)]
    hold(_WORDS)
    if len(_WORDS) > CACHED_WORDS:  # between two texts the cache may start anew
        _WORDS.clear()
    rows = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.int64, count=len(words))
    pairs = _WORDS.slots[rows]
    bare = np.unique(pairs[:, 0])
    fresh = int(10 * len(bare) / len(words))
    size = len(words).bit_length()
    parts, values = [np.array([0, _slot(b"r:%d" % fresh), _slot(b"l:%d" % size), _slot(b"rl:%d:%d" % (fresh, size))]), bare], [np.ones(4), np.full(len(bare), BARE)]
    for column, scale in ((1, SHAPE), (2, START), (3, START)):
        slots, counts = np.unique(pairs[:, column], return_counts=True)
        parts.append(slots)
        values.append(scale * np.sqrt(counts / len(words)))
    return np.concatenate(parts), np.concatenate(values)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1 .. n - 1."""
        return 1 - _sigmoid(self.thresholds[None, :] - score[:, None])

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.array([float(self.weights[s] @ v) for s, v in map(features, texts)])


def link_slopes(y: int, x: float, theta: np.ndarray) -> tuple[float, float, float, float]:
    """Likelihood F(theta_y - x) - F(theta_{y-1} - x) of grade y, and the slopes of its negative logarithm by x
    and by the upper and the lower threshold."""
    hi = _sigmoid(theta[y] - x) if y < len(theta) else 1.0
    lo = _sigmoid(theta[y - 1] - x) if y else 0.0
    dhi, dlo, p = hi * (1 - hi), lo * (1 - lo), max(hi - lo, 1e-6)
    return p, (dhi - dlo) / p, -dhi / p, dlo / p


def fit_ordinal(texts: list[bytes], grades: np.ndarray, n_grades: int, epochs: int = 12, rate: float = 0.08, penalty: float = 1e-3, seed: int = 5) -> OrdinalModel:
    """AdaGrad on the cumulative-link likelihood, rare grades weighted up to the square root of balance."""
    share = np.bincount(grades, minlength=n_grades) / max(1, len(grades))
    cum = np.clip(np.cumsum(share)[:-1], 1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(np.log(cum / (1 - cum)) + 1e-3 * np.arange(n_grades - 1))
    w = np.zeros(DIMS)
    if len(set(grades.tolist())) < 2:
        return OrdinalModel(w, theta)
    weight = 1 / np.sqrt(np.maximum(share, 1e-6) * n_grades)
    feats = [features(t) for t in texts]
    texts_of = np.zeros(DIMS, dtype=np.int64)
    for s, _ in feats:
        texts_of[s] += 1
    feats = [(s[k], v[k]) for s, v in feats for k in [texts_of[s] >= MIN_TEXTS]]
    seen, seen_t, rng = np.full(DIMS, 1e-2), np.full(n_grades - 1, 1.0), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(feats)):
            s, v = feats[i]
            y, x = int(grades[i]), float(w[s] @ v)
            _, by_x, by_upper, by_lower = link_slopes(y, x, theta)
            grad = weight[y] * by_x * v + penalty * w[s]
            grad[0] = 0.0  # the thresholds are the bias
            seen[s] += grad * grad
            w[s] -= rate * grad / np.sqrt(seen[s])
            for j, d in ((y, weight[y] * by_upper), (y - 1, weight[y] * by_lower)):
                if 0 <= j < n_grades - 1:
                    seen_t[j] += d * d
                    theta[j] -= rate * d / np.sqrt(seen_t[j])
            theta = np.maximum.accumulate(theta)
    return OrdinalModel(w, theta)


def fit_quality(docs: DataFrame, labels: DataFrame, grade: Column, n_grades: int = 3, max_rated: int = MAX_RATED) -> OrdinalModel:
    """Fit on the rated rows of ``docs``; ``grade`` is an expression over ``labels``.

    An id with several grades has the lowest of them; of several texts with one id the first in order counts.
    """
    rated = labels.select("doc_id", grade.cast("int").alias("grade")).where("grade is not null and doc_id is not null")
    rated = rated.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    n = rated.count()
    if n > max_rated:  # a share by hash that keeps within the bound
        rated = rated.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * 0.95 * max_rated / n))
    # The id test is a set of at most max_rated ids, so the texts need no shuffle.
    graded = dict(rated.limit(max_rated).toPandas().itertuples(index=False))
    sent = docs.sparkSession.sparkContext.broadcast(graded)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [d in sent.value for d in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(hit)) for c in batch.columns], schema=schema)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"]).drop_duplicates("doc_id")
        model = fit_ordinal([bytes(t) for t in pdf["text"]], pdf["doc_id"].map(sent.value).to_numpy(dtype=np.int64), n_grades)
        at = np.flatnonzero(model.weights)
        return pd.DataFrame({"slot": [at.astype(np.int64).tobytes()], "weight": [model.weights[at].tobytes()], "theta": [model.thresholds.tobytes()]})

    # One task fits the bounded sample; the driver gets the weights only.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    picked = rows.mapInArrow(pick, "doc_id long, text binary").withColumn("one", F.lit(1))
    got = picked.groupBy("one").applyInPandas(fit, "slot binary, weight binary, theta binary").first()
    if got is None:
        return fit_ordinal([], np.zeros(0, dtype=np.int64), n_grades)
    weights = np.zeros(DIMS)
    weights[np.frombuffer(got["slot"], dtype=np.int64)] = np.frombuffer(got["weight"])
    return OrdinalModel(weights, np.frombuffer(got["theta"]))


def score_quality(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """``docs`` with ``expected_grade`` and ``tail_prob``, the probability of the highest grade.

    Columns of these names in ``docs`` are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<expected_grade:double,tail_prob:double>")
    def graded(texts: pd.Series) -> pd.DataFrame:
        tails = sent.value.tails(sent.value.score([b"" if t is None else bytes(t) for t in texts]))
        return pd.DataFrame({"expected_grade": tails.sum(axis=1), "tail_prob": tails[:, -1]})

    out = docs.withColumn("_graded", graded(F.col(text).cast("binary")))
    return out.withColumn("expected_grade", F.col("_graded.expected_grade")).withColumn("tail_prob", F.col("_graded.tail_prob")).drop("_graded")


def document_grade() -> Column:
    """Grade of a labelled document: 0 toxic, 1 poor, 2 good."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
