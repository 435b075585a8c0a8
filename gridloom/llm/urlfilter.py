"""URL rules by a Bloom filter cascade.

A rule is a host and a path prefix.  A URL has one candidate key per (host suffix, path prefix of a length
that some rule has), longest first.  The cascade for a list of keys is built over the key universe of the
corpus: level 1 encodes the listed keys, level 2 the universe's keys that level 1 takes by mistake, level 3
the listed keys that level 2 takes by mistake, and so on until a level makes no mistake.  Membership of any
key of that universe is then exact, and a page is judged by looking at the levels only, without a join.

Defined cases: a null URL or one without ``://`` has an empty host and path and matches no rule; an empty
rule list allows everything; an empty table gives an empty result; a rule listed twice counts once, and a
key listed both to block and to allow is allowed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels larger than this are not sent to the executors; ``judge_urls`` then raises.
MAX_CASCADE_BYTES = 256 << 20


def url_host(url: Column) -> Column:
    """Lower-cased (A-Z) text after the first ``://`` up to ``/``, ``?``, ``#`` or the end; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """Text behind the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass
class Bloom:
    """A plain Bloom filter over strings; its size follows from the number of keys and the error rate."""

    n_keys: int
    salt: int
    error: float = 0.02
    bits: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        size = max(64, math.ceil(-self.n_keys * math.log(self.error) / math.log(2) ** 2))
        self.bits = np.zeros((size + 7) // 8, dtype=np.uint8)
        self.hashes = max(1, round(size / max(1, self.n_keys) * math.log(2)))
        self.hashes = min(self.hashes, 16)

    def _places(self, keys: list[str]) -> np.ndarray:
        raw = b"".join(xxhash.xxh3_128_digest(k, seed=self.salt) for k in keys)
        pair = np.frombuffer(raw, dtype=np.uint64).reshape(-1, 2)
        step = np.arange(self.hashes, dtype=np.uint64)[None, :]
        with np.errstate(over="ignore"):
            return (pair[:, :1] + step * (pair[:, 1:] | np.uint64(1))) % np.uint64(len(self.bits) * 8)

    def add(self, keys: list[str]) -> None:
        if keys:
            at = self._places(keys).ravel()
            np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))

    def __contains__(self, key: str) -> bool:
        return bool(self.test([key])[0])

    def test(self, keys: list[str]) -> np.ndarray:
        if not keys:
            return np.zeros(0, dtype=bool)
        at = self._places(keys)
        got = self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
        return got.all(axis=1)


@dataclass
class Cascade:
    levels: list[Bloom]

    @property
    def n_bytes(self) -> int:
        return sum(len(x.bits) for x in self.levels)

    def test(self, keys: list[str]) -> np.ndarray:
        """Whether each key of the universe is listed: the first level that denies it settles the answer."""
        inside = np.zeros(len(keys), dtype=bool)
        left = np.arange(len(keys))
        for depth, level in enumerate(self.levels):
            got = level.test([keys[i] for i in left])
            # Denied at an odd level (1, 3, ...): not listed.  Denied at an even one: listed.
            inside[left[~got]] = depth % 2 == 1
            left = left[got]
        inside[left] = len(self.levels) % 2 == 1
        return inside


def build_cascade(listed: list[str], universe: DataFrame, salt: int, max_levels: int = 40) -> Cascade:
    """Cascade of ``listed`` over ``universe`` (a table with the column ``key``; repeats do no harm).

    Only keys that a level takes by mistake leave the executors: the first level lets through ``error``
    times the universe, so the first level's error rate is set to pass about as many keys as are listed.
    """
    spark = universe.sparkSession
    listed = sorted(set(listed))
    if not listed:
        return Cascade([])
    total = universe.select(F.approx_count_distinct("key")).first()[0]
    first = Bloom(len(listed), salt, error=max(1e-9, min(0.02, len(listed) / max(1, total))))
    first.add(listed)
    levels, member = [first], set(listed)
    sent = spark.sparkContext.broadcast(first)

    def passed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = pdf["key"].drop_duplicates()
            yield pd.DataFrame({"key": keys[sent.value.test(keys.tolist())]})

    wrong = [r[0] for r in universe.mapInPandas(passed, "key string").distinct().collect() if r[0] not in member]
    inside, outside = listed, wrong  # what the last level encodes, and what it takes by mistake
    while outside:
        if len(levels) >= max_levels:
            raise RuntimeError("the cascade does not end")
        level = Bloom(len(outside), salt + len(levels))
        level.add(outside)
        levels.append(level)
        mistaken = [k for k, hit in zip(inside, level.test(inside), strict=True) if hit]
        inside, outside = outside, mistaken
    return Cascade(levels)


def candidate_keys(host: str, path: str, lengths: list[int]) -> list[str]:
    """Keys of a URL, longest first: every suffix of the host with every path prefix of a rule's length."""
    if not host:
        return []
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    return sorted((h + path[:n] for h in hosts for n in lengths if n <= len(path)), key=len, reverse=True)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages``.

    ``rules`` holds (verdict, host, path); the longest rule that fits decides, and a URL that no rule fits
    is allowed, as it is on no list.  The rule list and the levels are bounded by ``MAX_CASCADE_BYTES``.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    lengths = sorted({len(p) for _, _, p in rules})
    allow = {h + p for v, h, p in rules if v == "allow"}
    block = {h + p for v, h, p in rules if v == "block"} - allow

    def keys_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": list({k for h, p in zip(pdf["host"], pdf["path"], strict=True) for k in candidate_keys(h, p, lengths)})}, dtype=object)

    universe = rows.mapInPandas(keys_of, "key string")
    cascades = {"allow": build_cascade(sorted(allow), universe, 1), "block": build_cascade(sorted(block), universe, 101)}
    if sum(c.n_bytes for c in cascades.values()) > MAX_CASCADE_BYTES:
        raise ValueError("the rule lists are too large to send to every executor")
    sent = spark.sparkContext.broadcast(cascades)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = [candidate_keys(h, p, lengths) for h, p in zip(pdf["host"], pdf["path"], strict=True)]
            flat = list({k for ks in keys for k in ks})
            verdict: dict[str, str] = {}
            for name in ("block", "allow"):
                if sent.value[name].levels:
                    verdict.update((k, name) for k, hit in zip(flat, sent.value[name].test(flat), strict=True) if hit)
            rule = [next((k for k in ks if k in verdict), None) for ks in keys]
            yield pdf.assign(rule=pd.Series(rule, dtype=object, index=pdf.index), verdict=[verdict[k] if k else "allow" for k in rule])

    return rows.mapInPandas(judge, rows.schema.simpleString()[7:-1].replace(":", " ") + ", rule string, verdict string")
