"""Periodic runs of words in whole texts, by a descending-LCP Kruskal.

A run is a stretch of consecutive words with smallest period q, at least
``max(MIN_LENGTH, 2 * q)`` words long, that no neighbouring word extends
keeping that period.

The suffixes of a text start as classes of one.  Neighbours in suffix order
are united by decreasing length of their longest common prefix (LCP), with
union-find; every class keeps its positions in order.  When two classes unite
at LCP ``l``, a position i of one and j of the other that become neighbours
share exactly l words, so with q = j - i <= l the words from i to j + l have
period q, and q is their smallest: a smaller one would have put a position
between them at a greater LCP.  Such a pair is a seed; a run's seeds share its
end and period, and the first of them is its start.

A run of ``MIN_LENGTH`` words or more has a seed of LCP ``MIN_LENGTH / 2`` or
more (its length less its period), so neighbours below that are never united,
and suffixes whose first words stand nowhere else in their text are left out
before sorting.  Suffixes are sorted by prefix doubling over many texts at
once, each text by itself; the ranks of all doublings give the LCPs.

Texts are independent, so there is no shuffle, and copies or a hot source
spread as the rows do.  A task holds about ``SLICE_BYTES`` of text, or one
longer text, and some 100 bytes for each of its words.

Defined results: null, empty and blank texts have no words and no runs, and
collapse to the empty text; null ids and repeated rows are reported each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.llm.common import read_table
from tillpoint.llm.packing import slices
from tillpoint.llm.words import hashed_runs, mix

MIN_LENGTH = 12
SLICE_BYTES = 1 << 20

_LEAST = MIN_LENGTH // 2  # the least LCP of a seed
_WORD = r"[^\x20\x09-\x0D]+"
_NO_RUNS = np.zeros((0, 3), np.int64)


def _suffix_order(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose gram is not unique, in an order that keeps suffixes with
    common beginnings together, and for each but the last how many grams it
    shares with the next.  Grams with equal hashes are taken as equal; the
    hashes tell texts apart."""
    n = len(grams)
    kinds, rank, counts = np.unique(grams, return_inverse=True, return_counts=True)
    open_ = np.flatnonzero(counts[rank] > 1)
    if not len(open_):
        return open_, open_
    places = open_
    rank = (np.cumsum(counts) - counts)[rank]  # a class has the rank of its first member
    levels, step = [], 1
    while len(open_):
        levels.append(rank.astype(np.int32 if n < 1 << 31 else np.int64))
        after = open_ + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        by = np.lexsort((second, rank[open_]))
        open_, second = open_[by], second[by]
        first = rank[open_]
        new_class = np.diff(first, prepend=-1) != 0
        at = np.arange(len(open_))
        class_start = np.maximum.accumulate(np.where(new_class, at, 0))
        new_part = new_class | (np.diff(second, prepend=-2) != 0)
        part_start = np.maximum.accumulate(np.where(new_part, at, 0))
        rank = rank.copy()
        rank[open_] = first + part_start - class_start
        alone = new_part & np.append(new_part[1:], True)
        open_ = open_[~alone]
        step *= 2
    order = places[np.argsort(rank[places], kind="stable")]
    a, b = order[:-1], order[1:]
    shared = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + shared, b + shared
        inside = np.maximum(x, y) < n
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        shared += same.astype(np.int64) << k
    return order, shared


def _seeds(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """(end, period, start) of all seeds: neighbours in ``order`` are united by
    decreasing ``lcp``, those with an LCP of 0 never."""
    found: list[tuple[int, int, int]] = []
    parent = list(range(len(order)))
    members: list[list[int] | None] = [[p] for p in order.tolist()]
    edges = np.flatnonzero(lcp > 0)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    for t, l in zip(edges.tolist(), lcp[edges].tolist()):
        a, b = t, t + 1
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        large, small = members[a], members[b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        parent[b], members[b] = a, None
        last = len(small) - 1
        for k, p in enumerate(small):
            at = bisect_left(large, p)
            if at:
                low = large[at - 1]
                if p - low <= l and (k == 0 or small[k - 1] < low):
                    found.append((p + l, p - low, low))
            if at < len(large):
                high = large[at]
                if high - p <= l and (k == last or small[k + 1] > high):
                    found.append((high + l, high - p, p))
        if last < 8:
            for p in small:
                insort(large, p)
        else:
            large += small
            large.sort()  # two ordered stretches: a merge
    return np.array(found, np.int64).reshape(-1, 3)


def periodic_runs(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run, by start and period, of the texts
    words[bounds[k]:bounds[k + 1]]; ``words`` are numbers that are equal where
    the words are, starts count over all texts."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)).astype(np.uint64)
    grams = hashed_runs(mix(words.astype(np.uint64) + np.uint64(1)), list(range(_LEAST)))
    if not len(grams):
        return _NO_RUNS
    whole = text[: len(grams)] == text[_LEAST - 1:]
    grams = mix(grams ^ mix(text[: len(grams)] + np.uint64(1)))
    # The last words of a text have no gram; a number of their own keeps them unique.
    at = np.flatnonzero(~whole)
    grams[at] = mix(at.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    order, shared = _suffix_order(grams)
    seeds = _seeds(order, np.where(shared > 0, shared + _LEAST - 1, 0))
    if not len(seeds):
        return _NO_RUNS
    end, period, start = seeds[np.lexsort(seeds.T[::-1])].T
    first = np.append(True, (np.diff(end) != 0) | (np.diff(period) != 0))
    runs = np.stack([start[first], (end - start)[first], period[first]], axis=1)
    runs = runs[runs[:, 1] >= np.maximum(MIN_LENGTH, 2 * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id, ``n_words``, its ``runs`` in order of
    start and period (words from 0), and ``collapsed``, its words joined by one
    space without those that stand in a run after the run's first period."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, SLICE_BYTES):
                yield _scan(some)

    def _scan(some: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(t or b"").split() for t in some.column(1).cast(pa.large_binary()).to_pylist()]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        coded = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode()
        found = periodic_runs(coded.indices.to_numpy(), bounds)
        # The words to drop: those a run covers after its first period.
        change = np.zeros(bounds[-1] + 1, np.int64)
        np.add.at(change, found[:, 0] + found[:, 2], 1)
        np.add.at(change, found[:, 0] + found[:, 1], -1)
        dropped = np.cumsum(change[:-1]) > 0
        edges = np.searchsorted(found[:, 0], bounds)
        collapsed = []
        for k, t in enumerate(texts):
            if edges[k + 1] > edges[k]:
                t = [w for w, gone in zip(t, dropped[bounds[k]: bounds[k + 1]].tolist()) if not gone]
            collapsed.append(b" ".join(t).decode("utf-8", "replace"))
        of = np.repeat(np.arange(len(texts)), np.diff(edges))
        spans = pa.StructArray.from_arrays([pa.array(found[:, 0] - bounds[of]), pa.array(found[:, 1]), pa.array(found[:, 2])],
                                           ["start", "length", "period"])
        return pa.RecordBatch.from_arrays(
            [some.column(0), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(edges.astype(np.int32), spans),
             pa.array(collapsed, pa.string())], names=[id_col, "n_words", "runs", "collapsed"])

    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_words long, runs array<struct<start long, length long, period long>>, collapsed string")


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with a periodic tail in every tenth text by the
    CRC of its id: with h the CRC, g = floor(h / 10) and n words, the words
    from a = g % n on repeat the first p = 1 + floor((n - a) / (3 + g % 8)) of
    them.  A text without an id stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(
        h % 10 == 0, F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("words"))
    n = F.size("words").cast("long")
    placed = split.select("doc_id", "text", "words", n.alias("n"), (F.col("g") % n).alias("a"),
                          (1 + F.floor((n - F.col("g") % n) / (3 + F.col("g") % 8))).alias("p"))

    def word(i: Column) -> Column:
        a, p = F.col("a"), F.col("p")
        return F.get("words", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))

    # Null where there is nothing to plant, so that no sequence is built there.
    last = F.when(F.col("n") > 0, F.col("n") - 1)
    planted = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), last), word), " ")
    return placed.select("doc_id", F.coalesce(planted, F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_tails(read_table(spark, sf_dir, "documents", "doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    rows = found.withColumn("best", longest)
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        length.alias("length"), period.alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
