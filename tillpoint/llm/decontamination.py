"""Benchmark decontamination by spaced-seed hashing.

A mask is a fixed pattern over consecutive words; the hash of a place covers
only the words at the mask's ones, so a substituted word at a zero does not
change it.  All places of all texts are hashed under every mask.  A bit
filter of the benchmark's hashes, of bounded size whatever the benchmark's,
drops places that cannot match; the rest are joined with the benchmark's on
the hash by Spark.  Both sides carry the hashes of the words around the
place, so each joined pair is verified as it stands: some ``STRETCH`` aligned
words around the seed (the whole item when it is shorter), of which at least
``SHARE`` are equal.

An item shorter than the shortest mask, of ``MIN_ITEM`` words or more, has one
seed, all its words; the texts' runs of that many words are hashed too, only
for the lengths that the benchmark has.

Words are compared without case, punctuation and white space.

Defined results: null and empty texts and items match nothing, nor do items
of fewer than ``MIN_ITEM`` words, which name a thing rather than ask for it;
documents with equal ids and texts
share their result; null ids are kept; repeated rows are reported each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.llm.bitfilter import BitFilter, bit_filter
from tillpoint.llm.common import cut, frugal, read_table
from tillpoint.llm.packing import slices
from tillpoint.llm.words import hashed_runs, hashed_words, mix

# Spans of 6, 8, 10 and 11 words, six of them compared.
MASKS = ("111111", "11011011", "1101001101", "11001010011")
STRETCH = 13
SHARE = 0.8
MIN_ITEM = 3
SLICE_BYTES = 4 << 20

_OFFSETS = [[k for k, one in enumerate(m) if one == "1"] for m in MASKS]
_SHORT = tuple(range(MIN_ITEM, len(MASKS[0])))  # the first mask is the shortest
_BEFORE = STRETCH - 1
_AROUND = _BEFORE + max(map(len, MASKS)) + _BEFORE
_NOT_WORD = re.compile(r"[\W_]+")


def _word(token: str) -> str:
    return token if token.isalnum() and token.isascii() else _NOT_WORD.sub("", token.lower())


def _around(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """32-bit hashes of the words from ``_BEFORE`` before each place on; 0 outside."""
    short = (words >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    padded = np.concatenate([np.zeros(_BEFORE, np.uint32), short, np.zeros(_AROUND, np.uint32)])
    return padded[at[:, None] + np.arange(_AROUND)].view(np.int32)


def seeds(texts: DataFrame, keep: list[str], known: BitFilter | None = None, short: tuple[int, ...] = _SHORT) -> DataFrame:
    """A row for each place and mask of ``texts`` (``keep`` and last ``text``):
    ``hash``, ``place``, ``around``; only those that may be in the filter
    ``known`` if it is given.  Runs of as many words as in ``short`` are seeds
    too: with ``known`` those of all texts, else whole texts only."""
    names = [*keep, "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.select(*keep).schema)
    shared = texts.sparkSession.sparkContext.broadcast(known and tuple(known))
    masks = [*enumerate(_OFFSETS), *((len(MASKS) + n, list(range(n))) for n in short)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value and BitFilter(*shared.value)
        for batch in batches:
            for some in slices(batch, SLICE_BYTES, len(keep)):
                words, starts = hashed_words(some.column(len(keep)), _word)
                row = np.repeat(np.arange(some.num_rows), np.diff(starts))
                found = []
                for mask, taken in masks:
                    hashes = mix(hashed_runs(words, taken) + np.uint64(mask))
                    inside = row[taken[-1]:][: len(hashes)] == row[: len(hashes)]
                    if known is not None:
                        inside &= known.may_hold(hashes)
                    elif mask >= len(MASKS):
                        inside &= np.diff(starts)[row[: len(hashes)]] == len(taken)
                    at = np.flatnonzero(inside)
                    found.append((hashes[at], at))
                hashes, at = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(row[at], kind="stable")
                hashes, at = hashes[order], at[order]
                # The words around a place, from its own text only.
                edges = np.searchsorted(row[at], np.arange(some.num_rows + 1))
                near = [_around(words[starts[r]: starts[r + 1]], at[a:b] - starts[r])
                        for r, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
                flat = np.concatenate(near).ravel() if near else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * _AROUND, pa.array(flat))
                own = pa.array(row[at])
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(k).take(own) for k in range(len(keep))), pa.array(hashes.view(np.int64)),
                     pa.array(at - starts[row[at]]), lists], names=[*keep, "hash", "place", "around"])

    return texts.select(*names).mapInArrow(frugal(run), f"{schema}, hash long, place long, around array<int>")


def _aligned(stretch: int, share: float) -> Column:
    """Whether enough words around the joined places are equal."""
    same = F.zip_with(F.col("s.around"), F.col("b.around"), lambda x, y: ((x == y) & (x != 0)).cast("int"))
    inside = F.aggregate(F.col("b.around"), F.lit(0), lambda a, y: a + (y != 0).cast("int"))
    wanted = F.least(F.lit(stretch), inside)  # a shorter item counts as a whole
    return F.exists(F.sequence(F.lit(1), F.lit(_AROUND) - wanted + 1), lambda k: F.aggregate(
        F.slice(same, k, wanted), F.lit(0), lambda a, x: a + x) >= F.ceil(wanted * F.lit(share)))


def overlaps(docs: DataFrame, benchmark: DataFrame, stretch: int = STRETCH, share: float = SHARE) -> DataFrame:
    """``doc_id``, ``key`` (hash of the text), ``item_id`` of the verified
    overlaps of ``docs`` (doc_id, text) with ``benchmark`` (item_id, text)."""
    known_seeds = cut(seeds(benchmark, ["item_id"]))
    size = F.size(F.filter("around", lambda y: y != 0))
    short = tuple(sorted(r["n"] for r in known_seeds.select(size.alias("n")).filter(F.col("n") < len(MASKS[0])).distinct().collect()))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    found = seeds(keyed, ["doc_id", "key"], bit_filter(known_seeds), short)
    return (found.alias("s").join(known_seeds.alias("b"), F.col("s.hash") == F.col("b.hash"))
            .filter(_aligned(stretch, share)).select("s.doc_id", "s.key", "b.item_id").distinct())


def flag(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document: ``doc_id``, ``key``, ``contaminated`` and the
    items it holds."""
    items = (overlaps(docs, benchmark).groupBy("doc_id", "key")
             .agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    return (docs.select("doc_id", F.xxhash64("text").alias("key")).alias("d")
            .join(items.alias("i"), F.col("d.doc_id").eqNullSafe(F.col("i.doc_id"))
                  & (F.col("d.key") == F.col("i.key")), "left")
            .select("d.doc_id", "d.key", F.col("i.items").isNotNull().alias("contaminated"),
                    F.coalesce("i.items", F.expr("cast(array() as array<bigint>)")).alias("items")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all columns, without the documents that hold an item."""
    bad = overlaps(docs, benchmark).select("doc_id", "key").distinct()
    return (docs.alias("d").join(bad.alias("x"), F.col("d.doc_id").eqNullSafe(F.col("x.doc_id"))
                                 & (F.xxhash64("d.text") == F.col("x.key")), "left_anti"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return (flag(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))
            .select("doc_id", "contaminated", F.size("items").cast("long").alias("n_items"),
                    F.array_join(F.col("items").cast("array<string>"), ",").alias("items")))


QUERIES = {"op9_decontamination": op9_decontamination}
