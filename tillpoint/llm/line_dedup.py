"""Line dedup by content-defined chunks of lines.

A passage is a run of lines with at least ``MIN_LINES`` lines and
``MIN_WORDS`` words, or with ``ALONE_WORDS`` words; an empty line counts as a
word.  A text is cut into chunks.  Each place between two lines has a rolling
hash of the lines around it, and a place is a boundary when its hash is the
least among the places up to a reach of words ahead of some place, or behind
it.  Whether a place is a boundary thus depends on the lines nearby and not
on where they stand: an insertion moves the boundaries along and changes only
those around it.  The reach is under a quarter of ``MIN_WORDS``.  A line
longer than the reach is a chunk of its own; in a passage of shorter lines,
two windows of the reach lie side by side, and no place between their minima
can be made a boundary from outside.  Every copy of a passage, whatever
surrounds it, therefore has a whole chunk in common with the others.

Spark counts the hashes of the chunks over all texts.  Around chunks that
repeat, passages are read: from each line the shortest one that begins there,
and the shortest one that ends there, if it holds such a chunk.  Their hashes
are counted too, and every occurrence of a repeated one is compared, byte by
byte, with the first (by document id, then line).  Equal ones are merged to
runs and removed, unless they overlap the first one, in a text that repeats
itself.  A removed line always has an equal line at an earlier place, so one
copy of every passage stays.

Defined results: a null text stays null; an empty text has one empty line;
a text that loses all its lines is empty; rows with equal ids are ordered by
a hash of their text, and full repeats share their result, so the first
keeps its lines and so do they; null ids come first; an empty table gives no
rows; other columns pass through ``drop_repeats`` as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillpoint.llm.bitfilter import BitFilter, bit_filter
from tillpoint.llm.common import cut, frugal, read_table
from tillpoint.llm.packing import slices
from tillpoint.llm.words import mix

MIN_LINES = 2
MIN_WORDS = 30
ALONE_WORDS = 50
MAX_BROADCAST_BYTES = 32 << 20
SLICE_BYTES = 4 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LAST = np.uint64((1 << 64) - 1)
_WINDOW = "hash long, doc_id long, key long, line int, lines int, own string"


def _words(line: str) -> int:
    return line.count(" ") + 1


class Lines:
    """The lines of some texts, one after the other."""

    def __init__(self, texts: list[str]):
        split = [t.split("\n") for t in texts]
        self.lines = [x for t in split for x in t]
        self.n = np.fromiter(map(len, split), np.int64, len(split))
        n = len(self.lines)
        stops = np.cumsum(self.n)
        self.start, self.stop = np.repeat(stops - self.n, self.n), np.repeat(stops, self.n)  # of each line's text
        self.text = np.repeat(np.arange(len(split)), self.n)
        self.upto = np.concatenate([[0], np.cumsum(np.fromiter(map(_words, self.lines), np.int64, n))])
        self.own = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in self.lines), np.uint64, n)
        powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE))])
        self._back = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BACK))])
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.own * powers[:n], dtype=np.uint64)])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each run of lines, from sums over the lines before its ends."""
        return mix((self._sums[end] - self._sums[begin]) * self._back[begin] + (end - begin).astype(np.uint64))

    def chunks(self, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the chunks begin and end."""
        text = np.repeat(np.arange(len(self.n)), self.n + 1)  # a place before each line and after the last
        line = np.arange(len(text)) - text
        edge = np.ones(len(text), bool)
        edge[1:-1] = (text[1:-1] != text[:-2]) | (text[1:-1] != text[2:])
        value = np.full(len(text), _LAST)
        value[~edge] = mix(self.own[line[~edge] - 1] * _BASE + self.own[line[~edge]])
        at = self.upto[line] + text * (reach + 1)  # words; texts are out of each other's reach
        chosen = edge.copy()
        ahead, behind = value.copy(), value.copy()
        near = []
        for k in range(1, reach + 1):  # every line has a word
            near.append(at[k:] - at[:-k] <= reach)
            if not near[-1].any():
                near.pop()
                break
            ahead[:-k] = np.where(near[-1], np.minimum(ahead[:-k], value[k:]), ahead[:-k])
            behind[k:] = np.where(near[-1], np.minimum(behind[k:], value[:-k]), behind[k:])
        chosen |= (value == ahead) | (value == behind)
        for k, close in enumerate(near, 1):
            chosen[k:] |= close & (value[k:] == ahead[:-k])
            chosen[:-k] |= close & (value[:-k] == behind[k:])
        cuts = np.flatnonzero(chosen)
        same = text[cuts[1:]] == text[cuts[:-1]]
        return line[cuts[:-1][same]], line[cuts[1:][same]]

    def passages(self, min_lines: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the shortest passages from and to each line begin and end."""
        upto, n = self.upto, len(self.lines)
        at = np.arange(n)
        end = np.minimum(np.maximum(np.searchsorted(upto, upto[:-1] + min_words), at + min_lines),
                         np.searchsorted(upto, upto[:-1] + ALONE_WORDS))
        begin = np.maximum(np.minimum(np.searchsorted(upto, upto[1:] - min_words, "right") - 1, at + 1 - min_lines),
                           np.searchsorted(upto, upto[1:] - ALONE_WORDS, "right") - 1)
        ahead, behind = end <= self.stop, begin >= self.start
        both = np.unique(np.concatenate([at[ahead] * (n + 1) + end[ahead], begin[behind] * (n + 1) + at[behind] + 1]))
        return both // (n + 1), both % (n + 1)

    def around(self, known: BitFilter, reach: int, min_lines: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """The passages that hold a whole chunk of those in ``known``."""
        first, last = self.chunks(reach)
        held = known.may_hold(self.hashes(first, last))
        first, last = first[held], np.concatenate([last[held], [len(self.lines) + 1]])
        begin, end = self.passages(min_lines, min_words)
        inside = last[np.searchsorted(first, begin)] <= end
        return begin[inside], end[inside]


def reach_of(min_words: int) -> int:
    """The reach that gives every passage of ``min_words`` a whole chunk."""
    return (min_words - 1) // 4


def chunk_hashes(docs: DataFrame, min_words: int) -> DataFrame:
    """``hash`` of every chunk of ``docs`` (text)."""
    reach = reach_of(min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, SLICE_BYTES, 0):
                own = Lines([t for t in some.column(0).to_pylist() if t is not None])
                yield pa.RecordBatch.from_arrays([pa.array(own.hashes(*own.chunks(reach)).view(np.int64))], names=["hash"])

    return docs.select("text").mapInArrow(frugal(run), "hash long")


def windows(docs: DataFrame, min_lines: int, min_words: int, chunks: BitFilter, known: BitFilter | None = None) -> DataFrame:
    """The passages of ``docs`` (doc_id, key, text) around ``chunks``: only their
    ``hash``, or, for the hashes that may be in ``known``, with their place and
    lines."""
    shared = docs.sparkSession.sparkContext.broadcast((tuple(chunks), known and tuple(known)))
    reach = reach_of(min_words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = BitFilter(*shared.value[0])
        for batch in batches:
            for some in slices(batch, SLICE_BYTES, 2):
                own = Lines([t for t in some.column(2).to_pylist() if t is not None])
                found = own.hashes(*own.around(chunks, reach, min_lines, min_words))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["hash"])

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, known = (BitFilter(*x) for x in shared.value)
        for batch in batches:
            for some in slices(batch, SLICE_BYTES, 2):
                some = some.filter(some.column(2).is_valid())
                own = Lines(some.column(2).to_pylist())
                begin, end = own.around(chunks, reach, min_lines, min_words)
                hashes = own.hashes(begin, end)
                held = known.may_hold(hashes)
                begin, end, hashes = begin[held], end[held], hashes[held]
                texts = ["\n".join(own.lines[a:b]) for a, b in zip(begin.tolist(), end.tolist())]
                of = pa.array(own.text[begin])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), some.column(0).take(of), some.column(1).take(of),
                     pa.array((begin - own.start[begin]).astype(np.int32)), pa.array((end - begin).astype(np.int32)),
                     pa.array(texts, pa.string())], names=["hash", "doc_id", "key", "line", "lines", "own"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "key", "text")
    return rows.mapInArrow(frugal(count), "hash long") if known is None else rows.mapInArrow(frugal(show), _WINDOW)


def _repeated(hashes: DataFrame) -> BitFilter:
    return bit_filter(cut(hashes.groupBy("hash").count().filter("count > 1").select("hash")))


def _merged(found: DataFrame) -> DataFrame:
    """The line ranges ``found`` (doc_id, key, first, end) as runs that neither
    overlap nor touch."""
    order = Window.partitionBy("doc_id", "key").orderBy("first", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("first") <= F.col("reach"), 0).otherwise(1)).over(order)
    return (found.withColumn("reach", reach).withColumn("run", run)
            .groupBy("doc_id", "key", "run").agg(F.min("first").alias("first"), F.max("end").alias("end")))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id``, ``key`` and ``runs``, the array of line ranges to remove, of
    the documents (doc_id, text) that have any."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    chunks = _repeated(chunk_hashes(keyed, min_words))
    known = _repeated(windows(keyed, min_lines, min_words, chunks))
    seen = cut(windows(keyed, min_lines, min_words, chunks, known))
    place = F.struct("doc_id", "key", "line")
    first = seen.groupBy("hash").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    placed = seen.join(first, "hash")
    kept = (placed.filter(place == F.col("first")).dropDuplicates(["hash"])
            .select("hash", F.col("own").alias("own2")))
    itself = (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
              & (F.col("line") < F.col("first.line") + F.col("lines")))  # the first one, or over it
    found = (placed.filter(~itself).join(kept, "hash").filter("own = own2")
             .select("doc_id", "key", F.col("line").alias("first"), (F.col("line") + F.col("lines")).alias("end")))
    return (_merged(found.distinct())
            .groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "end")).alias("runs")))


def drop_repeats(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs``, all columns, without repeated runs; ``lines`` and
    ``removed_lines`` count the lines before and those removed."""
    runs = cut(repeated_runs(docs.select("doc_id", "text"), min_lines, min_words))
    held = runs.agg(F.sum(64 + 48 * F.size("runs")).alias("bytes")).first()["bytes"] or 0
    runs = (F.broadcast(runs) if held <= MAX_BROADCAST_BYTES else runs).alias("r")
    lines = F.split("d.text", "\n", -1)
    stays = F.filter(lines, lambda x, i: F.col("r.runs").isNull() | ~F.exists(
        "r.runs", lambda r: (i >= r["first"]) & (i < r["end"])))
    joined = docs.alias("d").join(runs, F.col("d.doc_id").eqNullSafe(F.col("r.doc_id"))
                                  & (F.xxhash64("d.text") == F.col("r.key")), "left")
    others = [F.col(f"d.`{c}`") for c in docs.columns if c != "text"]
    return joined.select(*others, F.when(F.col("r.runs").isNull(), F.col("d.text")).otherwise(
        F.array_join(stays, "\n")).alias("text"), F.size(lines).cast("long").alias("lines"),
        (F.size(lines) - F.size(stays)).cast("long").alias("removed_lines"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return drop_repeats(docs).select("doc_id", F.coalesce("lines", F.lit(0)).alias("n_lines"),
                                     F.coalesce("removed_lines", F.lit(0)).alias("n_removed"), "text")


QUERIES = {"op5_line_dedup": op5_line_dedup}
