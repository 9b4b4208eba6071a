"""Sharding by minimax contiguous partition of ordered atomic groups.

Rows with equal texts form one atomic group.  Groups are ordered by the
64-bit hash of their text, so a shard is a range of hashes and the shard of
a row is a pure expression of its text: no text is shuffled.  The cuts come
from a binary search for the smallest capacity that a greedy left-to-right
fill meets with the wanted number of shards.

The search sees every group without gathering them: Spark sums the sizes of
hash ranges ("cells"), at most ``MAX_CELLS`` of them reach the driver at
once, and only cells in which a cut can still fall are summed again at a
finer grain.  A cell that holds a single hash is an atom.  The refinement
ends when every cell near a cut is an atom, and the result is then the same
as the search over all groups one by one.

A group larger than the capacity takes a shard for itself, so one hot group
does not widen the other shards.  A greedy fill leaves its remainder in the
last shard, and in the one before such a group; the others are full but for
the size of a group.

Defined results: a null text counts as 0 bytes and all null and empty texts
form one group; null ids sort first in their slice; repeated rows get
separate slots; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import read_table, written

SHARDS = 24
ROW_OVERHEAD = 8
MAX_CELLS = 1 << 16
ROWS_PER_SLICE = 100_000


def text_key(text: Column) -> Column:
    """Order and identity of a group.  Equal texts have equal keys."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_OVERHEAD)


@dataclass(frozen=True)
class Cell:
    """Groups with hashes in [lo, hi]; an atom when the two are equal."""

    size: int
    lo: int
    hi: int


def _fill(cells: list[Cell], ends: list[int], capacity: int, divisible: bool) -> list[float]:
    """Greedy fill: the position in bytes at which each shard ends.

    ``divisible`` treats a cell of several groups as if it could be cut
    anywhere, which no real partition can beat; otherwise such a cell stays
    whole, which a real partition can always match.
    """
    cuts, at, total = [], 0, ends[-1] if ends else 0
    while at < total:
        k = bisect_right(ends, at + capacity)
        if k == len(cells):
            nxt = total
        else:
            nxt = ends[k - 1] if k else 0
            if divisible and cells[k].lo != cells[k].hi:
                nxt = at + capacity
            elif nxt <= at:  # the next group alone exceeds the capacity
                nxt = ends[k]
        cuts.append(nxt)
        at = nxt
    return cuts


def _smallest_capacity(cells: list[Cell], ends: list[int], shards: int, divisible: bool) -> int:
    low, high = 1, max(1, ends[-1])
    while low < high:
        mid = (low + high) // 2
        if len(_fill(cells, ends, mid, divisible)) <= shards:
            high = mid
        else:
            low = mid + 1
    return low


def _cells_near_cuts(cells: list[Cell], ends: list[int], shards: int) -> tuple[list[int], list[int]]:
    """Indices of the cells in which a cut can still fall, and the cut
    positions of the whole-cell fill."""
    low = _smallest_capacity(cells, ends, shards, divisible=True)
    high = _smallest_capacity(cells, ends, shards, divisible=False)
    early, late = _fill(cells, ends, min(low, high), False), _fill(cells, ends, max(low, high), True)
    near: set[int] = set()
    for j, last in enumerate(late):
        first = early[j] if j < len(early) else last
        first, last = min(first, last), max(first, last)
        for k in range(bisect_right(ends, first), min(bisect_right(ends, last), len(cells) - 1) + 1):
            if cells[k].lo != cells[k].hi:
                near.add(k)
    return sorted(near), _fill(cells, ends, high, False)


def _summed(groups: DataFrame, shift: int) -> list[Cell]:
    rows = (groups.groupBy(F.shiftright("key", shift).alias("cell"))
            .agg(F.sum("size").alias("size"), F.min("key").alias("lo"), F.max("key").alias("hi"))
            .collect())
    return sorted((Cell(r["size"], r["lo"], r["hi"]) for r in rows), key=lambda c: c.lo)


def _ranges(cells: list[Cell]) -> Column:
    test = F.lit(False)
    for c in cells:
        test = test | F.col("key").between(c.lo, c.hi)
    return test


def minimax_cuts(sized: DataFrame, shards: int, max_cells: int = MAX_CELLS) -> list[int]:
    """The largest key of each shard but the last, for ``sized`` (key, size).

    ``max_cells`` bounds the rows that one round brings to the driver.
    """
    cells = _summed(sized, 64 - (max_cells.bit_length() - 1))
    while cells:
        ends = list(accumulate(c.size for c in cells))
        near, cuts = _cells_near_cuts(cells, ends, shards)
        if not near:
            at = [bisect_right(ends, c) - 1 for c in cuts]
            return [cells[k].hi for k in at][: shards - 1]
        # As many open cells at once as keep the next round in bounds; runs of
        # neighbours are one range of keys.
        near = near[: max(1, max_cells // 256)]
        runs: list[list[int]] = []
        for k in near:
            if runs and runs[-1][-1] == k - 1:
                runs[-1].append(k)
            else:
                runs.append([k])
        spans = [Cell(0, cells[r[0]].lo, cells[r[-1]].hi) for r in runs]
        room = max_cells // len(near)
        widest = max((cells[k].hi - cells[k].lo).bit_length() for k in near)
        shift = max(0, widest - max(1, room.bit_length() - 1))
        fresh = _summed(sized.filter(_ranges(spans)), shift)
        gone = set(near)
        cells = sorted([c for k, c in enumerate(cells) if k not in gone] + fresh, key=lambda c: c.lo)
    return []


def shard_of(key: Column, cuts: list[int]) -> Column:
    """Number of cuts below the key."""
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (key > F.lit(c)).cast("int")
    return shard


def slots(rows: DataFrame, n_rows: int, per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``rows`` (shard, key, doc_id, ...) with their place in the shard, gapless
    from 0.  A shard is numbered in hash slices of about ``per_slice`` rows, and
    each slice starts where the counts of the ones before it end."""
    slices = max(1, -(-n_rows // per_slice))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "key"), F.lit(slices)))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
              .select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    within = Window.partitionBy("shard", "slice").orderBy("doc_id", "key", "size")
    return (rows.withColumn("place", F.row_number().over(within) - 1)
            .join(starts, ["shard", "slice"])
            .withColumn("slot", (F.col("first") + F.col("place")).cast("long")))


def with_shard(docs: DataFrame, shards: int = SHARDS, text_col: str = "text",
               shard_col: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row, balanced by bytes."""
    text = F.col(text_col)
    cuts = minimax_cuts(written(docs.select(text_key(text).alias("key"), row_size(text).alias("size")), "sizes"), shards)
    return docs.withColumn(shard_col, shard_of(text_key(text), cuts))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, text_col: str = "text") -> None:
    """One folder for each shard, written by as many tasks as hold its rows."""
    with_shard(docs, shards, text_col).write.mode("overwrite").partitionBy("shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    text = F.col("text")
    rows = written(docs.select(
        "doc_id", text_key(text).alias("key"), row_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")), "sizes")
    cuts = minimax_cuts(rows, SHARDS)
    placed = rows.withColumn("shard", shard_of(F.col("key"), cuts))
    return slots(placed, rows.count()).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_sharding": op10_sharding}
