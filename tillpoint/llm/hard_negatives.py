"""Hard negatives by Four-Russians scoring.

Vectors are whole numbers after quantising.  For each anchor and each group
of ``GROUP`` dimensions a table holds the sums of all 256 subsets of the
anchor's components there, each entry one addition away from another.  A
candidate's components are packed by bit plane (two's complement): one byte
for each plane and group.  A plane's bytes index the tables, the sum over the
groups is the anchor's product with that plane, and shifting and adding the
planes, the sign plane negative, gives the exact inner product.

Anchors are a query set against all rows.  They are read in rounds of at most
about ``ROUND_COMPONENTS`` components, each round's broadcast, and every task
meets them in blocks of ``BLOCK_ANCHORS`` against slices of ``SLICE_ROWS``
candidates, so memory does not grow with either side.  A task keeps, for each
query, its best rows so far, and only those are shuffled, so a vector or a
label that many rows share costs no more than others.  Each round makes two
passes: one for the positives, one for the negatives in the score range that
each positive sets.

Defined results: rows with a null label, a null vector, or a null or
non-finite component take no part; an absent component of a shorter vector
counts as 0; of rows with equal ids each is a row of its own (an anchor's
copy is one of its others, and a repeated anchor is answered once for each
row); a null id is no anchor, comes last among ties and is returned as null;
components beyond a long are the nearest long, and sums wrap as longs do; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import read_table, written

SCALE = 256
GROUP = 8
POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100  # a negative has between LOW and HIGH percent of the positive's score

ROUND_COMPONENTS = 1 << 20
BLOCK_ANCHORS = 64
SLICE_ROWS = 2048

_LAST = np.iinfo(np.int64).max
_FIRST = np.iinfo(np.int64).min


def quantised(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``label`` and whole ``parts`` of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf))
    return (vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                    F.transform(x, lambda v: F.floor(v * SCALE)).alias("parts")))


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): in each group of dimensions, the sum of the
    components whose bits are set, for anchors (anchors, groups * GROUP)."""
    n, dims = anchors.shape
    out = np.zeros((dims // GROUP, 1 << GROUP, n), np.int64)
    by_group = anchors.T.reshape(dims // GROUP, GROUP, n)
    for k in range(GROUP):
        out[:, 1 << k: 2 << k] = out[:, : 1 << k] + by_group[:, k: k + 1]
    return out


def bit_planes(parts: np.ndarray) -> np.ndarray:
    """(planes, groups, rows): bytes of the two's complement bits of ``parts``
    (rows, groups * GROUP), the sign plane last."""
    most = max(int(parts.max(initial=0)), -1 - int(parts.min(initial=0)))
    planes = most.bit_length() + 1
    rows, dims = parts.shape
    out = np.empty((planes, dims // GROUP, rows), np.uint8)
    for k in range(planes):
        bits = ((parts >> min(k, 63)) & 1).astype(np.uint8)
        out[k] = np.packbits(bits.reshape(rows, dims // GROUP, GROUP), axis=2, bitorder="little")[:, :, 0].T
    return out


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(rows, anchors): exact inner products by shift and add of look-ups."""
    out = np.zeros((planes.shape[2], tables.shape[2]), np.int64)
    for k in range(len(planes) - 1, -1, -1):
        own = np.zeros_like(out)
        for g in range(len(tables)):
            own += tables[g][planes[k, g]]
        out = -own if k == len(planes) - 1 else (out << 1) + own
    return out


@dataclass
class Best:
    """The best ``width`` rows of each query: by score, then by smaller id."""

    queries: int
    width: int
    score: np.ndarray = field(init=False)
    at: np.ndarray = field(init=False)
    known: np.ndarray = field(init=False)  # how many each query has

    def __post_init__(self) -> None:
        self.score = np.full((self.queries, self.width), _FIRST)
        self.at = np.full((self.queries, self.width), _LAST)
        self.known = np.zeros(self.queries, np.int64)

    def may_enter(self, query: np.ndarray, score: np.ndarray, at: np.ndarray) -> np.ndarray:
        last_score, last_at = self.score[query, -1], self.at[query, -1]
        return (self.known[query] < self.width) | (score > last_score) | ((score == last_score) & (at < last_at))

    def offer(self, query: np.ndarray, score: np.ndarray, at: np.ndarray) -> None:
        """Take in rows (score, id) for the given queries."""
        if not len(query):
            return
        touched = np.unique(query)
        held = np.repeat(touched, self.known[touched])
        slot = np.arange(len(held)) - np.repeat(np.cumsum(self.known[touched]) - self.known[touched], self.known[touched])
        query = np.concatenate([held, query])
        score = np.concatenate([self.score[held, slot], score])
        at = np.concatenate([self.at[held, slot], at])
        by = np.lexsort((at, ~score, query))
        query, score, at = query[by], score[by], at[by]
        start = np.searchsorted(query, query, "left")
        place = np.arange(len(query)) - start
        stay = place < self.width
        query, place = query[stay], place[stay]
        self.score[query, place], self.at[query, place] = score[stay], at[stay]
        self.known[touched] = np.bincount(np.searchsorted(touched, query), minlength=len(touched))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, place = np.nonzero(np.arange(self.width) < self.known[:, None])
        return query, self.score[query, place], self.at[query, place]


@dataclass
class Queries:
    """A round's queries: those of anchor ``anchor`` (in its order), of which
    rows with a score from ``low`` to ``high`` are wanted, of the anchor's
    label or of all others."""

    parts: np.ndarray  # (anchors, dims)
    label: np.ndarray  # of the anchors
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same_label: bool
    width: int


def _matrix(parts: pa.Array, dims: int) -> np.ndarray:
    """(rows, dims) of lists; shorter ones are filled with zeros."""
    sizes = np.diff(parts.offsets.to_numpy())
    flat = parts.flatten().to_numpy()
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[place < dims], place[place < dims]] = flat[place < dims]
    return out


def _round_up(dims: int) -> int:
    return -(-max(1, dims) // GROUP) * GROUP


def search(rows: DataFrame, queries: Queries) -> DataFrame:
    """``query`` (its number), ``score``, ``vec_id``: of all ``rows``, the best
    ``width`` of each query."""
    shared = rows.sparkSession.sparkContext.broadcast(vars(queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = Queries(**shared.value)
        dims = q.parts.shape[1]
        best = Best(len(q.anchor), q.width)
        edges = np.searchsorted(q.anchor, np.arange(0, len(q.label) + BLOCK_ANCHORS, BLOCK_ANCHORS))
        for batch in batches:
            tables_of = None
            ids = batch.column(0)
            at = ids.fill_null(_LAST).to_numpy()
            label = batch.column(1).to_numpy()
            planes = [bit_planes(_matrix(batch.column(2).slice(a, SLICE_ROWS), dims))
                      for a in range(0, batch.num_rows, SLICE_ROWS)]
            for block, first in enumerate(range(0, len(q.label), BLOCK_ANCHORS)):
                own = slice(first, first + BLOCK_ANCHORS)
                mine = np.arange(edges[block], edges[block + 1])
                if not len(mine) or (q.same_label and not np.isin(label, q.label[own]).any()):
                    continue
                tables_of = subset_sums(q.parts[own])
                column = q.anchor[mine] - first
                for k, some in enumerate(planes):
                    here = slice(k * SLICE_ROWS, (k + 1) * SLICE_ROWS)
                    _offer(best, q, mine, scores(some, tables_of)[:, column],
                           (label[here, None] == q.label[own][column]) == q.same_label, at[here])
        query, score, found = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(score), pa.array(found, mask=found == _LAST)],
                                         names=["query", "score", "vec_id"])

    each = rows.select("vec_id", "label", "parts").mapInArrow(run, "query long, score long, vec_id long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return each.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= queries.width)


def _offer(best: Best, q: Queries, mine: np.ndarray, score: np.ndarray, fits: np.ndarray, at: np.ndarray) -> None:
    row, column = np.nonzero(fits & (score >= q.low[mine]) & (score <= q.high[mine]))
    query, score, at = mine[column], score[row, column], at[row]
    enter = best.may_enter(query, score, at)
    best.offer(query[enter], score[enter], at[enter])


def _positives(rows: DataFrame, anchors: list, parts: np.ndarray, label: np.ndarray, most: int) -> list[tuple]:
    """(anchor's number, positive's id, score), each anchor's first ``most``
    other rows of its label."""
    n = len(anchors)
    # One more than wanted: the anchor itself may be among them.
    found = search(rows, Queries(parts, label, np.arange(n), np.full(n, _FIRST), np.full(n, _LAST), True, most + 1))
    own: list[list] = [[] for _ in range(n)]
    for r in found.orderBy("query", "place").collect():
        own[r["query"]].append((r["vec_id"], r["score"]))
    out = []
    for k, (anchor, near) in enumerate(zip(anchors, own)):
        self = (anchor["vec_id"], int((parts[k] * parts[k]).sum()))
        if self in near:  # one row with the anchor's id and score is the anchor
            near.remove(self)
        out += [(k, *x) for x in near[:most]]
    return out


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, round_components: int = ROUND_COMPONENTS) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score`` for the anchors among ``rows``
    (vec_id, label, parts): each anchor's first ``positives`` others of its
    label, and for each of these the first ``negatives`` of other labels with
    ``low`` to ``high`` percent of its score."""
    spark = rows.sparkSession
    size = rows.agg(F.max(F.size("parts")).alias("dims"),
                    F.sum(F.when(is_anchor, F.greatest(F.size("parts"), F.lit(GROUP)))).alias("total")).first()
    dims, rounds = _round_up(size["dims"] or 0), math.ceil((size["total"] or 0) / round_components)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    answers = None
    # Dealt to rounds by place, not by value, so that repeated rows spread too.
    dealt = written(rows.filter(is_anchor).select(
        "*", F.pmod(F.monotonically_increasing_id(), F.lit(max(1, rounds))).alias("round")), "anchors") if rounds else None
    for k in range(rounds):
        anchors = dealt.filter(F.col("round") == k).orderBy("vec_id", "label").collect()
        if not anchors:
            continue
        parts = np.zeros((len(anchors), dims), np.int64)
        for i, a in enumerate(anchors):
            parts[i, : len(a["parts"])] = a["parts"]
        label = np.array([a["label"] for a in anchors], np.int64)
        pairs = _positives(rows, anchors, parts, label, positives)
        if not pairs:
            continue
        anchor, positive, score = zip(*pairs)
        # low * p <= 100 * n <= high * p, in whole numbers of any size.
        bounds = [(max(-(-low * p // 100), int(_FIRST)), min(high * p // 100, int(_LAST))) for p in score]
        found = search(rows, Queries(parts, label, np.array(anchor), *(np.array(x, np.int64) for x in zip(*bounds)),
                                     False, negatives))
        names = spark.createDataFrame([(q, anchors[a]["vec_id"], p, s) for q, (a, p, s) in enumerate(pairs)],
                                      "query long, anchor_id long, positive_id long, positive_score long")
        answer = written(found.join(F.broadcast(names), "query").select(
            "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score")), "negatives")
        answers = answer if answers is None else answers.unionByName(answer)
    return spark.createDataFrame([], schema) if answers is None else answers


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(read_table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))


QUERIES = {"op11_hard_negatives": op11_hard_negatives}

SQL = {"op11_hard_negatives": """
WITH r AS (
  SELECT row_number() OVER () AS rid, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid AS arid, a.vec_id AS anchor_id, o.rid AS orid, o.vec_id AS other_id, a.label = o.label AS same,
         CAST(list_dot_product(a.v, o.v) AS BIGINT) AS score
  FROM r a JOIN r o ON a.rid <> o.rid WHERE a.vec_id % 100 = 0),
p AS (
  SELECT arid, anchor_id, orid AS prid, other_id AS positive_id, score AS positive_score
  FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, other_id, orid) <= 5),
n AS (
  SELECT p.anchor_id, p.positive_id, s.other_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.arid, p.prid ORDER BY s.score DESC, s.other_id, s.orid) AS rank
  FROM p JOIN s USING (arid)
  WHERE NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 5
"""}
