"""Near-duplicate search by bottom-k sketches from one hash function.

A document's set is the distinct hashes of its word shingles; its sketch is
the ``K`` smallest.  Documents with equal sets form a class, and the search
runs on classes.

Inverted lists.  A list is kept for each pair of neighbouring values among
the ``RUN`` smallest of a sketch.  Two sets with a similarity of 0.8 have a
common neighbouring pair there but for a chance of about 1e-11, and always
when their sketches are complete; the pair instead of the single value keeps
one frequent shingle from gathering a large part of the corpus.

Links.  The union-sketch estimate drops hopeless candidates, the rest are
verified on the full sets, and verified links give components.  Candidates:

- Every member of a list is tied to the list's pivot, the member whose own
  lists are longest in sum, so a list's candidates grow with its length and
  not with its square.  In a large group of near copies that is the one
  nearest to their common origin.
- A list of at most ``SHORT`` members that then spans several components is
  expanded, between components only.
- Longer lists that span several components get another pivot, one that has
  not been a pivot before, for as long as a round leaves at most half of the
  components there.
- The members of the long lists that still span several components get lists
  for each run of three neighbouring values among all ``K``, which far fewer
  texts that are not alike have in common, and these are expanded and tied in
  the same way.  Two sets with a similarity of 0.8 have a common run but for a
  chance of about 1e-10, and always when their sketches are complete, except
  for sets of four and five values: sets of at most ``SMALL`` keep pairs too.
- The members of the long ones of these that still span several components are
  joined on sketches of ``WIDE`` values, which for most texts are their whole
  sets, between components only.  Values that one component has to itself are
  left out; most members then have too few left for any link, and a bit filter
  of the others finds them before any row of theirs moves.  With the others of
  a sketch ordered from rare to frequent, the first common one of a pair must stand early enough in both to
  leave what a link has in common: exactly where both sketches are whole sets,
  else up to ``_WIDE_SLACK``, six deviations of the estimate.  A pair with one of
  the ``RARER`` next rarer values in common is left to that one, so that pairs
  meet once or a few times and never less.  Sizes are part of the key, and long
  keys are split into blocks.  The same bound on the two
  sketches then drops the rest before the full sets are compared.

Defined results: null and empty texts and texts without a word have an empty
set and link with nothing, not even each other; rows with equal ids count as
one document for the links; null ids are null components and kept; repeated
rows are reported each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillpoint.llm.bitfilter import bit_filter
from tillpoint.llm.common import Packed, cut, frugal, packed, read_table, release
from tillpoint.llm.components import components
from tillpoint.llm.packing import slices
from tillpoint.llm.words import hashed_runs, hashed_words

K = 64
RUN = 40
SHORT = 32
SMALL = 5  # values of the sets that need not have a run of three in common
LONG_SHARE = 0.15  # of a pivot round's members; the last join has no such bound
BLOCK = 1000
MAX_BROADCAST_IDS = 500_000
SKETCHES_A_TASK = 8_000
SETS_A_TASK = 1_000
SLICE_BYTES = 4 << 20
WIDE = 256
RARER = 4  # values that a row of the last join carries along
_ESTIMATE_SLACK = 0.3  # six deviations of an estimate of 0.8 from K values
_WIDE_SLACK = 0.15  # the same from WIDE values


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (63 bits)."""
    words, starts = hashed_words(texts)
    runs = hashed_runs(words, list(range(width))) >> np.uint64(1)
    out = []
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a >= width:
            out.append(np.unique(runs[a: b - width + 1]))
        elif b > a:  # fewer words: the whole sequence as one shingle
            out.append(hashed_runs(words[a:b], list(range(b - a))) >> np.uint64(1))
        else:
            out.append(runs[:0])
    return out


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(ends, pa.array(flat.astype(np.int64)))


def sketches(docs: DataFrame, width: int, k: int = K) -> DataFrame:
    """``doc_id``, ``n`` (set size), ``one`` and ``two`` (a 128-bit hash of the
    set) and ``sketch`` of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, SLICE_BYTES):
                sets = shingle_sets(some.column(1), width)
                whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(whole[::2]),
                     pa.array(whole[1::2]), _lists([s[:k] for s in sets])], names=["doc_id", "n", "one", "two", "sketch"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(
        frugal(run), "doc_id long, n long, one long, two long, sketch array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """``id`` and ``whole``, the set's bytes, of ``docs`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, SLICE_BYTES):
                sets = [s.astype("<u8").tobytes() for s in shingle_sets(some.column(1), width)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.large_binary()).cast(pa.binary())],
                                                 names=["id", "whole"])

    return docs.select("id", "text").mapInArrow(frugal(run), "id long, whole binary")


def linked(pairs: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b, set_a, set_b) with 100 * common >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                yes.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(frugal(run), "a long, b long")


def _estimate(a: Column, b: Column, k: int) -> Column:
    """Share of the union sketch's values that both sides hold."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


class Search:
    """The rounds over one table of classes."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, percent: int, k: int):
        self.docs, self.classes, self.width, self.percent, self.k = docs, classes, width, percent, k
        self.links: list[DataFrame] = []
        self.compared: list[DataFrame] = []  # (a, b), each pair in one of them
        self.sets: list[DataFrame] = []  # (id, whole), each id in one of them
        self.read: list[DataFrame] = []  # their ids
        self.nodes: DataFrame | None = None

    def verified(self, candidates: DataFrame) -> DataFrame:
        """The links among ``candidates`` (a, b)."""
        own = self.classes.select("id", "sketch")
        near = (candidates.join(own.alias("x"), F.col("a") == F.col("x.id")).join(own.alias("y"), F.col("b") == F.col("y.id"))
                .filter(_estimate(F.col("x.sketch"), F.col("y.sketch"), self.k) >= self.percent / 100 - _ESTIMATE_SLACK)
                .select("a", "b"))
        if self.compared:
            near = near.join(reduce(DataFrame.unionByName, self.compared), ["a", "b"], "left_anti")
        near = packed(near).rows
        self.compared.append(near)
        self._read_sets(near.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        sets = reduce(DataFrame.unionByName, self.sets)
        pairs = (near.join(sets.select(F.col("id").alias("a"), F.col("whole").alias("set_a")), "a")
                 .join(sets.select(F.col("id").alias("b"), F.col("whole").alias("set_b")), "b"))
        return linked(pairs, self.percent)

    def crossing(self, members: DataFrame) -> DataFrame:
        """All pairs (a, b) of ``members`` (id, n, component) in different
        components that their wide sketches admit as links."""
        own = sketches(self._texts(packed(members.select("id").distinct())).withColumnRenamed("id", "doc_id"), self.width, WIDE)
        wide = packed(own.select(F.col("doc_id").alias("id"), "n", "sketch").distinct(), SKETCHES_A_TASK * K // WIDE).rows
        pairs = _prefix_join(members.join(wide, ["id", "n"]), self.percent)
        x, y = wide.alias("x"), wide.alias("y")
        both = (pairs.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id")))
        common = F.size(F.array_intersect("x.sketch", "y.sketch"))
        whole = (F.col("x.n") <= WIDE) & (F.col("y.n") <= WIDE)
        return both.filter(F.when(whole, common * (100 + self.percent) >= self.percent * (F.col("x.n") + F.col("y.n"))).otherwise(
            _estimate(F.col("x.sketch"), F.col("y.sketch"), WIDE) >= self.percent / 100 - _WIDE_SLACK)).select("a", "b")

    def _texts(self, wanted: Packed) -> DataFrame:
        """(id, text) of the ids ``wanted``."""
        few = F.broadcast(wanted.rows) if wanted.count <= MAX_BROADCAST_IDS else wanted.rows
        return (self.docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(few, "id", "left_semi")
                .filter(F.col("id").isNotNull()))

    def _read_sets(self, wanted: DataFrame) -> None:
        """Read the full sets of the ids that no earlier round has read."""
        if self.read:
            wanted = wanted.join(reduce(DataFrame.unionByName, self.read), "id", "left_anti")
        fresh = packed(wanted)
        if not self.sets or fresh.count:
            self.read.append(fresh.rows)
            sets = cut(full_sets(self._texts(fresh), self.width).distinct())
            self.sets.append(sets.coalesce(-(-fresh.count // SETS_A_TASK) or 1))

    def add(self, candidates: DataFrame) -> tuple[DataFrame, bool]:
        """Verify; the components of all links so far as (node, component), and
        whether any of the candidates is a link."""
        links = packed(self.verified(packed(candidates).rows).distinct())
        self.links.append(links.rows)
        release(self.docs.sparkSession)
        if len(self.links) > 1 and not links.count:
            return self.nodes, False
        edges = self.links[0]
        for more in self.links[1:]:
            edges = edges.unionByName(more)
        self.nodes = packed(components(edges)).rows
        return self.nodes, True


def _may_link(n: str, m: str, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _tied(lists: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """The pairs of each member of ``lists`` (key, id, n, component) with its
    list's pivot, where the two are not yet in one component."""
    return (lists.join(pivots, "key").filter("id <> pivot and component <> pivot_component")
            .filter(_may_link("n", "pivot_n", percent))
            .select(F.greatest("id", "pivot").alias("a"), F.least("id", "pivot").alias("b")).distinct())


def _best(lists: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("id", "n", "component"), F.struct("quality", -F.col("id")))
    return lists.groupBy("key").agg(best.alias("best")).select(
        "key", F.col("best.id").alias("pivot"), F.col("best.n").alias("pivot_n"),
        F.col("best.component").alias("pivot_component"))


def _open(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """``lists`` with the components of their members, where they differ."""
    named = (lists.join(nodes, F.col("id") == F.col("node"), "left")
             .select("key", "id", "n", "m", "quality", "long", F.coalesce("component", "id").alias("component")))
    several = (named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
               .filter("low <> high").select("key"))
    return packed(named.join(several, "key", "left_semi")).rows


def _parts(lists: DataFrame, short: int) -> int:
    """How many components the long ones of ``lists`` span."""
    return lists.filter(F.col("m") > short).select("component").distinct().count()


def _expanded(lists: DataFrame, percent: int) -> DataFrame:
    x, y = lists.alias("x"), lists.alias("y")
    return (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") > F.col("y.id"))
                   & (F.col("x.component") != F.col("y.component")) & _may_link("x.n", "y.n", percent))
            .select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())


def _size_bin(n: Column, percent: int) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(100 / percent)))


def _among(members: DataFrame, values: DataFrame) -> DataFrame:
    """``members`` (id, n, sketch) with those values of the sketches only that
    may be among ``values`` (a written table)."""
    known = bit_filter(values, "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy()
            held = known.may_hold(flat.view(np.uint64))
            before = np.concatenate([[0], np.cumsum(held)])[ends - ends[0]].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(before, pa.array(flat[held]))], names=["id", "n", "sketch"])

    return members.mapInArrow(frugal(run), "id long, n long, sketch array<long>")


def _prefix_join(members: DataFrame, percent: int, wide: int | None = None) -> DataFrame:
    """The pairs of ``members`` (id, n, component, sketch of ``wide`` values) in
    different components whose first common value, from rare to frequent, leaves
    room for a link."""
    wide = wide or WIDE
    share = percent / 100 - _WIDE_SLACK
    sizes = members.select("id", "n", "component", F.least("n", F.lit(wide)).alias("s"))
    # Pairs of interest have none of the values that one component has to itself.
    several = packed(members.select("component", F.explode("sketch").alias("value")).groupBy("value")
                  .agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("low"), F.max("component").alias("high"))
                  .filter("low <> high").select("value", "m")).rows
    # No partner is longer than n * 100 / percent; up to there all are whole sets.
    exact = F.col("n") * 100 <= wide * percent

    def room_from(count: Column, s: Column) -> Column:
        return F.when(exact, count * 100 >= percent * F.col("n")).otherwise(count >= share * s)

    held = (_among(members.select("id", "n", "sketch"), several)
            .filter(room_from(F.size("sketch"), F.least("n", F.lit(wide)))).select("id", F.explode("sketch").alias("value")))
    order = Window.partitionBy("id").orderBy(F.desc("m"), F.desc("value"))
    # How many values of the sketch may still be common from this one on, and
    # the next rarer ones: a pair that has one of them in common meets there too.
    rest = F.row_number().over(order)
    rarer = F.collect_list("value").over(order.rowsBetween(1, RARER))
    rows = cut(held.join(several, "value").withColumn("rest", rest).withColumn("rarer", rarer).drop("m")
               .join(sizes, "id").filter(room_from(F.col("rest"), F.col("s"))))
    lowest = F.greatest(F.lit(1), F.ceil(percent * F.col("n") / 100))
    left, right = F.least("x.rest", "y.rest"), F.col("x.n") + F.col("y.n")
    room = F.when(F.greatest("x.n", "y.n") <= wide, left * (100 + percent) >= percent * right).otherwise(
        left >= share * F.greatest("x.s", "y.s"))
    large = rows.withColumn("bin", F.explode(F.sequence(_size_bin(lowest, percent), _size_bin(F.col("n"), percent))))
    small = rows.withColumn("bin", _size_bin(F.col("n"), percent))
    keys = (large.select("value", "bin", "component", F.lit(0).alias("small"))
            .unionByName(small.select("value", "bin", "component", F.lit(1).alias("small")))
            .groupBy("value", "bin").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                         F.sum("small").alias("smalls")))
    keys = packed(keys.filter("low <> high and smalls > 0").select(
        "value", "bin", F.ceil(F.col("smalls") / BLOCK).alias("blocks"))).rows
    x = (large.join(keys, ["value", "bin"])
         .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).alias("x"))
    y = (small.join(keys, ["value", "bin"])
         .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("y"))
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("value", "bin", "block")]
    return (x.join(y, reduce(Column.__and__, same) & (F.col("x.component") != F.col("y.component"))
                   & ((F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") > F.col("y.id"))))
                   & _may_link("x.n", "y.n", percent) & room & ~F.arrays_overlap("x.rarer", "y.rarer"))
            .select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct())


def _run_keys(classes: DataFrame, length: int, most: int) -> DataFrame:
    """(id, n, own, key) for each run of ``length`` neighbouring values among
    the ``most`` smallest of a sketch; ``own`` counts them."""
    own = F.least(F.lit(most), F.size("sketch")) - (length - 1)
    keys = F.transform(F.sequence(F.lit(1), own), lambda i: F.xxhash64(*(F.element_at("sketch", i + j) for j in range(length))))
    return classes.filter(F.size("sketch") >= length).select("id", "n", own.alias("own"), F.explode(keys).alias("key"))


def _shared(every: DataFrame, short: int) -> DataFrame:
    """The lists of more than one member of ``every`` (id, n, own, key)."""
    counts = every.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    several = packed(every.join(counts, "key")).rows
    # A pair that no short list holds shares long lists only, and many of its own.
    quality = several.groupBy("id").agg(
        F.sum("m").alias("quality"),
        (F.sum((F.col("m") > short).cast("long")) >= F.max("own") * LONG_SHARE).alias("long"))
    return packed(several.select("key", "id", "n", "m").join(quality, "id")).rows


def _settled(search: Search, unfinished: DataFrame, used: DataFrame | None, short: int) -> tuple[Packed, DataFrame]:
    """Expand the short ones of the lists ``unfinished`` and tie the long ones
    to further pivots; the members (id, n, component) of the long lists that
    still span several components, and the pivots ``used`` so far."""
    expanded = _expanded(unfinished.filter(F.col("m") <= short), search.percent)
    left = _parts(unfinished, short)
    while True:
        fresh = unfinished.filter((F.col("m") > short) & F.col("long"))
        pivots = packed(_best(fresh.join(used, "id", "left_anti"))).rows
        tied = _tied(fresh, pivots, search.percent)
        nodes, found = search.add(tied if expanded is None else tied.unionByName(expanded).distinct())
        if found:
            unfinished = _open(unfinished.drop("component"), nodes)
        used = packed(used.unionByName(pivots.select(F.col("pivot").alias("id"))).distinct()).rows
        before, left = left, _parts(unfinished, short)
        if not left or 2 * left > before:
            return packed(unfinished.filter(F.col("m") > short).select("id", "n", "component").distinct()), used
        expanded = None


def link_components(docs: DataFrame, sketched: DataFrame, width: int, percent: int, k: int = K,
                    run: int = RUN, short: int = SHORT) -> DataFrame:
    """(node, component) of the classes that have a link."""
    classes = packed(sketched.filter("n > 0 and doc_id is not null").groupBy("one", "two")
                     .agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")),
                     SKETCHES_A_TASK).rows
    search = Search(docs, classes, width, percent, k)
    lists = _shared(_run_keys(classes, 2, run), short)
    release(docs.sparkSession)

    alone = lists.withColumn("component", F.col("id"))
    pivots = packed(_best(alone)).rows
    nodes, _ = search.add(_tied(alone, pivots, percent))
    used = pivots.select(F.col("pivot").alias("id")).distinct()
    members, used = _settled(search, _open(lists, nodes), used, short)
    del lists, alone, pivots
    if not members.count:
        return search.nodes
    # Runs of three hold far fewer texts that are not alike.
    own = packed(classes.join(members.rows.select("id"), "id", "left_semi"), SKETCHES_A_TASK).rows
    lists = _shared(_run_keys(own, 3, k).unionByName(_run_keys(own.filter(F.col("n") <= SMALL), 2, k)), short)
    members, used = _settled(search, _open(lists, search.nodes), used, short)
    del lists, own
    release(docs.sparkSession)
    return search.add(search.crossing(members.rows))[0] if members.count else search.nodes


def near_groups(docs: DataFrame, width: int, percent: int = 80) -> DataFrame:
    """A row for each of ``docs`` (doc_id, text): ``doc_id``, ``n_shingles``,
    ``component_id`` and ``kept``."""
    sketched = cut(sketches(docs, width))
    nodes = link_components(docs, sketched, width, percent)
    classes = (sketched.filter("n > 0").groupBy("one", "two").agg(F.min("doc_id").alias("id")))
    named = (sketched.select("doc_id", "n", "one", "two").join(classes, ["one", "two"], "left")
             .join(nodes, F.col("id") == F.col("node"), "left"))
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id")), "doc_id")
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read_table(spark, sf_dir, "documents", "doc_id", "text"), width=2)


QUERIES = {"op3_near_dedup": op3_near_dedup}
