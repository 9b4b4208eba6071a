r"""Document fingerprints: a homomorphic multiset hash of paragraphs.

The fingerprint of a text is the sum of the vectors of its paragraphs, each
lane modulo a power of two.  Sums do not depend on the order of paragraphs,
and a paragraph is added or taken out by adding or subtracting its vector
(``combine``), without the rest of the text.  A paragraph's vector has

- four lanes modulo 2^32 from two hashes of the whole paragraph, which tell
  equal multisets of paragraphs from others;
- the number of its chunks (up to four words each, counted from the start
  of the paragraph), modulo 2^32;
- 64 lanes modulo 2^16, each the number of chunks whose hash has that bit.

Twice a bit count less the chunk count is a sum of random signs, so the
squared difference of two such vectors estimates how many chunks two texts
do not share; ``likeness`` is one minus its share of both texts' own squares.

Everything is a row expression of the text: no explode and no group.  The
query needs each document's neighbour in id order; it shuffles each text
once, into ranges of ids, and adds to each range the first document of the
next one.

Defined results: a null text is empty; empty texts have one empty paragraph
and no chunks, are fully like each other and not like any other; equal ids
are ordered by text; null ids come last; a single document is its own
neighbour; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import read_table

WORDS = 4
LANES = 32  # longs with two lanes each
HEAD = 5
BUCKETS = 4096
ROWS_PER_BUCKET = 1_000

_PAIR = 0x0000000100000001
_LOW32 = 0xFFFFFFFF


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def vector(text: Column) -> Column:
    """The fingerprint as an array of longs: four paragraph lanes, the number
    of chunks, then ``LANES`` pairs of bit counts."""
    lines = F.split(text, "\n", -1)
    chunks = F.transform(F.regexp_extract_all(text, F.lit(rf"(?:\S++[ \t]*+){{1,{WORDS}}}+"), F.lit(0)), lambda c: F.xxhash64(c))
    low = F.lit(_LOW32).cast("long")

    def half(hashes: Column, shift: int) -> Column:
        return _sum(F.transform(hashes, lambda h: F.shiftrightunsigned(h, shift).bitwiseAND(low))).bitwiseAND(low)

    one = F.transform(lines, lambda p: F.xxhash64(p))
    two = F.transform(lines, lambda p: F.xxhash64(F.lit(1), p))
    bits = F.aggregate(
        chunks, F.array_repeat(F.lit(0).cast("long"), LANES),
        lambda acc, h: F.transform(acc, lambda a, j: a + F.call_function("shiftright", h, j).bitwiseAND(
            F.lit(_PAIR).cast("long"))),
        lambda acc: F.transform(acc, lambda a: a.bitwiseAND(F.lit(0x0000FFFF0000FFFF).cast("long"))))
    head = F.array(half(one, 0), half(one, 32), half(two, 0), half(two, 32), F.size(chunks).cast("long"))
    return F.concat(head, bits)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the union of two texts' paragraphs, or with ``sign`` -1
    of ``a`` without the paragraphs of ``b``."""
    low, pair = F.lit(_LOW32).cast("long"), F.lit(0xFFFF).cast("long")

    def head(x: Column, y: Column) -> Column:
        return (x + sign * y).bitwiseAND(low)

    def lanes(x: Column, y: Column) -> Column:
        up = (F.shiftrightunsigned(x, 32) + sign * F.shiftrightunsigned(y, 32)).bitwiseAND(pair)
        down = (x.bitwiseAND(pair) + sign * y.bitwiseAND(pair)).bitwiseAND(pair)
        return F.shiftleft(up, 32).bitwiseOR(down)

    return F.concat(F.zip_with(F.slice(a, 1, HEAD), F.slice(b, 1, HEAD), head),
                    F.zip_with(F.slice(a, HEAD + 1, LANES), F.slice(b, HEAD + 1, LANES), lanes))


def as_string(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: F.lower(F.hex(x))), "-")


def _signed(x: Column) -> Column:
    """The residue modulo 2^16 nearest to zero."""
    return F.pmod(x + 32768, F.lit(65536)) - 32768


def _square(x: Column, n: Column) -> Column:
    """Sum of squares of both lanes of a pair, as sums of signs over ``n`` chunks."""
    up = _signed(2 * F.shiftright(x, 32) - n)
    down = _signed(2 * x.bitwiseAND(F.lit(0xFFFF).cast("long")) - n)
    return up * up + down * down


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common chunks, from 0 to 1, from two fingerprints."""
    n_a, n_b = F.get(a, F.lit(HEAD - 1)), F.get(b, F.lit(HEAD - 1))
    lanes_a, lanes_b = F.slice(a, HEAD + 1, LANES), F.slice(b, HEAD + 1, LANES)

    def apart(x: Column, y: Column) -> Column:
        mask = F.lit(0xFFFF).cast("long")
        up = _signed(2 * (F.shiftright(x, 32) - F.shiftright(y, 32)) - (n_a - n_b))
        down = _signed(2 * (x.bitwiseAND(mask) - y.bitwiseAND(mask)) - (n_a - n_b))
        return up * up + down * down

    own = _sum(F.transform(lanes_a, lambda x: _square(x, n_a))) + _sum(F.transform(lanes_b, lambda x: _square(x, n_b)))
    off = _sum(F.zip_with(lanes_a, lanes_b, apart))
    return (F.when(a == b, F.lit(1.0)).when(own == 0, F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), 1 - off / own)))


def with_fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    return docs.withColumn(out_col, as_string(vector(F.coalesce(F.col(text_col), F.lit("")))))


def _bucketed(docs: DataFrame, buckets: int, rows_per_bucket: int) -> DataFrame:
    """``docs`` (doc_id, text) with a ``bucket`` that rises with the id, and in
    each bucket, marked ``guest``, the first document of the next lower one (in
    the lowest: of the highest).  At most ``buckets`` + 2 of them."""
    lo, hi, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    lo, hi = lo or 0, hi or 0
    ranges = max(1, min(buckets, n // rows_per_bucket))
    width = -(-(hi - lo + 1) // ranges)
    low = abs(lo) // width * (1 if lo > 0 else -1) - 1
    bucket = F.coalesce(F.call_function("div", F.col("doc_id"), F.lit(width)), F.lit(low))
    own = docs.withColumn("bucket", bucket.cast("long"))
    # A window over all buckets: their number is bounded by the parameter.
    down = Window.orderBy(F.desc("bucket"))
    heads = (own.groupBy("bucket").agg(F.max("doc_id").alias("head"))
             .withColumn("host", F.coalesce(F.lag("bucket").over(down), F.min("bucket").over(
                 down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))))
    guests = (own.alias("d").join(F.broadcast(heads).alias("h"), (F.col("d.bucket") == F.col("h.bucket"))
                                  & F.col("d.doc_id").eqNullSafe(F.col("h.head")))
              .select("d.doc_id", "d.text", F.col("h.host").alias("bucket"), F.lit(True).alias("guest")))
    return own.withColumn("guest", F.lit(False)).unionByName(guests)


def edited_pairs(docs: DataFrame, buckets: int = BUCKETS, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Each document with its fingerprint, its edited text's and its neighbour's."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("doc_id"), F.desc("text"))
    n, k = F.col("n_chars"), F.col("n_chars") - F.call_function("div", F.col("n_chars"), F.lit(3)) * 1
    return (_bucketed(docs, buckets, rows_per_bucket)
            .withColumn("next_text", F.lead("text").over(order))
            .withColumn("n_chars", F.length("text").cast("long"))
            .withColumn("own", vector(F.col("text")))
            .withColumn("edited", F.concat(F.substring("text", F.lit(1), k.cast("int")),
                                           F.substring("next_text", F.lit(1), (n - k).cast("int"))))
            .withColumn("next", F.lead("own").over(order))
            .filter(~F.col("guest"))
            .withColumn("changed", vector(F.col("edited"))))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = edited_pairs(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("own")).alias("fingerprint"), as_string(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"))


QUERIES = {"op2_fingerprint": op2_fingerprint}
