r"""Personal data: four exact kinds, and a bootstrapped contextual extraction.

``base_spans`` finds e-mail addresses, IP addresses, card and phone numbers
by their formats.  Positions come from the text's own pieces: the gaps
between matches and the matches, whose lengths add up.

The contextual part extends them with Spark joins and aggregates only.  The
base entities are the seeds.  A label is a word with a following ``:``,
``=`` or ``#``, and each occurrence of a label before a token is an edge
between the label (a lexical pattern) and the token (an instance).  In each
of ``ROUNDS`` rounds

- a label's confidence is the mean score of its occurrences over all texts,
  where a seed scores 1 and any other token the confidence it has reached;
- an instance's score is the highest confidence among the labels with at
  least ``MIN_SUPPORT`` distinct scored instances that precede it somewhere.

Tokens that look like identifiers (a digit, six letters or digits at least)
and follow a label of confidence ``MIN_CONFIDENCE`` or more become spans of
kind ``id``; those that meet a base span are left to it.

Defined results: a null text is empty and has no spans; a null id is kept;
repeated rows are reported each; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.llm.common import cut, read_table

KINDS = ("email", "ip", "card", "phone")
FOUND = "id"
ROUNDS = 3
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.5

# The formats.  A match can begin only where a run of its first characters
# begins or the last match ended (\G): any later start in the run would fail
# for the same reason, and is not tried.
_FORMATS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for its kind to be looked for.
_NEEDS = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}

_LABEL = r"(?:\G|(?<![\p{L}_-]))[\p{L}_-]++[ \t]*+[:=#]++[ \t]*+[\"']?+"
_TOKEN = r"[^\s\"',;<>]++"
_SPAN = "array<struct<start:int,end:int,hit:string>>"


def matches(text: Column, pattern: str, needs: str) -> Column:
    """(start, end, hit) of the leftmost non-overlapping matches, in code
    points; texts without ``needs`` are not searched."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits,
                       lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], one).alias("out"))

    empty = F.expr(f"cast(array() as {_SPAN})")
    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.regexp_like(text, F.lit(needs)), found).otherwise(empty)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = 2 * d
        return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), worth), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.regexp_like(
            p, F.lit("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$")))
    digits = _digits(hit)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(matches(text, _FORMATS[kind], _NEEDS[kind]), lambda s: _valid(kind, s["hit"]))


def labelled_tokens(text: Column) -> Column:
    """(label, token, start, end) of the tokens that follow a label."""
    def parts(s: Column) -> Column:
        label = F.regexp_extract(s["hit"], rf"^(?:{_LABEL})", 0)
        token = F.rtrim(F.substring(s["hit"], F.length(label) + 1, F.length(s["hit"])), F.lit(".:!?)"))
        start = s["start"] + F.length(label)
        return F.struct(F.lower(F.regexp_replace(label, r"[ \t]", "")).alias("label"), token.alias("token"),
                        start.alias("start"), (start + F.length(token)).alias("end"))

    return F.transform(matches(text, _LABEL + _TOKEN, "[:=#]"), parts)


def scored_labels(edges: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(label, confidence) from ``edges`` (label, token, n, seeds): how often a
    label precedes a token, and how often the token is then a base entity."""
    edges = edges.withColumn("score", F.col("seeds") / F.col("n"))
    for k in range(rounds):
        labels = (edges.groupBy("label").agg(
            (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("confidence"),
            F.sum((F.col("score") > 0).cast("long")).alias("support"))
            .filter(F.col("support") >= min_support).select("label", "confidence"))
        if k == rounds - 1:
            return labels
        reached = (edges.join(labels, "label").groupBy("token").agg(F.max("confidence").alias("reached")))
        edges = cut(edges.join(reached, "token", "left").select(
            "label", "token", "n", "seeds",
            F.greatest(F.col("seeds") / F.col("n"), F.coalesce("reached", F.lit(0.0))).alias("score")))
    return labels


def find(docs: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Spans of ``docs`` (doc_id, text): an array for each base kind and ``id``."""
    text = F.coalesce("text", F.lit(""))
    rows = cut(docs.select("doc_id", text.alias("text")).select(
        "doc_id", F.xxhash64("text").alias("key"), *[base_spans(F.col("text"), k).alias(k) for k in KINDS],
        labelled_tokens(F.col("text")).alias("labelled")))

    base = F.concat(*KINDS)
    looks = F.regexp_like(F.col("o.token"), F.lit("[0-9]")) & (
        F.length(F.regexp_replace(F.col("o.token"), r"[^\p{L}0-9]", "")) >= 6)
    # A seed's instance is the whole entity, of which the token may be a part.
    entity = F.get(F.filter("base", lambda s: s["start"] == F.col("o.start")), F.lit(0))["hit"]
    uses = (rows.select("doc_id", "key", F.explode("labelled").alias("o"), base.alias("base"))
            .select("doc_id", "key", "o.label", F.coalesce(entity, F.col("o.token")).alias("token"), "o.start", "o.end",
                    looks.alias("looks"), entity.isNotNull().alias("seed"),
                    F.exists("base", lambda s: (s["start"] < F.col("o.end")) & (F.col("o.start") < s["end"]))
                    .alias("taken")))
    edges = cut(uses.groupBy("label", "token").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("seed").cast("long")).alias("seeds")))
    sure = scored_labels(edges).filter(F.col("confidence") >= min_confidence).select("label")
    found = (uses.filter(F.col("looks") & ~F.col("taken")).join(sure, "label", "left_semi")
             .groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(FOUND)))
    return (rows.alias("r").join(found.alias("f"), F.col("r.doc_id").eqNullSafe(F.col("f.doc_id"))
                                 & (F.col("r.key") == F.col("f.key")), "left")
            .select("r.doc_id", *[F.col(f"r.{k}") for k in KINDS],
                    F.coalesce(F.col(f"f.{FOUND}"), F.expr("cast(array() as array<struct<start:int,end:int>>)"))
                    .alias(FOUND)))


def listed(kind: str) -> Column:
    return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return spans.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.concat(*map(listed, KINDS)), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*map(listed, KINDS), listed(FOUND)), ",").alias("spans"))


QUERIES = {"op7_pii": op7_pii}
