"""License scan by ordered signature rules.

Texts are taken as words: runs of a-z (A-Z lowered), digits and characters
beyond ASCII, with one space between.  The rules (``license_rules``) are
regular expressions over that.  One pass of an Aho-Corasick automaton over
the text finds all keywords of all rules; a rule is only tried around the
hits of its keyword, so most texts meet no expression at all and the cost
does not grow with the number of rules.

Detections overlap: a grant names a license, whose name holds an
abbreviation.  A detection is suppressed if one that ranks higher contains
its interval: one of a stronger kind, or of the same kind and longer, or with
the same interval and of an earlier rule.  One sweep over the detections in
order of their starts decides all of them.

The fixed phrases (``PHRASES``) are reported at every place, also where
detections suppress or overlap them, and their labels stay.

Texts are independent, so there is no shuffle, and copies or a hot source
spread as the rows do.  A task holds about ``SLICE_BYTES`` of text, or one
longer text.

Defined results: null, empty and wordless texts have no words and no
detections, empty labels and score 0; null ids and repeated rows are reported
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.llm.common import read_table
from tillpoint.llm.license_rules import KINDS, PARTS, PHRASES, RULES
from tillpoint.llm.packing import slices

SLICE_BYTES = 8 << 20
REACH = 640  # no pattern matches more characters; tested

# Byte for byte: A-Z lowered, other ASCII than letters and digits to a space.
_WORDS_ONLY = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_RANK = {kind: k for k, kind in enumerate(KINDS)}


def expression(pattern: str) -> str:
    """A rule's pattern with its parts filled in, over whole words."""
    for part, text in PARTS.items():
        pattern = pattern.replace(part, text)
    return f"(?<= )(?:{pattern})(?= )"


@cache
def _compiled() -> tuple[ahocorasick.Automaton, list[re.Pattern]]:
    """The automaton of the keywords, with the rules (or the phrase) of each."""
    holders: dict[str, tuple[list[int], str | None]] = {}
    for k, (_, _, keyword, _) in enumerate(RULES):
        holders.setdefault(keyword, ([], None))[0].append(k)
    for label, phrase in PHRASES.items():
        holders[f" {phrase} "] = ([], label)
    automaton = ahocorasick.Automaton()
    for keyword, what in holders.items():
        automaton.add_word(keyword, (len(keyword), *what))
    automaton.make_automaton()
    return automaton, [re.compile(expression(pattern)) for _, _, _, pattern in RULES]


def suppress(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The detections (start, end, rule) that no higher one contains, by start."""
    rank = [_RANK[kind] for kind, _, _, _ in RULES]
    furthest = [-1] * len(_RANK)  # the last end so far, of detections of a kind and the stronger ones
    kept = []
    for start, end, rule in sorted(set(found), key=lambda d: (d[0], -d[1], rank[d[2]], d[2])):
        if furthest[rank[rule]] < end:
            kept.append((start, end, rule))
            for weaker in range(rank[rule], len(furthest)):
                furthest[weaker] = max(furthest[weaker], end)
    return kept


def detect(text: str) -> tuple[list[tuple[int, str]], list[tuple[int, int, int]]]:
    """Places of the phrases and unsuppressed detections in ``text``, which has
    one space before and after each word: (start, label), (start, end, rule)."""
    automaton, patterns = _compiled()
    phrases, windows = [], {}
    for end, (size, rules, label) in automaton.iter(text):
        if label is not None:
            phrases.append((end - size + 2, label))
        low, high = max(0, end - REACH), end + REACH
        for rule in rules:
            own = windows.setdefault(rule, [])
            if own and own[-1][1] >= low:
                own[-1][1] = high
            else:
                own.append([low, high])
    found = [(m.start(), m.end(), rule) for rule, own in windows.items() for low, high in own
             for m in patterns[rule].finditer(text, low, high)]
    return sorted(phrases), suppress(found)


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id, ``n_words``, ``phrases`` (all places of
    the fixed phrases) and ``found`` (the detections that stay), by start;
    places count words from 0, ends are exclusive."""
    kind = docs.schema[id_col].dataType.simpleString()

    def spans(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, phrases, found = [], [], []
        for raw in batch.column(1).cast(pa.large_binary()).to_pylist():
            own = (raw or b"").translate(_WORDS_ONLY).split()
            n_words.append(len(own))
            # One character for each byte, so places are those of the bytes.
            text = f" {b' '.join(own).decode('latin-1')} "
            said, seen = detect(text)
            if not said and not seen:
                phrases.append([]), found.append([])
                continue
            spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
            word = lambda at: int(np.searchsorted(spaces, at)) - 1
            phrases.append([{"label": label, "start": word(start)} for start, label in said])
            found.append([{"label": RULES[rule][1], "kind": RULES[rule][0], "rule": rule, "start": word(start),
                           "end": word(end - 1) + 1} for start, end, rule in seen])
        place = pa.struct([("label", pa.string()), ("start", pa.int64())])
        detection = pa.struct([("label", pa.string()), ("kind", pa.string()), ("rule", pa.int32()),
                               ("start", pa.int64()), ("end", pa.int64())])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(phrases, pa.list_(place)),
             pa.array(found, pa.list_(detection))], names=[id_col, "n_words", "phrases", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, SLICE_BYTES):
                yield spans(some)

    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_words long, phrases array<struct<label string, start long>>, "
             "found array<struct<label string, kind string, rule int, start long, end long>>")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score is the confidence of the strongest detection; a phrase counts
    as a notice."""
    found = find_licenses(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    strength = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    base = F.array_sort(F.array_distinct("phrases.label"))
    strengths = F.concat(F.transform("found.kind", lambda k: F.element_at(strength, k)),
                         F.transform("phrases", lambda _: F.lit(KINDS["notice"])))
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.start").alias("first_word"), F.array_max("phrases.start").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.col("phrases.label"), F.col("found.label"))), ",").alias("labels"),
        F.coalesce(F.array_max(strengths), F.lit(0.0)).alias("score"))


QUERIES = {"op12_licenses": op12_licenses}
