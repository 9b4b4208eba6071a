"""Language identification by prediction by partial matching.

Each language has a byte context tree of orders 0 to ``ORDER``.  A byte that
a context has seen n times among T, with D distinct ones, has probability
n / (T + D) there; otherwise the escape probability D / (T + D) times that
of the context one byte shorter, down to 1 / 256.  Statistics are frozen
after fitting, and a text's code length under a language is exact: the sum
over all its bytes.  The shortest code names the language.

The trees are fitted on a bounded sample: per language up to
``SAMPLE_BYTES`` bytes of distinct training texts, taken in the order of a
hash: whole ones of at most ``SAMPLE_TEXT_BYTES`` and, where a language has too
few of these, the first ``SAMPLE_TEXT_BYTES`` of longer ones.  All trees together
are one table, a row for each context that any tree has and in it, for each
byte, the code lengths under all languages, so a byte costs two look-ups.
Its size is bounded by the sample, and it is broadcast.

Defined results: null texts and texts without a letter are ``und`` with score
0, as is every text when nothing could be learned; a null id counts as the
empty text for the fold; ties go to the smaller language name; repeated rows
are predicted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import frugal, read_table
from tillpoint.llm.packing import slices

ORDER = 3
SAMPLE_BYTES = 400_000
SAMPLE_TEXT_BYTES = 40_000
UNDETERMINED = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
SLICE_BYTES = 4 << 20
BLOCK_BYTES = 256 << 10


@dataclass
class Trees:
    """The context trees of all languages as one table."""

    languages: list[str]
    symbol: np.ndarray  # byte -> symbol; bytes never seen share the last but one
    row_of: np.ndarray  # context of ORDER symbols -> row
    bits: np.ndarray  # (rows * symbols, languages)

    @property
    def symbols(self) -> int:
        return int(self.symbol.max()) + 2  # and the one before the start of a text

    def code_lengths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each text under each language; text k is data[starts[k]:starts[k + 1]].

        Works on ``BLOCK_BYTES`` at a time, each with the bytes before it that
        its contexts need, and adds up the parts of a text."""
        out = np.zeros((len(starts) - 1, len(self.languages)))
        for a in range(0, len(data), BLOCK_BYTES):
            b = min(len(data), a + BLOCK_BYTES)
            back = min(a, ORDER)
            sym = self.symbol[data[a - back: b]]
            first = starts[np.searchsorted(starts, a - back): np.searchsorted(starts, b)] - (a - back)
            context = np.zeros(b - a, np.int32)
            for far in range(ORDER, 0, -1):
                before = np.full(len(sym), self.symbols - 1, np.int32)
                before[far:] = sym[:-far]
                for k in range(far):  # places with fewer than `far` bytes before them
                    at = first + k
                    before[at[at < len(sym)]] = self.symbols - 1
                context = context * np.int32(self.symbols) + before[back:]
            bits = self.bits[self.row_of[context] * self.symbols + sym[back:]]
            # Texts with bytes in this block, and where each begins in it.
            texts = np.arange(np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b))
            texts = texts[starts[texts + 1] > np.maximum(starts[texts], a)]
            out[texts] += np.add.reduceat(bits, np.maximum(starts[texts], a) - a, axis=0, dtype=np.float64)
        return out


def fit(samples: dict[str, list[str]]) -> Trees | None:
    """Trees of the given texts by language."""
    languages = sorted(k for k, texts in samples.items() if any(texts))
    if not languages:
        return None
    raw = {k: [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in samples[k]] for k in languages}
    seen = np.unique(np.concatenate([b for bs in raw.values() for b in bs]))
    symbol = np.full(256, len(seen), np.uint8 if len(seen) < 254 else np.int32)
    symbol[seen] = np.arange(len(seen))
    start, n = len(seen) + 1, len(seen) + 2
    text = {k: np.concatenate([np.concatenate([np.full(ORDER, start), symbol[b]]) for b in bs]).astype(np.int64)
            for k, bs in raw.items()}

    # (context, symbol) counts of every order; contexts of order k in base n.
    grams: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for order in range(ORDER + 1):
        own = []
        for k in languages:
            s = text[k]
            code = np.zeros(len(s) - ORDER, np.int64)
            for back in range(order, -1, -1):
                code = code * n + s[ORDER - back: len(s) - back]
            own.append(np.unique(code[s[ORDER:] != start], return_counts=True))
        grams.append(own)

    row_of_order, tables = [], []
    chance = np.full((1, n, len(languages)), 1 / 256, np.float32)
    below = np.zeros(1, np.int64)  # contexts of the order before, sorted
    for order in range(ORDER + 1):
        contexts = np.unique(np.concatenate([g // n for g, _ in grams[order]]))
        shorter = np.searchsorted(below, contexts % n ** max(0, order - 1)) if order else np.zeros(1, np.int64)
        table = chance[shorter].copy()
        for k, (codes, counts) in enumerate(grams[order]):
            at = np.searchsorted(contexts, codes // n)
            total = np.bincount(at, counts, len(contexts))
            kinds = np.bincount(at, minlength=len(contexts))
            weight = np.where(total > 0, total + kinds, 1)
            table[:, :, k] *= np.where(total > 0, kinds / weight, 1.0)[:, None].astype(np.float32)
            table[at, codes % n, k] = counts / weight[at]
        tables.append(table)
        row_of_order.append(contexts)
        chance, below = table, contexts

    first_row = np.cumsum([0] + [len(c) for c in row_of_order])
    row_of = np.zeros(n ** ORDER, np.int32)
    for order in range(1, ORDER + 1):  # longer contexts overwrite shorter ones
        rows = (first_row[order] + np.arange(len(row_of_order[order]))).astype(np.int32)
        if order == ORDER:
            row_of[row_of_order[order]] = rows
        else:
            row_of.reshape(-1, n ** order)[:, row_of_order[order]] = rows
    bits = -np.log2(np.concatenate([t.reshape(-1, len(languages)) for t in tables]))
    return Trees(languages, symbol, row_of, np.ascontiguousarray(bits, np.float32))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(labelled: DataFrame, most_bytes: int = SAMPLE_BYTES, longest: int = SAMPLE_TEXT_BYTES) -> dict[str, list[str]]:
    """Up to ``most_bytes`` of distinct texts for each language of ``labelled``
    (lang, text), in the order of a hash of the text; longer texts than
    ``longest`` come last and are cut there."""
    size = F.octet_length("text")
    keyed = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64(F.lit("sample"), F.col("text")).alias("place"),
        F.least(size, F.lit(longest)).alias("bytes"), (size > longest).alias("long"))
    each = keyed.groupBy("lang", "place").agg(F.min("bytes").alias("bytes"), F.min("long").alias("long"))
    totals: dict[str, dict[bool, int]] = {}
    for r in each.groupBy("lang", "long").agg(F.sum("bytes").alias("total")).collect():
        totals.setdefault(r["lang"], {})[r["long"]] = r["total"]
    # Twice the wanted share, so that the drawn texts nearly always reach the bound.
    share = F.lit(0.0)
    for lang, own in totals.items():
        wanted = {False: most_bytes, True: max(0, most_bytes - own.get(False, 0))}
        for long, total in own.items():
            share = F.when((F.col("lang") == lang) & (F.col("long") == long),
                           F.lit(2.0 * wanted[long] / max(1, total))).otherwise(share)
    before = F.sum("bytes").over(Window.partitionBy("lang").orderBy("long", "place")) - F.col("bytes")
    drawn = (each.filter(F.pmod("place", F.lit(1 << 30)) < share * (1 << 30))
             .withColumn("before", before).filter(F.col("before") < most_bytes).select("lang", "place"))
    rows = (keyed.join(F.broadcast(drawn), ["lang", "place"], "left_semi")
            .groupBy("lang", "place").agg(F.first(F.substring("text", 1, longest)).alias("text"), F.min("long").alias("long"))
            .collect())
    out: dict[str, list[str]] = {lang: [] for lang in totals}
    for r in sorted(rows, key=lambda r: (r["long"], r["place"])):
        text = r["text"]
        out[r["lang"]].append(text.encode("utf-8", "replace")[:longest].decode("utf-8", "ignore") if r["long"] else text)
    return out


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, without a copy, and where each text's begin; a
    null text has none."""
    whole = pc.fill_null(texts, "").cast(pa.large_binary())
    starts = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset: whole.offset + len(whole) + 1]
    held = whole.buffers()[2]
    data = np.frombuffer(held, np.uint8)[starts[0]: starts[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, starts - starts[0]


def _has_letter(raw: np.ndarray) -> bool:
    text = raw.tobytes()
    return _ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text.decode("utf-8", "replace")))


def predict(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text",
            keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``text`` and the columns ``keep`` with ``lang_pred``,
    ``score`` and ``bits_per_byte`` (of the shortest code; null if ``und``)."""
    names = [id_col, text_col, *keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    shared = docs.sparkSession.sparkContext.broadcast(trees and tuple(vars(trees).values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value and Trees(*shared.value)
        for batch in batches:
            for some in slices(batch, SLICE_BYTES):
                data, starts = _bytes_of(some.column(1))
                lettered = [_has_letter(data[a:b]) for a, b in zip(starts[:-1], starts[1:])]
                langs, scores, rates = [], [], []
                bits = trees.code_lengths(data, starts) if trees else None
                for k, yes in enumerate(lettered):
                    if not yes or trees is None:
                        langs.append(UNDETERMINED), scores.append(0.0), rates.append(None)
                        continue
                    n, own = int(starts[k + 1] - starts[k]), bits[k]
                    best = int(np.argmin(own))
                    langs.append(trees.languages[best])
                    scores.append(float(1 / np.exp2((own[best] - own) / np.sqrt(n)).sum()))
                    rates.append(float(own[best] / n))
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                     pa.array(rates, pa.float64())],
                    names=[*names, "lang_pred", "score", "bits_per_byte"])

    return docs.select(*names).mapInArrow(frugal(run), f"{schema}, lang_pred string, score double, bits_per_byte double")


def identify(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fit on the training fold of ``docs`` (doc_id, text, lang), predict all."""
    trees = fit(sample(docs.filter(~held_out(F.col("doc_id"))).select("lang", "text")))
    return predict(docs, trees, keep=keep)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return identify(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
