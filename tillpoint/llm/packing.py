"""Packing into fixed windows by Karmarkar-Karp multiway differencing.

Each task tokenizes its documents, cuts off full windows, cuts what is left
of a document into tails of at most ``MAX_TAIL`` ids, and gathers the tails
in blocks of ``BLOCK``.  A block is divided into as few windows as its ids
need: every tail starts as a partial partition of its own, the two partial
partitions with the largest imbalance are merged with their fullest windows
against the other's emptiest, and so on until one partition remains.  When
its fullest window exceeds the capacity, the window count rises and the
block is divided again.  Nothing is shuffled; a block bounds the memory.

Tokens are those of ``tokenizers`` for the given vocabulary.  Its splitting
rule never joins pieces over white space, so a document's ids are the ids of
its words in order.  Words and their pieces are columns of a slice of the
texts, of distinct values each; the library's model codes each new piece by
itself, and a task keeps the ids of the pieces it has met (bounded by
``MAX_PIECES``).  Texts with characters outside the range for which this holds
exactly, or with the vocabulary's special strings, go to the library whole.

Defined results: a null or empty text is the end id alone; a null id is kept
as null; repeated rows are packed each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import codecs
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tillpoint.llm.common import frugal, read_table

WINDOW = 4096
MAX_TAIL = 1024
BLOCK = 384
END_ID = 2
MAX_PIECES = 400_000
SLICE_BYTES = 4 << 20
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")

# Latin letters that are their own composed form and whose lower case does not
# depend on their neighbours, with printable ASCII and the six ASCII blanks.
# That of U+0130 is two characters.
_PLAIN = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e¡-įı-ǿ]")

# Fixed value: the vocabulary's own splitting rule.
_PIECE = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"


def _taken(ids: np.ndarray, bounds: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the given runs in order, and where each ends; run k of ``ids``
    goes from bound k to the next."""
    starts, lengths = bounds[runs], bounds[runs + 1] - bounds[runs]
    ends = np.cumsum(lengths)
    at = np.arange(int(ends[-1]) if len(ends) else 0)
    at += np.repeat(starts - (ends - lengths), lengths)
    return ids[at], ends


class _Runs:
    """Runs of ids one after another, each known by its number."""

    def __init__(self):
        self.ids = np.empty(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)  # of run k at k + 1
        self.count = 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        used, k = int(self.ends[self.count]), self.count
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while k + len(lengths) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.empty_like(self.ends)])
        self.ids[used: used + len(ids)] = ids
        self.ends[k + 1: k + 1 + len(lengths)] = used + np.cumsum(lengths)
        self.count += len(lengths)

    def take(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _taken(self.ids, self.ends, runs)


class Vocabulary:
    """Ids of whole texts, with the ids of known pieces kept."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self.code = self.lib.model.tokenize
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # The model's characters stand for bytes; those of ASCII for themselves.
        stand = {b: m for c in range(0x80, 0x300) for b, m in zip(chr(c).encode(), level.pre_tokenize_str(chr(c))[0][0])}
        self.bytes = "".join(stand.get(b, chr(b)) for b in range(256))
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.piece_at: dict[str, int] = {}
        self.piece_ids = _Runs()

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.lib.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        ids, lengths = [], []
        for p in pieces:
            tokens = self.code(p if p.isascii() else codecs.charmap_decode(p.encode(), "strict", self.bytes)[0])
            ids += [t.id for t in tokens]
            lengths.append(len(tokens))
        self.piece_at.update(zip(pieces, range(self.piece_ids.count, self.piece_ids.count + len(pieces))))
        self.piece_ids.add(np.array(ids, np.uint32), np.array(lengths, np.int64))

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words in order, and the bounds of each word's."""
        # Most words are letters, or letters and a mark; the others go by the rule.
        stem, mark = pc.utf8_slice_codeunits(words, 0, -1), pc.utf8_slice_codeunits(words, -1)
        marked = pc.and_(pc.is_in(mark, value_set=pa.array([".", ","], words.type)), pc.utf8_is_alpha(stem))
        odd = pc.invert(pc.or_(marked, pc.utf8_is_alpha(words)))
        spaced = pc.if_else(marked, pc.binary_join_element_wise(stem, mark, pa.scalar(" ", words.type)), words)
        spaced = pc.replace_with_mask(spaced, odd, pc.replace_substring_regex(words.filter(odd), _PIECE, r"\1 "))
        pieces = pc.ascii_split_whitespace(spaced)  # an empty one, of no ids, after a last blank
        coded = pieces.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.piece_at) + len(distinct) > MAX_PIECES:
            self._forget()
        if new := [p for p in distinct if p not in self.piece_at]:
            self._learn(new)
        known = np.fromiter(map(self.piece_at.__getitem__, distinct), np.int64, len(distinct))
        ids, ends = self.piece_ids.take(known[coded.indices.to_numpy()] if len(distinct) else known)
        return ids, np.concatenate([[0], ends])[pieces.offsets.to_numpy()]

    def _by_words(self, texts: list[str]) -> list[np.ndarray]:
        words = pc.ascii_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
        coded = words.flatten().dictionary_encode()
        ids, ends = _taken(*self._word_ids(coded.dictionary), coded.indices.to_numpy())
        at = np.concatenate([[0], ends])[words.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(at[:-1], at[1:])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [not _PLAIN.search(t) and not any(s in t for s in self.special) for t in texts]
        by_words = iter(self._by_words([t for t, p in zip(texts, plain) if p]))
        whole = iter(self._whole([t for t, p in zip(texts, plain) if not p]))
        return [next(by_words if p else whole) for p in plain]


def slices(batch: pa.RecordBatch, most: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // most
    edges = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:]):
        yield batch.slice(a, b - a)


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Items (by index) of each of ``ways`` windows, by multiway differencing."""
    heap: list[tuple] = []
    for i, s in enumerate(sizes):
        sums = np.zeros(ways, np.int64)
        sums[0] = s
        heap.append((-s, i, sums, [[i]] + [[]] * (ways - 1)))
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        both = a + b[::-1]  # each side is in descending order
        order = np.argsort(-both, kind="stable")
        both = both[order]
        held = [in_a[k] + in_b[ways - 1 - k] for k in order]
        heapq.heappush(heap, (-int(both[0] - both[-1]), count, both, held))
        count += 1
    return heap[0][3] if heap else []


def windows(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """As few near-equal windows as multiway differencing fits within ``capacity``."""
    ways = max(1, -(-sum(sizes) // capacity))
    while sizes:
        parts = [p for p in differencing(sizes, ways) if p]
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return parts
        ways += 1
    return []


def _cuts(n: int, window: int, max_tail: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then even tails."""
    pieces = [(s, window) for s in range(0, n - n % window, window)]
    if left := n % window:
        parts = -(-left // max_tail)
        edges = [n - left + left * k // parts for k in range(parts + 1)]
        pieces += [(a, b - a) for a, b in zip(edges[:-1], edges[1:])]
    return pieces


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         max_tail: int = MAX_TAIL, block: int = BLOCK, vocabulary: str | None = None) -> DataFrame:
    """Pieces of ``docs`` with their sequence and place, and a checksum of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, task = Vocabulary(vocabulary), TaskContext.get().partitionId()
        sequence, tails, rows = 0, [], []

        def place(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for p in pieces:
                rows.append((*p, (task << 32) + sequence, offset))
                offset += p[2]
            sequence += 1

        def close() -> None:
            for part in windows([t[2] for t in tails], window):
                place([tails[i] for i in part])
            tails.clear()

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[
                "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for some in slices(batch, SLICE_BYTES):
                texts = [t or "" for t in some.column(1).to_pylist()]
                for doc, ids in zip(some.column(0).to_pylist(), vocab.encode(texts)):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for start, length in _cuts(len(ids), window, max_tail):
                        piece = (doc, start, length, zlib.crc32(ids[start: start + length].tobytes()), len(ids))
                        if length == window:
                            place([piece])
                        else:
                            tails.append(piece)
                            if len(tails) >= block:
                                close()
                if rows:
                    yield out()
        close()
        if rows:
            yield out()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(frugal(run), SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op1_packing": op1_packing}
