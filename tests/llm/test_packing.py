"""Packing: every id lies in one piece, sequences are gapless and full."""

import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from llm_tables import write_documents
from tillpoint.llm import packing


def check(rows, texts):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, pieces in by_doc.items():
        copies = [t for i, t in texts if i == doc]
        ids = [np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in copies]
        pieces.sort(key=lambda r: r.start)
        assert sum(r.length for r in pieces) == sum(map(len, ids)) and all(r.length > 0 for r in pieces)
        assert all(any(r.doc_tokens == len(x) and zlib.crc32(x[r.start: r.start + r.length].tobytes()) == r.ids_crc32
                       for x in ids) for r in pieces)
        if len(copies) == 1:
            assert [r.start for r in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    return by_sequence


def test_odd_documents(spark, tmp_path):
    sf = write_documents(spark, tmp_path)
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = packing.op1_packing(spark, sf).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in texts}
    check(rows, texts)


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs).collect()
    by_sequence = check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r.length for r in rows) / (packing.WINDOW * len(by_sequence)) > 0.95


def test_empty_table(spark, tmp_path):
    assert packing.op1_packing(spark, write_documents(spark, tmp_path, {})).count() == 0


def test_ids_equal_the_library_for_unusual_text():
    vocabulary = packing.Vocabulary()
    texts = ["it's I'LL don''t 'sabc ''s x'd", "<|endoftext|> a", "é ﬁ ẞ ǅ", "İstanbul ΣΑΣ",
             "a\x1cb\x85c\xa0d\xad", "日本語 text", "\xaa\xb2\xbc ŉ", "", "A" * 5000, "\U0001f600 ok"]
    want = vocabulary.lib.encode_batch(texts, add_special_tokens=False)
    assert [list(x) for x in vocabulary.encode(texts)] == [e.ids for e in want]


def test_ids_equal_the_library_for_every_character_coded_by_words():
    vocabulary = packing.Vocabulary()
    texts = [f"ab{chr(c)}d, 'x{chr(c)}. {chr(c)}'s" for c in range(0x21, 0x200)]
    want = vocabulary.lib.encode_batch(texts, add_special_tokens=False)
    assert [list(x) for x in vocabulary.encode(texts)] == [e.ids for e in want]


def test_memory_of_coding_a_large_batch_is_bounded():
    """A batch of 12 MB in 1.5 million words, as much as Spark may hand to a task at once."""
    rnd = np.random.default_rng(2)
    texts = [" ".join(map("w{}".format, rnd.integers(0, 3000, 15_000))) for _ in range(150)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(150), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    vocabulary = packing.Vocabulary()
    tracemalloc.start()
    for some in packing.slices(batch, packing.SLICE_BYTES):
        vocabulary.encode(some.column(1).to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6


def test_known_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "MAX_PIECES", 50)
    vocabulary = packing.Vocabulary()
    texts = [" ".join(f"{a}{b}" for b in "abcdefghij") for a in "abcdefghij"]
    want = vocabulary.lib.encode_batch(texts, add_special_tokens=False)
    assert [list(vocabulary.encode([t])[0]) for t in texts] == [e.ids for e in want]
    assert len(vocabulary.piece_at) <= 50


def test_window_count_rises_when_capacity_is_exceeded():
    sizes = [6, 6, 6, 4]  # 22 in windows of 11 need three, not two
    parts = packing.windows(sizes, 11)
    assert len(parts) == 3 and sorted(i for p in parts for i in p) == [0, 1, 2, 3]
    assert packing.windows([], 11) == []


def test_differencing_is_near_equal():
    rnd = np.random.default_rng(1)
    sizes = rnd.integers(1, 1000, 300).tolist()
    sums = [sum(sizes[i] for i in p) for p in packing.differencing(sizes, 20)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= 0.02 * max(sums)
