"""Language identification: held-out accuracy and exact code lengths."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from llm_tables import prose, write_documents
from tillpoint.llm import language_id as lid


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = lid.op8_language_id(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(langs) and len(rows) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.97


def brute_bits(sample, text, order):
    """Code length of ``text`` byte by byte, with escapes, from plain dicts."""
    counts = defaultdict(Counter)
    for t in sample:
        b = [None] * order + list(t.encode())
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts[k, tuple(b[i - k: i])][b[i]] += 1
    total, b = 0.0, [None] * order + list(text.encode())
    for i in range(order, len(b)):
        weight = 1.0
        for k in range(order, -1, -1):
            own = counts.get((k, tuple(b[i - k: i])))
            if not own:
                continue
            n, d = sum(own.values()), len(own)
            if b[i] in own:
                total -= math.log2(weight * own[b[i]] / (n + d))
                break
            weight *= d / (n + d)
        else:
            total -= math.log2(weight / 256)
    return total


def test_code_lengths_are_exact():
    samples = {"a": ["the cat sat on the mat", "the end"], "b": ["der hund", "das über"], "c": [""]}
    trees = lid.fit(samples)
    assert trees.languages == ["a", "b"]
    texts = ["the mat", "", "das ist über", "xyz \U0001f600", "t"]
    raw = [t.encode() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = trees.code_lengths(np.frombuffer(b"".join(raw), np.uint8), starts)
    for k, lang in enumerate(trees.languages):
        assert np.allclose(got[:, k], [brute_bits(samples[lang], t, lid.ORDER) for t in texts], rtol=1e-4)


def test_odd_documents(spark, tmp_path):
    rows = lid.op8_language_id(spark, write_documents(spark, tmp_path)).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == 14
    assert all(by_id[k].lang_pred == "und" and by_id[k].score == 0 for k in (1, 2, 3, 5))
    assert by_id[9].lang_pred in ("en", "de") and by_id[4].lang_pred in ("en", "de")


def test_nothing_to_learn_and_empty_table(spark, tmp_path):
    sf = write_documents(spark, tmp_path / "a", {1: "some text", 2: "more"}, lang=None)
    assert {r.lang_pred for r in lid.op8_language_id(spark, sf).collect()} == {"und"}
    assert lid.op8_language_id(spark, write_documents(spark, tmp_path / "b", {})).count() == 0


def test_sample_is_bounded_and_whole(spark):
    rows = [("en", prose(k, 50)) for k in range(60)] + [("de", prose(99, 40))] + [("en", "x" * 5000), (None, "a"), ("en", None)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = lid.sample(docs, most_bytes=4000, longest=3000)
    texts = {t for _, t in rows}
    assert set(got["en"]) <= texts and 4000 <= sum(map(len, got["en"])) < 4000 + 3000
    assert got["de"] == [prose(99, 40)] and "x" * 5000 not in got["en"]


def test_sample_of_long_and_of_repeated_texts(spark):
    """A language of long texts only is learned, from their beginnings; copies
    of one text take the place of one."""
    rows = [("fr", prose(k, 800)) for k in range(5)] + [("en", prose(50, 100))] * 40 + [("en", prose(60 + k, 50)) for k in range(9)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = lid.sample(docs, most_bytes=4000, longest=2000)
    starts = {t[:2000] for lang, t in rows if lang == "fr"}
    assert len(got["fr"]) == 2 and set(got["fr"]) <= starts
    assert len(got["en"]) == len(set(got["en"])) == 10


def test_blocks_give_the_same_code_lengths(monkeypatch):
    """Texts across, at and far over block borders, empty ones among them."""
    rnd = random.Random(5)
    trees = lid.fit({"a": ["abc abd " * 30, "cab dab"], "b": ["xyz zyx " * 30], "c": ["abc xyz é"]})
    texts = ["".join(rnd.choice("abcdxyzé \n") for _ in range(n)).encode() for n in (0, 1, 2, 3, 0, 50, 7, 8, 0, 0, 200, 1, 0)]
    data, starts = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = trees.code_lengths(data, starts)
    for k, t in enumerate(texts):
        alone = trees.code_lengths(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.allclose(whole[k], alone[0])
    for block in (1, 2, 3, 4, 7, 8, 64):
        monkeypatch.setattr(lid, "BLOCK_BYTES", block)
        assert np.allclose(trees.code_lengths(data, starts), whole)


def test_bytes_of_sliced_and_null_texts():
    import pyarrow as pa
    column = pa.array(["skip", None, "é1", "", "abc"], pa.string()).slice(1)
    data, starts = lid._bytes_of(column)
    assert [bytes(data[a:b]) for a, b in zip(starts[:-1], starts[1:])] == [b"", "é1".encode(), b"", b"abc"]
    assert lid._bytes_of(pa.array([None, None], pa.string()))[1].tolist() == [0, 0, 0]
    assert [lid._has_letter(np.frombuffer(t.encode(), np.uint8)) for t in ("12 é", "1 2!", "", "x")] == [True, False, False, True]
