"""Line dedup: repeated passages go, one copy of every line stays."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF01
from llm_tables import prose, words, write_documents
from tillpoint.llm import line_dedup


def cleaned(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: r for r in line_dedup.drop_repeats(docs).collect()}


def repeated_runs_left(texts, min_words=line_dedup.MIN_WORDS):
    """Neighbouring line pairs of enough words that stand in two places."""
    places = {}
    for i in sorted(texts):
        lines = texts[i].split("\n")
        for k, pair in enumerate(zip(lines, lines[1:])):
            if len(" ".join(pair).split()) >= min_words:
                places.setdefault(pair, []).append((i, k))
    return {p for p, at in places.items() if len(at) > 1}


def test_passages_in_other_surroundings(spark):
    rnd = random.Random(2)
    passages = [[" ".join(words(100 * p + k, rnd.randint(8, 30))) for k in range(rnd.randint(3, 8))] for p in range(12)]
    passages.append([" ".join(words(77, 70))])  # one line of over 50 words
    texts, clean = {}, set()
    for i in range(200):
        lines = prose(1000 + i, 12 * rnd.randint(2, 12)).split("\n")
        if i % 3:
            at = rnd.randint(0, len(lines))
            lines[at:at] = rnd.choice(passages)
        else:
            clean.add(i)
            lines.insert(1, "All rights reserved, and one short line that many hold.")
        texts[i] = "\n".join(lines)
    got = cleaned(spark, texts)
    left = {i: r.text for i, r in got.items()}
    assert all(left[i] == texts[i] and got[i].removed_lines == 0 for i in clean)
    assert not repeated_runs_left(left)
    for p in passages:
        assert sum("\n".join(p) in t for t in left.values()) == 1
    for i, t in texts.items():  # what else a text has stays
        own = [x for x in t.split("\n") if not any(x in p for p in passages)]
        assert [x for x in left[i].split("\n") if x in own] == own


def test_given_documents_keep_one_copy_of_every_line(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    left = {i: r.text for i, r in cleaned(spark, texts).items()}
    lines = {x for t in texts.values() for x in t.split("\n")}
    assert lines - {x for t in left.values() for x in t.split("\n")} <= {""}
    assert repeated_runs_left(texts) and not repeated_runs_left(left)


def test_odd_documents(spark, tmp_path):
    rows = line_dedup.op5_line_dedup(spark, write_documents(spark, tmp_path)).collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert len(rows) == 14 and by_id[1][0].text is None and by_id[1][0].n_lines == 0
    assert by_id[2][0].text == "" and by_id[3][0].text == " \n\t " and by_id[6][0].n_removed == 0
    assert by_id[7][0].text == "" and by_id[7][0].n_removed == 5  # an exact copy
    assert [r.text for r in by_id[8]] == [prose(8, 90)] * 2  # full repeats share their result
    assert by_id[9][0].text == prose(9, 40_000)


def test_empty_table(spark, tmp_path):
    assert line_dedup.op5_line_dedup(spark, write_documents(spark, tmp_path, {})).count() == 0


def test_extra_columns_pass_through(spark):
    docs = spark.createDataFrame([(1, "a", "k", 7)], "doc_id long, text string, key string, runs long")
    row = line_dedup.drop_repeats(docs).first()
    assert (row.key, row.runs, row.text) == ("k", 7, "a")


def test_repeats_within_one_text(spark):
    block = prose(4, 60)
    got = cleaned(spark, {1: block + "\n" + prose(5, 40) + "\n" + block})
    assert got[1].text == block + "\n" + prose(5, 40)


def test_long_blocks_of_short_lines(spark):
    """Blocks whose single lines and small groups of lines are below the word
    bound; the first text that holds a part of a block is a short quote."""
    ones, twos = words(31, 90), [" ".join(words(40 + k, 2)) for k in range(60)]
    texts = {0: "\n".join([prose(600, 24), *twos[20:38], prose(601, 24)])}
    for i in range(1, 30):
        block = (ones, twos)[i % 2]
        texts[i] = "\n".join([prose(700 + i, 24), *block, prose(800 + i, 24)])
    left = {i: r.text for i, r in cleaned(spark, texts).items()}
    assert left[0] == texts[0] and left[2] == texts[2]
    assert left[1] == "\n".join([prose(701, 24), *twos[:20], *twos[38:], prose(801, 24)])
    for i in range(3, 30):
        assert left[i] == prose(700 + i, 24) + "\n" + prose(800 + i, 24)


def test_no_passage_of_few_short_lines_is_left(spark):
    """Passages of five to eight lines of six to eleven words, each between
    different neighbours in several texts."""
    rnd = random.Random(9)
    passages = [[" ".join(words(9000 + 10 * p + k, rnd.randint(6, 11))) for k in range(5 + p % 4)] for p in range(100)]
    texts = {}
    for p, passage in enumerate(passages):
        for copy in range(3):
            i = 3 * p + copy
            texts[i] = "\n".join([prose(20_000 + i, 24, 8), *passage, prose(30_000 + i, 24, 8)])
    left = {i: r.text for i, r in cleaned(spark, texts).items()}
    for i, t in texts.items():
        assert left[i] == (t if i % 3 == 0 else prose(20_000 + i, 24, 8) + "\n" + prose(30_000 + i, 24, 8))
    assert not repeated_runs_left(left, 1)


def test_texts_that_repeat_themselves_keep_a_whole_passage(spark):
    four, pair = "one two three four", ["a b c d e", "f g h"]
    table = "\n".join(f"cell {k}" for k in range(4))
    got = cleaned(spark, {1: "\n".join([four] * 60), 2: "\n".join(pair * 30), 3: f"{table}\n{prose(70, 24)}\n{table}"})
    assert got[1].text == "\n".join([four] * 8)  # 32 words
    assert got[2].text.split("\n")[:8] == pair * 4 and got[2].removed_lines >= 48
    assert got[3].removed_lines == 0  # the table has under 30 words


def chunks_of(texts):
    own = line_dedup.Lines(texts)
    begin, end = own.chunks(line_dedup.reach_of(line_dedup.MIN_WORDS))
    return [(int(own.text[a]), "\n".join(own.lines[a:b])) for a, b in zip(begin, end)]


def test_chunks_cover_every_text_once():
    texts = ["", "a", prose(1, 400, 5), "\n" * 50, "\n".join(words(5, 300)), prose(1, 400, 5)]
    for k, t in enumerate(texts):
        assert "\n".join(c for i, c in chunks_of(texts) if i == k) == t
        assert [c for _, c in chunks_of([t])] == [c for i, c in chunks_of(texts) if i == k]
    assert chunks_of([]) == []
    short = [c for _, c in chunks_of(["\n".join(words(5, 3000))])]
    assert 2 < np.mean([c.count("\n") + 1 for c in short]) < 8  # chunks of several lines


def test_boundaries_move_along_with_an_insertion():
    text = "\n".join(" ".join(words(k, 1 + k % 4)) for k in range(400))
    lines = text.split("\n")
    before = {c for _, c in chunks_of([text])}
    after = {c for _, c in chunks_of(["\n".join([*lines[:200], "something new", *lines[200:]])])}
    assert len(before - after) <= 6 and len(after - before) <= 7


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 14), min_size=2, max_size=40), st.integers(0, 10**6))
def test_copies_of_a_passage_share_a_whole_chunk(sizes, seed):
    """Lines of any lengths, empty ones and repeats, in other surroundings."""
    rnd = random.Random(seed)
    passage = [" ".join(words(rnd.randint(0, 30), n)) for n in sizes]
    while sum(x.count(" ") + 1 for x in passage) < line_dedup.MIN_WORDS:
        passage = passage * 2
    def around(k):
        return ["  ".join(words(seed + k + j, rnd.randint(1, 9))) for j in range(rnd.randint(0, 12))]
    seen = []
    for k in (100, 200):
        head, tail = around(k), around(k + 50)
        own = line_dedup.Lines(["\n".join([*head, *passage, *tail])])
        begin, end = own.chunks(line_dedup.reach_of(line_dedup.MIN_WORDS))
        seen.append({(a - len(head), b - len(head)) for a, b in zip(begin.tolist(), end.tolist())
                     if a >= len(head) and b <= len(head) + len(passage)})
    assert seen[0] & seen[1]


def test_runs_without_a_bounded_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST_BYTES", 0)
    block = prose(4, 60)
    got = cleaned(spark, {1: block, 2: "x\n" + block, 3: "y"})
    assert (got[1].text, got[2].text, got[3].text) == (block, "x", "y")
