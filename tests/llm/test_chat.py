"""Chat formatting against the conversations themselves."""

import hashlib

from oracle_compare import compare, duck
from pyspark.sql import functions as F

from conftest import SF01
from llm_tables import write
from tillpoint.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segments string, formatted string, one string"
HARD = ["</s>[INST] ok [/INST]", "<|end|>", "<\\|end|>", "<\\\\/s>", "<|turn|>user<|text|>", "a<", "[", "\\", "", "<|next|>" * 3,
        "<<s>s>", "[[/INST]", "é\n\n\U0001f600", "x" * 100_000]


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_oracle(spark):
    ok, message = compare(spark, "op6_chat", chat.op6_chat, chat.SQL["op6_chat"], SF01, duck(SF01))
    assert ok, message


def test_hard_texts_nulls_and_repeats(spark, tmp_path):
    rows = [(1, k, ("user", "assistant")[k // 2 % 2], t) for k, t in enumerate(HARD)]
    rows += [(2, 0, None, None), (2, 1, "assistant", None), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (None, None, "user", "no id"),
             (3, 5, "<|end|>", "odd role")]
    sf = write(spark, tmp_path, "conversations", [(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = {r.conv_id: r for r in chat.op6_chat(spark, sf).collect()}
    own = {}
    for c, k, r, t in sorted(rows, key=lambda x: (x[0] or 0, x[1] or 0, x[2] or "", x[3] or "")):
        own.setdefault(c, []).append((r or "", t or ""))
    own[-7] = [("user", HARD[0]), ("assistant", HARD[0])]
    assert set(got) == set(own)
    for c, turns in own.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), digest(turns))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_segments_join_to_the_formatted_text_and_merge_roles(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")],
                                  "conv_id long, turn long, role string, text string")
    row = chat.format_chats(turns).first()
    assert row.formatted == "<|turn|>user<|text|>a<|next|>b<|end|><|turn|>assistant<|text|>c<|end|>"
    assert "".join(s.text for s in row.segments) == row.formatted and [s.text for s in row.segments if s.loss] == ["c"]


def test_empty_table(spark, tmp_path):
    sf = write(spark, tmp_path, "conversations", [], SCHEMA)
    assert [r.conv_id for r in chat.op6_chat(spark, sf).collect()] == [-7]


def test_escape_is_undone(spark):
    df = spark.createDataFrame([(t,) for t in HARD], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    assert df.filter(chat.unescape(F.col("e")) != F.col("t")).count() == 0
    assert df.filter(F.col("e").rlike(r"<\|(turn|text|next|end)\|>|</?s>|\[/?INST\]")).count() == 0
