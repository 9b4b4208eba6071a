r"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted by turn, and
concatenated; adjacent turns of one role share a header.  A conversation
becomes

    <|turn|>role<|text|>first text<|next|>second text<|end|><|turn|>...

Control strings inside roles and texts, the template's own and those of
other common templates, get a backslash after their first character, and
those that have backslashes there already get one more, so the step is
undone by taking one away and ordinary text stays as it is.

``segments`` are the pieces of the formatted text in order, each with its
loss flag; exactly the texts of assistant turns are flagged.  A conversation
is one training example and hence one row; its turns meet in one task.

Defined results: null texts and roles are empty; turns with equal numbers
are ordered by role, then text; repeated rows are separate turns; rows with
a null conversation id form one conversation; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.llm.common import read_table

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
ASSISTANT = "assistant"

# The control strings, each after its first character.
_REST = r"\|(?:turn|text|next|end)\|>|/?s>|/?INST\]"
_PROBE_ID = -7
_PROBE_TEXT = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={_REST})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={_REST})", r"$1$2")


def _exactly(mark: str) -> str:
    return mark.replace("|", r"\|")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: ``conv_id``, ``formatted``, ``segments``."""
    blank = F.lit("")
    one = F.struct(turns[turn_col].alias("turn"), F.coalesce(turns[role_col], blank).alias("role"),
                   F.coalesce(turns[text_col], blank).alias("text"))
    grouped = (turns.select(turns[conv_col].alias("conv_id"), one.alias("one"))
               .groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("turns")))

    def pieces(x: Column, i: Column) -> Column:
        joins = (i > 0) & (F.get("turns", i - 1)["role"] == x["role"])
        header = F.concat(F.when(i > 0, F.lit(END)).otherwise(blank), F.lit(TURN), escape(x["role"]), F.lit(TEXT))
        return F.array(
            F.struct(F.when(joins, F.lit(NEXT)).otherwise(header).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(x["text"]).alias("text"), (x["role"] == ASSISTANT).alias("loss")))

    closing = F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))
    return (grouped.select("conv_id", F.concat(F.flatten(F.transform("turns", pieces)), closing).alias("segments"))
            .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")))


def read_turns(formatted: Column) -> Column:
    """The (role, text) structs of a formatted conversation."""
    blocks = F.slice(F.split(formatted, _exactly(END), -1), 1, F.size(F.split(formatted, _exactly(END), -1)) - 1)

    def turns(block: Column) -> Column:
        role = unescape(F.substring_index(F.substring(block, F.lit(len(TURN) + 1), F.length(block)), TEXT, 1))
        texts = F.split(F.substring_index(block, TEXT, -1), _exactly(NEXT), -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(_PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit(ASSISTANT)).alias("role"),
        F.lit(_PROBE_TEXT).alias("text"))
    chats = format_chats(read_table(spark, sf_dir, "conversations", *columns).unionByName(probe))
    read = chats.select("conv_id", read_turns(F.col("formatted")).alias("turns"),
                        loss_text(F.col("segments")).alias("loss"), F.length("formatted").alias("chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"))


QUERIES = {"op6_chat": op6_chat}

SQL = {"op6_chat": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *,
    length(regexp_replace(text, '([<\[])(\\*)(\|(turn|text|next|end)\|>|/?s>|/?INST\])', '\1\\\2\3', 'g')) AS text_chars,
    length(regexp_replace(role, '([<\[])(\\*)(\|(turn|text|next|end)\|>|/?s>|/?INST\])', '\1\\\2\3', 'g')) AS role_chars,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN before = role THEN 8 ELSE 23 + role_chars END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""}
