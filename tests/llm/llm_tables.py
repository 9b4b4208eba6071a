"""Small tables with the cases every operator must take."""

from __future__ import annotations

import random

# Columns that the operators use as names of their own.
EXTRA = "key string, hash string, n string, shard string, id string, bucket string, node string, slot string, label string"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA


def words(seed: int, n: int) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 7))) for _ in range(n)]


def prose(seed: int, n: int, per_line: int = 12) -> str:
    w = words(seed, n)
    return "\n".join(" ".join(w[k: k + per_line]) + "." for k in range(0, n, per_line))


def odd_documents() -> list[tuple]:
    """Nulls in every column, empty and blank texts, one very long text, exact
    copies, a full repeat, and a null id."""
    texts = [(None, "A text without an id."), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "A"), (5, "..., 1 !"),
             (6, prose(6, 60)), (7, prose(6, 60)), (8, prose(8, 90)), (8, prose(8, 90)), (9, prose(9, 40_000)),
             (10, "é\U0001f600 Ünïcode ﬁ ß\n" + prose(10, 30)), (11, "one two")]
    return [(i, t, lang, "s", 1, *["x"] * 9) for (i, t), lang in zip(texts, ["en", None, "de"] * 5)]


def write(spark, folder, name: str, rows: list[tuple], schema: str) -> str:
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def write_documents(spark, folder, texts: dict[int, str | None] | None = None, lang: str = "en") -> str:
    rows = odd_documents() if texts is None else [(i, t, lang, "s", 1, *["x"] * 9) for i, t in texts.items()]
    return write(spark, folder, "documents", rows, DOCUMENTS)
