"""Fingerprints: the edited text exactly, and the algebra of the sums."""

import hashlib

from pyspark.sql import functions as F

from llm_tables import prose, write_documents
from tillpoint.llm import fingerprints as fp


def edited(texts):
    """Texts in descending order of id, each with its neighbour's start at its end."""
    for k, t in enumerate(texts):
        cut = len(t) // 3
        yield t[: len(t) - cut] + texts[(k + 1) % len(texts)][:cut]


def test_odd_documents(spark, tmp_path):
    sf = write_documents(spark, tmp_path)
    own = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    want = sorted((str(i), len(t), hashlib.sha256(e.encode()).hexdigest())
                  for (i, t), e in zip(own, edited([t for _, t in own])))
    rows = fp.op2_fingerprint(spark, sf).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in rows) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[6].fingerprint == by_id[7].fingerprint and by_id[1].fingerprint != by_id[4].fingerprint


def test_neighbours_across_ranges(spark):
    texts = {3 * k * k - 500: prose(k, 20 + k) for k in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    ids = sorted(texts, reverse=True)
    want = dict(zip(ids, edited([texts[i] for i in ids])))
    for ranges in (1, 7, 40):
        rows = fp.edited_pairs(docs, buckets=ranges, rows_per_bucket=1).select("doc_id", "edited").collect()
        assert {r.doc_id: r.edited for r in rows} == want and len(rows) == 40


def test_one_document_and_none(spark, tmp_path):
    row = fp.op2_fingerprint(spark, write_documents(spark, tmp_path / "one", {5: "abcdef"})).collect()[0]
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and row.near_next == 1.0
    assert fp.op2_fingerprint(spark, write_documents(spark, tmp_path / "none", {})).count() == 0


def test_sums_ignore_order_and_take_insertion_and_deletion(spark):
    a, b = prose(1, 200), prose(2, 120)
    row = spark.createDataFrame([(a, b)], "a string, b string").select(
        fp.vector(F.col("a")).alias("a"), fp.vector(F.col("b")).alias("b"),
        fp.vector(F.concat("a", F.lit("\n"), "b")).alias("ab"), fp.vector(F.concat("b", F.lit("\n"), "a")).alias("ba"))
    got = row.select(F.col("ab") == F.col("ba"), fp.combine(F.col("a"), F.col("b")) == F.col("ab"),
                     fp.combine(F.col("ab"), F.col("b"), -1) == F.col("a"), F.col("a") == F.col("b")).first()
    assert list(got) == [True, True, True, False]


def test_likeness_follows_the_shared_share(spark):
    a = prose(1, 1200)
    lines = a.split("\n")
    rows = [(a, "\n".join(lines[:k] + prose(50 + k, 1200).split("\n")[k:]), k / len(lines)) for k in (0, 25, 50, 75, 100)]
    got = (spark.createDataFrame(rows, "a string, b string, share double")
           .select("share", fp.likeness(fp.vector(F.col("a")), fp.vector(F.col("b"))).alias("near")).collect())
    assert all(abs(r.share - r.near) < 0.35 for r in got) and got[-1].near == 1.0
