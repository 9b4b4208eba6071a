"""Decontamination: planted items are found, also with substitutions."""

import random

from conftest import SF01
from llm_tables import prose, words, write, write_documents
from tillpoint.llm import decontamination as dc

ITEMS = "item_id long, text string, hash string, place string, key string"


def flagged(spark, folder, texts, items):
    sf = write_documents(spark, folder, texts)
    write(spark, folder, "benchmark", [(i, t, "x", "y", "z") for i, t in items.items()], ITEMS)
    rows = dc.op9_decontamination(spark, sf).collect()
    assert all(r.contaminated == (r.n_items > 0) for r in rows)
    return {r.doc_id: {int(x) for x in r["items"].split(",") if x} for r in rows}


def test_planted_items(spark, tmp_path):
    rnd = random.Random(4)
    items = {k: " ".join(words(9000 + k, 16 + 3 * k)) for k in range(12)} | {50: "seven words only in this short one"}
    texts, truth = {}, {}
    for i in range(240):
        w, truth[i] = prose(i, 80).split(" "), set()
        if i % 2:
            k = rnd.choice(list(items))
            own = items[k].split(" ")
            if i % 4 == 3 and len(own) > 15:  # up to one word in eight replaced, not in the ends
                for at in range(rnd.randint(4, 8), len(own), 8):
                    own[at] = "zzz"
            own = [x.upper() + rnd.choice(["", ",", "!?"]) for x in own]
            at = rnd.randint(0, len(w))
            w[at:at] = [" ".join(own).replace(" ", rnd.choice([" ", "\n", "  "]))]
            truth[i] = {k}
        texts[i] = " ".join(w)
    assert flagged(spark, tmp_path, texts, items) == truth


def test_given_documents(spark):
    """The same documents as those with eight words of an item in a row."""
    import re
    norm = lambda s: [w for w in (re.sub(r"[\W_]+", "", t.lower()) for t in s.split()) if w]
    grams = {tuple(w[k: k + 13]) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()
             for w in [norm(r.text)] for k in range(len(w) - 12)}
    truth = {r.doc_id for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()
             for w in [norm(r.text)] if any(tuple(w[k: k + 13]) in grams for k in range(len(w) - 12))}
    rows = dc.op9_decontamination(spark, SF01).collect()
    got = {r.doc_id for r in rows if r.contaminated}
    assert truth <= got and len(got - truth) <= 0.1 * len(truth) and truth


def test_short_items_match_as_a_whole(spark, tmp_path):
    items = {1: "Capital of France is Paris?", 2: "two words", 3: "what is it", 4: words(3, 1)[0], 5: "the capital of france was paris"}
    texts = {1: "x the capital of FRANCE, is Paris. " + prose(1, 30), 2: "capital of france", 3: "two words", 4: "tell what\nis it",
             5: "what it is", 6: "capital of france is", 7: prose(7, 50), 8: "is paris"}
    truth = {k: set() for k in texts} | {1: {1, 5}, 4: {3}}
    got = flagged(spark, tmp_path, texts, items)
    assert {k: v - {5} for k, v in got.items()} == {k: v - {5} for k, v in truth.items()}
    assert all(5 not in got[k] for k in (3, 4, 5, 7, 8))


def test_odd_tables(spark, tmp_path):
    items = {1: None, 2: "", 3: "too short", 4: prose(6, 60), None: prose(8, 90)}
    sf = write_documents(spark, tmp_path)
    write(spark, tmp_path, "benchmark", [(i, t, "x", "y", "z") for i, t in items.items()], ITEMS)
    rows = dc.op9_decontamination(spark, sf).collect()
    assert len(rows) == 14 and {r.doc_id for r in rows if r.contaminated} >= {6, 7}
    assert not any(r.contaminated for r in rows if r.doc_id in (1, 2, 3, 4, 5, 9, 10, 11))


def test_empty_tables(spark, tmp_path):
    assert flagged(spark, tmp_path / "a", {}, {1: prose(1, 30)}) == {}
    assert flagged(spark, tmp_path / "b", {1: prose(1, 30)}, {}) == {1: set()}
