"""The pipeline: each stage against a brute-force version on its own input."""

import re
from collections import defaultdict

import corpus_pipeline as cp
from conftest import SF01
from llm_tables import write, write_documents
from test_line_dedup import repeated_runs_left
from test_near_dedup import brute
from test_packing import check


def test_stages_on_given_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    tables = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF01)
        if name != "packing":
            assert out.columns == list(cp.COLUMNS)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        tables[name] = docs.collect()
    text = {name: {r.doc_id: r.text for r in rows} for name, rows in tables.items() if name != "packing"}

    start = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    assert {i for i, t in start.items() if re.search(r"[^\W\d_]", t or "")} == set(text["language"])

    lines = lambda t: {x for v in t.values() for x in v.split("\n")}
    assert lines(text["language"]) == lines(text["line_dedup"]) | ({""} & lines(text["language"]))
    assert repeated_runs_left(text["language"]) and not repeated_runs_left(text["line_dedup"])
    assert all(r.n_chars == len(r.text) for r in tables["line_dedup"])

    groups = defaultdict(list)
    for i, (_, c) in brute(text["line_dedup"], cp.SHINGLE_WORDS).items():
        groups[c].append(i)
    assert set(text["near_dedup"]) == {min(g) for g in groups.values()}

    norm = lambda s: [w for w in (re.sub(r"[\W_]+", "", t.lower()) for t in s.split()) if w]
    grams = {tuple(w[k: k + 13]) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()
             for w in [norm(r.text)] for k in range(len(w) - 12)}
    held = {i for i, t in text["near_dedup"].items() for w in [norm(t)]
            if any(tuple(w[k: k + 13]) in grams for k in range(len(w) - 12))}
    gone = set(text["near_dedup"]) - set(text["decontamination"])
    assert held <= gone and len(gone - held) <= 0.1 * len(held)

    check(tables["packing"], list(text["decontamination"].items()))
    assert {r.doc_id for r in tables["packing"]} == set(text["decontamination"])


def test_language_stage_rejects_unlearned_languages_only(spark):
    """Italian and Dutch go; learned languages stay, upper case, numbers and
    keys among their words too."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select(*cp.COLUMNS)
    other = {-1: "La nebbia agli irti colli piovigginando sale e sotto il maestrale urla e biancheggia il mare",
             -2: "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura. " * 8,
             -3: "De hond liep gisteren door het park en vond daar een grote tak die hij mee naar huis wilde nemen",
             -4: "Het is vandaag mooi weer en daarom gaan wij met de kinderen naar het strand om te zwemmen. " * 8}
    some = {r.doc_id: r.text for r in docs.filter("lang = 'de'").orderBy("doc_id").limit(3).collect()}
    own = {-10 - k: f"{t[:40]} token = \"dfd1944d2e84f15e89902e34b677eb5a\" {t[40:90]}" for k, t in enumerate(some.values())}
    own |= {-20 - k: t.upper() for k, t in enumerate(some.values())}
    planted = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in (other | own).items()],
                                    "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in cp.language(spark, docs.unionByName(planted), SF01).collect()}
    assert not kept & set(other) and set(own) <= kept


def test_run_equals_the_stages_and_takes_odd_documents(spark, tmp_path):
    sf = write_documents(spark, tmp_path)
    write(spark, tmp_path, "benchmark", [(1, None)], "item_id long, text string")
    rows = cp.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == {None, 4, 6, 8, 9, 10, 11}


def test_empty_table(spark, tmp_path):
    sf = write_documents(spark, tmp_path, {})
    write(spark, tmp_path, "benchmark", [], "item_id long, text string")
    assert cp.run(spark, sf).count() == 0
