"""License rules: against a version without prefilter and sweep, and on
license texts and notices as people write them."""

import re
from re import _parser

import pytest
from conftest import SF01
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import odd_documents, prose, write_documents
from tillpoint.llm import license_scan as ls
from tillpoint.llm.license_rules import KINDS, PHRASES, RULES

ORDER = list(KINDS)


def taken(text) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contains(a, b) -> bool:
    return a[0] <= b[0] and b[1] <= a[1]


def higher(a, b) -> bool:
    """Whether detection a outranks b: kind, then length, then the earlier rule."""
    key = [(ORDER.index(RULES[d[2]][0]), d[0] - d[1], d[2]) for d in (a, b)]
    return key[0] < key[1]


def every_detection(line: str) -> list[tuple[int, int, int]]:
    found = [(m.start(), m.end(), k) for k, rule in enumerate(RULES) for m in re.finditer(ls.expression(rule[3]), line)]
    return sorted(d for d in found if not any(contains(o, d) and higher(o, d) for o in found))


def answer(text) -> tuple:
    w = taken(text)
    line = f" {' '.join(w)} "
    base = sorted((i, label) for label, phrase in PHRASES.items() for own in [phrase.split()]
                  for i in range(len(w)) if w[i: i + len(own)] == own)
    found = every_detection(line)
    labels = {label for _, label in base}
    strength = [KINDS[RULES[d[2]][0]] for d in found] + [KINDS["notice"]] * bool(base)
    return (len(w), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)),
            ",".join(sorted(labels | {RULES[d[2]][1] for d in found})), max(strength, default=0.0))


def got(spark, folder) -> list[tuple]:
    return sorted(((r[0], *tuple(r)[1:]) for r in ls.op12_licenses(spark, str(folder)).collect()), key=repr)


def labels(text: str) -> set[str]:
    line = f" {' '.join(taken(text))} "
    return {RULES[rule][1] for _, _, rule in ls.detect(line)[1]}


# What people write, and what must be found there and nothing else.
NOTICES = {
    "// SPDX-License-Identifier: GPL-2.0-or-later": {"gpl-2"},
    "SPDX-License-Identifier: MIT-0": {"mit-0"},
    "Licensed under the Apache License, Version 2.0 (the \"License\")": {"apache-2"},
    "This code is released under the MIT licence.": {"mit"},
    "Distributed under the Boost Software License, Version 1.0.": {"bsl-1"},
    "the terms of the GNU Lesser General Public License v2.1": {"lgpl-2.1"},
    "licensed under the GPLv3": {"gpl-3"},
    "See https://creativecommons.org/licenses/by-nc-sa/4.0/ for details": {"cc-by-nc-sa"},
    "under CC BY-NC-ND 4.0": {"cc-by-nc-nd"},
    "a Creative Commons Attribution-ShareAlike license": {"cc-by-sa"},
    "Mozilla Public License, v. 2.0": {"mpl-2"},
    "under the Eclipse Public License 2.0": {"epl-2"},
    "This work is in the public domain": {"public-domain"},
    "(c) 2020 Somebody. All rights reserved.": {"proprietary"},
    "use of this source code is governed by a BSD-style license": {"bsd"},
    "The mitigation was licensed to commit to a limit": set(),
    "Sie kam mit Apache und Boost in die Stadt": set(),
}


@pytest.mark.parametrize("text", NOTICES)
def test_notices(text):
    assert labels(text) == NOTICES[text]


def test_rule_table():
    assert len(RULES) >= 250 and len({(r[1], r[3]) for r in RULES}) == len(RULES)
    for kind, label, keyword, pattern in RULES:
        assert kind in KINDS and "," not in label and keyword == keyword.lower().strip()
        assert _parser.parse(ls.expression(pattern)).getwidth()[1] <= ls.REACH, pattern


@pytest.mark.parametrize("rule", range(len(RULES)))
@settings(max_examples=4, deadline=None, database=None)
@given(data=st.data())
def test_rule_holds_its_keyword(rule, data):
    """Else the prefilter would lose matches."""
    _, _, keyword, pattern = RULES[rule]
    body = ls.expression(pattern).removeprefix("(?<= )").removesuffix("(?= )")
    text = data.draw(st.from_regex(re.compile(body, re.ASCII), fullmatch=True, alphabet=st.characters(codec="ascii", min_codepoint=32)))
    assert keyword in text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["license", "under", "the", "mit", "gnu", "general public license", "version 2", "v3", "apache",
                                 "licensed under", "lesser", "cc by nc", "sa 4 0", "creative commons attribution", "x y z",
                                 "spdx license identifier", "all rights reserved", "bsd", "3 clause"]), max_size=40))
def test_prefilter_and_sweep(parts):
    line = f" {' '.join(parts)} "
    assert ls.detect(line)[1] == every_detection(line)


def test_given_documents(spark):
    rows = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()
    found = got(spark, SF01)
    assert found == sorted(((r.doc_id, *answer(r.text)) for r in rows), key=repr)
    assert {label for r in found for label in r[5].split(",")} >= set(PHRASES)


def test_planted_notices(spark, tmp_path):
    texts = {i: f"{prose(i, 50)}\n{notice}\n{prose(99 + i, 400)} {notice.upper()}" for i, notice in enumerate(NOTICES)}
    texts |= {100: "under the MIT License " * 3000, 101: "under the mit license under the mit-license", 102: "cc by nc by nc cc by nc"}
    found = got(spark, write_documents(spark, tmp_path, texts))
    assert [r for r in found if r[0] != 100] == sorted(((i, *answer(t)) for i, t in texts.items() if i != 100), key=repr)
    long, = [r for r in found if r[0] == 100]
    assert long[1:6] == (12000, 3000, 0, 11996, "mit")


def test_odd_tables(spark, tmp_path):
    found = got(spark, write_documents(spark, tmp_path))
    assert found == sorted(((r[0], *answer(r[1])) for r in odd_documents()), key=repr)


def test_empty_table(spark, tmp_path):
    assert got(spark, write_documents(spark, tmp_path, {})) == []
