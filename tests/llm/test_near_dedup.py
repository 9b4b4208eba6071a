"""Near-duplicate groups against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from llm_tables import prose, words, write_documents
from tillpoint.llm import near_dedup
from tillpoint.llm.components import components


def brute(texts, width, percent=80):
    """Set sizes and components by comparing all pairs that share a shingle."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k: k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    seen = set()
    for own in holders.values():
        for a in own:
            for b in own:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        x, y = sorted((find(a), find(b)))
                        parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def got(rows):
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


@pytest.mark.parametrize("width", [2, 5])
def test_given_documents(spark, width):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got(near_dedup.near_groups(docs, width).collect()) == brute(texts, width)


def edits(text, n, rnd):
    w = text.split(" ")
    for _ in range(n):
        w[rnd.randrange(len(w))] = "".join(rnd.choice("abcdefgh") for _ in range(6))
    return " ".join(w)


def test_large_group_of_near_copies(spark):
    """Copies of one text with 0 to 16 words replaced: long lists, links on both
    sides of the threshold, and copies of copies."""
    rnd = random.Random(3)
    base = " ".join(words(1, 200))
    texts = {k: edits(base, rnd.randrange(17), rnd) for k in range(150)}
    texts |= {200 + k: edits(texts[rnd.randrange(150)], 2 + k % 4, rnd) for k in range(40)}
    texts |= {300 + k: " ".join(words(1, 2) + words(400 + k, 60)) for k in range(60)}  # one frequent word pair
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert got(near_dedup.near_groups(docs, 2).collect()) == brute(texts, 2)


def test_long_near_copies_in_long_lists(spark):
    """Texts of thousands of words: copies of one, and a copy of each copy that
    is near enough to that copy alone.  Many such pairs share long lists only."""
    rnd = random.Random(11)
    base = " ".join(words(21, 2000))
    texts = {k: edits(base, 20, rnd) for k in range(60)}
    texts |= {100 + k: edits(texts[k], 100, rnd) for k in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = brute(texts, 2)
    assert {c for _, c in expected.values()} == {0}
    assert got(near_dedup.near_groups(docs, 2).collect()) == expected


@pytest.mark.parametrize("wide", [None, 40])
def test_last_join_misses_no_link(spark, wide):
    """The join on wide sketches against all pairs, sizes on both sides of the
    bound; with 40 values about half of the sets are longer than the sketch, and
    every link whose sketches hold 65 % in common must be there."""
    rnd = random.Random(12)
    pool = rnd.sample(range(10 ** 6), 119)
    own = {k: set(rnd.sample(pool, rnd.randint(1, 60))) for k in range(60)}
    for k in range(200):
        some = sorted(own[rnd.randrange(len(own))])
        own[len(own)] = set(rnd.sample(some, max(1, len(some) - rnd.randint(0, 6)))) | set(rnd.sample(pool, rnd.randint(0, 4)))
    most = wide or near_dedup.WIDE
    members = spark.createDataFrame([(i, len(s), i % 7, sorted(s)[:most]) for i, s in own.items()],
                                    "id long, n long, component long, sketch array<long>")
    pairs = {(r.a, r.b) for r in near_dedup._prefix_join(members, 80, wide).collect()}

    def admitted(a, b):
        x, y = (set(sorted(own[k])[:most]) for k in (a, b))
        both = max(len(own[a]), len(own[b])) <= most
        return both or len(x & y) >= 0.65 * max(len(x), len(y))

    links = {(a, b) for a in own for b in own if a > b and a % 7 != b % 7 and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b])}
    wanted = {p for p in links if admitted(*p)}
    assert links and wanted <= pairs and all(a % 7 != b % 7 for a, b in pairs)
    assert len(wanted) >= (1 if wide is None else 0.9) * len(links)


def test_short_texts_and_exact_threshold(spark):
    five = words(5, 6)
    texts = {1: " ".join(five[:5]), 2: " ".join(five), 3: " ".join(five[1:]), 4: "a", 5: "A", 6: "b", 7: "a b", 8: "A  B\n", 9: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = got(near_dedup.near_groups(docs, 2).collect())
    assert rows == brute(texts, 2) and rows[2][1] == 1 and rows[5][1] == 4 and rows[8][1] == 7


def test_odd_documents(spark, tmp_path):
    rows = near_dedup.op3_near_dedup(spark, write_documents(spark, tmp_path)).collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert len(rows) == 14 and len(by_id[8]) == 2
    assert by_id[7][0].component_id == 6 and not by_id[7][0].kept
    assert all(by_id[k][0].n_shingles == 0 and by_id[k][0].kept for k in (1, 2, 3))
    assert all(r.component_id is None and r.kept for r in by_id[None])


def test_empty_table(spark, tmp_path):
    assert near_dedup.op3_near_dedup(spark, write_documents(spark, tmp_path, {})).count() == 0


def test_components_of_paths_stars_and_rings(spark):
    rnd = random.Random(1)
    ids = list(range(400))
    rnd.shuffle(ids)
    path, star, ring = ids[:200], ids[200:300], ids[300:]
    edges = list(zip(path, path[1:])) + [(star[0], x) for x in star] + list(zip(ring, ring[1:] + ring[:1]))
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.component for r in components(df).collect()}
    assert found == {i: min(g) for g in (path, star, ring) for i in g}


def test_a_long_text_is_one_row(spark):
    docs = spark.createDataFrame([(1, prose(1, 200_000)), (2, prose(1, 200_000).upper())], "doc_id long, text string")
    assert {r.component_id for r in near_dedup.near_groups(docs, 2).collect()} == {1}


def test_last_join_leaves_pairs_to_their_rarest_common_values(spark, monkeypatch):
    """Edited copies of sets, some of them longer than a wide sketch: the same
    pairs as the join that meets a pair at each of its common values."""
    rnd, rows = random.Random(3), []
    for g in range(25):
        base = [rnd.getrandbits(62) for _ in range(rnd.choice([3, 10, 40, 204, 240, 400]))]
        for _ in range(rnd.randint(2, 10)):
            rate = rnd.choice([0, 0.02, 0.1, 0.2])
            own = {v if rnd.random() >= rate else rnd.getrandbits(62) for v in base} | set(rnd.sample([1, 2, 3], rnd.randint(0, 3)))
            rows.append((len(rows), len(own), len(rows) if rnd.random() < 0.8 else 10_000 + g, sorted(own)[:near_dedup.WIDE]))
    members = spark.createDataFrame(rows, "id long, n long, component long, sketch array<long>")
    got = set(near_dedup._prefix_join(members, 80).collect())
    monkeypatch.setattr(F, "arrays_overlap", lambda a, b: F.lit(False))
    assert len(got) > 50 and got == set(near_dedup._prefix_join(members, 80).collect())


def test_last_join_leaves_out_values_of_one_component(spark, monkeypatch):
    """Near copies that are linked already, with a few values in common with
    other groups: none of their rows reaches the join of the values; a link
    between components does."""
    rows = []
    for g in range(20):
        base = [1000 * (g + 1) + k for k in range(50)] + [1, 2, 3]
        rows += [(100 * g + k, 54, g, sorted(base + [10 ** 6 + 100 * g + k])) for k in range(8)]
    rows += [(9000 + k, 54, 900 + k, sorted([10 ** 7 + v for v in range(53)] + [10 ** 8 + k])) for k in range(2)]
    members = spark.createDataFrame(rows, "id long, n long, component long, sketch array<long>")
    kept, cut = [], near_dedup.cut

    def seen(df):
        out = cut(df)
        if "rest" in df.columns:
            kept.append({r.id for r in out.collect()})
        return out

    monkeypatch.setattr(near_dedup, "cut", seen)
    assert {(r.a, r.b) for r in near_dedup._prefix_join(members, 80).collect()} == {(9001, 9000)}
    assert kept == [{9000, 9001}]


def test_similar_sets_share_a_run(spark):
    """Pairs of whole sets on or above the bound have a key of the second lists
    in common, the smallest ones too."""
    rnd, sets = random.Random(5), []
    for n in list(range(4, 13)) * 30 + [20, 40, 60] * 30:
        union = sorted(rnd.sample(range(10 ** 9), n))
        odd = rnd.sample(union, n // 5)
        left = {v for v in odd if rnd.random() < 0.5}
        sets += [[v for v in union if v not in left], [v for v in union if v not in set(odd) - left]]
    rows = [(i, len(s), s) for i, s in enumerate(sets)]
    classes = spark.createDataFrame(rows, "id long, n long, sketch array<long>")
    small = classes.filter(classes.n <= near_dedup.SMALL)
    keys = near_dedup._run_keys(classes, 3, near_dedup.K).unionByName(near_dedup._run_keys(small, 2, near_dedup.K))
    own = {}
    for r in keys.collect():
        own.setdefault(r.id, set()).add(r.key)
    assert all(own[i] & own[i + 1] for i in range(0, len(sets), 2))


def test_texts_with_a_pair_in_common_stay_out_of_the_last_join(spark, monkeypatch):
    """Texts that have two neighbouring values in common, and no more, share a
    long list; none of them reaches the last join."""
    texts = {k: " ".join(["of", "the", "same"] + words(700 + k, 8)) for k in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    joined, crossing = [], near_dedup.Search.crossing
    monkeypatch.setattr(near_dedup.Search, "crossing", lambda self, members: joined.append(members.count()) or crossing(self, members))
    assert got(near_dedup.near_groups(docs, 2).collect()) == brute(texts, 2)
    assert joined == []


def test_members_with_own_values_move_no_rows(spark):
    """Of texts that have 70 of 100 values in common with others, no value
    remains but those; a text without any keeps none."""
    from tillpoint.llm.common import cut
    rnd = random.Random(8)
    base = [rnd.getrandbits(62) for _ in range(70)]
    rows = [(i, 100, base + [rnd.getrandbits(62) for _ in range(30)]) for i in range(20)] + [(99, 2, [rnd.getrandbits(62), rnd.getrandbits(62)])]
    members = spark.createDataFrame(rows, "id long, n long, sketch array<long>")
    values = cut(spark.createDataFrame([(v,) for v in base], "value long"))
    left = {r.id: r.sketch for r in near_dedup._among(members, values).collect()}
    assert all(set(base) <= set(left[i]) and len(left[i]) < 73 for i in range(20)) and left[99] == []


def test_small_rounds_take_few_tasks(spark, monkeypatch):
    """What a round leaves is read in as many tasks as its rows are worth, not
    in one for each partition of the shuffle that it came from; many rows keep
    their parts."""
    from tillpoint.llm import common
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        edges = spark.createDataFrame([(k, k // 2) for k in range(1, 60)], "a long, b long")
        nodes = components(edges)
        assert nodes.rdd.getNumPartitions() == 1
        assert {tuple(r) for r in nodes.collect()} == {(k, 0) for k in range(60)}
        rows = spark.range(1000).groupBy((F.col("id") * 7).alias("k")).count()
        few, many = common.packed(rows, 300), common.packed(rows, 1)
        assert (few.count, few.rows.rdd.getNumPartitions(), many.rows.rdd.getNumPartitions()) == (1000, 4, 8)
        # The same with several tasks a round.
        real = common.packed
        monkeypatch.setattr("tillpoint.llm.components.packed", lambda df: real(df, 20))
        several = components(edges.unionByName(spark.createDataFrame([(k + 1, k) for k in range(100, 150)], "a long, b long")))
        assert {tuple(r) for r in several.collect()} == {(k, 0) for k in range(60)} | {(k, 100) for k in range(100, 151)}
    finally:
        spark.conf.set(key, before)
