"""Hard negatives: scores against plain products, rows against a brute-force
version, also with ties, repeated rows, rounds and odd vectors."""

import math
import random

import numpy as np
import pytest
from conftest import SF01
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import write
from tillpoint.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, query long, score long, parts string, place int, round int"


def table(spark, folder, rows):
    return write(spark, folder, "embeddings", [(i, v, label, 1, 2, "x", 3, 4) for i, v, label in rows], SCHEMA)


def brute(rows):
    """Row by row; a null id comes last."""
    own = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        own.append((i, label, [math.floor(float(np.float32(x)) * 256) for x in v]))
    out = []
    last = lambda i: (i is None, i or 0)
    for a, (anchor, label, v) in enumerate(own):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), i, lab) for b, (i, lab, w) in enumerate(own) if b != a]
        scored.sort(key=lambda r: (-r[0], last(r[1])))
        for p, pid, _ in [r for r in scored if r[2] == label][:5]:
            fits = [r for r in scored if r[2] != label and 80 * p <= 100 * r[0] <= 100 * p][:5]
            out += [(anchor, pid, k + 1, r[1], p, r[0]) for k, r in enumerate(fits)]
    return sorted(out, key=repr)


def got(spark, folder):
    df = hn.op11_hard_negatives(spark, str(folder))
    assert df.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"),
                         ("positive_score", "bigint"), ("negative_score", "bigint")]
    return sorted(map(tuple, df.collect()), key=repr)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 5), st.integers(0, 6), st.integers(1, 3), st.integers(1, 40), st.randoms(use_true_random=False))
def test_scores(rows, anchors, groups, bits, rnd):
    dims = groups * 8
    draw = lambda n: np.array([[rnd.randint(-(1 << bits), (1 << bits) - 1) >> rnd.randint(0, bits) for _ in range(dims)]
                               for _ in range(n)], np.int64).reshape(n, dims)
    a, c = draw(anchors) >> max(0, bits - 20), draw(rows)
    assert (hn.scores(hn.bit_planes(c), hn.subset_sums(a)) == c @ a.T).all()


def clustered(seed, n, dims=16, ids=None, labels=4):
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(size=(6, dims))
    return [(int(ids[k]) if ids is not None else k, [float(x) for x in np.float32(centre[rnd.integers(6)] + rnd.normal(size=dims) * .4)],
             int(rnd.integers(labels))) for k in range(n)]


def test_given_vectors(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    found = got(spark, SF01)
    assert found == brute(rows) and found


@pytest.mark.parametrize("components", [1 << 20, 40])
def test_rounds_slices_blocks(spark, tmp_path, monkeypatch, components):
    monkeypatch.setattr(hn, "SLICE_ROWS", 16)
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 3)
    monkeypatch.setattr(hn.mine, "__defaults__", (*hn.mine.__defaults__[:-1], components))
    rows = clustered(1, 900, ids=np.random.default_rng(2).permutation(900) * 10)
    assert got(spark, table(spark, tmp_path, rows)) == brute(rows)


def test_ties_and_repeated_rows(spark, tmp_path):
    """One vector held by a third of the rows, and anchors that stand twice."""
    rows = clustered(3, 300, dims=8, labels=2)
    hot = rows[0][1]
    rows = [(i, hot if i % 3 == 0 else v, label) for i, v, label in rows]
    rows += [rows[100], rows[200], rows[200], rows[201]]
    random.Random(1).shuffle(rows)
    assert got(spark, table(spark, tmp_path, rows)) == brute(rows)


def test_odd_vectors(spark, tmp_path):
    rows = clustered(5, 260, dims=5)
    rows += [(300, None, 1), (400, [1.0, None, 2.0], 1), (500, [1.0, math.nan], 1), (600, [math.inf] * 5, 1),
             (700, [1.0] * 5, None), (None, [1.5] * 5, 0), (None, [0.5] * 5, 1), (800, [], 1), (900, [2.0], 2),
             (1000, [0.0] * 5, 3), (-100, [-3.0, 2.0, 1.0, 0.25, 1e-9], 0), (1100, [3e4] * 5, 1), (1101, [-3e4, 3e4, 1.0, 1.0, 7.0], 2)]
    found = got(spark, table(spark, tmp_path, rows))
    assert found == brute(rows)
    assert {r[0] for r in found} >= {0, 1000, -100}


def test_no_anchors_and_empty(spark, tmp_path):
    assert got(spark, table(spark, tmp_path / "a", [(1, [1.0], 1), (2, [1.0], 2)])) == []
    assert got(spark, table(spark, tmp_path / "b", [])) == []
    assert got(spark, table(spark, tmp_path / "c", [(100, [1.0], 1), (2, [1.0], 2)])) == []
