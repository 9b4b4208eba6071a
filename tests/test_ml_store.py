"""The prediction store: fits are resumed, and what is made of the stored
forecasts equals DuckDB's SQL over them."""

import os
import shutil

import pytest

from conftest import SF001, SF01
from oracle_compare import _rows, duck
from tillpoint.operators import ml
from tillpoint.plans import ml as pml
from tillpoint.plans import oracle_ml, registry
from tillpoint.plans.context import Ctx
from tillpoint.sources import staging


def fresh_application(monkeypatch):
    """What a restarted driver knows: nothing."""
    for name in ("_STAGED", "_SHARED", "_FINGERPRINTS"):
        monkeypatch.setattr(staging, name, {})


@pytest.fixture
def own_input(tmp_path):
    """An input that no other test has stored fits for."""
    for t in staging.TABLES:
        copy = shutil.copytree if os.path.isdir(f"{SF001}/{t}.parquet") else shutil.copy
        copy(f"{SF001}/{t}.parquet", tmp_path / f"{t}.parquet")
    return str(tmp_path)


def test_a_killed_backtest_is_resumed(spark, own_input, small_trees, monkeypatch):
    real, done = ml.ml_forecasts, []

    def dies_after_six(panel, origin, method, *args, **kw):
        if len(done) == 6:
            raise KeyboardInterrupt("killed")
        done.append((origin, method))
        return real(panel, origin, method, *args, **kw)

    monkeypatch.setattr(pml, "fits_in_flight", lambda *_: 1)
    monkeypatch.setattr(ml, "ml_forecasts", dies_after_six)
    with pytest.raises(KeyboardInterrupt):
        pml.pool_forecasts(Ctx(spark, own_input))
    first = list(done)
    assert len(first) == 6

    fresh_application(monkeypatch)
    done.clear()
    monkeypatch.setattr(ml, "ml_forecasts", lambda p, o, m, *a, **k: done.append((o, m)) or real(p, o, m, *a, **k))
    c = Ctx(spark, own_input)
    rows = pml.pool_forecasts(c)
    assert set(first) | set(done) == set(pml.tree_tasks(c)) and len(done) == 6 and not set(first) & set(done)
    assert {(r.origin, r.method) for r in rows.select("origin", "method").distinct().collect()} == set(pml.tree_tasks(c))
    # Other parameters are another model: its fits are not taken from the store.
    fresh_application(monkeypatch)
    done.clear()
    monkeypatch.setitem(ml.RF_PARAMS, "numTrees", 4)
    pml.pool_forecasts(Ctx(spark, own_input))
    assert sorted(m for _, m in done) == ["random_forest"] * 6


def test_fit_tasks_follow_the_panel():
    assert [ml.fit_partitions(n) for n in (0, 10_000, 25_000, 10 ** 6)] == [2, 2, 4, 125]


@pytest.fixture(scope="module")
def stored(spark, small_trees):
    """DuckDB over the input and the prediction store of the same run."""
    c = Ctx(spark, SF01)
    pml.pool_forecasts(c)
    con = duck(SF01)
    folders = [f"{staging.staged_folder(spark).removeprefix('file:')}/trees-{m}-{ml.model_key(m)}-{o:%Y%m%d}-"
               f"{staging.fingerprint(spark, SF01)}/*.parquet" for o, m in pml.tree_tasks(c)]
    con.execute(f"CREATE VIEW stored AS SELECT * FROM read_parquet({folders!r})")
    assert con.sql("SELECT count(DISTINCT (origin, method)) FROM stored").fetchall() == [(12,)]
    return con


@pytest.mark.parametrize("key", oracle_ml.STORED_SQL)
def test_comparison_equals_sql_over_the_store(spark, stored, key):
    ours, theirs = registry.queries()[key](spark, SF01).toPandas(), stored.sql(oracle_ml.STORED_SQL[key]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours) == len(theirs) > 0
    assert _rows(ours) == _rows(theirs)
