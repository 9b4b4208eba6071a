import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
# Folder with published result CSVs for the golden tests (opt-in).
GOLDEN_DIR = os.environ.get("TILLPOINT_GOLDEN_DIR")


@pytest.fixture(scope="session")
def spark():
    from tillpoint.session import ensure_checkpoint_dir, get_session

    s = get_session("local[4]", shuffle_partitions=8, app_name="tillpoint-tests")
    ensure_checkpoint_dir(s)  # configured folder if set, else a scratch folder (local mode)
    yield s
    s.stop()


@pytest.fixture(scope="module")
def small_trees():
    """Few trees: for tests of plans, and of rows that no tree takes part in."""
    from tillpoint.operators import ml

    kept = dict(ml.RF_PARAMS), dict(ml.GBT_PARAMS)
    ml.RF_PARAMS.update(numTrees=3)
    ml.GBT_PARAMS.update(maxIter=2)
    yield
    ml.RF_PARAMS.update(kept[0])
    ml.GBT_PARAMS.update(kept[1])


def reference_csv(name: str) -> str:
    return os.path.join(GOLDEN_DIR, name)
