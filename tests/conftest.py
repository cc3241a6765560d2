import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from milepost.session import build_session
    s = build_session("local[4]", app="milepost-tests", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session", autouse=True)
def small_training():
    """Tests of the training machinery use fewer rounds and trees than the queries do."""
    from milepost.constants import GBT_PARAMS, RF_PARAMS
    from milepost.operators import training
    full = training.REFERENCE
    training.REFERENCE = training.Preset(gbt=dict(GBT_PARAMS, maxIter=4), rf=dict(RF_PARAMS, numTrees=6))
    yield training.REFERENCE
    training.REFERENCE = full
