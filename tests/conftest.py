import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from shipyard.session import get_session

    s = get_session("local[*]", shuffle_partitions=8, app_name="shipyard-tests")
    if not s.conf.get("spark.checkpoint.dir", None):
        ck = str(tmp_path_factory.mktemp("ckpt"))
        s.conf.set("spark.checkpoint.dir", ck)
        s.sparkContext.setCheckpointDir(ck)
    yield s


def rows(df, *cols):
    """Sorted list of tuples of ``cols`` (all columns when none given)."""
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda t: tuple(map(str, t)))
