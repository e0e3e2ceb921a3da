import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cadenza.session import build_session, ensure_checkpoint_dir

    scratch = tempfile.mkdtemp(prefix="cadenza-test-")
    s = build_session(master="local[4]", shuffle_partitions=4, app="cadenza-tests",
                      extra={"spark.local.dir": os.path.join(scratch, "local"),
                             "spark.driver.memory": "4g"})
    ensure_checkpoint_dir(s)   # keeps a configured spark.checkpoint.dir; sets a scratch one only if unset
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fx(spark):
    from tests.fixtures import frames

    return frames(spark)
