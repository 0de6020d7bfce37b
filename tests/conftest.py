import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cohortlens.session import build_session
    scratch = tempfile.mkdtemp(prefix="cohortlens-test-")
    s = build_session("local[4]", app="cohortlens-tests", shuffle_partitions=4,
                      extra={"spark.local.dir": scratch, "spark.driver.memory": "4g"})
    yield s
    s.stop()
